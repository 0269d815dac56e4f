"""The pipeline's stages, and the queries against their SQL, on the smallest tables."""

import pytest

from tools.oracle_check import rows_of, type_mismatches

from ..conftest import SF_SMALL


def names():
    from keelson.llm.queries import ORACLES
    return sorted(ORACLES)


@pytest.mark.parametrize("name", names())
def test_query_matches_sql(spark, duck, name):
    from keelson.llm.queries import ORACLES, QUERIES
    df = QUERIES[name](spark, SF_SMALL)
    res = duck.execute(ORACLES[name])
    cols = [c[0] for c in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())
    assert type_mismatches(df, duck.sql(ORACLES[name])) == []


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    from keelson.llm.decontam import decontaminate
    from keelson.llm.mixing import queue
    from keelson.llm.near_dedup import near_duplicates
    from keelson.llm.quality_rules import apply_rules
    from keelson.llm.text import stored
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SF_SMALL}/benchmark.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    keep = [lambda d: apply_rules(d).where("kept"), lambda d: near_duplicates(d, 80, 5).where("kept"),
            lambda d: decontaminate(d, bench).where("not contaminated")]
    for (name, stage), wanted in zip(P.STAGES, keep):
        out = stored(stage(spark, docs, SF_SMALL), "test-stage")
        assert out.columns == docs.columns and ids(out) == ids(wanted(docs)), name
        docs = out
    out = stored(P.mix(spark, docs, SF_SMALL), "test-stage")
    assert ids(out) == sorted(r.doc_id for r in queue(docs).collect() for _ in range(r.copies))
    got = P.tokens(spark, out, SF_SMALL)
    assert ids(got) == ids(out) and got.selectExpr("min(start)").first()[0] == 0
    empty = spark.read.parquet(f"{SF_SMALL}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0, name


def test_near_dedup_stage_takes_five_words_and_80_percent(spark):
    import random

    import corpus_pipeline as P

    from .conftest import make
    r = random.Random(3)
    word = lambda: f"w{r.randrange(10**9)}"
    rows, linked = [], []
    for i, extra in enumerate((180, 210, 240)):             # one block added: Jaccard 0.847 to 0.806
        base = [word() for _ in range(1000)]
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(base + [word() for _ in range(extra)]))]
        linked.append(2 * i + 1)
    for i, edits in enumerate((24, 27), 50):                # scattered edits: 0.785 to 0.761 on five words
        base = [word() for _ in range(1000)]
        new = base[:]
        for j in range(edits):
            new[36 * j + 10] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(new))]
    out = P.near_dedup(spark, make(spark, rows), "")
    assert sorted(x.doc_id for x in out.collect()) == sorted(d for d, _ in rows if d not in linked)


def test_bands_miss_few_pairs():
    from keelson.llm.near_dedup import SKIP, banding, least_matches
    assert banding() == (25, 5)
    for percent in (50, 80, 85, 95):
        bands, rows = banding(percent)
        assert (1 - (percent / 100) ** rows) ** bands <= SKIP and least_matches(percent)
