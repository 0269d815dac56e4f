"""Importance resampling, sharding and hard negatives against brute force in plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from .conftest import SCHEMA, make, prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower_az(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def bag(rows):
    return Counter(map(tuple, rows))


@pytest.fixture(scope="module")
def docs(spark, corpus):
    return make(spark, corpus)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- 11 --------------------------------------------------------------------------------
def brute_resample(rows, target, buckets=10_000, least=20, percent=25):
    def features(t):
        w = TERM.findall(lower_az(t))
        return len(w), [zlib.crc32(x.encode()) % buckets for x in w + [" ".join(p) for p in zip(w, w[1:])]]

    docs_ = [(d, *features(t)) for d, t, *_ in rows]
    s, t = Counter(), Counter()
    for _, _, f in docs_:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for d, n, f in docs_:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append((d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    stands = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    drawn = stands[:percent * len(stands) // 100]
    ranks = [(d, n, w, s_, k + 1) for k, (d, _, n, w, s_) in enumerate(drawn)]
    rest = Counter((d, n, w, s_) for d, _, n, w, s_ in out) - Counter(r[:4] for r in ranks)
    return bag(ranks) + bag([(*k, None) for k in rest.elements()])


def test_resampling(spark, docs, empty, corpus):
    from keelson.llm.importance import drawn_documents, resample
    target = [prose(50, 80), None, "", "One word_two émile 日本語日本語"]
    other = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "n_words long, text string")
    assert bag(resample(docs, other).collect()) == brute_resample(corpus, target)
    some = resample(docs, other, buckets=70_000, least_words=1, percent=60)
    assert bag(some.collect()) == brute_resample(corpus, target, 70_000, 1, 60)
    assert bag(resample(docs, empty).collect()) == brute_resample(corpus, [])
    assert resample(empty, other).count() == 0
    kept = drawn_documents(docs, other, percent=60)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()


def test_resampling_prefers_the_target(spark):
    from keelson.llm.importance import resample
    r = random.Random(5)
    alike = [(i, " ".join(r.choice(["red", "green", "blue"]) for _ in range(30))) for i in range(100)]
    odd = [(i, " ".join(r.choice(["north", "south", "east"]) for _ in range(30))) for i in range(100, 200)]
    target = spark.createDataFrame([("red green blue " * 200,)], "text string")
    drawn = [x.doc_id for x in resample(make(spark, alike + odd), target).where("rank is not null").collect()]
    assert len(drawn) == 50 and sum(d < 100 for d in drawn) >= 45


def test_crc_matrices():
    from keelson.llm.importance import crc32_all
    r = random.Random(1)
    values = [r.randbytes(r.choice([0, 1, 5, 13, 63, 64, 65, 127, 128, 129, 1000, 70000])) for _ in range(300)]
    column = pa.array(values, pa.binary())
    wanted = np.array([zlib.crc32(v) for v in values], np.uint32)
    assert (crc32_all(column) == wanted).all() and (crc32_all(column.slice(7, 50)) == wanted[7:57]).all()
    assert len(crc32_all(column.slice(0, 0))) == 0


def test_in_order_numbers_and_totals(spark):
    from keelson.operators.ordering import in_order
    r = random.Random(2)
    rows = [(r.choice([None, 1, 1, 1, 2, 3]), i, r.choice([None, 1, 2])) for i in range(500)]
    df = spark.createDataFrame(rows, "k long, i long, v long")
    out = in_order(df, [F.asc_nulls_last("k"), "i"], "place", {"before": F.col("v")}).collect()
    total = 0
    wanted = []
    for n, (k, i, v) in enumerate(sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1])), 1):
        wanted.append((k, i, v, n, total))
        total += v or 0
    assert bag((x.k, x.i, x.v, x.place, x.before) for x in out) == bag(wanted)
    tied = in_order(df, [F.lit(1)], "place")
    assert sorted(x.place for x in tied.select("place").collect()) == list(range(1, 501))
    assert in_order(df.limit(0), ["k"], "place", {"before": F.col("v")}).count() == 0


# ---- 12 --------------------------------------------------------------------------------
def run_shard(spark, docs, **options):
    import uuid

    from keelson.llm.sharding import shard
    from keelson.session import scratch_path
    path = scratch_path(spark, f"slot-map-{uuid.uuid4().hex}")
    return shard(docs, path, **options), path


def check_shards(rows, out, shards=24, slots=4096):
    """Contract of the result, and the slot map by a plain evaluation."""
    facts = [(d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t, *_ in rows]
    assert bag((x.doc_id, x.size, x.text_crc32) for x in out) == bag(facts)
    assert {x.law for x in out} <= {"bytes"} and {x.grown_shard for x in out} <= {None}
    by = {}
    for x in out:
        by.setdefault(x.shard, []).append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    load = [0] * slots
    for (d, size, crc), n in Counter(facts).items():
        for piece in range((n - 1) // 64 + 1):
            key = f"{'' if d is None else d}:{crc}:{size}:{piece}"
            load[int(hashlib.md5(key.encode()).hexdigest()[:8], 16) % slots] += size * min(64, n - 64 * piece)
    where, freed, held = {}, [], [0] * shards
    for s in range(shards):
        run = 0
        for slot in sorted(range(s, slots, shards), key=lambda k: (-load[k], k)):
            run += load[slot]
            if run * shards <= sum(load):
                where[slot], held[s] = s, run
            else:
                freed.append(slot)
    for slot in sorted(freed, key=lambda k: (-load[k], k)):
        where[slot] = held.index(min(held))
        held[where[slot]] += load[slot]
    assert all(x.shard == where[x.vslot] for x in out)
    return held


def test_sharding(spark, docs, empty, corpus):
    out, path = run_shard(spark, docs)
    check_shards(corpus, out.collect())
    out, _ = run_shard(spark, docs, shards=3, slots=16)
    check_shards(corpus, out.collect(), 3, 16)
    out, _ = run_shard(spark, empty)
    assert out.count() == 0
    from keelson.llm.sharding import read_map
    assert read_map(spark, path).first().version == 2 and read_map(spark, path, 1).where("shard <> vslot % 24").count() == 0


def test_equal_rows_spread_over_shards(spark):
    from keelson.llm.sharding import write_shards
    from keelson.session import scratch_path
    rows = [(7, "the same text again")] * 3000 + [(100 + i, prose(i, 5 + i % 30)) for i in range(1500)]
    docs = make(spark, rows)
    out, path = run_shard(spark, docs)
    held = check_shards(rows, out.collect())
    assert max(held) <= 1.1 * min(held)
    written = scratch_path(spark, "shards-" + path.rsplit("-", 1)[-1])
    write_shards(docs, path, written)
    back = spark.read.parquet(written)
    assert bag(back.select("row.*").select("doc_id", "text", "bucket").collect()) == bag(docs.select("doc_id", "text", "bucket").collect())
    assert back.select("shard").distinct().count() == 24


def test_map_grows_by_moving_few_slots(spark):
    from keelson.llm.sharding import even_map, rebalanced
    r = random.Random(4)
    totals = spark.createDataFrame([(i, r.randrange(1, 1000), 1) for i in range(500)], "vslot int, bytes long, rows long")
    now = rebalanced(even_map(spark, 4, 500), totals, 4)
    grown = {x.vslot: x.shard for x in rebalanced(now, totals, 5).collect()}
    before, size = {x.vslot: x.shard for x in now.collect()}, {x.vslot: x.bytes for x in totals.collect()}
    held = Counter()
    for slot, s in grown.items():
        held[s] += size[slot]
    assert set(grown.values()) == set(range(5)) and max(held.values()) - min(held.values()) <= 1000
    moved = sum(size[k] for k in grown if grown[k] != before[k])
    assert moved <= 0.25 * sum(size.values())                   # a fifth must move to the new shard
    shrunk = {x.shard for x in rebalanced(now, totals, 2).collect()}
    assert shrunk == {0, 1}


# ---- 13 --------------------------------------------------------------------------------
def brute_negatives(rows):
    """rows (vec_id, label, vector)."""
    sound = []
    for i, (v, label, vec) in enumerate(rows):
        if v is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        if any(not math.isfinite(float(x) * 256) for x in vec):
            continue
        sound.append((i, v, math.fmod(label + 1, 10) if v % 7 == 0 else label, [math.floor(256 * float(x)) for x in vec]))
    clip = lambda x: min(max(x, -(1 << 63)), (1 << 63) - 1)
    out = []
    for i, v, label, a in sound:
        if v % 50:
            continue
        scored = sorted((-clip(sum(x * y for x, y in zip(a, b))), w, j, lab) for j, w, lab, b in sound if j != i)
        for s, w, _, lab in [x for x in scored if x[3] == label][:5]:
            fits = [x for x in scored if x[3] != label and 50 * -s <= 100 * -x[0] <= 95 * -s][:3]
            out += [(v, w, k + 1, n[1], -s, -n[0]) for k, n in enumerate(fits)]
    return bag(out)


VECTORS = "vec_id long, label int, embedding array<float>, score long, uid string, shard int, wants int"


def clash(rows):
    return [(*r, 1, "u", 2, 3) if len(r) == 3 else r for r in [(v, label, vec) for v, label, vec in rows]]


def vectors(spark, rows):
    return spark.createDataFrame(clash(rows), VECTORS)


def test_hard_negatives(spark, monkeypatch):
    from keelson.llm import hard_negatives as H
    r = np.random.default_rng(3)
    rows = [(i, int(r.integers(0, 3)), [float(np.float32(x)) for x in r.normal(0.1, 0.4, 12)]) for i in range(400)]
    same = rows[17][2]
    rows += [(1000 + i, i % 2, same) for i in range(150)]                   # one vector very often
    rows += [(50, 1, rows[3][2]), (50, 1, rows[3][2]), (7, None, same), (8, 1, None), (None, 1, same), (9, 1, [float("nan")] * 12),
             (10, 1, [1.0, None]), (11, 2, [float("inf")]), (12, 2, []), (14, 0, [0.5, 0.25]), (2000, 1, [0.0] * 12)]
    wanted = brute_negatives(rows)
    assert wanted and bag(H.hard_negatives(vectors(spark, rows)).collect()) == wanted
    # many small shards, cells that are cut, and several copies of a shard
    monkeypatch.setattr(H, "SHARD_CELLS", 64 * 12)
    monkeypatch.setattr(H, "TASK_ANCHORS", 2)
    assert bag(H.hard_negatives(vectors(spark, rows)).collect()) == wanted
    assert H.hard_negatives(vectors(spark, rows).limit(0)).count() == 0
    assert H.hard_negatives(vectors(spark, [(0, 1, [1.0])])).count() == 0


def test_hard_negatives_beyond_exact_doubles(spark):
    from keelson.llm.hard_negatives import hard_negatives
    r = random.Random(8)
    rows = [(i, i % 3, [r.uniform(0, 1) * 10.0 ** r.choice([3, 5, 6]) for _ in range(5)]) for i in range(101)]
    rows += [(200, 1, [3e30, 1.0]), (250, 0, [2.9e30, 2.0]), (251, 1, [1e38])]
    rows = [(v, label, [float(np.float32(x)) for x in vec]) for v, label, vec in rows]
    assert bag(hard_negatives(vectors(spark, rows)).collect()) == brute_negatives(rows)


def test_walk_falls_and_visits_every_cell():
    from keelson.llm.hard_negatives import Index, Shard
    r = np.random.default_rng(0)
    index = Index(4, [r.normal(size=(5, 2)), r.normal(size=(6, 2))])
    cells = sorted((int(a), int(b)) for a, b in {(x % 5, x * 7 % 6) for x in range(20)})
    part = pa.RecordBatch.from_arrays([pa.array(range(len(cells))), pa.array(range(len(cells))), pa.array([0] * len(cells)),
                                       pa.array([c[0] for c in cells], pa.int32()), pa.array([c[1] for c in cells], pa.int32()),
                                       pa.array([[0.0] * 4] * len(cells), pa.list_(pa.float64()))],
                                      names=["uid", "vec_id", "label", "c1", "c2", "vec"])
    one, two = r.normal(size=5), r.normal(size=6)
    seen = list(Shard(index, [part]).walk(one, two))
    assert [b for b, _, _ in seen] == sorted((one[a] + two[b] for a, b in cells), reverse=True)
