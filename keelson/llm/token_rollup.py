"""Token counts kept up to date by deltas.

Totals by source, language and tokenizer version are additive, so a change set only
has to add its signed differences: an insert +1 document and +n tokens, a delete -1 and
-n, a revised count the difference between new and old.  ``commit`` reduces a batch of
changes to one row per group and writes it as the folder ``batch=<id>``; a batch that
is already there is left alone, so a retried batch counts once.  ``fold`` keeps a totals
table with the list of batches it holds; ``totals`` adds only the batches committed since.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encoding import CHUNK, tiktoken_encoder
from .text import chunks, pick

# tokenizer version -> rank file
VERSIONS = {"byte_bpe_50k": "/opt/tokenizers/byte_bpe_50k.tiktoken",
            "byte_bpe_multi_50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}
GROUP = ["source", "lang", "tokenizer_version"]
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long"


def count_tokens(docs: DataFrame, versions: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, source, lang, tokenizer_version, n_tokens): a row per input row and version; null texts count 0."""
    versions = versions or VERSIONS
    schema = "doc_id long, source string, lang string, " + ", ".join(f"n{i} long" for i in range(len(versions)))

    def run(batches):
        encoders = [tiktoken_encoder(p) for p in versions.values()]
        for b in batches:
            for first, last in chunks(b.column(3), CHUNK):
                some = b.slice(first, last - first)
                counts = [np.diff(e.encode(some.column(3))[1]) for e in encoders]
                yield pa.record_batch([some.column(i) for i in range(3)] + [pa.array(c) for c in counts],
                                      names=["doc_id", "source", "lang"] + [f"n{i}" for i in range(len(counts))])

    d = pick(docs, doc_id="long", source="string", lang="string", text="string")
    d = d.withColumn("text", F.coalesce(F.col("text").cast("binary"), F.lit(b""))).mapInArrow(run, schema)
    each = F.array(*[F.struct(F.lit(v).alias("tokenizer_version"), F.col(f"n{i}").alias("n_tokens"))
                     for i, v in enumerate(versions)])
    return d.select("doc_id", "source", "lang", F.inline(each))


def inserts(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(1).alias("n_docs"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    return counts.select(*GROUP, F.lit(-1).alias("n_docs"), (-F.coalesce("n_tokens", F.lit(0))).alias("n_tokens"))


def revisions(changes: DataFrame) -> DataFrame:
    """From (group columns, old_tokens, n_tokens): the documents stay, their counts change."""
    return changes.select(*GROUP, F.lit(0).alias("n_docs"),
                          (F.coalesce("n_tokens", F.lit(0)) - F.coalesce("old_tokens", F.lit(0))).alias("n_tokens"))


def is_committed(spark: SparkSession, path: str, batch_id: str) -> bool:
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}/_SUCCESS")
    return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)


def commit(deltas: DataFrame, path: str, batch_id: str) -> bool:
    """Add a batch of signed rows to the totals in ``path``; False if it was committed before.

    Partial sums run before the shuffle, so a hot source is a few rows per task.  Null
    sources, languages and versions are groups of their own; an empty batch commits
    nothing but its mark.  A batch that broke off is written again from the start.
    """
    if not batch_id.replace("-", "").replace("_", "").isalnum():
        raise ValueError(f"batch id {batch_id!r} is not a plain name")
    spark = deltas.sparkSession
    if is_committed(spark, path, batch_id):
        return False
    rows = deltas.groupBy(*GROUP).agg(F.sum("n_docs").cast("long").alias("n_docs"),
                                      F.sum("n_tokens").cast("long").alias("n_tokens"))
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return True


def committed(spark: SparkSession, path: str) -> list[str]:
    """Ids of the batches that are whole (their folder carries its mark)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()]
    return sorted(n[len("batch="):] for n in names if n.startswith("batch=") and is_committed(spark, path, n[len("batch="):]))


def folded(spark: SparkSession, path: str) -> tuple[list[str], str | None]:
    """The batches that the newest totals table holds already, and its folder."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return [], None
    whole = sorted(n for n in (f.getPath().getName() for f in fs.listStatus(root))
                   if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/totals/{n}/ids/_SUCCESS")))
    if not whole:
        return [], None
    newest = f"{path}/totals/{whole[-1]}"
    return [r.batch for r in spark.read.schema("batch string").parquet(f"{newest}/ids").collect()], f"{newest}/rows"


def totals(spark: SparkSession, path: str) -> DataFrame:
    """(source, lang, tokenizer_version, n_docs, n_tokens) over all committed batches; empty groups are gone.

    Reads the folded totals and the batches committed since.  Batches that broke off count
    nothing.
    """
    done, rows = folded(spark, path)
    parts = [spark.read.schema(DELTA).parquet(f"{path}/batch={b}") for b in committed(spark, path) if b not in set(done)]
    parts += [spark.read.schema(DELTA).parquet(rows)] if rows else []
    every = parts[0] if parts else spark.createDataFrame([], DELTA)
    for p in parts[1:]:
        every = every.union(p)
    t = every.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    return t.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))


def fold(spark: SparkSession, path: str) -> int:
    """Maintain the totals table: all committed batches go into its next version; returns how many it holds.

    Rows are written first, the list of batch ids last; a version without the list's mark is
    not read, so a fold that breaks off changes nothing and is done again.
    """
    done, _ = folded(spark, path)
    now = committed(spark, path)
    if set(now) == set(done):
        return len(now)
    new = f"{path}/totals/{len(now):012d}-{uuid.uuid4().hex}"
    totals(spark, path).write.parquet(f"{new}/rows")
    spark.createDataFrame([(b,) for b in now], "batch string").coalesce(1).write.parquet(f"{new}/ids")
    return len(now)
