"""Documents to token shards: five operators of ``keelson.llm`` in a row.

Each stage takes (spark, docs, sf_dir), with all rows the one before kept, and returns
a DataFrame.  All but the last return the columns they were given.  ``run`` writes each
stage's rows as Parquet to the shared folder and reads them back for the next, so a
lost executor repeats no earlier stage.

No SQL twin: the last stage's token ids come from a tokenizer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from keelson.llm.decontam import clean
from keelson.llm.mixing import mixed
from keelson.llm.near_dedup import one_of_each
from keelson.llm.quality_rules import keep_good
from keelson.llm.text import stored
from keelson.llm.token_output import token_output

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break no quality rule."""
    return keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 80 percent of the shingles of five words in common."""
    return one_of_each(docs, percent=80, shingle=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources: each document as often as the mix takes it."""
    return mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, token count and checksum of every document, read back from the written shards."""
    return token_output(docs)


STAGES = [("quality_rules", quality), ("near_dedup", near_dedup), ("decontamination", decontaminate),
          ("mixing", mix), ("token_output", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
