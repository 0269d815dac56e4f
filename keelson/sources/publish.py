"""Write, audit, publish (L6): new table states appear together or not at all.

Tables are written to a hidden folder beside the published versions and read back; only if
every check on the written rows holds is the folder renamed to the next version.  Readers
take the newest version, so a write that fails or is refused leaves the old tables in
place, and of two writers that publish the same version one is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "v"               # published folders are v000001, v000002, ...


class AuditFailed(Exception):
    """A check on the staged rows found faults; nothing was published."""


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    """Published versions, oldest first."""
    fs, p = _file_system(spark, root)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[len(VERSION):]) for n in names if n.startswith(VERSION) and n[len(VERSION):].isdigit())


def _folder(root: str, version: int) -> str:
    return f"{root.rstrip('/')}/{VERSION}{version:06d}"


def published(spark: SparkSession, root: str, table: str, version: int | None = None) -> DataFrame:
    """A table of one published version, the newest unless named."""
    have = versions(spark, root)
    if not have:
        raise FileNotFoundError(f"Nothing is published at {root}")
    return spark.read.parquet(f"{_folder(root, version or have[-1])}/{table}")


def publish(tables: dict[str, DataFrame], root: str,
            audits: dict[str, Callable[[dict[str, DataFrame]], DataFrame]] | None = None) -> int:
    """Write ``tables``, check what was written, and publish it as the next version, whose number is returned.

    An audit takes the written tables and returns the faulty rows; any row refuses the
    publication.  The rename is one step of the file system.
    """
    spark = next(iter(tables.values())).sparkSession
    staged = f"{root.rstrip('/')}/.staged-{uuid.uuid4().hex}"
    have = versions(spark, root)
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{staged}/{name}")
    written = {name: spark.read.schema(df.schema).parquet(f"{staged}/{name}") for name, df in tables.items()}
    failed = [name for name, audit in (audits or {}).items() if not audit(written).isEmpty()]
    if failed:
        raise AuditFailed(f"Not published, checks failed: {', '.join(failed)}")
    version = (have[-1] if have else 0) + 1
    fs, source = _file_system(spark, staged)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_folder(root, version))
    if fs.exists(target) or not fs.rename(source, target):
        raise FileExistsError(f"Version {version} of {root} is already published")
    return version


def same_rows(table: str, expected: DataFrame) -> Callable[[dict[str, DataFrame]], DataFrame]:
    """Audit: the written rows are those of ``expected``, repeats counted (one shuffle of both sides)."""
    def audit(written):
        both = written[table].withColumn("_n", F.lit(1)).unionByName(expected.withColumn("_n", F.lit(-1)))
        return both.groupBy(*[c for c in both.columns if c != "_n"]).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return audit
