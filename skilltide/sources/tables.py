"""Parquet tables: appended batches and whole snapshots.

No table format with MERGE is assumed. A changed table is written to a new version folder and
never over the one being read; a version counts once its write has succeeded.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..vocabulary import CANONICAL_SKILLS, SEED_FAMILIES, SEED_SPECIALIZATIONS, TECH_CAPITALIZATION


def _finished(spark: SparkSession, pattern: str) -> list[str]:
    """Folders matching a glob whose write has succeeded, in name order."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{pattern}/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return sorted(s.getPath().getParent().toString() for s in (found or []))


def write_snapshot(df: DataFrame, root: str) -> str:
    """Write a table as its next version and return the folder."""
    versions = _finished(df.sparkSession, f"{root}/version=*")
    last = max((int(v.rsplit("=", 1)[1]) for v in versions), default=0)
    target = f"{root}/version={last + 1:08d}"
    df.write.mode("overwrite").parquet(target)
    return target


def read_snapshot(spark: SparkSession, root: str) -> DataFrame | None:
    """Latest finished version; NULL before the first one."""
    versions = _finished(spark, f"{root}/version=*")
    return spark.read.parquet(versions[-1]) if versions else None


def pinned_snapshot(spark: SparkSession, root: str, pins: str, batch: int) -> DataFrame | None:
    """The version of a snapshot table that belongs to a batch: the latest one when the batch was
    first tried. The choice is written under ``pins`` by a rename, which happens once, so a
    repeated batch sees the version of its first attempt whatever was published since."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    pin = hadoop.Path(f"{pins}/batch={batch:010d}")
    fs = pin.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(pin):
        versions = _finished(spark, f"{root}/version=*")
        if not versions:
            return None
        draft = hadoop.Path(f"{pins}/_draft-{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(versions[-1].rsplit("/", 1)[1].encode()))
        out.close()
        if fs.exists(pin) or not fs.rename(draft, pin):
            fs.delete(draft, False)
    chosen = spark.read.text(str(pin.toString())).first()["value"]
    return spark.read.parquet(f"{root}/{chosen}")


def read_batches(spark: SparkSession, root: str, *, besides: int | None = None
                 ) -> DataFrame | None:
    """All finished batches of an appended table, optionally without one of them."""
    paths = [p for p in _finished(spark, f"{root}/batch=*")
             if besides is None or not p.endswith(f"/batch={besides:010d}")]
    return spark.read.option("basePath", root).parquet(*paths).drop("batch") if paths else None


def write_batch(df: DataFrame, root: str, batch: int) -> None:
    """Write one batch. A repeated batch replaces its own earlier attempt and nothing else."""
    df.write.mode("overwrite").parquet(f"{root}/batch={batch:010d}")


def seed_families(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(f,) for f in SEED_FAMILIES], "family string")
    return rows.select(
        "family", F.lit(None).cast("string").alias("parent_family"),
        F.lit(0).cast("long").alias("posting_count"),
        F.current_timestamp().alias("created_at"))


def seed_specs(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame([(s,) for s in SEED_SPECIALIZATIONS], "spec string")
    return rows.select("spec", F.lit("active").alias("status"),
                       F.current_timestamp().alias("created_at"))


def alias_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """(canonical names, capitalization), each as (spelling, skill)."""
    shape = "spelling string, skill string"
    return (spark.createDataFrame(list(CANONICAL_SKILLS.items()), shape),
            spark.createDataFrame(list(TECH_CAPITALIZATION.items()), shape))
