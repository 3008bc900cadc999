"""Raw posting files: JSON in, JSON archive out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import slug
from ..schemas import RAW_POSTING

CORRUPT = "_corrupt_record"
READ_SCHEMA = T.StructType([*RAW_POSTING.fields, T.StructField(CORRUPT, T.StringType())])
_OPTIONS = {"multiLine": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT,
            "pathGlobFilter": "*.json"}


def _with_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def with_arrival(df: DataFrame) -> DataFrame:
    """Arrival order: the file's path, then the place within the file."""
    return df.withColumn(
        "arrival", F.struct("source_file", F.monotonically_increasing_id().alias("place")))


def read_postings(spark: SparkSession, path: str, *, multi_line: bool = True) -> DataFrame:
    """Every *.json of a folder: one posting per file (or a list of them), or one per line with
    ``multi_line=False``. What cannot be read is a row with ``_corrupt_record`` set, no error."""
    return with_arrival(_with_source(
        spark.read.schema(READ_SCHEMA).options(**_OPTIONS).option("multiLine", multi_line)
        .json(path)))


def stream_postings(spark: SparkSession, path: str, *, files_per_batch: int = 10_000,
                    multi_line: bool = True) -> DataFrame:
    """The same folder as a stream of arriving files."""
    return _with_source(spark.readStream.schema(READ_SCHEMA).options(**_OPTIONS)
                        .option("multiLine", multi_line)
                        .option("maxFilesPerTrigger", files_per_batch).json(path))


def split_readable(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(readable rows, unreadable files)."""
    bad = F.col(CORRUPT).isNotNull()
    return df.filter(~bad).drop(CORRUPT), df.filter(bad).select("source_file", CORRUPT)


def archive_name(title: Column | str, company: Column | str, day: Column | str) -> Column:
    """slug(title)_slug(company)_yyyymmdd, the readable part of an archive file's name."""
    day = F.col(day) if isinstance(day, str) else day
    return F.concat_ws("_", slug(title), slug(company), F.date_format(day, "yyyyMMdd"))


def write_postings(df: DataFrame, path: str) -> None:
    """Archive postings as JSON under their posting day. Each task writes what it holds, so a
    day with very many postings needs no shuffle."""
    columns = [f.name for f in RAW_POSTING.fields]
    day = F.coalesce(F.try_to_date("posted_date"), F.current_date())
    df.select(*columns, archive_name("job_title", "company", day).alias("archive_name"),
              F.col("posted_date").alias("day")).write.mode("append").partitionBy("day").json(path)
