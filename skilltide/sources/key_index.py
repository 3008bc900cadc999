"""Keys of a stored table in buckets, so that a batch reads only where its own keys can be.

Under ``root`` lie ``bucket=<b>/batch=<n>`` folders of narrow rows (kind, key). A batch asks for the
buckets that its keys fall into; with buckets in proportion to the store, what a batch reads depends
on its own size. Batches that are settled can be merged, so that a bucket stays a few files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
NAME = "bucket={:05d}"


def _folders(spark: SparkSession, pattern: str) -> list:
    """Paths that match a glob, and their file system."""
    path = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(fs, s.getPath()) for s in (fs.globStatus(path) or [])]


class KeyIndex:
    """Ids and hashes of a table that is appended in batches."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS) -> None:
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def exists(self) -> bool:
        return bool(_folders(self.spark, f"{self.root}/bucket=*"))

    def _entries(self, rows: DataFrame, id_col: str, hash_col: str) -> DataFrame:
        both = [F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key"))
                for kind, c in (("id", id_col), ("hash", hash_col))]
        entry = rows.select(F.explode(F.array(*both)).alias("e")).select("e.*").filter("key IS NOT NULL")
        return entry.withColumn("bucket", self._bucket())

    def _bucket(self) -> Column:
        return F.format_string("%05d", F.pmod(F.xxhash64("key"), F.lit(self.buckets)))

    def add(self, rows: DataFrame, batch: int, *, id_col: str = "posting_id",
            hash_col: str = "content_hash") -> None:
        """Enter the keys of a batch; what an earlier attempt of it entered is removed first."""
        for fs, path in _folders(self.spark, f"{self.root}/bucket=*/batch={batch:010d}"):
            fs.delete(path, True)
        entries = self._entries(rows, id_col, hash_col).distinct().withColumn(
            "batch", F.lit(f"{batch:010d}"))
        (entries.repartition("bucket").write.mode("append").partitionBy("bucket", "batch")
         .parquet(self.root))

    def stored(self, rows: DataFrame, *, besides: int | None = None, id_col: str = "posting_id",
               hash_col: str = "content_hash") -> DataFrame | None:
        """(id, hash), one of them NULL: what is stored in the buckets that the rows' keys fall
        into, all other batches' keys of the rows among it."""
        asked = self._entries(rows, id_col, hash_col).select("bucket").distinct().collect()
        wanted = {NAME.format(int(r["bucket"])) for r in asked}
        folders = [str(p.toString()) for _, p in _folders(self.spark, f"{self.root}/bucket=*/batch=*")]
        skip = None if besides is None else f"batch={besides:010d}"
        paths = [p for p in folders if p.split("/")[-2] in wanted and p.split("/")[-1] != skip]
        if not paths:
            return None
        found = self.spark.read.schema("kind string, key string").parquet(*paths)
        return found.select(F.when(F.col("kind") == "id", F.col("key")).alias(id_col),
                            F.when(F.col("kind") == "hash", F.col("key")).alias(hash_col))

    def merge(self, before: int) -> None:
        """Merge the folders of batches before this one, which can no longer be repeated. A key that
        is there twice, in the old and the merged folder of a broken off merge, does no harm."""
        old = [(fs, p) for fs, p in _folders(self.spark, f"{self.root}/bucket=*/batch=*")
               if (n := p.getName().split("=")[1]).startswith("m") or int(n) < before]
        if not old:
            return
        read = self.spark.read.schema("kind string, key string, bucket string").option(
            "basePath", self.root).parquet(*[str(p.toString()) for _, p in old])
        merged = read.select("kind", "key").distinct().withColumn("bucket", self._bucket()).withColumn(
            "batch", F.lit(f"m{before:09d}-{len(old)}"))
        target = {f"batch=m{before:09d}-{len(old)}"}
        (merged.repartition("bucket").write.mode("append").partitionBy("bucket", "batch")
         .parquet(self.root))
        for fs, path in old:
            if path.getName() not in target:
                fs.delete(path, True)
