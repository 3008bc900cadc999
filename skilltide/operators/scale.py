"""Helpers that keep plans safe under skew and long lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# A window over few rows per map task needs no salt: the group limit below the shuffle already
# sends at most k rows of a group per task.
SMALL_K = 20
# Beyond this k Spark has no group limit below the shuffle (its default threshold).
GROUP_LIMIT = 1000
DEFAULT_SALTS = 16
# A key with more than 1/SLICES of the rows is hot.
SLICES = 64
# Rows of one range of a distributed prefix sum.
RANGE_ROWS = 500_000
# Whether a write removes its shuffle files when it ends; else they stay until the driver collects garbage.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder the cluster names; make one only for a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="skilltide-checkpoint-")
    context.setCheckpointDir(named)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows once as a table in the shared folder and read them back.

    Later reads neither recompute them nor depend on executors, read only the columns they need,
    and see the true size, so that small ones are broadcast. What was shuffled for them is removed.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    for tables in _scopes:
        tables.append(path)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN_UP) if before is None else spark.conf.set(CLEAN_UP, before)
    return spark.read.schema(df.schema).parquet(path)


# Tables written since each enclosing call of ``only_result`` began.
_scopes: list[list[str]] = []


def only_result(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written as a table; all tables it wrote on its way are removed."""
    _scopes.append([])
    spark, result = None, None
    try:
        result = cut_lineage(make())
        spark = result.sparkSession
        return result
    finally:
        tables = _scopes.pop()
        if result is not None:
            tables = tables[:-1]  # the last one is the result
        spark = spark or SparkSession.getActiveSession()
        for path in tables:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def fits(df: DataFrame, max_rows: int) -> bool:
    """Whether a frame has at most ``max_rows`` rows; stops reading beyond that."""
    return df.limit(max_rows + 1).count() <= max_rows


def spread_small_scan(df: DataFrame) -> DataFrame:
    """Deal out a scan of at most one piece per core before heavy row-wise work: a small file is
    one row group and would keep one core busy. A large scan has more pieces and stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df.repartition(cores) if pieces <= cores else df


def broadcast_if_small(df: DataFrame, max_rows: int = 200_000) -> DataFrame:
    """Broadcast a materialized frame of few narrow rows; leave a larger one to a shuffle join."""
    return F.broadcast(df) if fits(df, max_rows) else df


def spread(*columns: Column | str, salts: int) -> Column:
    """Repeatable salt in [0, salts): the same row gets the same salt when a task is retried."""
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, *,
                    spread_on: Sequence[str] = (), salts: int = DEFAULT_SALTS,
                    rank: str | None = None) -> DataFrame:
    """First k rows of every group. A hot group is cut to k rows per salt before it meets in
    one task. ``order`` must be total, so that the result does not depend on the layout. For a
    k beyond Spark's group limit, rows are first cut within the rows of each map task, so that
    the number of slices grows with the input."""
    marker = rank or "_rank"
    if spread_on and k > GROUP_LIMIT:
        piece = Window.partitionBy(*group, "_piece").orderBy(*order)
        df = (df.withColumn("_piece", F.spark_partition_id())
              .withColumn("_local", F.row_number().over(piece))
              .filter(F.col("_local") <= k).drop("_piece", "_local"))
    if spread_on and k > SMALL_K and salts > 1:
        local = Window.partitionBy(*group, "_salt").orderBy(*order)
        df = (df.withColumn("_salt", spread(*spread_on, salts=salts))
              .withColumn("_local", F.row_number().over(local))
              .filter(F.col("_local") <= k).drop("_salt", "_local"))
    whole = Window.partitionBy(*group).orderBy(*order)
    out = df.withColumn(marker, F.row_number().over(whole)).filter(F.col(marker) <= k)
    return out if rank else out.drop(marker)


def first_per_key(df: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The row with the least ``order`` of every key, by a partial aggregate (no window)."""
    rest = [c for c in df.columns if c not in key]
    first = F.min_by(F.struct(*rest), order).alias("_first")
    return df.groupBy(*key).agg(first).select(*key, "_first.*").select(*df.columns)


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", *,
                spread_on: Sequence[str]) -> DataFrame:
    """Equi-join on ``key`` in which a hot key of ``left`` is dealt over many tasks.

    A sketch of the heavy hitters, of bounded size, names the keys with more than a share of 1/SLICES
    of the rows. Rows of such a key get one of as many salts as it has shares, by a hash of
    ``spread_on``, and the rows of ``right`` under it are repeated for each salt. ``how`` is inner,
    left or left_semi. A key that the sketch misses or overrates changes the work, not the rows.
    """
    counts = left.select(F.count(key).alias("n"), F.expr(f"approx_top_k(`{key}`, {SLICES}, {8 * SLICES})")
                         .alias("top")).first()
    hot = {r["item"]: -(-r["count"] * SLICES // counts["n"]) for r in counts["top"] or []
           if r["item"] is not None and r["count"] * SLICES > counts["n"]}
    hot = {k: n for k, n in hot.items() if n > 1}
    if not hot:
        return left.join(right, key, how)
    kind = left.schema[key].dataType
    salts = F.coalesce(F.create_map(*[x for k, n in hot.items() for x in (
        F.lit(k).cast(kind), F.lit(int(n)))])[F.col(key)], F.lit(1))
    dealt = left.withColumn("_salt", F.pmod(F.xxhash64(*spread_on), salts).cast("int"))
    every = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), (salts - 1).cast("int"))))
    return dealt.join(every, [key, "_salt"], how).drop("_salt")


def running_sums(df: DataFrame, group: str, order: Sequence[str], sums: dict[str, Column], *,
                 rows_per_range: int = RANGE_ROWS) -> DataFrame:
    """Add, under each name of ``sums``, the sum of its column over the rows before a row in its group.

    Distributed prefix sums: rows are dealt out by ranges of (group, order), the number of ranges
    follows the number of rows, each range is summed by itself and moved up by the totals of the
    ranges before it. A hot group spans many ranges, so no task holds more than about one range of
    it, plus one total a range. ``group`` is a column without NULLs; ``order`` must be total.
    """
    held = cut_lineage(df.select("*", *[c.cast("long").alias(f"_{n}") for n, c in sums.items()]))
    ranges = max(1, -(-held.count() // rows_per_range))
    placed = cut_lineage(held.repartitionByRange(ranges, group, *order)
                         .withColumn("_range", F.spark_partition_id()))
    totals = placed.groupBy(group, "_range").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select(group, "_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0))
                                             .alias(f"_before_{n}") for n in sums])
    inside = (Window.partitionBy(group, "_range").orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.select(*df.columns, "_range", *[
                F.coalesce(F.sum(f"_{n}").over(inside), F.lit(0)).alias(f"_inside_{n}") for n in sums])
            .join(moved, [group, "_range"])
            .select(*df.columns, *[(F.col(f"_before_{n}") + F.col(f"_inside_{n}")).alias(n)
                                   for n in sums]))


def ranked_in_group(df: DataFrame, group: Sequence[str], order: str, *, tie: str | None = None,
                    rows_per_range: int = RANGE_ROWS, rank: str = "rank") -> DataFrame:
    """Dense position 1..n inside every group (NULLs are groups too) without bringing a group into
    one task; rows with a NULL ``order`` come first."""
    keyed = df.withColumn("_group", F.to_json(F.struct(*group)))
    ranked = running_sums(keyed, "_group", [order] if tie is None else [order, tie],
                          {"_rank": F.lit(1)}, rows_per_range=rows_per_range)
    return ranked.select(*df.columns, (F.col("_rank") + 1).alias(rank))
