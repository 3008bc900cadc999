"""Mixing sources to target weights in equal blocks of words; DataFrame functions only.

1. Targets: sources get ``share`` times all words by weight; none more than ``most`` times its own
   words. What is above goes to the others by weight until none is above (a level is raised).
2. Quotas: each target is a number of blocks of ``block`` words, apportioned by Sainte-Lague:
   blocks go to the highest quotients weight / (2 k + 1). Every source is cut into shards by a
   seeded hash of the id, and its blocks are apportioned over them by the same rule.
3. Selection: the documents of a shard lie end to end in a seeded order. Whole rounds are taken
   whole, the rest are the first blocks of that order.

The number of shards follows the words of a source (``SHARD_WORDS``), at most ``MAX_SHARDS``; a hot
source so is spread over many tasks. Only sizes travel, no texts. Null texts have no words and are
taken zero times; a null source is a source of its own, the last. Rows that share an id are ordered
together and get results of their own. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilltide.llm.common import WORD, text_or_empty
from skilltide.operators.scale import cut_lineage, fits

BLOCK = 16
SHARD_WORDS = 1 << 16
MAX_SHARDS = 4096
MAX_BROADCAST_SOURCES = 100_000


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def targets(sizes: DataFrame, *, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, weight) to the same with ``target``; few rows, one for each source."""
    cap = F.col("source_size") * most
    everything = Window.partitionBy()
    # Sources reach their cap in the order of cap / weight; the level that spends the rest on
    # the sources not yet at their cap is right where it is below the next one's ratio.
    before = (Window.partitionBy().orderBy("ratio", "place")
              .rowsBetween(Window.unboundedPreceding, -1))
    level = (F.sum("source_size").over(everything) * F.lit(share)
             - F.coalesce(F.sum("cap").over(before), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    ratios = (sizes.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
              .withColumn("level", level)
              .withColumn("final", F.min(F.when(
                  F.col("level") <= F.col("ratio"), F.struct("ratio", "place", "level")))
                          .over(everything)["level"]))
    return (ratios.withColumn("target", F.least(
        F.col("cap").cast("double"), F.col("weight") * F.coalesce("final", "level")))
        .drop("cap", "ratio", "level", "final"))


def apportioned(df: DataFrame, group: list[str], weight: str, seats: Column,
                order: list[str]) -> DataFrame:
    """Sainte-Lague: ``quota`` of each row of a group that has ``seats`` blocks to give.

    A row's quota differs from its exact share by at most half a block and a share of the rows
    over the blocks, so all below that is certain and only a few quotients a row are ranked."""
    all_of = Window.partitionBy(*group)
    exact = F.col("_seats") * F.col(weight) / F.col("_weight")
    slack = F.col("_rows") / (2 * F.col("_seats"))
    shares = (df.withColumn("_seats", seats.cast("long"))
              .withColumn("_weight", F.sum(weight).over(all_of))
              .withColumn("_rows", F.count("*").over(all_of))
              .withColumn("_open", (F.col("_seats") > 0) & (F.col(weight) > 0))
              .withColumn("_low", F.when(F.col("_open"), F.greatest(
                  F.lit(0), F.floor(exact * (1 - slack) - 0.5))).otherwise(0).cast("long"))
              .withColumn("_high", F.when(F.col("_open"), F.ceil(exact * (1 + slack) + 0.5))
                          .otherwise(0).cast("long"))
              .withColumn("_left", F.col("_seats") - F.sum("_low").over(all_of)))
    quotients = (shares.filter("_open")
                 .select(*group, *[c for c in order if c not in group], "_low", "_left", weight,
                         F.explode(F.sequence("_low", "_high")).alias("_k"))
                 .withColumn("_rank", F.row_number().over(all_of.orderBy(
                     (F.col(weight) / (2 * F.col("_k") + 1)).desc(), *order)))
                 .filter("_rank <= _left"))
    keys = list(dict.fromkeys([*group, *order]))
    more = quotients.groupBy(*keys).agg(F.count("*").alias("_more"))
    return (shares.join(more, keys, "left")
            .withColumn("quota", F.col("_low") + F.coalesce("_more", F.lit(0)))
            .drop("_seats", "_weight", "_rows", "_open", "_low", "_high", "_left", "_more"))


def mix(df: DataFrame, *, id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2,
        block: int = BLOCK, seed: int = 7) -> DataFrame:
    """Per row: id, size, source_size, target, taken, and its source's ``place`` and ``shard``."""
    sized = cut_lineage(df.select(F.col(id).alias("_id"), F.col(source).alias("_source"),
                                  word_count(text).alias("size")))
    place = F.row_number().over(Window.partitionBy().orderBy(F.col("_source").asc_nulls_last()))
    sources = (sized.groupBy("_source").agg(F.sum("size").alias("source_size"))
               .withColumn("place", place))
    sources = sources.withColumn("weight", F.array(*[F.lit(w) for w in weights])[
        (F.col("place") - 1) % len(weights)])
    blocks = F.round(F.sum("target").over(Window.partitionBy()) / block)
    shards = F.least(F.lit(MAX_SHARDS), F.greatest(
        F.lit(1), F.ceil(F.col("source_size") / SHARD_WORDS))).cast("int")
    sources = cut_lineage(
        apportioned(targets(sources, share=share, most=most), [], "target", blocks, ["place"])
        .withColumnRenamed("quota", "blocks").withColumn("shards", shards))
    few = F.broadcast(sources) if fits(sources, MAX_BROADCAST_SOURCES) else sources
    draw = F.xxhash64(F.lit(seed), F.col("_id"))
    dealt = cut_lineage(
        sized.join(few, sized["_source"].eqNullSafe(few["_source"]))
        .select("_id", "size", "source_size", "target", "place", "blocks", "shards",
                F.pmod(draw, F.col("shards")).cast("int").alias("shard")))
    quotas = apportioned(
        dealt.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"),
                                            F.first("blocks").alias("blocks")),
        ["place"], "shard_size", F.col("blocks"), ["shard"]).drop("blocks")
    line = (Window.partitionBy("place", "shard").orderBy(
        F.xxhash64(F.lit(seed + 1), F.col("_id")), "_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1))
    words = F.least(F.col("quota") * block, F.col("shard_size") * most)
    rounds = F.floor(F.col("words") / F.col("shard_size"))
    rest = F.col("words") - rounds * F.col("shard_size") - F.col("before")
    taken = F.when(F.col("size") == 0, 0).otherwise(
        rounds * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest)))
    return (dealt.join(quotas, ["place", "shard"])
            .withColumn("before", F.coalesce(F.sum("size").over(line), F.lit(0)))
            .withColumn("words", words)
            .select(F.col("_id").alias(id), "size", "source_size", "target",
                    taken.cast("long").alias("taken"), "place", "shard"))
