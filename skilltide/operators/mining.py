"""Frequent item triples with support and lift."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scale import cut_lineage

# Frequent items up to this many ride in the plan as a set; more of them are joined.
MAX_LITERAL_ITEMS = 5_000


def build_baskets(postings: DataFrame, *, id_col: str = "posting_id", items_col: str = "skills",
                  max_items: int = 30, min_size: int = 3) -> DataFrame:
    """(basket_id, items): distinct sorted items of the first ``max_items`` entries, for rows
    whose raw array has at least ``min_size`` entries."""
    items = F.array_distinct(F.filter(F.slice(items_col, 1, max_items), lambda s: s.isNotNull()))
    return postings.filter(F.size(items_col) >= min_size).select(
        F.col(id_col).alias("basket_id"), F.array_sort(items).alias("items"))


def item_support(baskets: DataFrame) -> DataFrame:
    """(item, cnt); the row with a NULL item counts the baskets."""
    marked = F.concat("items", F.array(F.lit(None).cast("string")))
    return (baskets.select(F.explode_outer(marked).alias("item")).groupBy("item")
            .agg(F.count("*").alias("cnt")))


def _only_frequent(baskets: DataFrame, frequent: DataFrame) -> DataFrame:
    """Baskets cut to frequent items by a join; regrouping is bounded by the basket size.

    Each row gets a key of its own, written once: baskets that share an id stay apart."""
    keyed = cut_lineage(baskets.withColumn("_row", F.expr("uuid()")))
    kept = (keyed.select("_row", F.explode("items").alias("item"))
            .join(frequent.select("item"), "item"))
    return kept.groupBy("_row").agg(F.array_sort(F.collect_list("item")).alias("items"))


def triple_support(baskets: DataFrame, min_support: int = 1) -> DataFrame:
    """(s1, s2, s3, support_count) with s1 < s2 < s3 in code-point order.

    The arrays are sorted and distinct, so later positions are greater: triples come out of
    each row by itself and the only shuffle is the count, combined on the map side.
    """
    first = baskets.filter(F.size("items") >= 3).select(
        F.posexplode("items").alias("i", "s1"), "items")
    second = first.select("s1", F.slice("items", F.col("i") + 2, F.size("items")).alias("rest"))
    second = second.select("s1", F.posexplode("rest").alias("j", "s2"), "rest")
    third = second.select("s1", "s2", F.explode(F.slice(
        "rest", F.col("j") + 2, F.size("rest"))).alias("s3"))
    return (third.groupBy("s1", "s2", "s3").agg(F.count("*").alias("support_count"))
            .filter(F.col("support_count") >= min_support))


def with_lift(triples: DataFrame, singles: DataFrame, total: int, min_lift: float) -> DataFrame:
    """Keep triples of lift >= min_lift. The test is exact: support * n^2 >= lift * product of
    the single supports, in decimals, so that a lift of exactly 1 is never lost to rounding."""
    out = triples
    for name in ("s1", "s2", "s3"):
        side = singles.select(F.col("item").alias(name), F.col("cnt").alias(f"n_{name}"))
        out = out.join(side, name)
    whole = T.DecimalType(38, 0)
    floor = Decimal(str(min_lift))
    n = F.lit(Decimal(total)).cast(whole)
    observed = F.col("support_count").cast(whole) * n * n
    product = (F.col("n_s1").cast(whole) * F.col("n_s2").cast(whole)
               * F.col("n_s3").cast(whole))
    lift = (F.col("support_count") * F.lit(float(total)) * F.lit(float(total))
            / (F.col("n_s1").cast("double") * F.col("n_s2") * F.col("n_s3")))
    return out.filter(observed >= product * F.lit(floor)).select(
        "s1", "s2", "s3", "support_count", lift.alias("lift"))


def mine_triples(postings: DataFrame, *, min_support: int = 25, min_lift: float = 1.0,
                 top_n: int | None = 200, max_skills: int = 30, id_col: str = "posting_id",
                 items_col: str = "skills", prune: bool = True) -> DataFrame:
    """Top triples by support.

    Items below ``min_support`` cannot be in a frequent triple; ``prune`` removes them before
    triples are formed, after the slice, while the basket total and single counts keep them.
    """
    baskets = build_baskets(postings, id_col=id_col, items_col=items_col, max_items=max_skills)
    support = item_support(baskets)
    frequent = support.filter(F.col("item").isNull() | (F.col("cnt") >= min_support))
    rows = frequent.limit(MAX_LITERAL_ITEMS + 2).collect()
    if len(rows) <= MAX_LITERAL_ITEMS + 1:
        frequent = postings.sparkSession.createDataFrame(rows, frequent.schema)
    else:
        frequent = cut_lineage(frequent)
    total = next((r["cnt"] for r in rows if r["item"] is None), None)
    if total is None:
        row = frequent.filter(F.col("item").isNull()).first()
        total = row["cnt"] if row else 0
    singles = frequent.filter(F.col("item").isNotNull())
    if prune and len(rows) <= MAX_LITERAL_ITEMS + 1:
        names = [r["item"] for r in rows if r["item"] is not None]
        baskets = baskets.select("basket_id", F.filter(
            "items", lambda s: s.isin(names)).alias("items"))
    elif prune:
        baskets = _only_frequent(baskets, singles)
    found = with_lift(triple_support(baskets, min_support), singles, total, min_lift)
    ordered = found.orderBy(F.desc("support_count"), "s1", "s2", "s3")
    return found if top_n is None else ordered.limit(top_n)
