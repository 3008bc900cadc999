"""Query resolution: exact key, then fuzzy key, then fallback."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .retrieval import queries_from_text
from .scale import cut_lineage, salted_join
from .similarity import best_match, trigram_pairs

# Fixed value: least similarity at which a misspelled key is accepted.
FUZZY_FLOOR = 0.55

DECISION = ["canonical_title", "role_family", "specializations"]


def decided_titles(title_map: DataFrame) -> DataFrame:
    """Rows with a family. An abstention must miss, so that its query falls back."""
    return title_map.filter(F.col("role_family").isNotNull()).select("raw_title_norm", *DECISION)


def exact_lookup(keys: DataFrame, title_map: DataFrame, key: str = "key") -> DataFrame:
    """Left join of distinct keys with the decided titles."""
    decided = decided_titles(title_map)
    return keys.join(decided, F.col(key) == F.col("raw_title_norm"), "left")


def fuzzy_lookup(keys: DataFrame, title_map: DataFrame, *, key: str = "key",
                 floor: float = FUZZY_FLOOR) -> DataFrame:
    """(key, raw_title_norm, similarity, decision): the most similar decided key of each text,
    where it reaches the floor."""
    decided = decided_titles(title_map)
    pairs = trigram_pairs(keys.filter(F.col(key) != ""), decided, key, "raw_title_norm",
                          threshold=floor)
    best = best_match(pairs, "left_text", F.col("similarity"), F.col("right_text"))
    return (best.withColumnRenamed("left_text", key)
            .withColumnRenamed("right_text", "raw_title_norm")
            .join(decided, "raw_title_norm")
            .select(key, "raw_title_norm", "similarity", *DECISION))


def resolve_queries(raw: DataFrame, title_map: DataFrame, *, text: str = "text",
                    floor: float = FUZZY_FLOOR, ascii_only: bool = False) -> DataFrame:
    """Add key, facets (of the raw text), the decision, ``step`` and ``mode``.

    Keys are looked up once each, however many queries share them. The queries are written with
    their keys, as they are read for the keys, for the hot ones and for the join.
    """
    asked = cut_lineage(queries_from_text(raw, text).withColumn(
        "key", X.title_key(F.coalesce(text, F.lit("")), ascii_only=ascii_only)))
    keys = asked.select("key").distinct().filter(F.col("key") != "")
    exact = exact_lookup(keys, title_map)
    hit = exact.filter(F.col("role_family").isNotNull()).select(
        "key", *DECISION, F.lit("exact").alias("step"))
    missed = exact.filter(F.col("role_family").isNull()).select("key")
    near = fuzzy_lookup(missed, title_map, floor=floor).select(
        "key", *DECISION, F.lit("fuzzy").alias("step"))
    plans = salted_join(asked, hit.unionByName(near), "key", "left", spread_on=[text])
    return (plans.withColumn("step", F.coalesce("step", F.lit("fallback")))
            .withColumn("mode", F.when(F.col("role_family").isNotNull(), "structured")
                        .otherwise("fallback"))
            .withColumn("specializations", F.coalesce(
                "specializations", F.array().cast("array<string>"))))
