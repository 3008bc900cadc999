"""Text in, skill report out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.report import add_facts, match_facts, skill_report
from ..operators.resolve import resolve_queries
from ..operators.retrieval import (HybridSettings, RecallSettings, hybrid_match,
                                   structured_primary, structured_recall)
from ..operators.scale import cut_lineage

PLAN = ["role_family", "specializations", "seniority_filter", "year_floor"]


def plan_queries(queries: DataFrame, title_map: DataFrame, *,
                 embed: Callable[[Column], Column] | None = None, mode: str = "auto"
                 ) -> DataFrame:
    """Resolved queries with their vector. mode 'auto' uses the title map where a query
    resolves, 'legacy' never does, 'structured' leaves out queries that do not resolve."""
    if mode not in ("auto", "legacy", "structured"):
        raise ValueError(f"unknown mode {mode!r}")
    plans = resolve_queries(queries, title_map)
    if embed is not None:
        plans = plans.withColumn("query_vector", embed(F.col("query_text")))
    if mode == "legacy":
        plans = plans.withColumn("mode", F.lit("fallback"))
    return plans.filter(F.col("mode") == "structured") if mode == "structured" else plans


def search_facts(postings: DataFrame, plans: DataFrame, *, dim: int,
                 hybrid: HybridSettings = HybridSettings(),
                 recall: RecallSettings = RecallSettings()) -> DataFrame:
    """Facts of every query. Title names are canonical on the structured side, raw elsewhere.

    Queries that resolve to the same plan match the same postings: these are counted once per
    plan, however many queries share it, and the counts are handed to each of them. Only the
    small recall pool depends on a query's own vector.
    """
    placed = plans.filter(F.col("mode") == "structured").withColumn(
        "specializations", F.array_sort(F.array_distinct("specializations"))).withColumn(
        "plan_id", F.to_json(F.struct(*PLAN)))
    loose = plans.filter(F.col("mode") != "structured")
    name = F.coalesce("canonical_title", "job_title")
    shared = structured_primary(
        postings, placed.select(F.col("plan_id").alias("query_id"), *PLAN).distinct())
    per_plan = match_facts(shared, name).withColumnRenamed("query_id", "plan_id")
    return add_facts(
        per_plan.join(placed.select("plan_id", "query_id"), "plan_id"),
        match_facts(structured_recall(postings, placed, dim=dim, settings=recall), name),
        match_facts(hybrid_match(postings, loose, dim=dim, settings=hybrid)))


def search(postings: DataFrame, queries: DataFrame, title_map: DataFrame, *,
           embed: Callable[[Column], Column] | None = None, dim: int = 64, mode: str = "auto",
           hybrid: HybridSettings = HybridSettings(),
           recall: RecallSettings = RecallSettings()) -> DataFrame:
    """Report of every query (query_id, text[, query_vector])."""
    plans = cut_lineage(plan_queries(queries, title_map, embed=embed, mode=mode))
    facts = cut_lineage(search_facts(postings, plans, dim=dim, hybrid=hybrid, recall=recall))
    asked = plans.select("query_id", "text", "canonical_title", "role_family", "specializations",
                         "seniority_filter", "mode")
    return skill_report(facts, asked)
