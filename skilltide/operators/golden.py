"""Expectation check: behavioral cases against the answers of a search run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXPECTATIONS = ("query string, expect_includes array<string>, expect_excludes array<string>, "
                "expect_resolves_to string, expect_seniority string, "
                "expect_same_results_as string")


def _lower_set(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.transform(F.coalesce(c, empty), lambda s: F.lower(s))))


def check_expectations(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """(query, mode, passed, detail): all expectations of a case together; detail names each
    that failed. answers: (query, titles, canonical_title, seniority_filter, job_count, mode).
    Titles are compared as lower-case sets.
    """
    got = answers.select("query", _lower_set("titles").alias("titles"), "canonical_title",
                         "seniority_filter", "job_count", "mode")
    other = got.select(F.col("query").alias("expect_same_results_as"),
                       F.col("titles").alias("other_titles"),
                       F.col("job_count").alias("other_count"))
    rows = cases.join(got, "query", "left").join(other, "expect_same_results_as", "left")
    titles = F.coalesce("titles", F.array().cast("array<string>"))
    missing = F.array_except(_lower_set("expect_includes"), titles)
    extra = F.array_intersect(_lower_set("expect_excludes"), titles)

    def failed(bad: Column, text: Column) -> Column:
        return F.when(F.coalesce(bad, F.lit(True)), text)

    same = F.col("titles").eqNullSafe(F.col("other_titles")) & F.col("job_count").eqNullSafe(
        F.col("other_count")) & F.col("titles").isNotNull()
    checks = [
        F.when(F.col("titles").isNull(), F.lit("no answer")),
        failed(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", "))),
        failed(F.size(extra) > 0, F.concat(F.lit("unexpected: "), F.array_join(extra, ", "))),
        F.when(F.col("expect_resolves_to").isNotNull(), failed(
            ~F.col("canonical_title").eqNullSafe(F.lower("expect_resolves_to")),
            F.concat(F.lit("resolved to "), F.coalesce("canonical_title", F.lit("nothing"))))),
        F.when(F.col("expect_seniority").isNotNull(), failed(
            ~F.col("seniority_filter").eqNullSafe(F.col("expect_seniority")),
            F.concat(F.lit("seniority "), F.coalesce("seniority_filter", F.lit("none"))))),
        F.when(F.col("expect_same_results_as").isNotNull(), failed(
            ~same, F.concat(F.lit("differs from "), "expect_same_results_as"))),
    ]
    detail = F.concat_ws("; ", *checks)
    return rows.select("query", "mode", (detail == "").alias("passed"), detail.alias("detail"))


def summary(checked: DataFrame) -> DataFrame:
    return checked.agg(F.sum(F.col("passed").cast("int")).alias("passed"),
                       F.count("*").alias("cases"))
