"""Aggregates over matched sets, for one query or many."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scale import top_k_per_group

TOP_SKILLS = 10
TOP_TITLES = 8


def percentage(part: Column, whole: Column) -> Column:
    """100 * part / whole, two decimals, halves away from zero; NULL for an empty whole."""
    exact = (part * 100).cast("decimal(20,0)") / F.nullif(whole, F.lit(0)).cast("decimal(20,0)")
    return F.round(exact, 2).cast("double")


def match_facts(matched: DataFrame, title: Column | str = "job_title") -> DataFrame:
    """(query_id, kind, value, cnt) with kind 'skill', 'title' or 'all'.

    One pass and one shuffle serve every report: each posting gives its skills, its title and
    one row that counts it. A skill written twice in one posting counts twice.
    """
    title = F.col(title) if isinstance(title, str) else title

    def fact(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), value.alias("value"))

    skills = F.coalesce("skills", F.array().cast("array<string>"))
    facts = F.concat(F.transform(skills, lambda s: fact("skill", s)),
                     F.array(fact("title", title), fact("all", F.lit(None).cast("string"))))
    return (matched.select("query_id", F.explode_outer(facts).alias("f"))
            .groupBy("query_id", "f.kind", "f.value").agg(F.count("*").alias("cnt")))


def job_totals(facts: DataFrame) -> DataFrame:
    """(query_id, job_total, skills_count, job_count).

    job_count is what a skill report shows: it is read off the skill rows, so it is 0 when no
    matched posting names a skill.
    """
    totals = facts.filter(F.col("kind") != "title").groupBy("query_id").agg(
        F.sum(F.when(F.col("kind") == "all", F.col("cnt"))).alias("job_total"),
        F.count(F.when(F.col("kind") == "skill", 1)).alias("skills_count"))
    return totals.withColumn("job_count", F.when(
        F.col("skills_count") > 0, F.col("job_total")).otherwise(0))


def top_skills(facts: DataFrame, k: int = TOP_SKILLS) -> DataFrame:
    """(query_id, rank, skill, cnt, pct, job_total)."""
    ranked = top_k_per_group(
        facts.filter(F.col("kind") == "skill"), ["query_id"],
        [F.desc("cnt"), F.asc("value")], k, rank="rank")
    return ranked.join(job_totals(facts), "query_id").select(
        "query_id", "rank", F.col("value").alias("skill"), "cnt",
        percentage(F.col("cnt"), F.col("job_total")).alias("pct"), "job_total")


def all_skills(facts: DataFrame) -> DataFrame:
    """Every skill of every query, most frequent first (a range-partitioned sort)."""
    return (facts.filter(F.col("kind") == "skill")
            .select("query_id", F.col("value").alias("skill"), "cnt")
            .orderBy("query_id", F.desc("cnt"), "skill"))


def related_titles(facts: DataFrame, k: int = TOP_TITLES) -> DataFrame:
    """(query_id, rank, title, cnt)."""
    return top_k_per_group(
        facts.filter(F.col("kind") == "title"), ["query_id"],
        [F.desc("cnt"), F.asc("value")], k, rank="rank").select(
        "query_id", "rank", F.col("value").alias("title"), "cnt")


def related_canonicals(matched: DataFrame, k: int = TOP_TITLES) -> DataFrame:
    """Related titles by canonical name; recall rows may have none and keep their own."""
    name = F.coalesce("canonical_title", "job_title").alias("title")
    counts = matched.select("query_id", name).groupBy("query_id", "title").agg(
        F.count("*").alias("cnt"))
    return top_k_per_group(counts, ["query_id"], [F.desc("cnt"), F.asc("title")], k, rank="rank")


def add_facts(*parts: DataFrame) -> DataFrame:
    """Facts of disjoint matched sets, summed."""
    columns = ["query_id", "kind", "value", "cnt"]
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out.groupBy("query_id", "kind", "value").agg(F.sum("cnt").alias("cnt"))


def skill_report(facts: DataFrame, queries: DataFrame) -> DataFrame:
    """One row per query: counts, top skills with share, related titles.

    The full skill list of a query is unbounded; take it from ``all_skills``.
    """
    skills = top_skills(facts).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(
        "rank", F.col("skill").alias("name"), F.col("cnt").alias("count"),
        F.col("pct").cast("float").alias("percentage")))).alias("skills"))
    titles = related_titles(facts).groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "title"))),
        lambda t: t["title"]).alias("related_titles"))
    return (queries.join(job_totals(facts).drop("job_total"), "query_id", "left")
            .join(skills, "query_id", "left").join(titles, "query_id", "left")
            .withColumn("job_count", F.coalesce("job_count", F.lit(0)))
            .withColumn("skills_count", F.coalesce("skills_count", F.lit(0))))


def demand_bars(top: DataFrame) -> DataFrame:
    """Bar width relative to the leading skill of the query, with shown rank and percentage."""
    leader = F.greatest(F.max("pct").over(Window.partitionBy("query_id")), F.lit(1.0))
    return top.select(
        "query_id", "rank", "skill", "cnt", "pct",
        F.floor(F.col("pct") + 0.5).cast("long").alias("shown_pct"),
        (F.col("pct") / leader * 100).alias("bar"))


def corpus_profile(postings: DataFrame) -> DataFrame:
    """Postings and mean skills per posting; a posting without skills is not averaged."""
    sizes = F.nullif(F.size("skills"), F.lit(0))
    return postings.agg(F.count("*").alias("postings"),
                        F.floor(F.avg(sizes) + 0.5).cast("int").alias("avg_skills"))


def newest_postings(postings: DataFrame, k: int = 10) -> DataFrame:
    return (postings.select("posting_id", "job_title", "seniority", "posting_year", "posted_date",
                            F.nullif(F.size("skills"), F.lit(0)).alias("n_skills"))
            .orderBy(F.desc_nulls_first("posted_date"), "posting_id").limit(k))


def fallback_rate(plans: DataFrame) -> DataFrame:
    """Share of queries the title map did not resolve."""
    missed = (F.col("mode") == "fallback").cast("int")
    return plans.agg(F.count("*").alias("queries"), F.sum(missed).alias("fallbacks"),
                     F.avg(missed).alias("fallback_rate"))
