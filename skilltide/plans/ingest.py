"""Raw posting -> posting row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..functions import text as X
from ..operators.extract import (
    Embedder,
    Extractor,
    with_clean_skills,
    with_embedding,
    with_extracted,
)
from ..schemas import POSTING
from ..sources.pages import FieldSelectors, page_fields
from ..vocabulary import CANONICAL_SKILLS, TECH_CAPITALIZATION

COLUMNS = [f.name for f in POSTING.fields]


def build_postings(raw: DataFrame, *, extractor: Extractor | None = None,
                   embedder: Embedder | None = None, spellings: Sequence[str] | None = None,
                   canonical: Mapping[str, str] = CANONICAL_SKILLS,
                   capitalization: Mapping[str, str] = TECH_CAPITALIZATION,
                   vector_dim: int = 64) -> DataFrame:
    """Posting columns, ``error``, and all other columns of ``raw`` (arrival, lineage).

    Facets are read off the raw title. Without a URL the id is random: cut the lineage before
    such rows are used twice. Rows with an ``error`` belong in the dead-letter sink.
    """
    carried = [c for c in raw.columns if c not in (
        "job_title", "company", "job_description", "job_url", "posted_date")]
    rows = raw.withColumn("job_title", F.coalesce("job_title", F.lit(""))).withColumn(
        "_body", F.coalesce("job_description", F.lit(""))).withColumn(
        "_day", F.try_to_date("posted_date"))
    rows = with_extracted(rows, "_body", extractor, spellings=spellings)
    rows = with_clean_skills(rows, "raw_skills", canonical, capitalization, out="_skills")
    rows = with_embedding(rows, "job_title", embedder, dim=vector_dim)
    bad_day = (F.coalesce("posted_date", F.lit("")) != "") & F.col("_day").isNull()
    error = (F.when(bad_day, "bad posted_date")
             .when(F.col("raw_skills").isNull(), "extraction failed")
             .when(F.col("title_embedding").isNull(), "embedding failed"))
    return rows.select(
        F.coalesce(ids.posting_id("job_url"), F.uuid()).alias("posting_id"),
        "job_title", "company",
        F.col("_skills").alias("skills"),
        X.seniority("job_title").alias("seniority"),
        X.posting_year("job_title", "_day").alias("posting_year"),
        F.col("_day").alias("posted_date"), "title_embedding",
        ids.content_hash("company", "job_title", "_body").alias("content_hash"),
        error.alias("error"), *carried)


def raw_from_pages(pages: DataFrame, day: Column, *,
                   selectors: FieldSelectors = FieldSelectors()) -> DataFrame:
    """Raw postings of fetched pages (url, html), scraped on ``day``; ``error`` marks pages to
    drop for good."""
    found = page_fields(pages, selectors=selectors)
    return found.select("job_title", "company", "job_description", F.col("url").alias("job_url"),
                        F.date_format(day, "yyyy-MM-dd").alias("posted_date"), "error")


def split_failures(built: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows to insert, dead letters)."""
    return built.filter(F.col("error").isNull()).drop("error"), built.filter(
        F.col("error").isNotNull())
