"""Explicit table schemas. Nothing in this package infers a schema."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

_TEXTS = T.ArrayType(T.StringType(), False)
_VECTOR = T.ArrayType(T.FloatType(), False)

RAW_POSTING = T.StructType([
    T.StructField("job_title", T.StringType()),
    T.StructField("company", T.StringType()),
    T.StructField("job_description", T.StringType()),
    T.StructField("job_url", T.StringType()),
    T.StructField("posted_date", T.StringType()),
])

POSTING = T.StructType([
    T.StructField("posting_id", T.StringType(), False),
    T.StructField("job_title", T.StringType(), False),
    T.StructField("company", T.StringType()),
    T.StructField("skills", _TEXTS, False),
    T.StructField("seniority", T.StringType()),
    T.StructField("posting_year", T.IntegerType()),
    T.StructField("posted_date", T.DateType()),
    T.StructField("title_embedding", _VECTOR),
    T.StructField("content_hash", T.StringType()),
])

TAXONOMY_FIELDS = T.StructType([
    T.StructField("canonical_title", T.StringType()),
    T.StructField("role_family", T.StringType()),
    T.StructField("specializations", _TEXTS, False),
])

PROJECT = T.StructType([
    T.StructField("project_id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("blurb", T.StringType(), False),
    T.StructField("skills", _TEXTS, False),
    T.StructField("support_count", T.IntegerType(), False),
    T.StructField("lift", T.FloatType()),
    T.StructField("score", T.FloatType(), False),
    T.StructField("skills_key", T.StringType(), False),
    T.StructField("generated_at", T.TimestampType(), False),
])

TITLE_MAP = T.StructType([
    T.StructField("raw_title_norm", T.StringType(), False),
    T.StructField("canonical_title", T.StringType(), False),
    T.StructField("role_family", T.StringType()),
    T.StructField("specializations", _TEXTS, False),
    T.StructField("source", T.StringType(), False),
    T.StructField("model_version", T.StringType()),
    T.StructField("prompt_version", T.StringType()),
    T.StructField("decided_at", T.TimestampType(), False),
])

ROLE_FAMILY = T.StructType([
    T.StructField("family", T.StringType(), False),
    T.StructField("parent_family", T.StringType()),
    T.StructField("posting_count", T.LongType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

SPEC_VOCABULARY = T.StructType([
    T.StructField("spec", T.StringType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Fail before any work starts when a migration has not been applied."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; have {df.columns}")
    return df


def with_taxonomy_defaults(df: DataFrame) -> DataFrame:
    """Add the three title-decision columns where absent (empty array, never NULL)."""
    from pyspark.sql import functions as F

    for field in TAXONOMY_FIELDS:
        if field.name not in df.columns:
            df = df.withColumn(field.name, F.lit(None).cast(field.dataType))
    return df.withColumn(
        "specializations", F.coalesce("specializations", F.array().cast(_TEXTS)))
