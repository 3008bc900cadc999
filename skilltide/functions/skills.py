"""Skill spelling rules."""

from __future__ import annotations

from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..vocabulary import CANONICAL_SKILLS, TECH_CAPITALIZATION
from .text import SPACE, _col, bind, strip

# An alias table rides in the plan as a literal; ``with_clean_skills`` joins larger ones.
MAX_LITERAL_ALIASES = 5_000


def lookup(c: Column, table: Mapping[str, str]) -> Column:
    """Value of a small literal table, or the text itself where it has no entry."""
    if len(table) > MAX_LITERAL_ALIASES:
        raise ValueError(f"alias table of {len(table)} entries: use with_clean_skills")
    if not table:
        return c
    literal = F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])
    return F.coalesce(F.try_element_at(literal, c), c)


def _unwrap_brackets(c: Column) -> Column:
    return F.regexp_replace(c, r"\(([^)]+)\)", "$1")


def bare_skills(c: Column | str) -> Column:
    """One raw skill -> array of lower-case skills before any alias lookup. A '/' separates
    skills; punctuation other than '+' and '#' goes."""
    parts = bind(_unwrap_brackets(F.lower(strip(c))), lambda text: F.when(
        F.contains(text, F.lit("/")), F.transform(
            F.split(text, "/"), lambda p: _unwrap_brackets(strip(p)))).otherwise(F.array(text)))
    return F.transform(parts, lambda p: F.regexp_replace(p, rf"[^\p{{L}}\p{{N}}_{SPACE}+#]", ""))


def normalize_skill(c: Column | str, canonical: Mapping[str, str] = CANONICAL_SKILLS,
                    capitalization: Mapping[str, str] = TECH_CAPITALIZATION) -> Column:
    """One raw skill -> array of skills: ``bare_skills`` after the two alias lookups; names
    without an alias stay lower-case."""
    named = F.transform(bare_skills(c), lambda p: lookup(p, canonical))
    return F.transform(named, lambda p: lookup(p, capitalization))


def clean_skills(raw: Column | str, canonical: Mapping[str, str] = CANONICAL_SKILLS,
                 capitalization: Mapping[str, str] = TECH_CAPITALIZATION, *,
                 drop_empty: bool = False) -> Column:
    """Array of raw skills -> distinct skills in code-point order; NULL gives no skills.

    Skills made of punctuation only become '' and are kept unless ``drop_empty``.
    """
    raw = F.filter(F.coalesce(_col(raw), F.array().cast("array<string>")),
                   lambda s: s.isNotNull())
    out = F.array_distinct(F.flatten(F.transform(
        raw, lambda s: normalize_skill(s, canonical, capitalization))))
    return F.array_sort(F.filter(out, lambda s: s != "") if drop_empty else out)


def parse_skills_json(reply: Column | str) -> Column:
    """The 'skills' of an extractor's JSON reply as array<string>.

    A single value counts as a list of one, entries that are not text are dropped, a missing
    key gives no skills, and text that is not JSON gives NULL.
    """
    doc = F.try_parse_json(_col(reply))
    value = F.variant_get(doc, "$.skills", "variant")
    kind = F.schema_of_variant(value)
    entries = F.when(kind.startswith("ARRAY"), F.try_variant_get(value, "$", "array<variant>"))
    texts = F.transform(
        F.filter(entries, lambda v: F.schema_of_variant(v) == "STRING"),
        lambda v: F.variant_get(v, "$", "string"))
    single = F.when(kind == "STRING", F.array(F.variant_get(value, "$", "string")))
    return F.when(doc.isNotNull(),
                  F.coalesce(texts, single, F.array().cast("array<string>")))
