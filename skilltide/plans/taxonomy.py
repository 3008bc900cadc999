"""Taxonomy runs: title backfill and reconcile."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import taxonomy as tax
from ..operators.scale import cut_lineage
from ..schemas import require_columns


class TitleBackfill(NamedTuple):
    """The updated tables, the classifier's decisions and what each title (with its number of
    postings, ``n``) was mapped to."""

    postings: DataFrame
    title_map: DataFrame
    families: DataFrame
    vocabulary: DataFrame
    decisions: DataFrame
    titles: DataFrame


# A registry rides in the request of a plugged classifier, so it must stay a short list there.
MAX_REGISTRY = 10_000


def _names(df: DataFrame, column: str) -> list[str]:
    rows = df.select(column).limit(MAX_REGISTRY + 1).collect()
    if len(rows) > MAX_REGISTRY:
        raise ValueError(f"more than {MAX_REGISTRY} entries in a registry")
    return [r[column] for r in rows]


def decide_titles(keys: DataFrame, title_map: DataFrame, families: DataFrame,
                  vocabulary: DataFrame, classifier: Callable | None = None) -> tax.Decisions:
    """Classify each distinct key the map does not know, once."""
    unknown = keys.select("key").distinct().join(
        title_map.select(F.col("raw_title_norm").alias("key")), "key", "left_anti")
    if classifier is None:
        replies = tax.classify_by_rules(unknown, families, tax.active_specs(vocabulary))
    else:
        replies = tax.classify_keys(
            unknown, _names(tax.family_registry(families), "family"),
            _names(tax.active_specs(vocabulary), "spec"), classifier)
    replies = cut_lineage(replies)
    return tax.validate_replies(replies, families, vocabulary)


def backfill_titles(postings: DataFrame, title_map: DataFrame, families: DataFrame,
                    vocabulary: DataFrame, *, classifier: Callable | None = None,
                    source: str = "backfill", min_count: int = 1, limit: int | None = None,
                    ascii_only: bool = False) -> TitleBackfill:
    """Map all unmapped titles. Known keys come from the map; a failed classification leaves
    an abstention on the posting's row but nothing in the map, so a later run can decide it."""
    require_columns(postings, "job_title", "canonical_title", "role_family", "specializations")
    titles = tax.distinct_titles(postings, min_count=min_count, limit=limit).withColumn(
        "key", X.title_key("job_title", ascii_only=ascii_only))
    titles = cut_lineage(titles)
    found = decide_titles(
        titles, title_map, families, vocabulary, classifier)
    decisions = cut_lineage(found.decisions)
    new_map = tax.remember_decisions(title_map, decisions, source=source)
    known = title_map.select(F.col("raw_title_norm").alias("key"), "canonical_title",
                             "role_family", "specializations")
    fresh = decisions.drop("status")
    decided = titles.join(known.unionByName(fresh), "key", "left").select(
        "job_title", "n", "key", F.coalesce("canonical_title", "key").alias("canonical_title"),
        "role_family", F.coalesce("specializations", F.array().cast("array<string>"))
        .alias("specializations"))
    decided = cut_lineage(decided)
    return TitleBackfill(
        tax.stamp_decisions(postings, decided), new_map,
        tax.register_families(families, found.new_families),
        tax.register_specs(vocabulary, found.new_specs), decisions, decided)


def title_tally(run: TitleBackfill) -> DataFrame:
    """(counter, n): titles processed, rows updated, abstentions, classifier calls, cache hits
    (titles whose key was known or came up again) and errors."""
    titles = run.titles.agg(
        F.count("*").alias("titles_processed"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_updated"),
        F.count_if(F.col("role_family").isNull()).alias("abstentions"),
        F.count_if(F.col("key") != "").alias("keyed"))
    calls = run.decisions.agg(F.count("*").alias("classifier_calls"),
                              F.count_if(F.col("status") == "invalid").alias("errors"))
    # Two rows of totals side by side, as scalars.
    both = titles.select("*", calls.select("classifier_calls").scalar().alias("classifier_calls"),
                         calls.select("errors").scalar().alias("errors"))
    counters = ["titles_processed", "rows_updated", "abstentions", "classifier_calls",
                "cache_hits", "errors"]
    return both.withColumn("cache_hits", F.col("keyed") - F.col("classifier_calls")).select(
        *counters).unpivot([], counters, "counter", "n")


def export_taxonomy(postings: DataFrame, path: str) -> None:
    """Write the taxonomy tree as text; the part files are in order."""
    tax.taxonomy_lines(tax.taxonomy_tree(postings)).write.mode("overwrite").text(path)


class Reconciled(NamedTuple):
    title_map: DataFrame
    postings: DataFrame
    families: DataFrame
    vocabulary: DataFrame
    merges: DataFrame
    folds: DataFrame
    pending: DataFrame


def reconcile(title_map: DataFrame, postings: DataFrame, families: DataFrame,
              vocabulary: DataFrame, title_vectors: DataFrame, family_vectors: DataFrame, *,
              dim: int, apply: bool = False, apply_folds: bool = False,
              promote: Sequence[str] = (), reject: Sequence[str] = (),
              merge: Mapping[str, str] | None = None) -> Reconciled:
    """Merges, folds, pending specializations, then fresh counts; proposals only by default."""
    counts = (postings.filter(F.col("canonical_title").isNotNull()).groupBy("canonical_title")
              .agg(F.count("*").alias("n")))
    merges = cut_lineage(tax.merge_proposals(
        tax.canonical_titles(title_map), title_vectors, counts, dim=dim))
    if apply:
        title_map, postings = tax.apply_merges(
            title_map, postings, merges.filter("same_family").select("keep", "merge_from"))
    folds = cut_lineage(tax.family_folds(postings, family_vectors, dim=dim))
    if apply_folds:
        title_map, postings, families = tax.apply_folds(title_map, postings, families, folds)
    pending = tax.pending_usage(vocabulary, postings)
    if promote or reject or merge:
        vocabulary, title_map, postings = tax.review_specs(
            vocabulary, title_map, postings, promote=promote, reject=reject, merge=merge)
    return Reconciled(title_map, postings, tax.refresh_family_counts(families, postings),
                      vocabulary, merges, folds, pending)
