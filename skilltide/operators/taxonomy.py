"""Title taxonomy: decisions, merges, folds, vocabulary review, coverage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from itertools import chain
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.text import _col, bind
from ..functions.vectors import cosine, round_vector
from .keys import insert_absent
from .scale import cut_lineage
from .similarity import trigram_pairs
from .vector_search import vector_search

# Caps of an accepted decision, thresholds of merge and fold proposals.
MAX_SPECS = 4
MAX_CANONICAL_WORDS = 6
MERGE_COSINE = 0.92
MERGE_TRIGRAM = 0.6
FOLD_MIN_POSTINGS = 15

_DECISION_KEYS = ("canonical_title", "role_family", "specializations")
_TEXTS = "array<string>"


# Decisions ---------------------------------------------------------------------------------

def rule_classifier(key: Column | str, families: Sequence[str], specs: Sequence[str]) -> Column:
    """Default classifier as a Column: the longest known family inside the rewritten key and
    the known specializations that occur in it, as JSON text."""
    canonical = X.rewrite_head_noun(_col(key))

    def present(names: Sequence[str]) -> Column:
        listed = F.array(*[F.lit(n) for n in names]) if names else F.array().cast(_TEXTS)
        return bind(F.concat(F.lit(" "), canonical, F.lit(" ")), lambda padded: F.filter(
            listed, lambda n: F.contains(padded, F.concat(F.lit(" "), n, F.lit(" ")))))

    longest_first = sorted(families, key=lambda f: (-len(f), f))
    return F.to_json(F.struct(
        canonical.alias("canonical_title"),
        F.get(present(longest_first), 0).alias("role_family"),
        F.slice(present(specs), 1, MAX_SPECS).alias("specializations")),
        {"ignoreNullFields": "false"})


def classify_by_rules(keys: DataFrame, families: DataFrame, specs: DataFrame) -> DataFrame:
    """(key, reply) of ``rule_classifier`` for registries of any size: (family) and (spec) are
    joined to the word runs of the rewritten keys. Specializations come in code-point order."""
    names = families.select(F.col("family").alias("run"), F.lit(True).alias("is_family")).union(
        specs.select("spec", F.lit(False))).filter(F.col("run") != "").distinct()
    row = names.agg(F.max(F.size(F.split("run", " ")))).first()
    longest = row[0] or 1
    distinct = keys.select("key").filter(F.col("key") != "").distinct().withColumn(
        "canonical_title", X.rewrite_head_noun("key"))

    def runs(words: Column) -> Column:
        return F.flatten(F.transform(words, lambda _, i: F.transform(
            F.sequence(F.lit(1), F.least(F.lit(longest), F.size(words) - i)),
            lambda n: F.array_join(F.slice(words, i + 1, n), " "))))

    said = distinct.select("key", F.explode(F.array_distinct(bind(
        F.split("canonical_title", " "), runs))).alias("run"))
    found = said.join(names, "run").groupBy("key").agg(
        F.min(F.when(F.col("is_family"), F.struct((-F.length("run")).alias("n"), "run")))
        .alias("family"),
        F.slice(F.array_sort(F.collect_set(F.when(~F.col("is_family"), F.col("run")))), 1,
                MAX_SPECS).alias("specs"))
    return distinct.join(found, "key", "left").select("key", F.to_json(F.struct(
        "canonical_title", F.col("family.run").alias("role_family"),
        F.coalesce("specs", F.array().cast(_TEXTS)).alias("specializations")),
        {"ignoreNullFields": "false"}).alias("reply"))


def classify_keys(keys: DataFrame, families: Sequence[str], specs: Sequence[str],
                  classifier: Callable[[str, Sequence[str], Sequence[str]], str] | None = None
                  ) -> DataFrame:
    """(key, reply): a classifier's JSON per distinct key; NULL where it failed (transient)."""
    distinct = keys.select("key").filter(F.col("key") != "").distinct()
    if classifier is None:
        return distinct.withColumn("reply", rule_classifier("key", families, specs))
    known, active = list(families), list(specs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def attempt(key: str) -> str | None:
            try:
                return classifier(key, known, active)
            except Exception:
                return None

        for batch in batches:
            yield batch.assign(reply=[attempt(k) for k in batch["key"]])

    return distinct.mapInPandas(run, "key string, reply string")


class Decisions(NamedTuple):
    """Validated decisions, with the vocabulary entries they propose."""

    decisions: DataFrame
    new_families: DataFrame
    new_specs: DataFrame


def _clean(c: Column) -> Column:
    return X.normalize_query(c)


def validate_replies(replies: DataFrame, families: DataFrame, vocabulary: DataFrame
                     ) -> Decisions:
    """Trust boundary between a classifier and the title map. ``replies`` is (key, reply).

    decisions: (key, canonical_title, role_family, specializations, status). 'invalid' is a
    reply that is no JSON object of exactly the three typed fields: it abstains and must not be
    stored. 'capped' has too many specializations or words: a stored abstention. New families
    and unknown specializations are proposed but kept on the decision.

    Replies are parsed once and written: the three results would each parse them again, and a filter
    on what was parsed would be moved below and parse them for every condition.
    """
    doc = F.col("_doc")

    def kind(name: str) -> Column:
        return F.schema_of_variant(F.variant_get(doc, f"$.{name}", "variant"))

    def field(name: str, as_type: str) -> Column:
        return F.try_variant_get(doc, f"$.{name}", as_type)

    keys = F.array_sort(F.json_object_keys(F.when(doc.isNotNull(), F.col("reply"))))
    shape = keys == F.array(*[F.lit(k) for k in _DECISION_KEYS])
    specs = field("specializations", _TEXTS)
    typed = ((kind("canonical_title") == "STRING")
             & kind("role_family").isin("STRING", "VOID")
             & kind("specializations").isin("ARRAY<STRING>", "ARRAY<VOID>")
             & ~F.exists(specs, lambda s: s.isNull()))
    parsed = cut_lineage(replies.withColumn("_doc", F.try_parse_json("reply")).select(
        "key", F.coalesce(shape & typed, F.lit(False)).alias("valid"),
        X.rewrite_head_noun(_clean(field("canonical_title", "string"))).alias("canonical"),
        _clean(field("role_family", "string")).alias("family"),
        F.array_distinct(F.transform(specs, _clean)).alias("specs")))
    capped = ((F.size("specs") > MAX_SPECS)
              | (F.size(F.split("canonical", " ")) > MAX_CANONICAL_WORDS))
    status = (F.when(~F.col("valid"), "invalid").when(capped, "capped").otherwise("accepted"))
    judged = parsed.withColumn("status", status)
    accepted = F.col("status") == "accepted"
    empty = F.array().cast(_TEXTS)
    decisions = judged.select(
        "key", F.when(accepted, F.col("canonical")).otherwise(F.col("key"))
        .alias("canonical_title"),
        F.when(accepted, F.col("family")).alias("role_family"),
        F.when(accepted, F.col("specs")).otherwise(empty).alias("specializations"), "status")
    # Proposals are registered before the caps are looked at.
    usable = judged.filter("valid")
    new_families = (usable.select("family").filter(F.col("family").isNotNull()).distinct()
                    .join(families.select("family"), "family", "left_anti"))
    active = vocabulary.filter(F.col("status") == "active").select("spec")
    new_specs = (usable.select(F.explode("specs").alias("spec")).distinct()
                 .join(active, "spec", "left_anti").withColumn("status", F.lit("pending")))
    return Decisions(decisions, new_families, new_specs)


def register_families(registry: DataFrame, proposed: DataFrame) -> DataFrame:
    """Add families that are not there yet, with no postings counted."""
    rows = proposed.select(
        "family", F.lit(None).cast("string").alias("parent_family"),
        F.lit(0).cast("long").alias("posting_count"),
        F.current_timestamp().alias("created_at"))
    return insert_absent(registry, rows, ["family"])


def register_specs(vocabulary: DataFrame, proposed: DataFrame) -> DataFrame:
    """Add specializations that are not there yet; a rejected one stays rejected."""
    rows = proposed.select("spec", "status", F.current_timestamp().alias("created_at"))
    return insert_absent(vocabulary, rows, ["spec"])


def family_registry(families: DataFrame) -> DataFrame:
    """Families, most populated first."""
    return families.select("family", "posting_count").orderBy(F.desc("posting_count"), "family")


def active_specs(vocabulary: DataFrame) -> DataFrame:
    return vocabulary.filter(F.col("status") == "active").select("spec").orderBy("spec")


def remember_decisions(title_map: DataFrame, decisions: DataFrame, *, source: str,
                       model_version: str | None = None, prompt_version: str | None = None
                       ) -> DataFrame:
    """Store decisions, first writer wins. Invalid replies are not stored, so that a later run
    may decide them; deliberate abstentions are."""
    rows = decisions.filter(F.col("status") != "invalid").select(
        F.col("key").alias("raw_title_norm"), "canonical_title", "role_family",
        "specializations", F.lit(source).alias("source"),
        F.lit(model_version).cast("string").alias("model_version"),
        F.lit(prompt_version).cast("string").alias("prompt_version"),
        F.current_timestamp().alias("decided_at"))
    return insert_absent(title_map, rows, ["raw_title_norm"])


def distinct_titles(postings: DataFrame, *, min_count: int = 1, only_unmapped: bool = True,
                    limit: int | None = None) -> DataFrame:
    """(job_title, n) of titles still to be mapped, most frequent first."""
    rows = postings.filter(F.col("canonical_title").isNull()) if only_unmapped else postings
    counts = (rows.groupBy("job_title").agg(F.count("*").alias("n"))
              .filter(F.col("n") >= min_count).orderBy(F.desc("n"), "job_title"))
    return counts if limit is None else counts.limit(limit)


def stamp_decisions(postings: DataFrame, decided: DataFrame) -> DataFrame:
    """Write decisions onto postings of exactly that raw title that have none yet.

    ``decided`` is (job_title, canonical_title, role_family, specializations). An abstention
    also sets the canonical title: the row counts as processed, its family stays NULL.
    """
    names = ["canonical_title", "role_family", "specializations"]
    new = decided.select("job_title", *[F.col(c).alias(f"_{c}") for c in names])
    fresh = F.col("canonical_title").isNull() & F.col("_canonical_title").isNotNull()
    out = postings.join(new, "job_title", "left")
    stamped = {c: F.when(fresh, F.col(f"_{c}")).otherwise(F.col(c)) for c in names}
    return out.select(*[stamped.get(c, F.col(c)).alias(c) for c in postings.columns])


# Merges and folds --------------------------------------------------------------------------

def canonical_titles(title_map: DataFrame) -> DataFrame:
    """(canonical_title, role_family) of placed titles; of several families the least."""
    return (title_map.filter(F.col("role_family").isNotNull()).groupBy("canonical_title")
            .agg(F.min("role_family").alias("role_family"),
                 F.count_distinct("role_family").alias("n_families")))


def merge_proposals(canonicals: DataFrame, vectors: DataFrame, counts: DataFrame, *, dim: int,
                    cos_threshold: float = MERGE_COSINE, trgm_threshold: float = MERGE_TRIGRAM
                    ) -> DataFrame:
    """(keep, merge_from, cos, trgm, count_keep, count_merge, same_family).

    Pairs come from two generators, the trigram join and the vector search, each exact for its
    own threshold; both scores are then computed for every pair. The title with more postings is
    kept, then the shorter one. Pairs of two families are only flagged.
    canonicals: (canonical_title, role_family); vectors: (canonical_title, vector);
    counts: (canonical_title, n).
    """
    by_text = trigram_pairs(canonicals, canonicals, "canonical_title", "canonical_title",
                            threshold=trgm_threshold, less_than=True).select(
        F.col("left_text").alias("a"), F.col("right_text").alias("b"))
    known = vectors.join(canonicals.select("canonical_title"), "canonical_title", "left_semi")
    by_vector = vector_search(
        known, known.select(F.col("canonical_title").alias("query_id"),
                            F.col("vector").alias("query_vector")),
        dim=dim, floor=cos_threshold, inclusive=True, id_col="canonical_title",
        vector_col="vector", faceted=False).filter(
        F.col("query_id") < F.col("posting_id")).select(
        F.col("query_id").alias("a"), F.col("posting_id").alias("b"))
    pairs = by_text.unionByName(by_vector).distinct()
    facts = canonicals.join(vectors, "canonical_title", "left").join(
        counts, "canonical_title", "left").select(
        "canonical_title", "role_family", "vector", F.coalesce("n", F.lit(0)).alias("n"))

    def side(name: str) -> DataFrame:
        return facts.select(F.col("canonical_title").alias(name),
                            *[F.col(c).alias(f"{c}_{name}") for c in
                              ("role_family", "vector", "n")])

    scored = pairs.join(side("a"), "a").join(side("b"), "b")
    a_first = ((F.col("n_a") > F.col("n_b"))
               | ((F.col("n_a") == F.col("n_b")) & (F.length("a") <= F.length("b"))))
    cos = F.coalesce(F.round(cosine(round_vector("vector_a"), round_vector("vector_b")), 9), F.lit(0.0))
    return scored.select(
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("keep"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("merge_from"),
        cos.alias("cos"), X.trigram_similarity("a", "b").alias("trgm"),
        F.greatest("n_a", "n_b").alias("count_keep"), F.least("n_a", "n_b").alias("count_merge"),
        F.col("role_family_a").eqNullSafe(F.col("role_family_b")).alias("same_family")
    ).orderBy(F.desc(F.greatest("cos", "trgm")), "keep", "merge_from")


def final_targets(merges: DataFrame) -> DataFrame:
    """(merge_from, keep) with chains resolved: A->B and B->C send A to C.

    Every title goes one way only (of several proposals the least ``keep``). Each round doubles
    the resolved length; a circle of renames is an error.
    """
    links = merges.groupBy("merge_from").agg(F.min("keep").alias("keep"))
    links = cut_lineage(links.filter(F.col("merge_from") != F.col("keep")))
    longest = 2 * max(1, links.count())
    reach = 1
    while True:
        ahead = links.select(F.col("merge_from").alias("keep"), F.col("keep").alias("_next"))
        open_ends = links.join(ahead, "keep", "left")
        if open_ends.filter(F.col("_next").isNotNull()).isEmpty():
            return links
        if reach > longest or not open_ends.filter(F.col("_next") == F.col("merge_from")).isEmpty():
            raise ValueError("the merges form a circle")
        links = cut_lineage(open_ends.select(
            "merge_from", F.coalesce("_next", "keep").alias("keep")))
        reach *= 2


def rename_values(table: DataFrame, column: str, targets: DataFrame, *,
                  mark: Mapping[str, str] | None = None) -> DataFrame:
    """Replace values of a column by (merge_from, keep); ``mark`` sets other columns there."""
    mark = mark or {}
    moved = table.join(targets.select(F.col("merge_from").alias(column), "keep"), column, "left")
    hit = F.col("keep").isNotNull()
    return moved.select(*[
        F.coalesce("keep", column).alias(column) if c == column
        else F.when(hit, F.lit(mark[c])).otherwise(F.col(c)).alias(c) if c in mark
        else F.col(c) for c in table.columns])


def apply_merges(title_map: DataFrame, postings: DataFrame, merges: DataFrame
                 ) -> tuple[DataFrame, DataFrame]:
    """Rename merged canonical titles in both tables."""
    targets = final_targets(merges)
    return (rename_values(title_map, "canonical_title", targets, mark={"source": "merge"}),
            rename_values(postings, "canonical_title", targets))


def family_folds(postings: DataFrame, family_vectors: DataFrame, *, dim: int,
                 min_count: int = FOLD_MIN_POSTINGS) -> DataFrame:
    """(family, n, target, similarity): the nearest big family of every small one.

    Only families with postings take part. family_vectors: (family, vector).
    """
    counts = (postings.filter(F.col("role_family").isNotNull())
              .groupBy(F.col("role_family").alias("family")).agg(F.count("*").alias("n")))
    sized = counts.join(family_vectors, "family")
    small = sized.filter(F.col("n") < min_count)
    near = vector_search(
        sized.filter(F.col("n") >= min_count),
        small.select(F.col("family").alias("query_id"), F.col("vector").alias("query_vector")),
        dim=dim, k=1, id_col="family", vector_col="vector", faceted=False)
    return small.select("family", "n").join(
        near.select(F.col("query_id").alias("family"), F.col("posting_id").alias("target"),
                    F.col("score").alias("similarity")), "family")


def apply_folds(title_map: DataFrame, postings: DataFrame, registry: DataFrame,
                folds: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Move folded families in both tables and delete them from the registry."""
    targets = final_targets(folds.select(F.col("family").alias("merge_from"),
                                         F.col("target").alias("keep")))
    gone = targets.select(F.col("merge_from").alias("family"))
    return (rename_values(title_map, "role_family", targets),
            rename_values(postings, "role_family", targets),
            registry.join(gone, "family", "left_anti"))


# Specialization review ---------------------------------------------------------------------

def pending_usage(vocabulary: DataFrame, postings: DataFrame) -> DataFrame:
    """(spec, n): postings that carry each pending specialization, unused ones included."""
    pending = vocabulary.filter(F.col("status") == "pending").select("spec")
    used = (postings.select(F.explode(F.array_distinct("specializations")).alias("spec"))
            .groupBy("spec").agg(F.count("*").alias("n")))
    return pending.join(used, "spec", "left").select(
        "spec", F.coalesce("n", F.lit(0)).alias("n")).orderBy(F.desc("n"), "spec")


def replace_specs(specs: Column | str, *, merge: Mapping[str, str] = {},
                  reject: Sequence[str] = ()) -> Column:
    """Specializations with synonyms replaced and rejected ones removed, without repeats."""
    final: dict[str, str] = {}
    for old, new in merge.items():  # in the given order, so that a -> b, b -> c ends at c
        final = {k: new if v == old else v for k, v in final.items()}
        final.setdefault(old, new)
    out = _col(specs)
    if final:
        names = F.create_map(*[F.lit(x) for x in chain.from_iterable(final.items())])
        out = F.transform(out, lambda s: F.coalesce(F.try_element_at(names, s), s))
    if reject:
        out = F.filter(out, lambda s: ~F.coalesce(s.isin(list(reject)), F.lit(False)))
    return F.array_distinct(out)


def review_specs(vocabulary: DataFrame, title_map: DataFrame, postings: DataFrame, *,
                 promote: Sequence[str] = (), reject: Sequence[str] = (),
                 merge: Mapping[str, str] | None = None
                 ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Apply a review in the vocabulary and in both tables. A merged synonym is rejected."""
    merge = dict(merge or {})
    spec = F.col("spec")
    status = (F.when(spec.isin(*reject, *merge), "rejected").when(spec.isin(*promote), "active")
              .otherwise(F.col("status")))
    touched = [*reject, *merge]
    mentions = F.arrays_overlap("specializations", F.array(*[F.lit(t) for t in touched])) \
        if touched else F.lit(False)
    revised = F.when(mentions, replace_specs("specializations", merge=merge, reject=reject)
                     ).otherwise(F.col("specializations"))
    return (vocabulary.withColumn("status", status),
            title_map.withColumn("specializations", revised),
            postings.withColumn("specializations", revised))


# Counts, tree and coverage -----------------------------------------------------------------

def refresh_family_counts(registry: DataFrame, postings: DataFrame) -> DataFrame:
    """Posting counts of all families, zeros included."""
    counts = (postings.filter(F.col("role_family").isNotNull())
              .groupBy(F.col("role_family").alias("family")).agg(F.count("*").alias("_n")))
    fresh = F.coalesce("_n", F.lit(0)).cast(registry.schema["posting_count"].dataType)
    return registry.join(counts, "family", "left").select(*[
        fresh.alias(c) if c == "posting_count" else F.col(c) for c in registry.columns])


def taxonomy_tree(postings: DataFrame) -> DataFrame:
    """(role_family, canonical_title, specializations, posting_count); arrays are compared in
    order, so [a, b] and [b, a] are two rows."""
    return (postings.filter(F.col("role_family").isNotNull())
            .groupBy("role_family", "canonical_title", "specializations")
            .agg(F.count("*").alias("posting_count")))


def taxonomy_lines(tree: DataFrame) -> DataFrame:
    """The tree as text lines in order: '## family (total)', then '- title {specs} (n)'.

    Lines are rows of one range-partitioned sort, so a family may have any number of them.
    """
    heads = tree.groupBy("role_family").agg(F.sum("posting_count").alias("total")).select(
        "role_family", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"),
        F.lit("").alias("tie"),
        F.format_string("## %s (%d)", "role_family", "total").alias("line"))
    specs = F.array_join("specializations", ", ")
    items = tree.select(
        "role_family", F.lit(1).alias("part"), (-F.col("posting_count")).alias("place"),
        F.concat_ws("\u0001", "canonical_title", specs).alias("tie"),
        F.format_string("- %s {%s} (%d)", "canonical_title", specs, "posting_count")
        .alias("line"))
    return heads.unionByName(items).orderBy("role_family", "part", "place", "tie").select("line")


def coverage_totals(postings: DataFrame) -> DataFrame:
    placed = F.count("role_family")
    return postings.agg(
        F.count("*").alias("postings"), placed.alias("placed"),
        (placed * 100.0 / F.nullif(F.count("*"), F.lit(0))).alias("pct"))


def coverage_by_family(postings: DataFrame) -> DataFrame:
    return (postings.filter(F.col("role_family").isNotNull()).groupBy("role_family")
            .agg(F.count("*").alias("n")).orderBy(F.desc("n"), "role_family"))


def unmapped_titles(postings: DataFrame, k: int = 20) -> DataFrame:
    """Most frequent titles without a family: never processed, or abstained on purpose."""
    state = F.when(F.col("canonical_title").isNull(), "unprocessed").otherwise("abstained")
    return (postings.filter(F.col("role_family").isNull()).groupBy("job_title")
            .agg(F.count("*").alias("n"),
                 F.sum((state == "unprocessed").cast("long")).alias("unprocessed"),
                 F.sum((state == "abstained").cast("long")).alias("abstained"))
            .orderBy(F.desc("n"), "job_title").limit(k))
