"""Matched sets: hybrid (vector and trigram), structured (title map), and their seam.

Queries are rows: (query_id, query_text, query_vector, seniority_filter, year_floor); a single
question is a one-row frame. Both ways give (query_id, posting_id, job_title, canonical_title,
skills), so everything downstream is the same.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..schemas import with_taxonomy_defaults
from .scale import cut_lineage, salted_join, top_k_per_group
from .similarity import SIMILARITY_GATE, trigram_pairs
from .vector_search import SCORE_DECIMALS, vector_search


@dataclass(frozen=True)
class HybridSettings:
    """Pool sizes, weights and the relevance floor of a hybrid match."""

    semantic_pool: int = 500
    lexical_pool: int = 500
    match_limit: int = 2000
    vector_weight: float = 0.4
    trigram_weight: float = 0.6
    floor: float = 0.80
    similarity_gate: float = SIMILARITY_GATE

    @property
    def needs_both(self) -> bool:
        """A posting in one pool only cannot pass the floor."""
        return max(self.vector_weight, self.trigram_weight) <= self.floor


@dataclass(frozen=True)
class RecallSettings:
    """Floor and size of the pool of postings without a family."""

    floor: float = 0.86
    pool: int = 200


def queries_from_text(raw: DataFrame, text: str = "text") -> DataFrame:
    """Add the normalized text and the facets that the raw text asks for."""
    return (raw.withColumn("query_text", X.normalize_query(text))
            .withColumn("seniority_filter", X.query_seniority_filter(text))
            .withColumn("year_floor", X.year_token(text)))


def facet_match(seniority: Column, year: Column, wanted: Column, floor: Column) -> Column:
    """Three-valued: a NULL facet is excluded as soon as its filter is set."""
    return ((wanted.isNull() | (seniority == wanted) | (seniority == "unknown"))
            & (floor.isNull() | (year >= floor)))


def _facets() -> Column:
    return facet_match(F.col("seniority"), F.col("posting_year"),
                       F.col("seniority_filter"), F.col("year_floor"))


def contains_all(have: Column | str, wanted: Column | str) -> Column:
    """Asymmetric containment: every wanted element is there; nothing wanted is always there."""
    return F.size(F.array_except(wanted, have)) == 0


def semantic_pool(postings: DataFrame, queries: DataFrame, *, dim: int, k: int,
                  floor: float | None = None) -> DataFrame:
    return (vector_search(postings, queries, dim=dim, k=k, floor=floor)
            .withColumnRenamed("score", "vec_sim"))


def lexical_pool(postings: DataFrame, queries: DataFrame, *, k: int,
                 gate: float = SIMILARITY_GATE) -> DataFrame:
    """Best k titles by trigram similarity. Texts are compared once per distinct title.

    Postings of one title, seniority and year are alike to every query but for their id, so only
    the first k of them can be in a pool. They are cut to those before the queries multiply
    them, which keeps a title that a third of all postings have from flooding the join.
    """
    pairs = cut_lineage(trigram_pairs(queries, postings, "query_text", "job_title",
                                      threshold=gate))
    asked = queries.select("query_id", "query_text", "seniority_filter", "year_floor")
    scored = asked.join(pairs, F.col("query_text") == F.col("left_text")).select(
        "query_id", "seniority_filter", "year_floor",
        F.col("right_text").alias("job_title"), F.col("similarity").alias("trgm_sim"))
    rows = postings.select("posting_id", "job_title", "seniority", "posting_year").join(
        pairs.select(F.col("right_text").alias("job_title")).distinct(), "job_title", "left_semi")
    alike = ["job_title", "seniority", "posting_year"]
    first = top_k_per_group(rows, alike, [F.asc("posting_id")], k, spread_on=["posting_id"])
    hits = first.join(scored, "job_title").filter(_facets()).select(
        "query_id", "posting_id", "trgm_sim")
    return top_k_per_group(hits, ["query_id"], [F.desc("trgm_sim"), F.asc("posting_id")], k,
                           spread_on=["posting_id"])


def blend(semantic: DataFrame, lexical: DataFrame, settings: HybridSettings,
          how: str | None = None) -> DataFrame:
    """Merge the pools; a posting in one pool only scores 0 on the other signal.

    Where the weights let such a posting never pass the floor, an inner join gives the same
    rows as the full outer one and moves less.
    """
    how = how or ("inner" if settings.needs_both else "full_outer")
    both = semantic.join(lexical, ["query_id", "posting_id"], how).select(
        "query_id", "posting_id",
        F.coalesce("vec_sim", F.lit(0.0)).alias("vec_sim"),
        F.coalesce("trgm_sim", F.lit(0.0)).alias("trgm_sim"))
    combined = F.round(F.col("vec_sim") * settings.vector_weight
                       + F.col("trgm_sim") * settings.trigram_weight, SCORE_DECIMALS)
    return both.withColumn("combined", combined).filter(F.col("combined") > settings.floor)


def hybrid_scores(postings: DataFrame, queries: DataFrame, *, dim: int,
                  settings: HybridSettings = HybridSettings(), prune: bool = True) -> DataFrame:
    """(query_id, posting_id, vec_sim, trgm_sim, combined) of the matched set.

    ``prune`` drops from each pool what its own score already rules out. This never changes
    which rows are above the rest, so pools and result stay the same.
    """
    gate, vec_floor = settings.similarity_gate, None
    if prune and settings.needs_both:
        slack = 1e-6
        gate = max(gate, (settings.floor - settings.vector_weight)
                   / settings.trigram_weight - slack)
        vec_floor = (settings.floor - settings.trigram_weight) / settings.vector_weight - slack
    matched = blend(
        semantic_pool(postings, queries, dim=dim, k=settings.semantic_pool, floor=vec_floor),
        lexical_pool(postings, queries, k=settings.lexical_pool, gate=gate), settings)
    if settings.semantic_pool + settings.lexical_pool <= settings.match_limit:
        return matched
    return top_k_per_group(matched, ["query_id"], [F.desc("combined"), F.asc("posting_id")],
                           settings.match_limit, spread_on=["posting_id"])


def _payload(postings: DataFrame) -> DataFrame:
    return with_taxonomy_defaults(postings).select(
        "posting_id", "job_title", "canonical_title", "skills")


def hybrid_match(postings: DataFrame, queries: DataFrame, *, dim: int,
                 settings: HybridSettings = HybridSettings(), prune: bool = True) -> DataFrame:
    """Matched postings of every query with what the reports read."""
    scores = hybrid_scores(postings, queries, dim=dim, settings=settings, prune=prune)
    return _payload(postings).join(scores, "posting_id").select(
        "query_id", "posting_id", "job_title", "canonical_title", "skills",
        "vec_sim", "trgm_sim", "combined")


def structured_primary(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """Postings of the query's family that carry all its specializations. No relevance floor. A
    family that a third of all postings have is dealt over many tasks."""
    asked = queries.select(
        "query_id", F.col("role_family"), F.col("specializations").alias("wanted"),
        "seniority_filter", "year_floor")
    rows = with_taxonomy_defaults(postings)
    placed = rows.filter(F.col("role_family").isNotNull())
    return (salted_join(placed, asked, "role_family", spread_on=["posting_id"])
            .filter(contains_all("specializations", "wanted") & _facets())
            .select("query_id", "posting_id", "job_title", "canonical_title", "skills"))


def structured_recall(postings: DataFrame, queries: DataFrame, *, dim: int,
                      settings: RecallSettings = RecallSettings()) -> DataFrame:
    """Nearest postings without a family, above the floor; the limit binds this pool only."""
    unplaced = with_taxonomy_defaults(postings).filter(F.col("role_family").isNull())
    near = vector_search(unplaced, queries, dim=dim, k=settings.pool, floor=settings.floor)
    return _payload(unplaced).join(near, "posting_id").select(
        "query_id", "posting_id", "job_title", "canonical_title", "skills")


def structured_match(postings: DataFrame, queries: DataFrame, *, dim: int,
                     settings: RecallSettings = RecallSettings()) -> DataFrame:
    """Primary and recall rows; disjoint, since one has a family and the other has none."""
    return structured_primary(postings, queries).unionByName(
        structured_recall(postings, queries, dim=dim, settings=settings))


def match_by_mode(postings: DataFrame, plans: DataFrame, *, dim: int,
                  hybrid: HybridSettings = HybridSettings(),
                  recall: RecallSettings = RecallSettings()) -> DataFrame:
    """Resolved queries (mode 'structured') by the title map, the others by hybrid match."""
    shape = ["query_id", "posting_id", "job_title", "canonical_title", "skills"]
    placed = plans.filter(F.col("mode") == "structured")
    loose = plans.filter(F.col("mode") != "structured")
    return (structured_match(postings, placed, dim=dim, settings=recall).select(*shape)
            .unionByName(hybrid_match(postings, loose, dim=dim, settings=hybrid).select(*shape)))
