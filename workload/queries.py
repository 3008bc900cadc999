"""Registered queries: each operator of the package over whole tables, with the SQL to check it.

Arrays are shown as joined text and doubles at six decimals, so that results compare by value.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import suppress

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltide.functions import ids, skills, vectors
from skilltide.functions import text as X
from skilltide.operators import backfill, extract, golden, keys, mining, recommend, report
from skilltide.operators import resolve, retrieval, similarity
from skilltide.operators import taxonomy as tax
from skilltide.operators.scale import cut_lineage, ensure_checkpoint_dir, top_k_per_group
from skilltide.operators.vector_join import vector_join
from skilltide.operators.vector_search import vector_search
from skilltide.plans.ingest import build_postings
from skilltide.plans.search import search
from skilltide.plans.taxonomy import backfill_titles, title_tally
from skilltide.sources import pages, postings, tables
from skilltide.streaming.ingest import ingest_batch, start_ingest
from skilltide.vocabulary import CANONICAL_SKILLS, TECH_CAPITALIZATION

from . import views as V
from .views import table, with_views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = (with_views(*views) if views else "") + sql
        return fn

    return register


def joined(c: Column | str, mark: str = "|") -> Column:
    return F.array_join(c, mark)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


# Text, id and vector functions -----------------------------------------------------------------

@query(f"""
SELECT p_partkey, {V.sql_jaccard('a', 'b')} AS similarity, len(a) AS n_trigrams
FROM (SELECT p_partkey, {V.sql_trigrams("p_name || ' ' || p_type")} AS a,
             {V.sql_trigrams("p_type || ' ' || p_brand")} AS b FROM part)""")
def trigram_similarity(spark, sf):
    a, b = F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_brand")
    grams = table(spark, sf, "part").select("p_partkey", X.trigrams(a).alias("a"),
                                            X.trigrams(b).alias("b"))
    return grams.select("p_partkey", X.jaccard(F.col("a"), F.col("b")).alias("similarity"),
                        F.size("a").cast("long").alias("n_trigrams"))


FACET_RULES = (("urgent", r"\burgent\b"), ("top", r"\b(high|1-[a-z]+)\b"),
               ("open", r"\bstatus[\s\-]?o\b"))


@query(r"""
SELECT o_orderkey, CASE WHEN regexp_matches(t, '(?i)\burgent\b') THEN 'urgent'
         WHEN regexp_matches(t, '(?i)\b(high|1-[a-z]+)\b') THEN 'top'
         WHEN regexp_matches(t, '(?i)\bstatus[\s\-]?o\b') THEN 'open' ELSE 'unknown' END AS level,
       coalesce(nullif(regexp_extract(t, '\b(20\d{2})\b', 1), '')::INT, year(o_orderdate)::INT)
           AS posting_year
FROM (SELECT *, o_orderpriority || ' status-' || o_orderstatus || CASE WHEN o_custkey % 3 = 0
             THEN ' ' || (1990 + o_custkey % 40) ELSE '' END AS t FROM orders)""")
def facets(spark, sf):
    stated = F.when(F.col("o_custkey") % 3 == 0, F.concat(
        F.lit(" "), (F.col("o_custkey") % 40 + 1990).cast("string"))).otherwise("")
    title = F.concat("o_orderpriority", F.lit(" status-"), "o_orderstatus", stated)
    return table(spark, sf, "orders").select(
        "o_orderkey", X.seniority(title, FACET_RULES).alias("level"),
        X.posting_year(title, "o_orderdate").alias("posting_year"))


@query(r"""
SELECT doc_id, trim(regexp_replace(lower(text), '[\s]+', ' ', 'g')) AS query_text,
       coalesce(nullif(trim(regexp_replace(trim(lower(text), e' \t\n\r'), '[^A-Za-z0-9]+', '_', 'g'),
                            '_'), ''), 'untitled') AS slug
FROM documents""")
def text_forms(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", X.normalize_query("text").alias("query_text"), X.slug("text").alias("slug"))


@query(r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name) || ' ' ||
         lower(p_brand), '[^a-z0-9 &+/#-]', ' ', 'g'), '(^| )-+( |$)', ' ', 'g'), ' +', ' ', 'g'))
         AS title_key FROM part""")
def title_key(spark, sf):
    year = (F.col("p_size") + 2000).cast("string")
    raw = F.concat(F.lit("Sr. "), F.col("p_name"), F.lit(" (New Grad) - "), F.col("p_brand"),
                   F.lit(", "), year, F.lit(" | "), F.col("p_type"))
    return table(spark, sf, "part").select("p_partkey", X.title_key(raw).alias("title_key"))


@query(r"""
SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(split_part(
         regexp_replace(nfc_normalize(text), '[\(\[][^\)\]]*[\)\]]', ' ', 'g'), '|', 1)),
         '[^a-z0-9 &+/#-]', ' ', 'g'), '(^| )-+( |$)', ' ', 'g'), ' +', ' ', 'g')) AS title_key
FROM documents""")
def document_keys(spark, sf):
    """Title keys of whole texts without seniority rules; exercises Unicode composition."""
    return table(spark, sf, "documents").select(
        "doc_id", F.regexp_replace(X.title_key("text", rules=()), "^$", "").alias("title_key"))


@query("""
SELECT p_partkey, CASE WHEN w = 'ring' THEN f || ' engineer' ELSE f || ' ' || w END AS canonical,
       upper(f[1]) || f[2:] || ' ' || CASE WHEN w = 'rod' THEN 'ROD' ELSE upper(w[1]) || w[2:] END
           AS shown
FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS f, string_split(p_name, ' ')[2] AS w
      FROM part)""")
def display_forms(spark, sf):
    """Head-noun rewrite (rings become programmers first) and display titles."""
    name = F.regexp_replace("p_name", "ring$", "programmer")
    return table(spark, sf, "part").select(
        "p_partkey", X.rewrite_head_noun(name).alias("canonical"),
        X.display_title("p_name", acronyms=("rod",)).alias("shown"))


ALIASES = {"ring": "Ring", "large rod": "Large Rod", "economy": "ECO", "brand#1": "First"}
CAPITALS = {"ECO": "Eco", "promo": "Promo", "small bolt": "Small Bolt", "c++": "C++"}


def _sql_alias(x: str) -> str:
    def table_(pairs, y):
        return "CASE " + y + "".join(
            f" WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {y} END"

    return table_(CAPITALS, f"({table_(ALIASES, x)})")


@query(fr"""
SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(raw, lambda x:
           {_sql_alias('x')}))), '|') AS skills
FROM (SELECT p_partkey, [lower(p_name), lower(p_type), lower(p_brand),
             string_split(p_name, ' ')[2] || ' ' || lower(p_type), 'c++', ''] AS raw FROM part)""")
def normalize_items(spark, sf):
    raw = F.array(
        F.concat(F.lit("  "), "p_name", F.lit("!!")), F.concat_ws("/", "p_type", "p_brand"),
        F.concat(V.last_word("p_name"), F.lit(" ("), "p_type", F.lit(")")), F.lit("C++."),
        F.lit("!!!"), F.lit(None).cast("string"))
    return table(spark, sf, "part").select(
        "p_partkey", joined(skills.clean_skills(raw, ALIASES, CAPITALS)).alias("skills"))


PAGE_PATTERN = r"/[a-z]{2}/(\d+)"


@query(fr"""
SELECT page_id, key, {V.sql_uuid5(ids.URL_NAMESPACE, 'key')} AS posting_id FROM (
    SELECT page_id, CASE WHEN k <> '' THEN 'page:' || k ELSE url END AS key FROM (
        SELECT page_id, url, regexp_extract(url, '^https?://[^/]+/[a-z]{{2}}/(\d+)', 1) AS k
        FROM pages))""")
def uuid5_keys(spark, sf):
    options = {"pattern": PAGE_PATTERN, "prefix": "page:"}
    return table(spark, sf, "pages").select(
        "page_id", ids.posting_key("url", **options).alias("key"),
        ids.posting_id("url", **options).alias("posting_id"))


_SQL_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_SQL_CONTENT = (f"{_SQL_NORM.format('source')} || '|' || {_SQL_NORM.format('lang')} || '|' || "
                f"{_SQL_NORM.format('text')}")


@query(f"SELECT doc_id, {V.sql_uuid5(ids.URL_NAMESPACE, _SQL_CONTENT)} AS content_hash "
       "FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", ids.content_hash("source", "lang", "text").alias("content_hash"))


@query(f"""
WITH g AS (SELECT p_partkey, list_transform({V.sql_trigrams('p_name')}, lambda t:
               ('0x' || substr(md5(t), 1, 6))::INT % 16) AS b FROM part),
c AS (SELECT p_partkey, list_transform(range(16), lambda i: len(list_filter(b, lambda x: x = i)))
          AS n FROM g)
SELECT p_partkey, i AS dim, round((n[i + 1] / sqrt(list_sum(list_transform(n, lambda x: x * x))))
           ::FLOAT::DOUBLE, 6) AS x FROM c, range(16) t(i)""")
def hashed_vectors(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.posexplode(
        vectors.hashed_trigram_vector("p_name", 16)).alias("dim", "x")).select(
        "p_partkey", F.col("dim").cast("long").alias("dim"), r6(F.col("x").cast("double"))
        .alias("x"))


@query("""
SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm,
       round(list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w)), 6)
           AS self_cos
FROM (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v,
             list_transform(embedding, lambda x: round(x::DOUBLE * x::DOUBLE, 6)) AS w
      FROM embeddings)""")
def vector_functions(spark, sf):
    v = vectors.round_vector("embedding")
    squares = F.transform("embedding", lambda x: F.round(x.cast("double") * x.cast("double"), 6))
    return table(spark, sf, "embeddings").select("vec_id", v.alias("v"), squares.alias("w")).select(
        "vec_id", r6(vectors.norm("v")).alias("norm"), r6(vectors.cosine("v", "w"))
        .alias("self_cos"))


# Pools and matched sets ------------------------------------------------------------------------

@query("""
WITH q AS (SELECT label AS query_id, min(vec_id) AS vec_id FROM embeddings GROUP BY label),
v AS (SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v
      FROM embeddings)
SELECT query_id::INT AS query_id, posting_id, score FROM (
    SELECT query_id, c.vec_id AS posting_id, round(s, 9) AS score, row_number() OVER (
               PARTITION BY query_id ORDER BY round(s, 9) DESC, c.vec_id) AS rn
    FROM (SELECT q.query_id, c.vec_id, list_cosine_similarity(c.v, qv.v) AS s
          FROM q JOIN v qv ON qv.vec_id = q.vec_id CROSS JOIN v c) c) WHERE rn <= 100""")
def cosine_topk(spark, sf):
    corpus = table(spark, sf, "embeddings")
    asked = corpus.groupBy(F.col("label").alias("query_id")).agg(
        F.min_by("embedding", "vec_id").alias("query_vector"))
    return vector_search(corpus, asked, dim=V.VECTOR_DIM, k=100, id_col="vec_id",
                         vector_col="embedding", faceted=False)


@query("""
SELECT query_id, posting_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, posting_id) AS rn
    FROM (SELECT a.vec_id AS query_id, b.vec_id AS posting_id, round(list_cosine_similarity(
                     list_transform(a.embedding, lambda x: round(x::DOUBLE, 6)),
                     list_transform(b.embedding, lambda x: round(x::DOUBLE, 6))), 9) AS score
          FROM embeddings a CROSS JOIN embeddings b)) WHERE rn <= 10""")
def nearest_vectors(spark, sf):
    """The ten nearest vectors of every vector: the queries are as many rows as the corpus."""
    rows = table(spark, sf, "embeddings")
    asked = rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vector_join(rows, asked, dim=V.VECTOR_DIM, k=10, id_col="vec_id", vector_col="embedding",
                       faceted=False)


@query(f"""
SELECT query_id, posting_id, s AS trgm_sim FROM (
    SELECT query_id, posting_id, s, row_number() OVER (
               PARTITION BY query_id ORDER BY s DESC, posting_id) AS rn
    FROM (SELECT query_id, job_title AS t, seniority_filter, year_floor, s FROM (
              SELECT *, {V.sql_jaccard('a.g', 'b.g')} AS s
              FROM (SELECT *, {V.sql_trigrams('query_text')} AS g FROM asked) a CROSS JOIN (
                   SELECT DISTINCT job_title, {V.sql_trigrams('job_title')} AS g FROM postings) b)
          WHERE s >= 0.3) x
    JOIN postings ON job_title = t
    WHERE (seniority_filter IS NULL OR seniority = seniority_filter OR seniority = 'unknown')
      AND (year_floor IS NULL OR posting_year >= year_floor)) WHERE rn <= 100""", ("asked",))
def trigram_topk(spark, sf):
    return retrieval.lexical_pool(V.stored_postings(spark, sf, skills=False), V.asked(spark, sf), k=100)


@query("""
SELECT query_id, posting_id, vec_sim, trgm_sim, combined FROM hybrid""", ("hybrid",))
def hybrid_match(spark, sf):
    rows = V.stored_postings(spark, sf, skills=False)
    return retrieval.hybrid_scores(rows, V.asked(spark, sf), dim=V.VECTOR_DIM)


def _hybrid_rows(spark, sf):
    return retrieval.hybrid_match(V.stored_postings(spark, sf), V.asked(spark, sf), dim=V.VECTOR_DIM)


_SQL_TOP = """
SELECT query_id, rn AS rank, skill, cnt, {pct} AS pct, n AS job_total FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cnt DESC, skill) AS rn
    FROM (SELECT query_id, skill, count(*) AS cnt FROM (
              SELECT query_id, unnest(skills) AS skill FROM {rows}) GROUP BY ALL)
    JOIN (SELECT query_id, count(*) AS n FROM {rows} GROUP BY query_id) USING (query_id))
WHERE rn <= 10"""


def _ranked(df: DataFrame) -> DataFrame:
    return df.withColumn("rank", F.col("rank").cast("long"))


@query(_SQL_TOP.format(rows="hybrid_rows", pct=V.sql_pct("cnt", "n")), ("hybrid_rows",))
def hybrid_top_items(spark, sf):
    return _ranked(report.top_skills(report.match_facts(_hybrid_rows(spark, sf))))


_SQL_STRUCTURED = """
structured AS (
    SELECT query_id, p.* FROM postings p JOIN asked a ON p.role_family = a.role_family
     AND list_has_all(specializations, wanted)
     AND (seniority_filter IS NULL OR seniority = seniority_filter OR seniority = 'unknown')
     AND (year_floor IS NULL OR posting_year >= year_floor)
    UNION ALL
    SELECT query_id, p.* FROM (
        SELECT query_id, posting_id, row_number() OVER (
                   PARTITION BY query_id ORDER BY s DESC, posting_id) AS rn
        FROM (SELECT query_id, posting_id,
                     round(list_cosine_similarity(v, query_vector), 9) AS s
              FROM postings p JOIN asked a ON p.role_family IS NULL AND v IS NOT NULL
               AND (seniority_filter IS NULL OR seniority = seniority_filter
                    OR seniority = 'unknown')
               AND (year_floor IS NULL OR posting_year >= year_floor))
        WHERE s > 0.86) r JOIN postings p ON p.posting_id = r.posting_id
    WHERE rn <= 200)
"""


@query(", " + _SQL_STRUCTURED + """
SELECT query_id, posting_id, job_title, canonical_title, array_to_string(skills, '|') AS skills
FROM structured""", ("asked",))
def structured_match(spark, sf):
    rows = retrieval.structured_match(V.stored_postings(spark, sf), V.asked(spark, sf),
                                      dim=V.VECTOR_DIM)
    return rows.withColumn("skills", joined("skills"))


@query(", " + _SQL_STRUCTURED + """
SELECT query_id, rn AS rank, title, cnt FROM (
    SELECT query_id, coalesce(canonical_title, job_title) AS title, count(*) AS cnt,
           row_number() OVER (PARTITION BY query_id ORDER BY count(*) DESC,
                              coalesce(canonical_title, job_title)) AS rn
    FROM structured GROUP BY query_id, coalesce(canonical_title, job_title)) WHERE rn <= 8""",
       ("asked",))
def related_canonicals(spark, sf):
    rows = retrieval.structured_match(V.stored_postings(spark, sf, skills=False), V.asked(spark, sf),
                                      dim=V.VECTOR_DIM)
    return _ranked(report.related_canonicals(rows)).select("query_id", "rank", "title", "cnt")


@query("""
SELECT a.query_id, count(*) AS n, sum(posting_id)::BIGINT AS ids FROM postings p JOIN asked a
  ON list_has_all(specializations, wanted)
 AND (seniority_filter IS NULL OR seniority = seniority_filter OR seniority = 'unknown')
 AND (year_floor IS NULL OR posting_year >= year_floor) AND a.role_family = p.role_family
GROUP BY a.query_id""", ("asked",))
def containment_filter(spark, sf):
    rows = retrieval.structured_primary(V.postings(spark, sf, skills=False), V.asked(spark, sf))
    return rows.groupBy("query_id").agg(F.count("*").alias("n"), F.sum("posting_id").alias("ids"))


# Reports ---------------------------------------------------------------------------------------

def _facts(spark, sf):
    return report.match_facts(V.order_matches(spark, sf))


@query(_SQL_TOP.format(rows="order_matches", pct=V.sql_pct("cnt", "n")), ("order_matches",))
def top_items(spark, sf):
    return _ranked(report.top_skills(_facts(spark, sf)))


@query("""
SELECT query_id, skill, count(*) AS cnt FROM (
    SELECT query_id, unnest(skills) AS skill FROM order_matches) GROUP BY ALL""",
       ("order_matches",))
def all_items_ranked(spark, sf):
    return report.all_skills(_facts(spark, sf))


@query("""
SELECT query_id, rn AS rank, job_title AS title, cnt FROM (
    SELECT query_id, job_title, count(*) AS cnt, row_number() OVER (
               PARTITION BY query_id ORDER BY count(*) DESC, job_title) AS rn
    FROM order_matches GROUP BY query_id, job_title) WHERE rn <= 8""", ("order_matches",))
def related_titles(spark, sf):
    return _ranked(report.related_titles(_facts(spark, sf)))


@query(f""", top AS ({_SQL_TOP.format(rows='hybrid_rows', pct=V.sql_pct('cnt', 'n'))}),
titles AS (SELECT query_id, job_title, row_number() OVER (
               PARTITION BY query_id ORDER BY count(*) DESC, job_title) AS rn
           FROM hybrid_rows GROUP BY query_id, job_title)
SELECT a.query_id, coalesce(s.job_count, 0) AS job_count, coalesce(s.n, 0) AS skills_count,
       coalesce(k.names, '') AS names, coalesce(t.titles, '') AS titles
FROM asked a LEFT JOIN (SELECT query_id, max(job_total) AS job_count FROM top GROUP BY ALL) s0
    ON s0.query_id = a.query_id
LEFT JOIN (SELECT query_id, count(DISTINCT skill) AS n, count(DISTINCT posting_id) AS m,
                  any_value(jc) AS job_count
           FROM (SELECT query_id, posting_id, unnest(skills) AS skill,
                        count(*) OVER (PARTITION BY query_id) AS jc FROM hybrid_rows)
           GROUP BY query_id) s ON s.query_id = a.query_id
LEFT JOIN (SELECT query_id, string_agg(skill || ':' || cnt, '|' ORDER BY rank) AS names
           FROM top GROUP BY query_id) k ON k.query_id = a.query_id
LEFT JOIN (SELECT query_id, string_agg(job_title, '|' ORDER BY rn) AS titles
           FROM titles WHERE rn <= 8 GROUP BY query_id) t ON t.query_id = a.query_id""",
       ("hybrid_rows",))
def item_report(spark, sf):
    asked = V.asked(spark, sf)
    matched = retrieval.hybrid_match(V.stored_postings(spark, sf), asked, dim=V.VECTOR_DIM)
    facts = cut_lineage(report.match_facts(matched))
    rows = report.skill_report(facts, asked.select("query_id"))
    names = F.transform("skills", lambda s: F.concat_ws(":", s["name"], s["count"]))
    return rows.select("query_id", "job_count", "skills_count",
                       F.coalesce(joined(names), F.lit("")).alias("names"),
                       F.coalesce(joined("related_titles"), F.lit("")).alias("titles"))


@query(f", top AS ({_SQL_TOP.format(rows='order_matches', pct=V.sql_pct('cnt', 'n'))})" """
SELECT query_id, rank, skill, floor(pct + 0.5)::BIGINT AS shown_pct,
       round(pct / greatest(max(pct) OVER (PARTITION BY query_id), 1.0) * 100, 6) AS bar
FROM top""", ("order_matches",))
def demand_bars(spark, sf):
    bars = report.demand_bars(report.top_skills(_facts(spark, sf)))
    return _ranked(bars).select("query_id", "rank", "skill", "shown_pct", r6("bar").alias("bar"))


@query("""
SELECT count(*) AS postings, floor(avg(nullif(len(skills), 0)) + 0.5)::INT AS avg_skills
FROM postings""", ("postings",))
def corpus_profile(spark, sf):
    return report.corpus_profile(V.postings(spark, sf))


@query("""
SELECT o_orderkey AS posting_id, o_orderstatus AS job_title, o_orderpriority AS seniority,
       year(o_orderdate)::INT AS posting_year, o_orderdate::DATE AS posted_date,
       nullif(len(items), 0)::INT AS n_skills
FROM orders LEFT JOIN brand_baskets ON basket_id = o_orderkey
ORDER BY o_orderdate::DATE DESC, o_orderkey LIMIT 10""", ("brand_baskets",))
def newest_postings(spark, sf):
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("posting_id"), F.col("o_orderstatus").alias("job_title"),
        F.col("o_orderpriority").alias("seniority"), F.year("o_orderdate").alias("posting_year"),
        F.to_date("o_orderdate").alias("posted_date"))
    return report.newest_postings(orders.join(V.brand_baskets(spark, sf), "posting_id", "left"))


_SQL_LOOSE = V.SQL_VIEWS["hybrid"].replace("asked", "loose")
_SQL_PLACED = _SQL_STRUCTURED.replace("asked a", "placed a")


@query(f"""
, free AS (SELECT query_id, query_text, query_vector, NULL::VARCHAR AS seniority_filter,
                  NULL::INT AS year_floor, role_family, wanted FROM asked),
placed AS (SELECT * FROM free WHERE role_family <> 'anvil'),
loose AS (SELECT * FROM free WHERE role_family = 'anvil'),
hyb AS ({_SQL_LOOSE}), {_SQL_PLACED},
found AS (SELECT query_id, skills FROM structured UNION ALL
          SELECT query_id, skills FROM hyb JOIN postings p ON p.posting_id = hyb.posting_id),
totals AS (SELECT query_id, count(*) AS n FROM found GROUP BY query_id),
names AS (SELECT query_id, count(DISTINCT s) AS n FROM (
              SELECT query_id, unnest(skills) AS s FROM found) GROUP BY query_id)
SELECT f.query_id, CASE WHEN role_family = 'anvil' THEN 'fallback' ELSE 'structured' END AS mode,
       CASE WHEN names.n > 0 THEN totals.n ELSE 0 END AS job_count,
       coalesce(names.n, 0) AS skills_count
FROM free f LEFT JOIN totals ON totals.query_id = f.query_id
LEFT JOIN names ON names.query_id = f.query_id""", ("asked",))
def search_report(spark, sf):
    """Text in, report out: exact and fuzzy keys by the title map, anvils by hybrid match."""
    asked = V.asked(spark, sf).select("query_id", F.col("query_text").alias("text"),
                                      "query_vector")
    found = search(V.stored_postings(spark, sf), asked, V.title_map(spark, sf),
                   dim=V.VECTOR_DIM)
    return found.select("query_id", "mode", "job_count", "skills_count")


# Mining and recommendations --------------------------------------------------------------------

def _triples(spark, sf, top_n=None):
    baskets = cut_lineage(V.brand_baskets(spark, sf))
    return mining.mine_triples(baskets, min_support=8, top_n=top_n)


@query("""
SELECT s1, s2, s3, support_count, round(lift, 6) AS lift FROM triples""", ("triples",))
def triple_lift(spark, sf):
    return _triples(spark, sf).withColumn("lift", r6("lift"))


@query("""
SELECT a.item AS s1, b.item AS s2, c.item AS s3, count(*) AS support_count
FROM (SELECT basket_id, unnest(items) AS item FROM brand_baskets) a
JOIN (SELECT basket_id, unnest(items) AS item FROM brand_baskets) b
  ON a.basket_id = b.basket_id AND a.item < b.item
JOIN (SELECT basket_id, unnest(items) AS item FROM brand_baskets) c
  ON b.basket_id = c.basket_id AND b.item < c.item GROUP BY ALL""", ("brand_baskets",))
def triple_support(spark, sf):
    return mining.triple_support(mining.build_baskets(V.brand_baskets(spark, sf)))


@query("SELECT item, cnt FROM singles UNION ALL SELECT NULL, count(*) FROM brand_baskets "
       "WHERE len(items) >= 3", ("singles",))
def item_support(spark, sf):
    return mining.item_support(mining.build_baskets(V.brand_baskets(spark, sf)))


def _catalog(spark, sf):
    return recommend.catalog_rows(recommend.generate_projects(_triples(spark, sf, 200)))


@query("""
SELECT project_id, title, level, array_to_string(skills, '|') AS skills, support_count::INT
           AS support_count, round(lift::FLOAT::DOUBLE, 5) AS lift, score, skills_key
FROM catalog""", ("catalog",))
def catalog_rows(spark, sf):
    return _catalog(spark, sf).select(
        "project_id", "title", "level", joined("skills").alias("skills"), "support_count",
        F.round(F.col("lift").cast("double"), 5).alias("lift"),
        F.col("score").cast("double").alias("score"), "skills_key")


@query("""
SELECT project_id, support_count::INT AS support_count, skills_key, 'new' AS origin FROM catalog
UNION ALL
SELECT project_id, 1, s, 'old' FROM (
    SELECT DISTINCT {} AS project_id, s FROM (
        SELECT array_to_string(list_sort([lower(a.p_brand), lower(b.p_brand), lower(c.p_brand)]),
                               '|') AS s
        FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
        JOIN part c ON c.p_partkey = a.p_partkey + 2))
WHERE project_id NOT IN (SELECT project_id FROM catalog)""".format(
    V.sql_uuid5(ids.CATALOG_NAMESPACE, "s")), ("catalog",))
def upsert_catalog(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")

    def at(step: int) -> DataFrame:
        return part.select((F.col("p_partkey") - step).alias("k"),
                           F.col("p_brand").alias(f"b{step}"))

    key = recommend.skills_key(F.array("b0", "b1", "b2"))
    old = at(0).join(at(1), "k").join(at(2), "k").select(key.alias("skills_key")).distinct()
    old = old.select(ids.uuid5(ids.CATALOG_NAMESPACE, "skills_key").alias("project_id"),
                     F.lit(1).alias("support_count"), "skills_key", F.lit("old").alias("origin"))
    return recommend.upsert_catalog(old, _catalog(spark, sf).withColumn("origin", F.lit("new")))


_SQL_REQUESTS = """requests AS (
    SELECT query_id, list(p_brand ORDER BY n DESC, p_brand) AS top FROM (
        SELECT c_nationkey AS query_id, p_brand, count(*) AS n, row_number() OVER (
                   PARTITION BY c_nationkey ORDER BY count(*) DESC, p_brand) AS rn
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON o_orderkey = l_orderkey
        JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, p_brand) WHERE rn <= 7 GROUP BY query_id)"""


def _requests(spark, sf):
    """Leading brands of each nation's customers: seven, of which five count."""
    rows = (table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
            .join(table(spark, sf, "part").select("p_partkey", "p_brand"),
                  F.col("l_partkey") == F.col("p_partkey"))
            .join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"),
                  F.col("l_orderkey") == F.col("o_orderkey"))
            .join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"),
                  F.col("o_custkey") == F.col("c_custkey")))
    counts = rows.groupBy(F.col("c_nationkey").alias("query_id"), "p_brand").agg(
        F.count("*").alias("n"))
    best = top_k_per_group(counts, ["query_id"], [F.desc("n"), F.asc("p_brand")], 7)
    return best.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "p_brand"))),
        lambda s: s["p_brand"]).alias("skills"))


@query(f", {_SQL_REQUESTS}" """
SELECT query_id, skills_key, score FROM requests JOIN catalog
  ON list_has_all(top[1:5], skills) WHERE len(top) >= 3""", ("catalog",))
def subset_join(spark, sf):
    return recommend.subset_join(_requests(spark, sf), _catalog(spark, sf)).select(
        "query_id", "skills_key", F.col("score").cast("double").alias("score"))


_SQL_COVER = f""", {_SQL_REQUESTS},
cands AS (SELECT query_id, list({{'id': project_id, 'skills': skills}}
                                ORDER BY score DESC, project_id) AS c
          FROM requests JOIN catalog ON list_has_all(top[1:5], skills) GROUP BY query_id),
steps AS (
    SELECT query_id, c, 0 AS pick, []::VARCHAR[] AS covered, []::BIGINT[] AS used, false AS done,
           0::BIGINT AS place FROM cands
    UNION ALL
    SELECT query_id, c, pick + 1, list_distinct(covered || c[b].skills), used || [b],
           len(list_distinct(covered || c[b].skills)) >= 5 AND pick + 1 >= 3, b
    FROM (SELECT *, list_position(gains, list_max(gains)) AS b, list_max(gains) AS g FROM (
              SELECT *, list_transform(range(1, len(c) + 1), lambda i:
                  CASE WHEN list_contains(used, i) THEN -1
                       ELSE len(list_filter(c[i].skills, lambda s:
                                            NOT list_contains(covered, s))) END) AS gains
              FROM steps WHERE NOT done AND pick < 4 AND pick < len(c)))
    WHERE NOT (g = 0 AND pick >= 3))
SELECT query_id, pick, c[place].id AS project_id, array_to_string(c[place].skills, '|') AS skills
FROM steps WHERE pick > 0"""


@query((with_views("catalog") + _SQL_COVER).replace("WITH ", "WITH RECURSIVE ", 1))
def set_cover(spark, sf):
    answers = recommend.recommend(_requests(spark, sf), _catalog(spark, sf))
    return recommend.recommended_projects(answers).select(
        "query_id", "pick", "project_id", joined("skills").alias("skills"))


# Keys ------------------------------------------------------------------------------------------

def _keyed_documents(spark, sf):
    """Documents with an id that collides and a hash that sometimes is missing."""
    own = F.concat_ws(":", "source", (F.col("n_chars") % 97).cast("string"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("arrival"), own.alias("posting_id"),
        F.when(F.col("doc_id") % 10 != 0, ids.content_hash("lang", "lang", "text"))
        .alias("content_hash"))


def sql_first_wins(rows: str) -> str:
    """Recursive SQL of the insert rule over (arrival, p, h), one row after the other."""
    return f"""
WITH RECURSIVE given AS MATERIALIZED (
    SELECT arrival, p, md5(h) AS h, row_number() OVER (ORDER BY arrival) AS i FROM ({rows})),
run AS (
    SELECT 0::BIGINT AS i, []::VARCHAR[] AS ps, []::VARCHAR[] AS hs, NULL::BIGINT AS arrival
    UNION ALL
    SELECT i, CASE WHEN ok THEN ps || [p] ELSE ps END,
           CASE WHEN ok AND h IS NOT NULL THEN hs || [h] ELSE hs END,
           CASE WHEN ok THEN a END
    FROM (SELECT given.i, given.p, given.h, given.arrival AS a, run.ps, run.hs,
                 NOT list_contains(run.ps, given.p) AND (given.h IS NULL
                     OR NOT list_contains(run.hs, given.h)) AS ok
          FROM run JOIN given ON given.i = run.i + 1)),
entered AS (SELECT arrival FROM run WHERE arrival IS NOT NULL)"""


@query(sql_first_wins(f"""
    SELECT doc_id AS arrival, source || ':' || (n_chars % 97) AS p,
           CASE WHEN doc_id % 10 <> 0 THEN {_SQL_NORM.format('lang')} || '|' ||
                {_SQL_NORM.format('text')} END AS h FROM documents""") + """
SELECT arrival FROM entered""")
def dedup_first_wins(spark, sf):
    return keys.insert_rows(_keyed_documents(spark, sf)).select("arrival")


@query("""
SELECT o_orderkey AS arrival FROM (
    SELECT o_orderkey, max(CASE WHEN o_orderkey = 0 OR (o_orderkey % 2 = 0 AND (h IS NULL OR before
        IS NULL)) THEN o_orderkey END) OVER (ORDER BY o_orderkey) AS start
    FROM (SELECT *, lag(h) OVER (ORDER BY o_orderkey) AS before FROM (
        SELECT o_orderkey, CASE WHEN o_totalprice % 400 >= 1 THEN (o_orderkey + 1) // 2 END AS h
        FROM orders)))
WHERE (o_orderkey - start) % 2 = 0""")
def insert_chain(spark, sf):
    """Orders that each share the id with one neighbour and the hash with the other, so that every
    row waits for the one before it; a few have no hash, which ends a chain."""
    key = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(
        key.alias("arrival"), F.floor(key / 2).cast("string").alias("posting_id"),
        F.when(F.col("o_totalprice") % 400 >= 1, F.floor((key + 1) / 2)).cast("string")
        .alias("content_hash"))
    return keys.insert_rows(rows).select("arrival")


@query(f"""
SELECT min(doc_id) AS arrival FROM documents GROUP BY {_SQL_NORM.format('lang')} || '|' ||
       {_SQL_NORM.format('text')}""")
def insert_unique_content(spark, sf):
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("arrival"), F.col("doc_id").alias("posting_id"),
        ids.content_hash("lang", "lang", "text").alias("content_hash"))
    return keys.insert_rows(rows).select("arrival")


@query("""
SELECT k, max(v) AS v FROM (
    SELECT o_custkey AS k, 'old' || max(o_orderkey) AS v FROM orders WHERE o_orderstatus = 'F'
    GROUP BY o_custkey
    UNION ALL
    SELECT o_custkey, 'new' || min(o_orderkey) FROM orders WHERE o_orderstatus <> 'F'
      AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')
    GROUP BY o_custkey) GROUP BY k""")
def first_writer_wins(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    finished = F.col("o_orderstatus") == "F"
    stored = orders.filter(finished).groupBy(F.col("o_custkey").alias("k")).agg(
        F.concat(F.lit("old"), F.max("o_orderkey").cast("string")).alias("v"))
    late = orders.filter(~finished).select(
        F.col("o_custkey").alias("k"), F.concat(F.lit("new"), F.col("o_orderkey").cast("string"))
        .alias("v"), F.col("o_orderkey").alias("at"))
    return keys.insert_absent(stored, late, ["k"], "at")


# Resolution ------------------------------------------------------------------------------------

def _resolved(spark, sf):
    return resolve.resolve_queries(V.raw_queries(spark, sf), V.title_map(spark, sf))


@query("""
SELECT query_id, key, canonical_title, role_family,
       coalesce(array_to_string(specializations, '|'), '') AS specializations, seniority_filter,
       year_floor, step, mode FROM resolved""", ("resolved",))
def resolve_ladder(spark, sf):
    return _resolved(spark, sf).select(
        "query_id", "key", "canonical_title", "role_family",
        joined("specializations").alias("specializations"), "seniority_filter", "year_floor",
        "step", "mode")


@query("""
SELECT count(*) AS queries, sum((mode = 'fallback')::INT)::BIGINT AS fallbacks,
       round(avg((mode = 'fallback')::INT), 6) AS fallback_rate FROM resolved""", ("resolved",))
def fallback_rate(spark, sf):
    return report.fallback_rate(_resolved(spark, sf)).withColumn(
        "fallback_rate", r6("fallback_rate"))


@query("""
SELECT key, role_family FROM (SELECT DISTINCT p_name || CASE WHEN p_size % 2 = 0 THEN '' ELSE 's'
                              END AS key FROM part)
LEFT JOIN (SELECT * FROM title_map WHERE role_family IS NOT NULL) ON raw_title_norm = key""",
       ("title_map",))
def exact_lookup(spark, sf):
    key = F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "").otherwise("s"))
    asked = table(spark, sf, "part").select(key.alias("key")).distinct()
    return resolve.exact_lookup(asked, V.title_map(spark, sf)).select("key", "role_family")


@query(f"""
, k AS (SELECT DISTINCT p_brand || ' ' || p_name AS key FROM part),
kg AS (SELECT key, {V.sql_trigrams('key')} AS g FROM k),
d AS (SELECT *, {V.sql_trigrams('raw_title_norm')} AS g FROM title_map
      WHERE role_family IS NOT NULL)
SELECT key, raw_title_norm, s AS similarity, role_family FROM (
    SELECT *, row_number() OVER (PARTITION BY key ORDER BY s DESC, raw_title_norm) AS rn
    FROM (SELECT key, raw_title_norm, role_family, {V.sql_jaccard('kg.g', 'd.g')} AS s
          FROM kg CROSS JOIN d)) WHERE rn = 1 AND s >= 0.45""", ("title_map",))
def fuzzy_lookup(spark, sf):
    asked = table(spark, sf, "part").select(F.concat_ws(" ", "p_brand", "p_name").alias("key"))
    found = resolve.fuzzy_lookup(asked, V.title_map(spark, sf), floor=0.45)
    return found.select("key", "raw_title_norm", "similarity", "role_family")


_SQL_NAMES = f"""
WITH t AS (SELECT DISTINCT p_name || ' ' || lower(p_type) AS t FROM part),
g AS (SELECT t, {V.sql_trigrams('t')} AS g FROM t)
SELECT a.t AS left_text, b.t AS right_text, {V.sql_jaccard('a.g', 'b.g')} AS similarity
FROM g a JOIN g b ON a.t < b.t WHERE {V.sql_jaccard('a.g', 'b.g')} >= 0.6"""


@query(_SQL_NAMES)
def trigram_pairs(spark, sf):
    names = table(spark, sf, "part").select(F.concat_ws(" ", "p_name", F.lower("p_type"))
                                            .alias("t"))
    return similarity.trigram_pairs(names, names, "t", "t", threshold=0.6, less_than=True)


_SQL_KEY_PAIRS = r"""
WITH k AS MATERIALIZED (SELECT DISTINCT title_key AS t FROM (
    SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(split_part(
             regexp_replace(nfc_normalize(text), '[\(\[][^\)\]]*[\)\]]', ' ', 'g'), '|', 1)),
             '[^a-z0-9 &+/#-]', ' ', 'g'), '(^| )-+( |$)', ' ', 'g'), ' +', ' ', 'g')) AS title_key
    FROM documents)),
g AS MATERIALIZED (SELECT md5(t) AS t, {grams} AS g FROM k),
u AS MATERIALIZED (SELECT t, len(g) AS n, unnest(g) AS x FROM g),
c AS (SELECT a.t AS l, b.t AS r, a.n AS ln, b.n AS rn, count(*) AS shared
      FROM u a JOIN u b ON a.x = b.x AND a.t < b.t GROUP BY ALL)
SELECT l AS left_key, r AS right_key, shared::DOUBLE / (ln + rn - shared) AS similarity FROM c
WHERE shared::DOUBLE / (ln + rn - shared) >= 0.6""".replace("{grams}", V.sql_trigrams("t"))


@query(_SQL_KEY_PAIRS)
def document_key_pairs(spark, sf):
    """Similar title keys of whole texts: long sets that nearly all share some trigram."""
    docs = table(spark, sf, "documents").select(
        X.title_key("text", rules=()).alias("t"))
    found = similarity.trigram_pairs(docs, docs, "t", "t", threshold=0.6, less_than=True, label=F.md5)
    return found.select(F.col("left_text").alias("left_key"), F.col("right_text").alias("right_key"),
                        "similarity")


# Taxonomy --------------------------------------------------------------------------------------

def _typed_name() -> Column:
    return F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.right("p_name", F.lit(1)))
                  ).otherwise(F.col("p_name"))


_SQL_CANON = """
canon AS (SELECT t AS canonical_title, min(f) AS role_family, count(*) AS n, any_value(v) AS v
          FROM (SELECT CASE WHEN p_size % 2 = 0 THEN part.p_name || right(part.p_name, 1)
                            ELSE part.p_name END AS t,
                       string_split(part.p_name, ' ')[1] AS f, nv.v AS v
                FROM part LEFT JOIN name_vectors nv ON nv.p_name = part.p_name) GROUP BY t)"""


@query(f""", {_SQL_CANON},
g AS (SELECT *, {V.sql_trigrams('canonical_title')} AS g FROM canon),
p AS (SELECT a.canonical_title AS a, b.canonical_title AS b, a.n AS na, b.n AS nb,
             a.role_family = b.role_family AS same_family,
             round(list_cosine_similarity(a.v, b.v), 9) AS cos,
             {V.sql_jaccard('a.g', 'b.g')} AS trgm
      FROM g a JOIN g b ON a.canonical_title < b.canonical_title)
SELECT CASE WHEN k THEN a ELSE b END AS keep, CASE WHEN k THEN b ELSE a END AS merge_from,
       cos, trgm, greatest(na, nb) AS count_keep,
       least(na, nb) AS count_merge, same_family
FROM (SELECT *, na > nb OR (na = nb AND length(a) <= length(b)) AS k FROM p
      WHERE cos >= 0.92 OR trgm >= 0.6)""", ("name_vectors",))
def merge_proposals(spark, sf):
    rows = table(spark, sf, "part").join(V.name_vectors(spark, sf), "p_name", "left").select(
        _typed_name().alias("canonical_title"), V.first_word("p_name").alias("role_family"), "v")
    canon = rows.groupBy("canonical_title").agg(
        F.min("role_family").alias("role_family"), F.count("*").alias("n"),
        F.first("v", ignorenulls=True).alias("vector"))
    return tax.merge_proposals(
        canon.select("canonical_title", "role_family"), canon.select("canonical_title", "vector"),
        canon.select("canonical_title", "n"), dim=V.VECTOR_DIM)


@query("""
WITH f AS (SELECT p_brand || '/' || p_type AS family, count(*) AS n,
                  min(CASE WHEN p_partkey IN (SELECT vec_id FROM embeddings) THEN p_partkey END)
                      AS rep FROM part GROUP BY ALL),
v AS (SELECT family, n, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v
      FROM f JOIN embeddings ON vec_id = rep)
SELECT family, n, target, round(s, 9) AS similarity FROM (
    SELECT a.family, a.n, b.family AS target, list_cosine_similarity(a.v, b.v) AS s,
           row_number() OVER (PARTITION BY a.family ORDER BY
               round(list_cosine_similarity(a.v, b.v), 9) DESC, b.family) AS rn
    FROM v a JOIN v b ON a.n < 15 AND b.n >= 15) WHERE rn = 1""")
def family_folds(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("role_family"))
    named = parts.join(table(spark, sf, "embeddings"), F.col("p_partkey") == F.col("vec_id"))
    vectors_ = named.groupBy(F.col("role_family").alias("family")).agg(
        F.min_by("embedding", "p_partkey").alias("vector"))
    return tax.family_folds(parts, vectors_, dim=V.VECTOR_DIM)


@query("""
SELECT coalesce(x.canonical_title, '') AS canonical_title, count(*) AS n
FROM (SELECT CASE WHEN string_split(canonical_title, ' ')[2] IN ('ring', 'rod', 'bolt')
                  THEN string_split(canonical_title, ' ')[1] || ' anvil'
                  ELSE canonical_title END AS canonical_title FROM postings) x GROUP BY ALL""",
       ("postings",))
def apply_merges(spark, sf):
    """Rings become rods, rods bolts, bolts anvils: a chain for every first word."""
    names = table(spark, sf, "part").select("p_name").distinct()
    chain = F.create_map(*[F.lit(w) for w in ("ring", "rod", "rod", "bolt", "bolt", "anvil")])
    merges = names.select(
        F.col("p_name").alias("merge_from"),
        F.concat_ws(" ", V.first_word("p_name"), F.try_element_at(chain, V.last_word("p_name")))
        .alias("keep"), V.last_word("p_name").alias("w")).filter(
        F.col("w").isin("ring", "rod", "bolt")).drop("w")
    _, rows = tax.apply_merges(V.title_map(spark, sf), V.postings(spark, sf, skills=False), merges)
    return rows.groupBy(F.coalesce("canonical_title", F.lit("")).alias("canonical_title")).agg(
        F.count("*").alias("n"))


@query("""
SELECT family, count(*) AS posting_count FROM (
    SELECT CASE WHEN role_family IN ('ring', 'rod') THEN 'bolt' ELSE role_family END AS family
    FROM postings WHERE role_family IS NOT NULL) GROUP BY family
UNION ALL SELECT DISTINCT company, 0 FROM postings""", ("postings",))
def fold_and_refresh(spark, sf):
    """Fold two families into a third, delete them, and recount; companies are empty families."""
    rows = V.postings(spark, sf, skills=False)
    registry = (rows.select(F.col("role_family").alias("family")).filter("family IS NOT NULL")
                .unionByName(rows.select(F.col("company").alias("family"))).distinct()
                .withColumn("posting_count", F.lit(-1).cast("long")))
    folds = rows.filter(F.col("role_family").isin("ring", "rod")).select(
        F.col("role_family").alias("family"), F.lit("bolt").alias("target")).distinct()
    _, moved, kept = tax.apply_folds(V.title_map(spark, sf), rows, registry, folds)
    return tax.refresh_family_counts(kept, moved)


@query("""
SELECT role_family, canonical_title, array_to_string(specializations, '|') AS specializations,
       count(*) AS posting_count
FROM postings WHERE role_family IS NOT NULL GROUP BY ALL""", ("postings",))
def taxonomy_tree(spark, sf):
    tree = tax.taxonomy_tree(V.postings(spark, sf, skills=False))
    return tree.withColumn("specializations", joined("specializations"))


@query("""
, tree AS (SELECT role_family, canonical_title, specializations, count(*) AS n FROM postings
           WHERE role_family IS NOT NULL GROUP BY ALL)
SELECT '## ' || role_family || ' (' || sum(n)::BIGINT || ')' AS line FROM tree GROUP BY role_family
UNION ALL SELECT '- ' || canonical_title || ' {' || array_to_string(specializations, ', ') || '} ('
       || n || ')' FROM tree""", ("postings",))
def taxonomy_lines(spark, sf):
    return tax.taxonomy_lines(tax.taxonomy_tree(V.postings(spark, sf, skills=False)))


@query("""
SELECT spec, count(posting_id) AS n FROM (
    SELECT DISTINCT string_split(p_name, ' ')[1] AS spec FROM part
    UNION SELECT DISTINCT p_brand FROM part) v
LEFT JOIN (SELECT posting_id, unnest(list_distinct(specializations)) AS s FROM postings) ON s = spec
GROUP BY spec""", ("postings",))
def pending_usage(spark, sf):
    part = table(spark, sf, "part")
    specs = part.select(V.first_word("p_name").alias("spec")).unionByName(
        part.select(F.col("p_brand").alias("spec"))).distinct()
    active = part.select(F.lower("p_type").alias("spec"), F.lit("active").alias("status")).distinct()
    vocabulary = specs.withColumn("status", F.lit("pending")).unionByName(active)
    return tax.pending_usage(vocabulary, V.postings(spark, sf, skills=False))


@query("""
SELECT posting_id, array_to_string(list_filter([CASE WHEN s[1] = 'red' THEN 'promo' ELSE s[1] END,
    CASE WHEN s[1] = 'red' AND s[2] = 'promo' THEN NULL ELSE s[2] END],
    lambda x: x IS NOT NULL AND x <> 'small'), '|') AS specializations
FROM (SELECT posting_id, specializations AS s FROM postings)""", ("postings",))
def spec_merge(spark, sf):
    rows = V.postings(spark, sf, skills=False)
    vocabulary = rows.select(F.explode("specializations").alias("spec")).distinct().withColumn(
        "status", F.lit("pending"))
    _, _, out = tax.review_specs(vocabulary, V.title_map(spark, sf), rows,
                                 merge={"red": "promo"}, reject=["small"])
    return out.select("posting_id", joined("specializations").alias("specializations"))


@query("""
SELECT spec, CASE WHEN spec IN ('small', 'red') THEN 'rejected' WHEN spec = 'blue' THEN 'active'
                  ELSE 'pending' END AS status
FROM (SELECT DISTINCT unnest(specializations) AS spec FROM postings)""", ("postings",))
def spec_review(spark, sf):
    rows = V.postings(spark, sf, skills=False)
    vocabulary = rows.select(F.explode("specializations").alias("spec")).distinct().withColumn(
        "status", F.lit("pending"))
    out, _, _ = tax.review_specs(vocabulary, V.title_map(spark, sf), rows, promote=["blue"],
                                 merge={"red": "promo"}, reject=["small"])
    return out


@query("""
SELECT 'all' AS part, 'placed' AS name, count(role_family) AS n FROM postings
UNION ALL SELECT 'all', 'postings', count(*) FROM postings
UNION ALL SELECT 'family', role_family, count(*) FROM postings WHERE role_family IS NOT NULL
GROUP BY role_family""", ("postings",))
def coverage(spark, sf):
    rows = V.postings(spark, sf, skills=False)
    totals = tax.coverage_totals(rows).unpivot([], ["placed", "postings"], "name", "n")
    return totals.select(F.lit("all").alias("part"), "name", "n").unionByName(
        tax.coverage_by_family(rows).select(F.lit("family").alias("part"),
                                            F.col("role_family").alias("name"), "n"))


@query("""
SELECT job_title, count(*) AS n, sum((canonical_title IS NULL)::INT)::BIGINT AS unprocessed,
       sum((canonical_title IS NOT NULL)::INT)::BIGINT AS abstained
FROM (SELECT job_title, role_family, CASE WHEN posting_id % 2 = 0 THEN job_title
             ELSE canonical_title END AS canonical_title FROM postings)
WHERE role_family IS NULL GROUP BY job_title ORDER BY n DESC, job_title LIMIT 20""",
       ("postings",))
def unmapped_titles(spark, sf):
    rows = V.postings(spark, sf, skills=False)
    name = F.when(F.col("posting_id") % 2 == 0, F.col("job_title")).otherwise(
        F.col("canonical_title"))
    return tax.unmapped_titles(rows.withColumn("canonical_title", name))


@query("""
SELECT job_title, count(*) AS n FROM postings WHERE canonical_title IS NULL
GROUP BY job_title HAVING count(*) >= 3""", ("postings",))
def distinct_titles(spark, sf):
    return tax.distinct_titles(V.postings(spark, sf, skills=False), min_count=3)


@query("SELECT role_family AS family, count(*) AS posting_count FROM postings "
       "WHERE role_family IS NOT NULL GROUP BY ALL", ("postings",))
def family_registry(spark, sf):
    counts = tax.coverage_by_family(V.postings(spark, sf, skills=False))
    return tax.family_registry(counts.select(F.col("role_family").alias("family"),
                                             F.col("n").alias("posting_count")))


@query("SELECT DISTINCT string_split(p_name, ' ')[1] AS spec FROM part "
       "WHERE string_split(p_name, ' ')[1] NOT IN ('red', 'old')")
def active_specs(spark, sf):
    words = table(spark, sf, "part").select(V.first_word("p_name").alias("spec")).distinct()
    return tax.active_specs(words.withColumn("status", F.when(
        F.col("spec").isin("red", "old"), "pending").otherwise("active")))


def _replies(spark, sf):
    """Classifier replies made from parts: good, with a surplus key, ill-typed, too long, cut."""
    kind, name = F.col("p_partkey") % 6, F.col("p_name")
    reply = (F.when(kind == 0, '{"canonical_title": "%s", "role_family": "%s", '
                               '"specializations": ["%s"]}')
             .when(kind == 1, '{"canonical_title": " %s  Developer", "role_family": null, '
                              '"specializations": [], "x": "%s%s"}')
             .when(kind == 2, '{"canonical_title": "%s", "role_family": 7, '
                              '"specializations": ["%s%s"]}')
             .when(kind == 3, '{"canonical_title": "%s", "role_family": "%s", '
                              '"specializations": ["a", "b", "c", "d", "%s"]}')
             .when(kind == 4, '{"canonical_title": "The  %s DEVELOPER", "role_family": "%s", '
                              '"specializations": ["New%s", "new%1$s", "web"]}')
             .otherwise('{"canonical_title": "%s", "role_family": "%s", "specialization%s'))
    words = [name, V.last_word("p_name"), V.first_word("p_name")]
    out = reply
    for word in words:
        out = F.regexp_replace(out, F.lit("^(.*?)%s"), F.concat(F.lit("$1"), word))
    out = F.regexp_replace(out, F.lit("%1\\$s"), V.first_word("p_name"))
    return V.dealt_table(spark, sf, "part", "p_partkey", "p_name").select(
        F.concat_ws(" ", "p_partkey", "p_name").alias("key"), out.alias("reply"))


def _validated(spark, sf):
    part = table(spark, sf, "part")
    families = part.select(V.last_word("p_name").alias("family")).distinct().filter(
        "family <> 'ring'")
    vocabulary = part.select(V.first_word("p_name").alias("spec")).distinct().select(
        "spec", F.when(F.col("spec") == "red", "rejected").otherwise("active").alias("status"))
    return tax.validate_replies(_replies(spark, sf), families, vocabulary)


_SQL_DECIDED = """
SELECT p_partkey || ' ' || p_name AS key, CASE p_partkey % 6 WHEN 0 THEN p_name
           WHEN 4 THEN 'the ' || p_name || ' engineer' ELSE p_partkey || ' ' || p_name END
           AS canonical_title,
       CASE WHEN p_partkey % 6 IN (0, 4) THEN string_split(p_name, ' ')[2] END AS role_family,
       CASE p_partkey % 6 WHEN 0 THEN string_split(p_name, ' ')[1]
           WHEN 4 THEN 'new' || string_split(p_name, ' ')[1] || '|web' ELSE '' END
           AS specializations,
       CASE p_partkey % 6 WHEN 0 THEN 'accepted' WHEN 4 THEN 'accepted' WHEN 3 THEN 'capped'
           ELSE 'invalid' END AS status
FROM part"""


@query(_SQL_DECIDED)
def validate_replies(spark, sf):
    return _validated(spark, sf).decisions.withColumn(
        "specializations", joined("specializations"))


@query("""
WITH u AS (SELECT DISTINCT unnest(CASE p_partkey % 6 WHEN 0 THEN [f] WHEN 3 THEN ['a', 'b', 'c',
               'd', f] ELSE ['new' || f, 'web'] END) AS spec
           FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS f FROM part)
           WHERE p_partkey % 6 IN (0, 3, 4))
SELECT DISTINCT 'family' AS kind, 'ring' AS name FROM part WHERE p_partkey % 6 IN (0, 3, 4)
   AND p_name LIKE '% ring'
UNION ALL SELECT 'spec', spec FROM u WHERE spec = 'red' OR spec NOT IN (
    SELECT string_split(p_name, ' ')[1] FROM part)""")
def vocabulary_proposals(spark, sf):
    found = _validated(spark, sf)
    return found.new_families.select(F.lit("family").alias("kind"), F.col("family").alias("name")
                                     ).unionByName(found.new_specs.select(
                                         F.lit("spec").alias("kind"), F.col("spec").alias("name")))


def _title_backfill(spark, sf):
    rows = V.stored_postings(spark, sf, skills=False)
    known = V.title_map(spark, sf).filter("role_family IS NULL")
    part = table(spark, sf, "part")
    now = F.current_timestamp().alias("created_at")
    families = part.select(V.last_word("p_name").alias("family")).distinct().filter(
        "family NOT IN ('ring', 'anvil')").select(
        "family", F.lit(None).cast("string").alias("parent_family"),
        F.lit(0).cast("long").alias("posting_count"), now)
    vocabulary = part.select(V.first_word("p_name").alias("spec")).distinct().select(
        "spec", F.when(F.col("spec").isin("red", "blue"), "active").otherwise("pending")
        .alias("status"), now)
    return backfill_titles(rows, known, families, vocabulary, ascii_only=True)


@query("""
, t AS (SELECT job_title, string_split(job_title, ' ')[2] AS w, count(*) AS n FROM postings
        WHERE canonical_title IS NULL GROUP BY job_title)
SELECT 'titles_processed' AS counter, count(*) AS n FROM t
UNION ALL SELECT 'rows_updated', sum(n)::BIGINT FROM t
UNION ALL SELECT 'abstentions', count(*) FROM t WHERE w IN ('anvil', 'ring')
UNION ALL SELECT 'classifier_calls', count(*) FROM t WHERE w <> 'anvil'
UNION ALL SELECT 'cache_hits', count(*) FROM t WHERE w = 'anvil'
UNION ALL SELECT 'errors', 0""", ("postings",))
def title_backfill_tally(spark, sf):
    return title_tally(_title_backfill(spark, sf))


@query("""
SELECT posting_id, coalesce(canonical_title, job_title) AS canonical_title,
       CASE WHEN canonical_title IS NOT NULL THEN role_family
            WHEN string_split(job_title, ' ')[2] NOT IN ('anvil', 'ring')
            THEN string_split(job_title, ' ')[2] END AS role_family,
       CASE WHEN canonical_title IS NOT NULL THEN array_to_string(specializations, '|')
            WHEN string_split(job_title, ' ')[2] = 'anvil' THEN string_split(job_title, ' ')[1]
            WHEN string_split(job_title, ' ')[1] IN ('red', 'blue')
            THEN string_split(job_title, ' ')[1] ELSE '' END AS specializations
FROM postings""", ("postings",))
def title_backfill(spark, sf):
    """Anvils are known abstentions; the other unmapped titles go through the rule classifier
    with families besides 'ring' and two active specializations."""
    done = _title_backfill(spark, sf)
    return done.postings.select("posting_id", "canonical_title", "role_family",
                                joined("specializations").alias("specializations"))


# Backfill, pages, extraction, ingest -----------------------------------------------------------

_SQL_BACKFILL = f"""
WITH RECURSIVE docs AS MATERIALIZED (
    SELECT doc_id, source || '/' || lang AS g, {V.sql_uuid5(ids.URL_NAMESPACE, _SQL_CONTENT)} AS h,
           {V.sql_uuid5(ids.URL_NAMESPACE, "'linkedin:' || doc_id")} AS named,
           {V.sql_uuid5(ids.URL_NAMESPACE, "doc_id::VARCHAR")} AS other FROM documents),
st AS MATERIALIZED (
    SELECT p, g, CASE WHEN p = min(p) OVER (PARTITION BY h) THEN h END AS h FROM (
        SELECT CASE WHEN doc_id % 2 = 0 THEN named ELSE other END AS p, g,
               CASE WHEN doc_id % 3 = 0 THEN h END AS h FROM docs WHERE doc_id % 5 <> 0)),
room AS MATERIALIZED (SELECT g, list(p ORDER BY p) AS room FROM st WHERE h IS NULL GROUP BY g),
files AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY doc_id) AS i, doc_id AS seq, d.h, st.p, room FROM docs d
    LEFT JOIN st ON st.p = d.named AND st.h IS NULL AND doc_id % 4 <> 1
    LEFT JOIN room ON room.g = d.g),
run AS (
    SELECT 0::BIGINT AS i, []::VARCHAR[] AS ps, (SELECT list(h) FROM st WHERE h IS NOT NULL) AS hs,
           '' AS outcome, NULL::BIGINT AS seq, NULL::VARCHAR AS target, NULL::VARCHAR AS h
    UNION ALL
    SELECT i, CASE WHEN outcome LIKE 'matched%' THEN ps || [target] ELSE ps END,
           CASE WHEN outcome LIKE 'matched%' THEN hs || [h] ELSE hs END, outcome, seq, target, h
    FROM (SELECT *, CASE WHEN target IS NULL THEN 'unmatched'
                         WHEN list_contains(hs, h) THEN 'collided'
                         WHEN strong THEN 'matched_strong' ELSE 'matched_weak' END AS outcome
          FROM (SELECT *, CASE WHEN strong THEN p ELSE list_filter(room, lambda x:
                              NOT list_contains(ps, x))[1] END AS target
                FROM (SELECT f.*, ps, hs, f.p IS NOT NULL AND NOT list_contains(ps, f.p) AS strong
                      FROM run JOIN files f ON f.i = run.i + 1)))),
ends AS MATERIALIZED (SELECT seq, outcome, target, h FROM run WHERE i > 0),
filled AS (SELECT (SELECT count(h) FROM st) + (SELECT count(*) FROM ends
                  WHERE outcome LIKE 'matched%') AS n)"""


def _backfill(spark, sf):
    """Documents as stored rows (every third already hashed) and again as raw files."""
    docs = table(spark, sf, "documents")
    url = F.concat(F.lit("https://example.org/jobs/view/doc-"), F.col("doc_id").cast("string"))
    stored = docs.filter(F.col("doc_id") % 5 != 0).select(
        F.when(F.col("doc_id") % 2 == 0, ids.posting_id(url)).otherwise(
            ids.uuid5(ids.URL_NAMESPACE, F.col("doc_id").cast("string"))).alias("posting_id"),
        F.col("source").alias("company"), F.col("lang").alias("job_title"),
        F.lit(None).cast("date").alias("posted_date"),
        F.when(F.col("doc_id") % 3 == 0, ids.content_hash("source", "lang", "text"))
        .alias("content_hash"))
    raw = docs.select(
        F.col("doc_id").alias("seq"), F.col("lang").alias("job_title"),
        F.col("source").alias("company"), F.col("text").alias("job_description"),
        F.when(F.col("doc_id") % 4 != 1, url).alias("job_url"),
        F.lit("").alias("posted_date"))
    # A copy of a text may be hashed already; a table holds each hash once.
    first = stored.groupBy("content_hash").agg(F.min("posting_id").alias("posting_id"),
                                               F.lit(True).alias("first"))
    stored = cut_lineage(stored.join(first, ["posting_id", "content_hash"], "left").withColumn(
        "content_hash", F.when(F.col("first"), F.col("content_hash"))).drop("first"))
    return backfill.backfill_hashes(stored, backfill.prepare_files(raw))


@query(_SQL_BACKFILL + """
SELECT outcome AS counter, count(*) AS n FROM ends GROUP BY outcome
UNION ALL SELECT 'rows', count(*) FROM st
UNION ALL SELECT 'rows_with_hash', n FROM filled
UNION ALL SELECT 'rows_still_null', (SELECT count(*) FROM st) - n FROM filled""")
def backfill_hash(spark, sf):
    result = _backfill(spark, sf)
    return backfill.tally(result.outcomes, result.table)


@query(_SQL_BACKFILL + "\nSELECT seq, outcome FROM ends")
def backfill_files(spark, sf):
    """What became of every file, in file order."""
    return _backfill(spark, sf).outcomes


@query(_SQL_BACKFILL + """
SELECT p AS posting_id, coalesce(st.h, e.h) AS content_hash FROM st
LEFT JOIN ends e ON e.target = p AND outcome LIKE 'matched%'""")
def backfill_rows(spark, sf):
    """The stored rows with their hashes after the backfill."""
    return _backfill(spark, sf).table.select("posting_id", "content_hash")


_ARTICLE = r"regexp_extract(html, '<article>(.*?)</article>', 1, 's')"
_UNESCAPE = ("replace(replace(replace(replace({}, '&copy;', '©'), '&middot;', '·'), '&quot;', "
             "'\"'), '&amp;', '&')")
_SPACE = r"e' \t\n\r'"


@query(fr"""
SELECT *, CASE WHEN job_title = '' OR job_description = '' THEN 'missing title or description' END
    AS error FROM (
SELECT page_id, trim({_UNESCAPE.format("regexp_extract(html, '<h1>(.*?)</h1>', 1, 's')")},
                     {_SPACE}) AS job_title,
       nullif(trim({_UNESCAPE.format("regexp_extract(html, '<title>(.*?)</title>', 1, 's')")},
                   {_SPACE}), '') AS company,
       array_to_string(list_filter(list_transform(regexp_split_to_array({_ARTICLE}, '<[^>]*>'),
           lambda x: trim({_UNESCAPE.format('x')}, {_SPACE})), lambda x: x <> ''), ' ')
           AS job_description
FROM pages)""")
def page_fields(spark, sf):
    chosen = pages.FieldSelectors(title=("h1", ""), company=("title", ""),
                                  description=("article", ""))
    return pages.page_fields(table(spark, sf, "pages"), selectors=chosen).select(
        "page_id", "job_title", "company", "job_description", "error")


@query(r"""
SELECT page_id, i - 1 AS place, links[i] AS link FROM (
    SELECT page_id, list_filter(list_transform(regexp_extract_all(
        regexp_extract(html, '<nav>(.*?)</nav>', 1, 's'), '<a href="([^"]*)"', 1),
        lambda x: trim(x)), lambda x: x <> '') AS links FROM pages), range(1, 1000) t(i)
WHERE i <= len(links)""")
def page_links(spark, sf):
    found = pages.page_links(table(spark, sf, "pages"), keep=("page_id",),
                             selector=pages.LinkSelector(("nav", ""), ""))
    return found.withColumn("place", F.col("place").cast("long"))


WORDS = ["the", "and", "of the", "le", "que", "der", "und", "in the on", "el", "and the"]


_SQL_GRAMS = r"""
SELECT doc_id, array_to_string(list_sort(list_filter(['the', 'and', 'le', 'que', 'der', 'und',
    'el', 'of the', 'in the on', 'and the'], lambda k: contains(padded, ' ' || k || ' '))), '|')
    AS skills
FROM (SELECT doc_id, ' ' || array_to_string(list_filter(list_transform(regexp_split_to_array(
          lower(text), '[^\p{L}\p{N}_+#./-]+'), lambda w: regexp_replace(w,
          '^[./-]+|[./-]+$', '', 'g')), lambda w: w <> ''), ' ') || ' ' AS padded FROM documents)"""


@query(_SQL_GRAMS)
def gazetteer_items(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", joined(extract.gazetteer_skills("text", WORDS)).alias("skills"))


@query("SELECT doc_id, unnest(string_split(skills, '|')) AS skill FROM (" + _SQL_GRAMS +
       ") WHERE skills <> ''")
def gazetteer_table(spark, sf):
    """The same extraction as a join, for vocabularies of any size."""
    docs = table(spark, sf, "documents")
    return extract.gazetteer_join(docs, extract.alias_frame(docs, [{w: w for w in WORDS}]),
                                  id_col="doc_id", text_col="text")


def _raw_documents(spark, sf):
    """Documents as raw postings: the URL repeats, the text may be a copy."""
    return table(spark, sf, "documents").select(
        F.col("lang").alias("job_title"), F.col("source").alias("company"),
        F.col("text").alias("job_description"),
        F.concat(F.lit("https://example.org/jobs/view/d-"), F.floor(F.col("doc_id") / 2)
                 .cast("string")).alias("job_url"),
        F.when(F.col("doc_id") % 50 == 49, "soon").otherwise("2026-01-15").alias("posted_date"),
        "doc_id")


_SQL_BUILT = f"""
SELECT doc_id, {V.sql_uuid5(ids.URL_NAMESPACE, "'linkedin:' || (doc_id // 2)")} AS posting_id,
       {V.sql_uuid5(ids.URL_NAMESPACE, _SQL_CONTENT)} AS content_hash, 'unknown' AS seniority,
       CASE WHEN doc_id % 50 <> 49 THEN 2026 END AS posting_year,
       CASE WHEN doc_id % 50 = 49 THEN 'bad posted_date' END AS error
FROM documents"""


@query(f"""
SELECT b.*, lang AS job_title, source AS company, skills,
       CASE WHEN error IS NULL THEN '2026-01-15' END AS posted_date
FROM ({_SQL_BUILT}) b JOIN documents USING (doc_id) JOIN ({_SQL_GRAMS}) USING (doc_id)""")
def build_posting_rows(spark, sf):
    built = build_postings(_raw_documents(spark, sf), spellings=WORDS)
    return built.select("doc_id", "posting_id", "job_title", "company", joined("skills")
                        .alias("skills"), "content_hash", "seniority", "posting_year",
                        F.col("posted_date").cast("string").alias("posted_date"), "error")


@query("""
SELECT lang AS job_title, source AS company, md5(text) AS body,
       'https://example.org/jobs/view/d-' || doc_id // 2 AS job_url,
       CASE WHEN doc_id % 50 = 49 THEN 'soon' ELSE '2026-01-15' END AS posted_date,
       CASE WHEN doc_id % 50 = 49 THEN 'soon' ELSE '2026-01-15' END AS day
FROM documents""")
def read_archive(spark, sf):
    """Documents archived as JSON by day and read back."""
    folder = _scratch(spark)
    postings.write_postings(_raw_documents(spark, sf), folder)
    good, _ = postings.split_readable(postings.read_postings(spark, folder, multi_line=False))
    return good.select("job_title", "company", F.md5("job_description").alias("body"), "job_url",
                       "posted_date", F.col("day").cast("string").alias("day"))


@query("""
SELECT CASE WHEN (doc_id % 7 = 0 OR coalesce(lang, '') = '')
                 AND (doc_id % 3 = 0 OR coalesce(text, '') = '') THEN 'empty'
            WHEN doc_id % 4 <> 1 THEN 'strong_match_candidate' ELSE 'weak_match_candidate' END
           AS outcome, count(*) AS n FROM documents GROUP BY 1""")
def empty_records(spark, sf):
    """Dry run of the hash backfill; documents without title and body are empty records."""
    docs = table(spark, sf, "documents")
    url = F.concat(F.lit("https://example.org/jobs/view/doc-"), F.col("doc_id").cast("string"))
    return backfill.match_candidates(backfill.prepare_files(docs.select(
        F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 7 != 0, F.col("lang"))
        .alias("job_title"), F.col("source").alias("company"),
        F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("job_description"),
        F.when(F.col("doc_id") % 4 != 1, url).alias("job_url"),
        F.lit("2026-01-15").alias("posted_date"))))


def _scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"


@query(sql_first_wins(f"""
    SELECT doc_id AS arrival, (doc_id // 2)::VARCHAR AS p, {_SQL_CONTENT} AS h
    FROM documents WHERE doc_id % 50 <> 49""") + f"""
SELECT b.posting_id, b.content_hash, NULL AS error FROM ({_SQL_BUILT}) b
JOIN entered ON doc_id = arrival
UNION ALL SELECT NULL, NULL, error FROM ({_SQL_BUILT}) WHERE error IS NOT NULL""")
def ingest_stream(spark, sf):
    """Documents written as JSON files in order, then ingested as a stream until none is left;
    inserted postings and dead letters."""
    folder = _scratch(spark)
    _raw_documents(spark, sf).orderBy("doc_id").drop("doc_id").write.json(f"{folder}/inbox")

    def build(raw: DataFrame) -> DataFrame:
        return build_postings(raw, spellings=WORDS)

    start_ingest(spark, f"{folder}/inbox", table=f"{folder}/table",
                 dead_letters=f"{folder}/dead", checkpoint=f"{folder}/state", build=build,
                 multi_line=False).awaitTermination()
    rows = tables.read_batches(spark, f"{folder}/table")
    dead = tables.read_batches(spark, f"{folder}/dead")
    none = F.lit(None).cast("string")
    return rows.select("posting_id", "content_hash", none.alias("error")).unionByName(
        dead.select(none.alias("posting_id"), none.alias("content_hash"), "error"))


@query(sql_first_wins(f"""
    SELECT (doc_id % 3) * 1000000000 + doc_id AS arrival, (doc_id // 2)::VARCHAR AS p, {_SQL_CONTENT} AS h
    FROM documents WHERE doc_id % 50 <> 49""") + f"""
SELECT b.posting_id, b.content_hash, CASE WHEN doc_id % 3 < 2 THEN 'old ' || lang
       WHEN lang IN ('en', 'de') THEN 'new ' || lang END AS canonical_title
FROM ({_SQL_BUILT}) b JOIN documents USING (doc_id)
JOIN entered ON arrival = (doc_id % 3) * 1000000000 + doc_id""")
def replayed_ingest(spark, sf):
    """Three batches of documents. The second is cut off before its rows are written, the title map
    is published anew, and the batch is repeated: it sees the map of its first attempt, its rows are
    there once, and the third batch sees the new map."""
    folder = _scratch(spark)
    raw = cut_lineage(_raw_documents(spark, sf).withColumn(
        "source_file", F.format_string("%012d", "doc_id")).withColumn(
        "_corrupt_record", F.lit(None).cast("string")))
    old = raw.select("job_title").distinct().withColumn(
        "canonical_title", F.concat(F.lit("old "), "job_title"))
    new = (old.filter(F.col("job_title").isin("en", "de"))
           .withColumn("canonical_title", F.concat(F.lit("new "), "job_title")))
    paths = {"table": f"{folder}/table", "dead_letters": f"{folder}/dead"}

    class Lost(Exception):
        pass

    def ingest(batch: int, lost: bool = False) -> None:
        titles = tables.pinned_snapshot(spark, f"{folder}/titles", f"{folder}/pins", batch)

        def attach(rows: DataFrame) -> DataFrame:
            if lost:
                raise Lost
            return rows.join(titles, "job_title", "left")

        ingest_batch(raw.filter(F.col("doc_id") % 3 == batch), batch, enrich=attach, key_buckets=8,
                     build=lambda rows: build_postings(rows, spellings=WORDS), **paths)

    tables.write_snapshot(old, f"{folder}/titles")
    ingest(0)
    with suppress(Lost):
        ingest(1, lost=True)
    tables.write_snapshot(new, f"{folder}/titles")
    ingest(1)
    ingest(1)
    ingest(2)
    return tables.read_batches(spark, f"{folder}/table").select(
        "posting_id", "content_hash", "canonical_title")


# Vocabularies and snapshots --------------------------------------------------------------------

@query("""
SELECT p_name AS raw_title_norm, min(p_type) AS role_family FROM part
WHERE p_size % 3 <> 0 AND p_type <> 'PROMO' GROUP BY p_name""")
def decided_snapshot(spark, sf):
    """The decided titles after the title map was swapped for a newer version."""
    folder = _scratch(spark)
    part = table(spark, sf, "part").withColumn("keep", F.col("p_size") % 3 != 0)
    for kept in (F.lit(True), F.col("keep")):
        titles = part.filter(kept & (F.col("p_type") != "PROMO")).groupBy("p_name").agg(
            F.min("p_type").alias("role_family"))
        abstained = part.select("p_name").distinct().join(titles, "p_name", "left_anti").withColumn(
            "role_family", F.lit(None).cast("string"))
        tables.write_snapshot(titles.unionByName(abstained).select(
            F.col("p_name").alias("raw_title_norm"), F.col("p_name").alias("canonical_title"), "role_family",
            F.array().cast("array<string>").alias("specializations")), folder)
    return resolve.decided_titles(tables.read_snapshot(spark, folder)).select(
        "raw_title_norm", "role_family")


def _sql_values(names) -> str:
    return ", ".join("('" + n.replace("'", "''") + "')" for n in names)


@query(f"""
WITH stored AS (SELECT CASE WHEN w = 'ring' THEN 'data engineer' ELSE w END AS family, count(*) AS n
                FROM (SELECT string_split(p_name, ' ')[2] AS w FROM part) GROUP BY 1)
SELECT family, n AS posting_count FROM stored
UNION ALL SELECT f, 0 FROM (VALUES {_sql_values(tables.SEED_FAMILIES)}) s(f)
WHERE f NOT IN (SELECT family FROM stored)""")
def seeded_families(spark, sf):
    """Seed families enter a stored registry where it has no row of that name."""
    family = F.when(V.last_word("p_name") == "ring", "data engineer").otherwise(V.last_word("p_name"))
    stored = table(spark, sf, "part").groupBy(family.alias("family")).agg(
        F.count("*").alias("posting_count")).select(
        "family", F.lit(None).cast("string").alias("parent_family"), "posting_count",
        F.current_timestamp().alias("created_at"))
    return keys.insert_absent(stored, tables.seed_families(spark), ["family"]).select(
        "family", "posting_count")


_ALIASES = sorted({*CANONICAL_SKILLS, *TECH_CAPITALIZATION})


def _sql_pairs(pairs) -> str:
    quoted = [(k.replace("'", "''"), v.replace("'", "''")) for k, v in sorted(pairs.items())]
    return ", ".join(f"('{k}', '{v}')" for k, v in quoted)


@query(f"""
WITH words AS (SELECT i - 1 AS i, s[i] AS w FROM (SELECT [{', '.join("'" + w + "'" for w in _ALIASES)}] AS s),
               range(1, {len(_ALIASES) + 1}) t(i)),
asked AS (SELECT p_partkey, regexp_replace(w, '[^a-z0-9 +#/]', '', 'g') AS w FROM part
          JOIN words ON i IN (p_partkey % {len(_ALIASES)}, (p_partkey * 7 + p_size) % {len(_ALIASES)})),
parts AS (SELECT p_partkey, trim(unnest(string_split(w, '/'))) AS w FROM asked),
named AS (SELECT p_partkey, coalesce(c.v, w) AS w FROM parts LEFT JOIN
          (VALUES {_sql_pairs(CANONICAL_SKILLS)}) c(k, v) ON c.k = w),
shown AS (SELECT DISTINCT p_partkey, coalesce(t.v, w) AS w FROM named LEFT JOIN
          (VALUES {_sql_pairs(TECH_CAPITALIZATION)}) t(k, v) ON t.k = w)
SELECT p_partkey, string_agg(w, '|' ORDER BY w) AS skills FROM shown GROUP BY p_partkey""")
def alias_skills(spark, sf):
    """Spellings of the real alias tables, two a part in capitals, to their skills; the tables are
    joined as data."""
    spellings = F.array(*[F.lit(w) for w in _ALIASES])
    n = len(_ALIASES)
    picked = F.array(F.get(spellings, (F.col("p_partkey") % n).cast("int")),
                     F.get(spellings, ((F.col("p_partkey") * 7 + F.col("p_size")) % n).cast("int")))
    raw = table(spark, sf, "part").select("p_partkey", F.explode(F.array_distinct(picked)).alias("raw"))
    named = raw.select("p_partkey", F.explode(skills.bare_skills(F.upper("raw"))).alias("spelling"))
    for aliases in tables.alias_tables(spark):
        named = named.join(aliases, "spelling", "left").select(
            "p_partkey", F.coalesce("skill", "spelling").alias("spelling"))
    return named.groupBy("p_partkey").agg(
        joined(F.array_sort(F.collect_set("spelling"))).alias("skills"))


@query("""
SELECT query_id, posting_id, combined FROM (
    SELECT query_id, posting_id, combined, row_number() OVER (
        PARTITION BY query_id ORDER BY combined DESC, posting_id) AS rn FROM hybrid) WHERE rn <= 7""",
       ("hybrid",))
def match_limit(spark, sf):
    """Pools above the match limit, so that it cuts the merged set of every query."""
    rows = V.stored_postings(spark, sf, skills=False)
    few = retrieval.HybridSettings(match_limit=7)
    return retrieval.hybrid_scores(rows, V.asked(spark, sf), dim=V.VECTOR_DIM, settings=few).select(
        "query_id", "posting_id", "combined")


# Expectations ----------------------------------------------------------------------------------

@query("""
SELECT r.query_id::VARCHAR AS query, r.mode,
       r.canonical_title IS NOT NULL AND r.canonical_title = q.p_name
       AND r.canonical_title <> string_split(q.p_name, ' ')[1] || ' ring'
       AND (q.kind <> 0 OR r.seniority_filter = 'senior')
       AND (q.kind <> 2 OR r.query_id < 4 OR r.canonical_title IS NOT DISTINCT FROM
            o.canonical_title) AS passed
FROM resolved r JOIN raw_queries q ON q.query_id = r.query_id
LEFT JOIN resolved o ON o.query_id = r.query_id - 4""", ("resolved",))
def golden_check(spark, sf):
    """Every query is a case: it must resolve to its part's name and to no ring, ask for its
    seniority, and (every fourth) answer like the case four ids before."""
    plans = _resolved(spark, sf)
    name = F.col("query_id").cast("string")
    found = F.when(F.col("canonical_title").isNotNull(), F.array(F.upper("canonical_title")))
    answers = plans.select(
        name.alias("query"), F.coalesce(found, F.array().cast("array<string>")).alias("titles"),
        "canonical_title", "seniority_filter", F.lit(1).alias("job_count"), "mode")
    kind = F.col("p_partkey") % 4
    cases = table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("query"),
        F.array("p_name").alias("expect_includes"),
        F.array(F.concat(V.first_word("p_name"), F.lit(" RING"))).alias("expect_excludes"),
        F.col("p_name").alias("expect_resolves_to"),
        F.when(kind == 0, "senior").alias("expect_seniority"),
        F.when((kind == 2) & (F.col("p_partkey") >= 4),
               (F.col("p_partkey") - 4).cast("string")).alias("expect_same_results_as"))
    return golden.check_expectations(cases, answers).drop("detail")
