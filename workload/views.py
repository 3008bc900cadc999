"""Posting-shaped views over the star-schema tables, in Spark and as SQL for the checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltide.operators.scale import cut_lineage, spread_small_scan

VECTOR_DIM = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small_scan(df) if name in ("documents", "pages") else df


def dealt_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a narrow table for row-wise work: millions of narrow rows lie in one or two row
    groups, which would keep as many cores busy."""
    return spread_small_scan(spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns))



# SQL -----------------------------------------------------------------------------------------

def sql_trigrams(x: str) -> str:
    return (f"list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({x}), "
            r"'[^\p{L}\p{N}]+'), lambda w: w <> ''), lambda w: list_transform("
            "range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))")


def sql_jaccard(a: str, b: str) -> str:
    common = f"len(list_intersect({a}, {b}))"
    return f"coalesce({common}::DOUBLE / nullif(len({a}) + len({b}) - {common}, 0), 0.0)"


def sql_uuid5(namespace: str, name: str) -> str:
    d = f"sha1(unhex('{namespace.replace('-', '')}') || encode({name}))"
    return (f"(substr({d},1,8) || '-' || substr({d},9,4) || '-5' || substr({d},14,3) || '-' || "
            f"substr('89ab', ('0x' || substr({d},17,1))::INT % 4 + 1, 1) || substr({d},18,3) "
            f"|| '-' || substr({d},21,12))")


def sql_pct(part: str, whole: str) -> str:
    """100 * part / whole to two decimals, halves up, in whole numbers."""
    return f"((({part}) * 20000 + ({whole})) // (2 * ({whole}))) / 100.0"


SQL_VIEWS = {
    "brand_baskets": """
        SELECT l_orderkey AS basket_id, list_sort(list(DISTINCT p_brand)) AS items
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""",
    "order_matches": """
        SELECT o_orderpriority AS query_id, o_orderkey AS posting_id,
               o_orderstatus || '-' || year(o_orderdate) AS job_title, items AS skills
        FROM orders JOIN brand_baskets ON o_orderkey = basket_id""",
    "name_vectors": """
        SELECT n.p_name, list_transform(embedding, lambda x: round(x::DOUBLE, 6)) AS v
        FROM (SELECT p_name, min(p_partkey) AS rep FROM part
              WHERE p_partkey IN (SELECT vec_id FROM embeddings) GROUP BY p_name) n
        JOIN embeddings ON vec_id = rep""",
    "part_nations": """
        SELECT l_partkey, list_sort(list(DISTINCT n_name)) AS skills
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
        JOIN nation ON s_nationkey = n_nationkey GROUP BY l_partkey""",
    "postings": """
        SELECT p_partkey AS posting_id, p.p_name AS job_title, p_brand AS company,
               coalesce(skills, []) AS skills,
               CASE p_type WHEN 'STANDARD' THEN 'unknown' WHEN 'ECONOMY' THEN NULL
                    ELSE lower(p_type) END AS seniority,
               CASE WHEN p_size % 10 <> 0 THEN 2015 + p_size % 10 END AS posting_year,
               CASE WHEN p_size > 2 THEN v END AS v,
               CASE WHEN p_size % 7 <> 0 THEN string_split(p.p_name, ' ')[2] END AS role_family,
               CASE WHEN p_size % 7 <> 0 THEN p.p_name END AS canonical_title,
               CASE WHEN p_size % 7 <> 0 THEN [string_split(p.p_name, ' ')[1], lower(p_type)]
                    ELSE [] END AS specializations
        FROM part p LEFT JOIN part_nations ON l_partkey = p_partkey
        LEFT JOIN name_vectors n ON n.p_name = p.p_name""",
    "asked": """
        SELECT query_id, query_text, v AS query_vector,
               CASE WHEN seniority <> 'unknown' THEN seniority END AS seniority_filter,
               CASE WHEN posting_id % 3 = 0 THEN posting_year END AS year_floor,
               role_family, wanted
        FROM (SELECT company AS query_id, posting_id, seniority, posting_year,
                     CASE WHEN posting_id % 2 = 0 THEN job_title || right(job_title, 1)
                          ELSE job_title END AS query_text,
                     string_split(job_title, ' ')[2] AS role_family,
                     [string_split(job_title, ' ')[1]] AS wanted, p_vec AS v
              FROM (SELECT postings.*, n.v AS p_vec, row_number() OVER
                           (PARTITION BY company ORDER BY posting_id) AS rn
                    FROM postings JOIN name_vectors n ON p_name = job_title) WHERE rn = 1)""",
    "hybrid": """
        WITH sem AS (
            SELECT * FROM (SELECT query_id, posting_id, s AS vec_sim, row_number() OVER
                    (PARTITION BY query_id ORDER BY s DESC, posting_id) AS rn
                FROM (SELECT query_id, posting_id,
                             round(list_cosine_similarity(v, query_vector), 9) AS s
                      FROM postings JOIN asked
                        ON (seniority_filter IS NULL OR seniority = seniority_filter
                            OR seniority = 'unknown')
                       AND (year_floor IS NULL OR posting_year >= year_floor)
                      WHERE v IS NOT NULL)) WHERE rn <= 500),
        tt AS (SELECT DISTINCT job_title, {tri_title} AS g FROM postings),
        qq AS (SELECT query_id, seniority_filter, year_floor, {tri_query} AS g FROM asked),
        qt AS (SELECT query_id, seniority_filter, year_floor, job_title, {jac} AS s
               FROM qq CROSS JOIN tt),
        lex AS (
            SELECT * FROM (SELECT query_id, posting_id, s AS trgm_sim, row_number() OVER
                    (PARTITION BY query_id ORDER BY s DESC, posting_id) AS rn
                FROM postings JOIN qt ON postings.job_title = qt.job_title
                WHERE s >= 0.3 AND (seniority_filter IS NULL OR seniority = seniority_filter
                                    OR seniority = 'unknown')
                  AND (year_floor IS NULL OR posting_year >= year_floor)) WHERE rn <= 500)
        SELECT query_id, posting_id, vec_sim, trgm_sim, combined FROM (
            SELECT coalesce(sem.query_id, lex.query_id) AS query_id,
                   coalesce(sem.posting_id, lex.posting_id) AS posting_id,
                   coalesce(vec_sim, 0.0) AS vec_sim, coalesce(trgm_sim, 0.0) AS trgm_sim,
                   round(0.4::DOUBLE * coalesce(vec_sim, 0.0)
                         + 0.6::DOUBLE * coalesce(trgm_sim, 0.0), 9) AS combined
            FROM sem FULL OUTER JOIN lex
              ON sem.query_id = lex.query_id AND sem.posting_id = lex.posting_id)
        WHERE combined > 0.8""".format(
        tri_title=sql_trigrams("job_title"), tri_query=sql_trigrams("query_text"),
        jac=sql_jaccard("qq.g", "tt.g")),
    "hybrid_rows": """
        SELECT query_id, p.* FROM hybrid JOIN postings p ON p.posting_id = hybrid.posting_id""",
    "singles": """
        SELECT item, count(*) AS cnt FROM (
            SELECT unnest(items) AS item FROM brand_baskets WHERE len(items) >= 3) GROUP BY item""",
    "triples": """
        WITH long AS (SELECT basket_id, unnest(items) AS item FROM brand_baskets
                      WHERE len(items) >= 3),
        n AS (SELECT count(*) AS n FROM brand_baskets WHERE len(items) >= 3),
        t AS (SELECT a.item AS s1, b.item AS s2, c.item AS s3, count(*) AS support_count
              FROM long a JOIN long b ON a.basket_id = b.basket_id AND a.item < b.item
              JOIN long c ON b.basket_id = c.basket_id AND b.item < c.item GROUP BY ALL)
        SELECT s1, s2, s3, support_count,
               support_count::DOUBLE * n * n / (x.cnt::DOUBLE * y.cnt * z.cnt) AS lift
        FROM t, n, singles x, singles y, singles z
        WHERE x.item = s1 AND y.item = s2 AND z.item = s3 AND support_count >= 8
          AND support_count::HUGEINT * n * n >= x.cnt::HUGEINT * y.cnt * z.cnt""",
    "top_triples": """
        SELECT * FROM triples ORDER BY support_count DESC, s1, s2, s3 LIMIT 200""",
    "catalog": """
        SELECT {uuid} AS project_id, s1 || ' and ' || s2 || ' with ' || s3 AS title,
               'INTERMEDIATE' AS level, [s1, s2, s3] AS skills, support_count, lift,
               support_count::DOUBLE AS score, {key} AS skills_key FROM top_triples""".format(
        key="array_to_string(list_sort([lower(s1), lower(s2), lower(s3)]), '|')",
        uuid=sql_uuid5("6f8d2e4a-9c1b-4e7a-9b2f-1a3c5d7e9f01",
                       "array_to_string(list_sort([lower(s1), lower(s2), lower(s3)]), '|')")),
    "title_map": """
        SELECT p_name AS raw_title_norm, p_name AS canonical_title,
               CASE WHEN string_split(p_name, ' ')[2] <> 'anvil'
                    THEN string_split(p_name, ' ')[2] END AS role_family,
               [string_split(p_name, ' ')[1]] AS specializations
        FROM (SELECT DISTINCT p_name FROM part)""",
    "raw_queries": """
        SELECT p_partkey AS query_id, CASE p_partkey % 4
                 WHEN 0 THEN 'Senior ' || p_name || ' (Remote) ' || (2000 + p_size)
                 WHEN 1 THEN p_name || right(p_name, 1)
                 WHEN 2 THEN upper(p_name) || ' | ' || p_brand
                 ELSE p_brand || ' intern' END AS text, p_partkey % 4 AS kind, p_name, p_size
        FROM part""",
    "resolved": """
        WITH keyed AS (SELECT *, CASE kind WHEN 1 THEN p_name || right(p_name, 1)
                       WHEN 3 THEN lower(replace(text, ' intern', '')) ELSE p_name END AS key
                       FROM raw_queries),
        d AS (SELECT *, {tm} AS g FROM title_map WHERE role_family IS NOT NULL),
        kk AS (SELECT DISTINCT key, {tk} AS g FROM keyed),
        best AS (SELECT * FROM (SELECT kk.key, d.*, {jac} AS s, row_number() OVER (
                     PARTITION BY kk.key ORDER BY {jac} DESC, raw_title_norm) AS rn
                 FROM kk CROSS JOIN d) WHERE rn = 1 AND s >= 0.55)
        SELECT query_id, keyed.key, best.canonical_title, best.role_family,
               best.specializations,
               CASE WHEN kind = 0 THEN 'senior' WHEN kind = 3 THEN 'intern' END
                   AS seniority_filter,
               CASE WHEN kind = 0 THEN (2000 + p_size)::INT END AS year_floor,
               CASE WHEN best.key IS NULL THEN 'fallback' WHEN raw_title_norm = keyed.key
                    THEN 'exact' ELSE 'fuzzy' END AS step,
               CASE WHEN best.key IS NULL THEN 'fallback' ELSE 'structured' END AS mode
        FROM keyed LEFT JOIN best ON best.key = keyed.key""".format(
        tm=sql_trigrams("raw_title_norm"), tk=sql_trigrams("key"),
        jac=sql_jaccard("kk.g", "d.g")),
}

_NEEDS = {
    "order_matches": ["brand_baskets"], "postings": ["name_vectors", "part_nations"],
    "asked": ["postings"], "hybrid": ["asked"], "hybrid_rows": ["hybrid"],
    "singles": ["brand_baskets"], "triples": ["singles"], "top_triples": ["triples"],
    "catalog": ["top_triples"], "resolved": ["title_map", "raw_queries"],
}


def with_views(*names: str) -> str:
    """WITH clause of the named views and all they are made of, in order."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in _NEEDS.get(name, []):
            need(other)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({SQL_VIEWS[n]})" for n in order) + "\n"


# Spark ---------------------------------------------------------------------------------------

def brand_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(posting_id, skills): brands of an order. A basket holds no more than the 25 brands, and
    the set is built on the map side first, so a huge order is one small array."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return (lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
            .groupBy(F.col("l_orderkey").alias("posting_id"))
            .agg(F.array_sort(F.collect_set("p_brand")).alias("skills")))


def order_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.join(brand_baskets(spark, sf_dir),
                       F.col("o_orderkey") == F.col("posting_id")).select(
        F.col("o_orderpriority").alias("query_id"), "posting_id",
        F.concat_ws("-", "o_orderstatus", F.year("o_orderdate").cast("string"))
        .alias("job_title"), "skills")


def name_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return (parts.join(vectors, F.col("p_partkey") == F.col("vec_id"))
            .groupBy("p_name").agg(F.min_by("embedding", "p_partkey").alias("v")))


def part_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return (lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
            .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
            .groupBy("l_partkey").agg(F.array_sort(F.collect_set("n_name")).alias("skills")))


def first_word(c: str) -> Column:
    return F.get(F.split(c, " "), 0)


def last_word(c: str) -> Column:
    return F.get(F.split(c, " "), 1)


def postings(spark: SparkSession, sf_dir: str, *, skills: bool = True) -> DataFrame:
    """Parts as postings: title p_name, company p_brand, skills the suppliers' nations."""
    out = table(spark, sf_dir, "part").join(name_vectors(spark, sf_dir), "p_name", "left")
    if skills:
        out = out.join(part_nations(spark, sf_dir), F.col("l_partkey") == F.col("p_partkey"),
                       "left")
    none = F.array().cast("array<string>")
    placed = F.col("p_size") % 7 != 0
    return out.select(
        F.col("p_partkey").alias("posting_id"), F.col("p_name").alias("job_title"),
        F.col("p_brand").alias("company"),
        (F.coalesce("skills", none) if skills else none).alias("skills"),
        F.when(F.col("p_type") == "STANDARD", "unknown").when(
            F.col("p_type") != "ECONOMY", F.lower("p_type")).alias("seniority"),
        F.when(F.col("p_size") % 10 != 0, F.col("p_size") % 10 + 2015).alias("posting_year"),
        F.when(F.col("p_size") > 2, F.col("v")).alias("title_embedding"),
        F.when(placed, last_word("p_name")).alias("role_family"),
        F.when(placed, F.col("p_name")).alias("canonical_title"),
        F.when(placed, F.array(first_word("p_name"), F.lower("p_type"))).otherwise(none)
        .alias("specializations"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per company: the title of its first part, on even ids with a typing error."""
    first = (table(spark, sf_dir, "part")
             .join(name_vectors(spark, sf_dir), "p_name")
             .groupBy(F.col("p_brand").alias("query_id"))
             .agg(F.min_by(F.struct("p_partkey", "p_name", "p_type", "p_size", "v"), "p_partkey")
                  .alias("f")).select("query_id", "f.*"))
    typo = F.concat("p_name", F.right("p_name", F.lit(1)))
    year = F.when(F.col("p_size") % 10 != 0, F.col("p_size") % 10 + 2015)
    return cut_lineage(first.select(
        "query_id",
        F.when(F.col("p_partkey") % 2 == 0, typo).otherwise(F.col("p_name")).alias("query_text"),
        F.col("v").alias("query_vector"),
        F.when(~F.col("p_type").isin("STANDARD", "ECONOMY"), F.lower("p_type"))
        .alias("seniority_filter"),
        F.when(F.col("p_partkey") % 3 == 0, year).alias("year_floor"),
        last_word("p_name").alias("role_family"),
        F.array(first_word("p_name")).alias("specializations")))


def stored_postings(spark: SparkSession, sf_dir: str, *, skills: bool = True) -> DataFrame:
    """The postings written out as the table they would be: searches read it several times."""
    return cut_lineage(postings(spark, sf_dir, skills=skills))


def title_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select("p_name").distinct()
    return names.select(
        F.col("p_name").alias("raw_title_norm"), F.col("p_name").alias("canonical_title"),
        F.when(last_word("p_name") != "anvil", last_word("p_name")).alias("role_family"),
        F.array(first_word("p_name")).alias("specializations"), F.lit("manual").alias("source"),
        F.lit(None).cast("string").alias("model_version"),
        F.lit(None).cast("string").alias("prompt_version"),
        F.to_timestamp(F.lit("2026-01-01")).alias("decided_at"))


def raw_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One free text per part: with facets and noise, misspelled, shouted, or unknown."""
    kind, name = F.col("p_partkey") % 4, F.col("p_name")
    year = (F.col("p_size") + 2000).cast("string")
    return dealt_table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size").select(
        F.col("p_partkey").alias("query_id"),
        F.when(kind == 0, F.concat(F.lit("Senior "), name, F.lit(" (Remote) "), year))
        .when(kind == 1, F.concat(name, F.right(name, F.lit(1))))
        .when(kind == 2, F.concat(F.upper(name), F.lit(" | "), "p_brand"))
        .otherwise(F.concat("p_brand", F.lit(" intern"))).alias("text"))
