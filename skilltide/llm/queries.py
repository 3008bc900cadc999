"""One registered query for each corpus operator, over the whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltide.llm import (
    bpe, conversation_repair, exact_dedup, language_id, license_scan, line_quality, mixing, ngram_join, pii, secrets,
    suffix_dedup, token_counts, whitening,
)
from skilltide.llm.common import documents

TOKEN_LIMIT = 1024


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf_dir), width=4, percent=85)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.prefix_token_counts(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"),
        budgets=[TOKEN_LIMIT], keep=False)
    return counted.select("doc_id", "n_bytes", "n_tokens",
                          (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
                          f"fits_{TOKEN_LIMIT}")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = language_id.held_out()
    model = language_id.train(docs.filter(~held))
    return language_id.predict(docs, model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(documents(spark, sf_dir))


OP4_SQL = r"""
WITH norm AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t
  FROM documents),
grouped AS (
  SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id,
         count(*) OVER (PARTITION BY t) AS group_size FROM norm)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
"""


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select(
        "doc_id", "size", "source_size", "target", "taken")


def op6_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.quality(documents(spark, sf_dir))


OP6_SQL = r"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS n
        FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
again AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM win WHERE n > 1)
          GROUP BY r),
rows AS (SELECT r, source, line, regexp_extract_all(lower(line), '[^\x20\x09-\x0D]+') AS lw
         FROM (SELECT r, source, unnest(string_split(t, chr(10))) AS line FROM docs)),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM rows WHERE len(lw) > 0 GROUP BY r),
lines AS MATERIALIZED (SELECT r, source, array_to_string(lw, ' ') AS line, sum(len(lw)) AS words
                       FROM rows WHERE len(lw) > 0 GROUP BY ALL),
hosts AS (SELECT source, count(*) AS n_docs FROM docs GROUP BY source),
above AS (SELECT l.source, line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
          GROUP BY l.source, line, n_docs HAVING count(*) >= 20 AND count(*) > n_docs * 0.05),
gone AS (SELECT r, sum(words) AS n FROM lines l JOIN above a ON l.source IS NOT DISTINCT FROM a.source
         AND l.line = a.line GROUP BY r),
found AS (
  SELECT doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines,
         coalesce(again.n, 0) AS n_repeat_words, (len(w) - coalesce(gone.n, 0))::BIGINT AS n_left
  FROM docs LEFT JOIN again USING (r) LEFT JOIN dup USING (r) LEFT JOIN gone USING (r))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left >= n_words / 3.0 AS kept
FROM found
"""


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is an example; a real one comes from where secrets are kept."""
    return pii.replace(documents(spark, sf_dir), b"example key of the registered query")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.secrets(documents(spark, sf_dir)))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    decoded = bpe.decode(bpe.encode(documents(spark, sf_dir), path), path)
    return decoded.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.remove_repeats(documents(spark, sf_dir))
    return cut.select("doc_id", "n_bytes", "n_removed",
                      (F.size("spans") / 2).cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", whitening.quantised("embedding").alias("x"))
    return whitening.whiten(vectors).withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def repaired_damage(spoken: DataFrame) -> DataFrame:
    """Damages rows by a checksum of their ids and repairs what is left, all conversations returned."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    hit = F.crc32(F.concat_ws(":", *written[:2])) % 20
    role, text = (F.col(f"_{c}") for c in ("role", "text"))
    damaged = (spoken.select("conv_id", "turn", written[2].alias("_role"), written[3].alias("_text"),
                             hit.alias("_hit")).filter("_hit <> 0")
               .select("conv_id", "turn", F.when(F.col("_hit") == 4, "user").otherwise(role).alias("role"),
                       F.when(F.col("_hit") == 1, "").when(F.col("_hit") == 2, F.translate(text, ".!?", ""))
                       .otherwise(text).alias("text"),
                       F.explode(F.array_repeat(F.lit(0), F.when(F.col("_hit") == 3, 2).otherwise(1)))))
    return conversation_repair.repair(damaged, also=spoken.select("conv_id")).digests()


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_damage(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def license_columns(scanned: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"] & (s["covered"] == s["length"]))
    starts = F.transform(base, lambda s: s["start"].cast("bigint"))

    def labels(spans: Column | str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")

    score = F.array_max(F.transform("spans", lambda s: s["covered"] / s["length"]))
    return scanned.select(
        "doc_id", "n_words", F.size(base).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        labels(base).alias("base_labels"), labels("spans").alias("labels"),
        F.coalesce(score, F.lit(0.0)).alias("score"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_columns(license_scan.license_spans(documents(spark, sf_dir)))


def _sql_templates() -> str:
    rows = [*[(label, text, True) for label, text in license_scan.PHRASES],
            *[(label, text, False) for label, text in license_scan.NOTICES]]
    return ", ".join(f"({i}, '{label}', '{text.replace(chr(39), chr(39) * 2)}', {base})"
                     for i, (label, text, base) in enumerate(rows))


_SQL_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
OP13_SQL = f"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_SQL_WORDS} AS w FROM documents),
tpl AS MATERIALIZED (
  SELECT *, least(len(w), 4) AS k, CASE WHEN len(w) <= 4 THEN 0 ELSE len(w) // 8 END AS slack
  FROM (SELECT id, label, base, {_SQL_WORDS} AS w FROM (VALUES {_sql_templates()}) v(id, label, text, base))),
sizes AS (SELECT DISTINCT k FROM tpl),
grams AS MATERIALIZED (
  SELECT id, label, base, slack, k, len(w) AS n, i - 1 AS t, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM tpl)),
hits AS (
  SELECT r, grams.*, d - t AS diagonal
  FROM (SELECT r, k, i - 1 AS d, array_to_string(w[i:i + k - 1], ' ') AS g FROM (
          SELECT r, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes)) x
  JOIN grams USING (k, g)),
lined AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, id ORDER BY diagonal) <= slack
                    THEN 0 ELSE 1 END AS opens FROM (SELECT DISTINCT r, id, slack, diagonal FROM hits)),
spanned AS (SELECT r, id, diagonal, sum(opens) OVER (PARTITION BY r, id ORDER BY diagonal) AS span FROM lined),
covered AS (SELECT DISTINCT r, id, span, label, base, n, unnest(range(t, t + k)) AS word, diagonal
            FROM hits JOIN spanned USING (r, id, diagonal)),
spans AS (SELECT r, label, base, n, min(diagonal + word) AS start, count(DISTINCT word) AS c FROM covered
          GROUP BY r, id, span, label, base, n HAVING count(DISTINCT word) >= n * 0.6),
per AS (SELECT r, count(*) FILTER (base AND c = n) AS n_base, min(start) FILTER (base AND c = n) AS first_word,
               max(start) FILTER (base AND c = n) AS last_word,
               array_to_string(list_sort(list(DISTINCT label) FILTER (base AND c = n)), ',') AS base_labels,
               array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(c / n) AS score
        FROM spans GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0) AS score
FROM docs LEFT JOIN per USING (r)
"""


QUERIES = {f.__name__: f for f in (
    op1_ngram_join, op2_token_counts, op3_language_id, op4_exact_dedup, op5_mixing, op6_line_quality, op7_pii,
    op8_secrets,
    op9_bpe, op10_suffix_dedup, op11_whitening, op12_conversation_repair,
    op13_license_scan)}
ORACLES = {"op4_exact_dedup": OP4_SQL, "op6_line_quality": OP6_SQL, "op13_license_scan": OP13_SQL}
