"""Secrets by corpus-wide ownership frequency; DataFrame functions only.

One scan finds candidates: the base kinds (assignments to a password-like name, access keys, long hex
runs) and two wide ones that the method judges (``vendor``: documented token formats and private key
headers; ``mixed``: long runs of letters of both cases and digits). Every candidate's value is hashed,
and its different repositories and owners are counted over the whole corpus. A value held by more than
``max_owners`` owners is a widely copied example; one that belongs to few owners, has enough different
characters and is no placeholder looks live. Base spans are always reported; spans of the wide kinds
only where they look live and overlap no base span.

Counting is by (value, owner, repository), then (value, owner), then value, each with partial sums, so
a value copied by a third of all rows does not meet in one task. Positions are code points, the end
exclusive. Null texts count as empty; a null owner or repository counts as one owner or repository.
Rows that share an id are reported each on its own. Further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilltide.llm.common import text_or_empty
from skilltide.operators.scale import cut_lineage

# The base kinds. A hex run of 16 or more is the same as a maximal run of that length.
ASSIGN = (r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?"
          r"([A-Za-z0-9+/_.=-]+)")
ACCESS = r"AKIA[A-Z0-9]+()"
HEX = r"[0-9a-f]{16,}()"
# Documented formats of widely used services, and long mixed runs.
VENDOR = (r"(?:gh[opsu]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}"
          r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}"
          r"|-----BEGIN [A-Z ]*PRIVATE KEY-----)()")
MIXED = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{24,}+()"
KINDS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "vendor": VENDOR, "mixed": MIXED}
BASE = ("assign", "access", "hex")
PLACEHOLDER = r"(?i)example|sample|changeme|placeholder|dummy|your|xxxx|0000000|1234567"
MAX_OWNERS = 2
MIN_CHARACTERS = 8


def _found(pattern: str) -> Column:
    """All matches with the length of what lies before each: array of (gap, hit, value).

    The rest behind the last match is taken as a whole, else it would be searched from each of
    its places."""
    parts = f"(?s)(.*?)({pattern})|.+"
    take = [F.regexp_extract_all("_text", F.lit(parts), F.lit(g)) for g in (1, 2, 3)]
    zipped = F.arrays_zip(F.transform(take[0], F.length).alias("gap"), take[1].alias("hit"),
                          take[2].alias("value"))
    return F.when(F.col("_text").rlike(pattern), F.filter(zipped, lambda x: x["hit"] != ""))


def _keeps(kind: Column) -> Column:
    mixed = F.col("value").rlike("[a-z]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[0-9]")
    return (F.when(kind == "assign", F.length("value") >= 12)
            .when(kind == "access", F.length("value") >= 18)
            .when(kind == "mixed", mixed).otherwise(True))


def secrets(df: DataFrame, *, id: str = "doc_id", text: str = "text", owner: str = "source",
            repository: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """Per row: id and ``found``, its spans in order of start and kind, each with
    (start, rank, kind, end, value_sha256, n_owners, n_repositories, live)."""
    scanned = cut_lineage(
        df.select(F.col(id).alias("_id"), F.col(owner).cast("string").alias("_owner"),
                  F.col(repository).cast("string").alias("_repository"),
                  text_or_empty(text).alias("_text"))
        .select("_id", "_owner", "_repository",
                *[_found(p).alias(k) for k, p in KINDS.items()])
        .withColumn("_row", F.expr("uuid()")))
    some = F.filter(F.array(*[
        F.struct(F.lit(i).alias("rank"), F.lit(k).alias("kind"), F.col(k).alias("hits"))
        for i, k in enumerate(KINDS)]), lambda x: x["hits"].isNotNull())
    matches = (scanned.select("_row", "_owner", "_repository", F.explode(some).alias("s"))
               .select("_row", "_owner", "_repository", "s.rank", "s.kind",
                       F.posexplode("s.hits").alias("at", "m"))
               .select("*", F.col("m.gap").alias("gap"), F.col("m.hit").alias("hit"),
                       F.when(F.col("kind") == "assign", F.col("m.value"))
                       .otherwise(F.col("m.hit")).alias("value")).drop("m"))
    end = F.sum(F.col("gap") + F.length("hit")).over(
        Window.partitionBy("_row", "rank").orderBy("at"))
    spans = cut_lineage(
        matches.withColumn("end", end.cast("long"))
        .withColumn("start", F.col("end") - F.length("hit")).filter(_keeps(F.col("kind")))
        .select("_row", "_owner", "_repository", "rank", "kind", "start", "end",
                F.sha2("value", 256).alias("value_sha256"),
                ((F.size(F.array_distinct(F.split("value", ""))) >= MIN_CHARACTERS)
                 & ~F.col("value").rlike(PLACEHOLDER)).alias("varied")))

    owners = cut_lineage(
        spans.groupBy("value_sha256", "_owner", "_repository").agg(F.count("*").alias("n"))
        .groupBy("value_sha256", "_owner").agg(F.count("*").alias("n_repositories"))
        .groupBy("value_sha256").agg(F.count("*").alias("n_owners"),
                                     F.sum("n_repositories").alias("n_repositories")))
    judged = (spans.join(owners, "value_sha256")
              .withColumn("live", F.col("varied") & (F.col("n_owners") <= max_owners))
              .filter((F.col("rank") < len(BASE)) | F.col("live")))
    one = F.struct("start", "rank", "kind", "end", "value_sha256", "n_owners", "n_repositories",
                   "live")
    per_row = judged.groupBy("_row").agg(F.sort_array(F.collect_list(one)).alias("found"))
    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    clear = F.when(F.size(base) == F.size("found"), F.col("found")).otherwise(F.filter(
        "found", lambda x: (x["rank"] < len(BASE)) | ~F.exists(
            base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))))
    per_row = per_row.select("_row", clear.alias("found"))
    none = F.array().cast(per_row.schema["found"].dataType)
    return (scanned.select("_row", "_id").join(per_row, "_row", "left")
            .select(F.col("_id").alias(id), F.coalesce("found", none).alias("found")))


def digests(found: DataFrame, *, id: str = "doc_id") -> DataFrame:
    """Counts per base kind, digest of the base spans and all spans as text."""
    def spelled(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(
            ":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("found", lambda x: x["rank"] < len(BASE))
    return found.select(
        id, *[number(k).alias(f"n_{k}") for k in BASE],
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["live"])).cast("long").alias("n_live"),
        F.size(F.filter("found", lambda x: x["n_owners"] > MAX_OWNERS)).cast("long")
        .alias("n_copied"))
