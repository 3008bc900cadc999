"""Content-hash backfill of stored postings from their raw files."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import content_hash, posting_id
from .scale import cut_lineage, running_sums

GROUP = ["company", "job_title", "posted_date"]


class Backfill(NamedTuple):
    """The table with hashes filled in, and (seq, outcome) of every file."""

    table: DataFrame
    outcomes: DataFrame


def prepare_files(raw: DataFrame) -> DataFrame:
    """(seq, state, posting_id, content_hash, company, job_title, posted_date) of raw files.

    ``raw`` has the raw posting columns, ``seq`` (unique file order, a long) and optionally
    ``_corrupt_record``. A date that does not parse is NULL here.
    """
    title = F.coalesce("job_title", F.lit(""))
    body = F.coalesce("job_description", F.lit(""))
    broken = F.col("_corrupt_record").isNotNull() if "_corrupt_record" in raw.columns \
        else F.lit(False)
    state = (F.when(broken, "unreadable").when((title == "") & (body == ""), "empty")
             .otherwise("ready"))
    return raw.select(
        "seq", state.alias("state"), posting_id("job_url").alias("posting_id"),
        content_hash("company", title, body).alias("content_hash"), "company",
        title.alias("job_title"), F.try_to_date("posted_date").alias("posted_date"))


def match_candidates(files: DataFrame) -> DataFrame:
    """Dry run: (outcome, n) without touching the table."""
    kind = F.when(F.col("posting_id").isNotNull(), "strong_match_candidate").otherwise(
        "weak_match_candidate")
    outcome = F.when(F.col("state") == "ready", kind).otherwise(F.col("state"))
    return files.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


def _round(files: DataFrame, rows: DataFrame, weak: DataFrame) -> DataFrame:
    """Files left, with what is certain about them now: strong, weak, unmatched, demoted or open.

    Weak files take the rows of their group from the least id on, so what counts is how many files
    that come before may take a row of a group. ``files`` is (seq, p, h, g, tg): the row still
    named, the hash, the own group and the row's group. ``rows`` (p, g) are the rows that no strong
    file has taken, ``weak`` (seq, g) the files that certainly got one, whichever it is.
    """
    strong = F.col("p").isNotNull()
    first = files.groupBy("h").agg(F.min("seq").alias("lead_h"))
    naming = files.filter(strong).groupBy("p").agg(F.min("seq").alias("lead_p"))
    now = (files.join(first, "h").join(naming, "p", "left")
           .withColumn("first_h", F.col("seq") == F.col("lead_h"))
           .withColumn("first_p", F.coalesce(F.col("seq") == F.col("lead_p"), F.lit(False))))
    now = cut_lineage(now.select("seq", "p", "h", "g", "tg", "first_h", "first_p"))
    # Who may take a row of a group, and in which turn. Only files that fall through to it, or
    # that name a row another one names before, take one by the order of the rows.
    own = now.select("g", "seq", F.lit("own").alias("side"), F.lit(1).alias("u"), F.lit(0).alias("w"),
                     (~(F.col("first_p") & (F.col("tg") == F.col("g")))).cast("int").alias("d"))
    across = now.filter(F.col("tg") != F.col("g")).select(
        F.col("tg").alias("g"), "seq", F.lit("across").alias("side"), F.lit(1).alias("u"),
        F.lit(0).alias("w"), F.lit(0).alias("d"))
    got = weak.select("g", "seq", F.lit("won").alias("side"), F.lit(0).alias("u"), F.lit(1).alias("w"),
                      F.lit(0).alias("d"))
    turns = cut_lineage(running_sums(
        own.unionByName(across).unionByName(got), "g", ["seq", "side"],
        {"files": F.col("u"), "won": F.col("w"), "loose": F.col("d")}).select(
            "g", "seq", "side", "files", "won", "loose"))
    places = running_sums(rows, "g", ["p"], {"place": F.lit(1)}).select("p", "place")
    room = rows.groupBy("g").agg(F.count("*").alias("room"))
    here = turns.filter("side = 'own'").select("seq", F.col("files").alias("files_g"),
                                               F.col("won").alias("won_g"))
    there = turns.filter("side <> 'won'").select("seq", F.col("g").alias("tg"), "files", "won", "loose")
    judged = (now.join(here, "seq").join(there, ["seq", "tg"], "left").join(places, "p", "left")
              .join(room, "g", "left").withColumn("room", F.coalesce("room", F.lit(0))))
    safe = (F.col("files") + F.col("won") <= F.col("place")) | (
        (F.col("loose") == 0) & (F.col("won") == 0))
    verdict = (F.when(strong, F.when(F.col("won") > F.col("place"), "demoted")
                      .when(F.col("first_h") & F.col("first_p") & safe, "strong"))
               .when(F.col("won_g") >= F.col("room"), "unmatched")
               .when(F.col("first_h") & (F.col("files_g") + F.col("won_g") < F.col("room")), "weak"))
    return cut_lineage(judged.select("seq", "p", "h", "g", "tg",
                                     F.coalesce(verdict, F.lit("open")).alias("verdict")))


def _both(one: DataFrame | None, other: DataFrame) -> DataFrame:
    return other if one is None else one.unionByName(other)


def backfill_hashes(table: DataFrame, files: DataFrame) -> Backfill:
    """Fill NULL content hashes from prepared files, as if file after file in ``seq`` order.

    A strong match is the row with the file's posting id; a file whose row is missing or has a hash
    by its turn tries a weak one: the row of least id of equal company, title and date (NULLs equal)
    without a hash. Hashes stay unique: a file whose target exists but whose hash is taken has
    'collided', and it leaves its row free. A file without a target is 'unmatched'.

    Solved in rounds. Each settles all files whose end is certain whatever the open files before
    them do (see ``_round``), the first one left among them, and usually nearly all. A file whose
    hash is taken disturbs nobody, so it is set aside; whether it had a target follows from the
    claims in the end. Which row a weak file got follows from its rank. All counts are distributed
    prefix sums, so neither a hot group nor a hot hash meets in one task.
    """
    group = F.to_json(F.struct(*GROUP))
    rows = cut_lineage(table.filter(F.col("content_hash").isNull()).select(
        F.col("posting_id").alias("p"), group.alias("g")))
    ready = files.filter(F.col("state") == "ready").select(
        "seq", F.col("posting_id").alias("p"), F.col("content_hash").alias("h"), group.alias("g"))
    named = rows.select("p", F.col("g").alias("tg"))
    ready = cut_lineage(ready.join(named, "p", "left").select(
        "seq", F.when(F.col("tg").isNotNull(), F.col("p")).alias("p"), "h", "g", "tg"))
    taken = table.filter(F.col("content_hash").isNotNull()).select(
        F.col("content_hash").alias("h")).distinct()

    aside = cut_lineage(ready.join(taken, "h", "left_semi").select("seq"))
    left = ready.join(aside, "seq", "left_anti")
    strong = weak = unmatched = None
    free = rows
    while not left.isEmpty():
        judged = _round(left, free, ready.limit(0) if weak is None else weak)
        won = judged.filter("verdict = 'strong'").select("seq", "p", "h", F.col("tg").alias("g"))
        got = judged.filter("verdict = 'weak'").select("seq", "g", "h")
        strong, weak = _both(strong, won), _both(weak, got)
        unmatched = _both(unmatched, judged.filter("verdict = 'unmatched'").select("seq"))
        free = cut_lineage(free.join(won.select("p"), "p", "left_anti"))
        used = won.select("h").unionByName(got.select("h"))
        rest = (judged.filter("verdict IN ('open', 'demoted')")
                .join(won.select("p", F.lit(True).alias("gone")), "p", "left")
                .join(used.withColumn("late", F.lit(True)), "h", "left"))
        lost = F.coalesce("gone", F.col("verdict") == "demoted")
        rest = cut_lineage(rest.select(
            "seq", F.when(~lost, F.col("p")).alias("p"), "h", "g", F.when(~lost, F.col("tg")).alias("tg"),
            F.coalesce("late", F.lit(False)).alias("late")))
        aside = aside.unionByName(rest.filter("late").select("seq"))
        left = rest.filter("NOT late").drop("late")
    if strong is None:
        strong, weak = ready.limit(0).select("seq", "p", "h", "g"), ready.limit(0).select("seq", "g", "h")
        unmatched = ready.limit(0).select("seq")

    takers = running_sums(weak, "g", ["seq"], {"rank": F.lit(1)})
    places = running_sums(free, "g", ["p"], {"rank": F.lit(1)})
    claims = cut_lineage(strong.select("seq", "p", "h", "g").unionByName(
        takers.join(places, ["g", "rank"]).select("seq", "p", "h", "g")))
    done = table.join(claims.select(F.col("p").alias("posting_id"), F.col("h").alias("_filled")),
                      "posting_id", "left").select(*[
                          F.coalesce("content_hash", "_filled").alias(c) if c == "content_hash"
                          else F.col(c) for c in table.columns])

    asked = ready.join(aside, "seq", "left_semi")
    before = running_sums(
        claims.select("g", "seq", F.lit(1).alias("n"))
        .unionByName(asked.select("g", "seq", F.lit(0).alias("n"))), "g", ["seq"],
        {"used": F.col("n")}).filter("n = 0").select("seq", "used")
    room = rows.groupBy("g").agg(F.count("*").alias("room"))
    target = (F.col("p").isNotNull() & F.coalesce(F.col("claimed") > F.col("seq"), F.lit(True))) | (
        F.coalesce("room", F.lit(0)) > F.col("used"))
    late = (asked.join(claims.select("p", F.col("seq").alias("claimed")), "p", "left")
            .join(before, "seq").join(room, "g", "left")
            .select("seq", F.when(target, "collided").otherwise("unmatched").alias("outcome")))
    outcomes = (strong.select("seq", F.lit("matched_strong").alias("outcome"))
                .unionByName(weak.select("seq", F.lit("matched_weak").alias("outcome")))
                .unionByName(unmatched.select("seq", F.lit("unmatched").alias("outcome")))
                .unionByName(late)
                .unionByName(files.filter(F.col("state") != "ready").select(
                    "seq", F.col("state").alias("outcome"))))
    return Backfill(done, cut_lineage(outcomes))


def tally(outcomes: DataFrame, table: DataFrame) -> DataFrame:
    """(counter, n): files by outcome, then rows, rows with and rows without a hash."""
    files = outcomes.groupBy(F.col("outcome").alias("counter")).agg(F.count("*").alias("n"))
    sums = table.agg(F.count("*").alias("rows"),
                     F.count("content_hash").alias("rows_with_hash"))
    totals = sums.withColumn("rows_still_null", F.col("rows") - F.col("rows_with_hash")).unpivot(
        [], ["rows", "rows_with_hash", "rows_still_null"], "counter", "n")
    return files.unionByName(totals)
