"""Key constraints as operators: double-key insert, upsert, first writer wins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scale import broadcast_if_small, cut_lineage, first_per_key

# State of a row in a chain: known to be out or to enter, waiting for two rows, or a link, which enters
# exactly if the row it points to does not (OPPOSITE) or does (ALIKE).
OUT, ENTERS, WAITS, OPPOSITE, ALIKE = range(5)


def insert_flags(batch: DataFrame, existing: DataFrame | None = None, *,
                 id_col: str = "posting_id", hash_col: str = "content_hash",
                 arrival: str = "arrival") -> DataFrame:
    """Add ``inserted``: whether a row would enter a table with unique id and unique hash.

    A row enters when no row that entered before it, in ``arrival`` order, has its id or its
    non-NULL hash. Rows that did not enter block nobody, so this is not a pair of
    drop-duplicates. ``arrival`` must be unique and orderable.

    Solved in rounds: among the rows left, one that arrives first for both of its keys enters,
    and all rows sharing a key with it are out. A round is two partial aggregates and joins on
    unique values, so a key held by a third of all rows costs no more than others, and it usually
    settles nearly all. What it leaves are rows that wait for one another; after a round that
    settles less than half, chains of such rows are settled whole by pointer doubling (see
    ``_chains``), so a chain of n rows takes about log2(n) joins.
    """
    left = batch.select(F.col(arrival).alias("a"), F.col(id_col).alias("p"),
                        F.col(hash_col).alias("h"))
    given = left = cut_lineage(left)
    if existing is not None:
        # First look up which keys of the batch are stored: a small batch is broadcast to a
        # narrow scan, where an anti join would shuffle every stored key.
        asked = broadcast_if_small(left.select("p", "h"))
        ids = existing.select(F.col(id_col).alias("p")).join(asked, "p", "left_semi")
        hashes = existing.select(F.col(hash_col).alias("h")).join(asked, "h", "left_semi")
        left = left.join(ids, "p", "left_anti").join(hashes, "h", "left_anti")
        left = cut_lineage(left.select("a", "p", "h"))
    entered, settle, n = None, _first_on_both, left.count()
    while n:
        winners, left = settle(left)
        entered = winners if entered is None else entered.unionByName(winners)
        # What settles most rows by itself goes on; rows that wait in chains are taken as such.
        before, n = n, left.count()
        settle = _first_on_both if settle is _chains or 2 * n < before else _chains
    if entered is None:
        return batch.withColumn("inserted", F.lit(False))
    # Mark the rows by whichever side is smaller. Mostly few rows are refused, and their keys
    # are broadcast, so that the wide rows of the batch are not shuffled.
    most = 2 * entered.count() > given.count()
    marked = given.select("a").join(entered, "a", "left_anti") if most else entered
    marks = cut_lineage(marked.select(F.col("a").alias(arrival), F.lit(True).alias("_marked")))
    hit = F.coalesce("_marked", F.lit(False))
    return (batch.join(marks, arrival, "left")
            .withColumn("inserted", ~hit if most else hit).drop("_marked"))


def _first_on_both(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (a) that arrive first for both keys, and the rows (a, p, h) that share none with them."""
    by_id = left.groupBy("p").agg(F.min_by(F.struct("a", "h"), "a").alias("r")).select(
        "p", "r.a", "r.h")
    by_hash = left.filter(F.col("h").isNotNull()).groupBy("h").agg(
        F.min("a").alias("a")).select("a", F.lit(True).alias("first_hash"))
    won = by_id.join(by_hash, "a", "left").filter(
        F.col("h").isNull() | F.col("first_hash")).select("a", "p", "h")
    # Winners, and rows that share no key with one, in a single written step.
    step = cut_lineage(
        left.join(won.select("p", F.col("a").alias("winner")), "p", "left")
        .join(won.filter(F.col("h").isNotNull()).select("h", F.lit(True).alias("used")),
              "h", "left")
        .withColumn("won", F.coalesce(F.col("winner") == F.col("a"), F.lit(False)))
        .filter(F.col("won") | (F.col("winner").isNull() & F.col("used").isNull()))
        .select("a", "p", "h", "won"))
    return step.filter("won").select("a"), step.filter(~F.col("won")).drop("won")


def _chains(left: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same, for rows whose entry depends on one other row each.

    A key is taken after the first of its rows that is also first for its other key, whether or
    not that row enters; the key's later rows are out. A row that is first for one key and, of
    the rows not out, second for the other enters exactly if the first row of that key does not:
    a link with a negation. Links form chains, as a row is second for one key at most. Doubling
    joins each link to the one it points at until all point to a row that is settled, or that
    waits for two rows; what hangs on such a row is left for the next round.
    """
    hashed = F.col("h").isNotNull()
    marked = cut_lineage(
        left.join(left.groupBy("p").agg(F.min("a").alias("lead_p")), "p")
        .join(left.filter(hashed).groupBy("h").agg(F.min("a").alias("lead_h")), "h", "left")
        .withColumn("first_p", F.col("a") == F.col("lead_p"))
        .withColumn("first_h", ~hashed | (F.col("a") == F.col("lead_h"))))
    end_p = marked.filter("first_h").groupBy("p").agg(F.min("a").alias("end_p"))
    end_h = marked.filter(hashed & F.col("first_p")).groupBy("h").agg(F.min("a").alias("end_h"))
    still = cut_lineage(
        marked.join(end_p, "p", "left").join(end_h, "h", "left")
        .filter((F.col("a") <= F.coalesce("end_p", "a")) & (F.col("a") <= F.coalesce("end_h", "a")))
        .select("a", "p", "h", "lead_p", "lead_h", "first_p", "first_h"))
    sure = F.col("first_p") & F.col("first_h")
    next_p = still.filter(~F.col("first_p")).groupBy("p").agg(F.min("a").alias("next_p"))
    next_h = still.filter(~F.col("first_h")).groupBy("h").agg(F.min("a").alias("next_h"))
    to = (F.when(F.col("first_p") & (F.col("a") == F.col("next_h")), F.col("lead_h"))
          .when(F.col("first_h") & (F.col("a") == F.col("next_p")), F.col("lead_p")))
    state = F.when(sure, ENTERS).when(to.isNotNull(), OPPOSITE).otherwise(WAITS).cast("tinyint")
    nodes = cut_lineage(
        still.join(next_p, "p", "left").join(next_h, "h", "left")
        .select("a", "p", "h", F.when(~sure, to).alias("to"), state.alias("state")))
    # Only (a, to, state) goes through the joins, and a row that is settled is written no more.
    links = nodes.filter("to IS NOT NULL").select("a", "to", "state")
    settled = [nodes.filter("to IS NULL").select("a", "state")]
    while not links.isEmpty():
        none = F.lit(None).cast(links.schema["to"].dataType)
        target = reduce(DataFrame.unionByName, [
            links.select(F.col("a").alias("to"), F.col("to").alias("to2"), F.col("state").alias("state2")),
            *[s.select(F.col("a").alias("to"), none.alias("to2"), F.col("state").alias("state2"))
              for s in settled]])
        # A row that is not among the nodes is out, which is known as well.
        mine, its = F.col("state"), F.coalesce("state2", F.lit(OUT))
        now = (F.when(its == WAITS, WAITS)
               .when(its.isin(OUT, ENTERS), F.when(mine == OPPOSITE, ENTERS - its).otherwise(its))
               .when(mine == its, ALIKE).otherwise(OPPOSITE))
        stepped = cut_lineage(links.join(target, "to", "left").select(
            "a", F.col("to2").alias("to"), now.cast("tinyint").alias("state")))
        links = stepped.filter("to IS NOT NULL")
        settled.append(stepped.filter("to IS NULL").select("a", "state"))
    states = reduce(DataFrame.unionByName, settled)
    won = states.filter(F.col("state") == ENTERS).select("a")
    waiting = states.filter(F.col("state") == WAITS).select("a")
    rows = nodes.select("a", "p", "h")
    if waiting.isEmpty():
        return won, rows.limit(0)
    used = cut_lineage(rows.join(won, "a"))
    rest = cut_lineage(rows.join(waiting, "a").join(used.select("p"), "p", "left_anti")
                       .join(used.filter(hashed).select("h"), "h", "left_anti").select("a", "p", "h"))
    return won, rest


def insert_rows(batch: DataFrame, existing: DataFrame | None = None, **names: str) -> DataFrame:
    """Only the rows that enter, in the shape of the batch."""
    return insert_flags(batch, existing, **names).filter("inserted").drop("inserted")


def upsert(table: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``new`` replace those with the same key; all others stay as they are."""
    kept = table.join(new.select(*key), list(key), "left_anti")
    return kept.unionByName(new.select(*table.columns))


def insert_absent(table: DataFrame, new: DataFrame, key: Sequence[str],
                  arrival: str | None = None) -> DataFrame:
    """First writer wins: rows of ``new`` enter only under keys the table does not have, and of
    several new rows the earliest. Nothing already stored is changed."""
    order = F.col(arrival) if arrival else F.struct(*[c for c in new.columns if c not in key])
    first = first_per_key(new, list(key), order)
    fresh = first.join(table.select(*key), list(key), "left_anti")
    return table.unionByName(fresh.select(*table.columns))
