"""Posting ingest as a stream of arriving files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.keys import insert_flags
from ..operators.scale import cut_lineage
from ..plans.ingest import COLUMNS, build_postings, split_failures
from ..sources.key_index import BUCKETS, KeyIndex
from ..sources.postings import split_readable, stream_postings, with_arrival
from ..sources.tables import pinned_snapshot, read_batches, write_batch

# Stands for the batches of a table that had no index yet.
BUILT = -1


def ingest_batch(raw: DataFrame, batch: int, *, table: str, dead_letters: str,
                 build: Callable[[DataFrame], DataFrame] = build_postings,
                 enrich: Callable[[DataFrame], DataFrame] | None = None,
                 key_buckets: int = BUCKETS) -> None:
    """Insert one batch of raw rows, with the double-key rule against all other batches.

    The batch has its own folder, which a repeated attempt replaces, so replaying it after a
    lost executor or driver neither loses nor doubles rows. Rows that fail for good go to the
    dead letters; a transient failure fails the batch and Spark tries it again.

    Stored keys are looked up in an index beside the table (``_keys``), of which only the buckets
    of the batch's own keys are read. The index is entered before the rows: if the driver is lost
    in between, the repeated batch replaces both. An index that is missing is built from the table.
    """
    spark = raw.sparkSession
    readable, broken = split_readable(cut_lineage(with_arrival(raw)))
    # Random ids must be drawn once, before the rows are used several times.
    built = cut_lineage(build(readable))
    good, failed = split_failures(built)
    index = KeyIndex(spark, f"{table}/_keys", key_buckets)
    if not index.exists() and (stored := read_batches(spark, table, besides=batch)) is not None:
        index.add(stored, BUILT)
    # Not written by themselves: the flags are, and the index reads two columns of the built rows.
    fresh = (insert_flags(good, index.stored(good, besides=batch))
             .filter("inserted").select(*COLUMNS))
    index.add(fresh, batch)
    write_batch(fresh if enrich is None else enrich(fresh), table, batch)
    letters = failed.select("source_file", "error").unionByName(
        broken.select("source_file", F.lit("unreadable").alias("error")))
    write_batch(letters, dead_letters, batch)


def start_ingest(spark: SparkSession, inbox: str, *, table: str, dead_letters: str,
                 checkpoint: str, build: Callable[[DataFrame], DataFrame] = build_postings,
                 read_dimension: Callable[[SparkSession], DataFrame] | None = None,
                 attach: Callable[[DataFrame, DataFrame], DataFrame] | None = None,
                 dimension: str | None = None, key_buckets: int = BUCKETS,
                 files_per_batch: int = 10_000, multi_line: bool = True,
                 once: bool = True) -> StreamingQuery:
    """Run the ingest over everything in the inbox (``once``) or every minute.

    ``read_dimension`` is called for every batch and ``attach`` joins it to the new rows, so a
    refreshed title map is seen without a restart. With ``dimension``, a snapshot table, a batch
    sees the version that was the latest when it was first tried, also when it is repeated.
    """
    def run(raw: DataFrame, batch: int) -> None:
        enrich = None
        titles = None
        if dimension is not None:
            titles = pinned_snapshot(raw.sparkSession, dimension, f"{table}/_pins", batch)
        elif read_dimension is not None:
            titles = read_dimension(raw.sparkSession)
        if titles is not None and attach is not None:
            enrich = lambda rows: attach(rows, titles)
        ingest_batch(raw, batch, table=table, dead_letters=dead_letters, build=build,
                     enrich=enrich, key_buckets=key_buckets)

    writer = (stream_postings(spark, inbox, files_per_batch=files_per_batch,
                              multi_line=multi_line).writeStream
              .option("checkpointLocation", checkpoint).foreachBatch(run))
    timing = {"availableNow": True} if once else {"processingTime": "1 minute"}
    return writer.trigger(**timing).start()
