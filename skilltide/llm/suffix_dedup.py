"""Long repeated passages: a logarithmic family of sparse suffix arrays.

A suffix array of all suffixes would be many times the text. Here a text's suffixes are sampled by
content: of the ``K``-byte strings that begin within any ``WINDOW - K + 1`` neighbouring places, the one
of least hash is an *anchor* (all of them where several are least). Two places that begin the same
``WINDOW`` bytes so have anchors at the same distance, and every repeat of that length is found at an
anchor. A batch's suffix array is the sorted table of its anchors' hashes.

* ``SuffixFamily.add`` sorts a batch, scans it against every existing level by merging (a sorted join),
  which gives the anchors that occur again, and then merges it with levels of its own size: level i
  holds 2^i batches, so each anchor is rewritten only log times. Old level files stay until the job's
  shared folder is removed.
* For anchors that occur again, their surroundings (all windows around the anchor) are hashed. Where
  these occur again too, every window of the anchor is a repeat. Else (the edge of a repeat) the windows
  are compared one by one: in one task for anchors with at most ``BIG_GROUP`` different surroundings,
  else as rows that are counted by window.
* A byte is removed if a repeated window covers it. Windows are judged on the input.

Equal anchors, surroundings and windows are counted by partial sums. The only broadcast is a bit table of fixed size that keeps anchors which occur once out of the second scan's
output; collisions there cost rows, not results.

Null texts count as empty. Rows with null or repeated ids are texts of their own. Further columns
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.llm.common import arrow_schema, forget_others
from skilltide.llm.shingles import OF_BYTE, mixed, powers
from skilltide.operators.scale import cut_lineage

WINDOW = 200
K = 64
BIT_TABLE = 1 << 27
PART = 1 << 18
HIGH = np.uint64((1 << 64) - (1 << 19))
BATCHES = 2
BIG_GROUP = 20_000
COMPARED_AT_ONCE = 4096
SIDE = WINDOW - K


def prefix_sums(codes: np.ndarray) -> np.ndarray:
    up, _ = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(OF_BYTE[codes] * up, out=sums[1:])
    return sums


def hashes_at(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges, the same for the same bytes anywhere."""
    _, down = powers(len(sums))
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` neighbours, by doubling."""
    out, size = values, 1
    while size < width:
        step = min(size, width - size)
        out = np.minimum(out[:len(out) - step], out[step:])
        size += step
    return out


def anchors(raw: bytes) -> Iterator[tuple]:
    """Parts of a text: (bytes, their prefix sums, begin of the part, and for each anchor its place,
    hash and the first and last begin of its windows; places count from the begin of the part).

    The place is put behind the hash in one number, so the leftmost of equal hashes is the least,
    and every window has exactly one anchor."""
    for start in range(0, max(0, len(raw) - WINDOW + 1), PART):
        codes = np.frombuffer(raw[start:start + PART + WINDOW - 1], np.uint8)
        sums = prefix_sums(codes)
        begins = np.arange(len(codes) - K + 1)
        _, down = powers(len(sums))
        values = mixed((sums[K:] - sums[:-K]) * down[:len(begins)])
        least = sliding_min((values & HIGH) | begins.astype(np.uint64), SIDE + 1)
        change = np.flatnonzero(np.diff(least)) + 1
        low = np.concatenate([[0], change])
        high = np.concatenate([change, [len(least)]]) - 1
        at = (least[low] & ~HIGH).astype(np.int64)
        yield codes, sums, start, at, values[at], low, high


def _rows(schema: pa.Schema, columns: list[list[np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64)).cast(f.type)
         for c, f in zip(columns, schema, strict=True)], schema=schema)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    forget_others()
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(1)[i].as_py()
            yield batch.column(0)[i].as_py(), (text or "").encode()


def suffix_array(texts: DataFrame) -> DataFrame:
    """(key, n): the different anchors of a batch with their number of occurrences, sorted."""
    schema = pa.schema([("key", pa.int64())])

    def run(batches):
        keys, size = [], 0
        for _, raw in _texts(batches):
            for _, _, _, _, found, _, _ in anchors(raw):
                keys.append(found.view(np.int64))
                size += len(found)
            if size > 1 << 17:
                yield _rows(schema, [keys])
                keys, size = [], 0
        yield _rows(schema, [keys])

    return (texts.select("_row", "_text").mapInArrow(run, "key bigint")
            .groupBy("key").agg(F.count("*").alias("n")).sortWithinPartitions("key"))


class SuffixFamily:
    """Levels of sorted anchor tables in the shared folder."""

    def __init__(self):
        self.levels: dict[int, DataFrame] = {}
        self.merged_only: set[int] = set()
        self.again: list[DataFrame] = []

    def add(self, texts: DataFrame) -> None:
        """Scan a new batch against all levels, then merge equal-sized levels."""
        new = cut_lineage(suffix_array(texts))
        self.again.append(new.filter("n > 1").select("key"))
        for size in self.levels:
            if size in self.merged_only:  # written when first read
                self.levels[size] = cut_lineage(self.levels[size])
                self.merged_only.discard(size)
            level = self.levels[size].select("key")
            self.again.append(cut_lineage(new.select("key").join(level, "key")))
        size = 0
        while size in self.levels:
            new = (new.unionByName(self.levels.pop(size)).groupBy("key")
                   .agg(F.sum("n").alias("n")).sortWithinPartitions("key"))
            size += 1
            self.merged_only.add(size)
        self.levels[size] = new

    def repeated(self) -> DataFrame:
        """Anchors with more than one occurrence in all that was added."""
        out = self.again[0]
        for more in self.again[1:]:
            out = out.unionByName(more)
        return cut_lineage(out.distinct())


def bit_table(keys: DataFrame) -> np.ndarray:
    """One bit for each place of a table of fixed size, set for the keys' places."""
    place = F.pmod(F.col("key"), F.lit(BIT_TABLE)) + 1
    maps = (keys.select(place.alias("at"))
            .groupBy(F.bitmap_bucket_number("at").alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")))
    table = np.zeros(BIT_TABLE // 8, np.uint8)
    for row in maps.toLocalIterator():
        at = (row["bucket"] - 1) * 4096
        table[at:at + 4096] = np.frombuffer(row["bits"], np.uint8)
    return table


def in_table(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys % np.uint64(BIT_TABLE)
    return table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 > 0


def at_anchors(texts: DataFrame, table: np.ndarray, columns: str, make) -> DataFrame:
    """Rows that ``make`` gives for the anchors of each part that are set in the table.

    What ``make`` remembers in its last argument lasts for the task."""
    shared = texts.sparkSession.sparkContext.broadcast(table)
    row_type = texts.schema["_row"].dataType.simpleString()
    arrow_row = arrow_schema(texts.sparkSession, f"_row {row_type}").field(0).type
    names = ["_row", *[c.split()[0] for c in columns.split(", ")]]

    def run(batches):
        table, seen = shared.value, set()
        for row, raw in _texts(batches):
            for codes, sums, start, *found in anchors(raw):
                keep = in_table(table, found[1])
                if keep.any():
                    made = make(codes, sums, start, *[x[keep] for x in found], seen)
                    if len(made[0]):
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([row] * len(made[0]), arrow_row), *map(pa.array, made)],
                            names=names)

    return texts.select("_row", "_text").mapInArrow(run, f"_row {row_type}, {columns}")


def _whole(sums, at, low, high) -> np.ndarray:
    """Hash of all bytes of an anchor's windows and its place among them."""
    return hashes_at(sums, low, high + WINDOW) ^ mixed((at - low).astype(np.uint64))


def _around(codes, sums, start, at, keys, low, high, seen):
    return (keys.view(np.int64), _whole(sums, at, low, high).view(np.int64), low + start,
            high + start)


def _first_seen(whole: np.ndarray, seen: set) -> np.ndarray:
    """Places of surroundings that this task has not sent yet; copies are sent once."""
    new = [i for i, x in enumerate(whole.tolist()) if not (x in seen or seen.add(x))]
    return np.array(new, np.int64)


def _bytes_around(codes, sums, start, at, keys, low, high, seen):
    whole = _whole(sums, at, low, high).view(np.int64)
    i = _first_seen(whole, seen)
    data = codes.tobytes()
    return (keys[i].view(np.int64), whole[i], low[i] + start,
            [data[a:b + WINDOW] for a, b in zip(low[i], high[i], strict=True)])


def _each_window(codes, sums, start, at, keys, low, high, seen):
    whole = _whole(sums, at, low, high).view(np.int64)
    i = _first_seen(whole, seen)
    keys, whole, low, sizes = keys[i], whole[i], low[i], (high - low + 1)[i]
    begins = np.repeat(low - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
    windows = hashes_at(sums, begins, begins + WINDOW).view(np.int64)
    return np.repeat(keys, sizes).view(np.int64), np.repeat(whole, sizes), begins + start, windows


def _compared(group: pd.DataFrame) -> pd.DataFrame:
    """Repeated windows of the surroundings that occur once, among all surroundings of their anchors.

    Equal windows have equal anchors, so the surroundings of several anchors are counted together."""
    group = group.drop_duplicates(["key", "whole"])
    sizes = group["data"].str.len().to_numpy(np.int64)
    counts = sizes - WINDOW + 1
    data = np.cumsum(sizes) - sizes
    before = np.cumsum(counts) - counts
    begins = np.repeat(data - before, counts) + np.arange(counts.sum())
    sums = prefix_sums(np.frombuffer(b"".join(group["data"]), np.uint8))
    _, inverse, often = np.unique(hashes_at(sums, begins, begins + WINDOW), return_inverse=True,
                                  return_counts=True)
    mine = np.zeros(len(begins) + 1, bool)
    mine[:-1] = often[inverse] > 1
    starts = np.zeros(len(begins) + 1, bool)
    starts[before] = True
    begin = np.flatnonzero(mine & (starts | ~np.concatenate([[False], mine[:-1]])))
    end = np.flatnonzero(mine[:-1] & (starts[1:] | ~mine[1:])
                         | mine[:-1] & (np.arange(len(begins)) == len(begins) - 1))
    at = np.searchsorted(before, begin, "right") - 1
    low = group["low"].to_numpy(np.int64)[at] + begin - before[at]
    return pd.DataFrame({"_row": group["_row"].to_numpy()[at], "low": low,
                         "high": low + (end - begin)})


def _in_key_order(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare sorted rows, some thousand at once, never parting an anchor."""
    waiting = None
    for frame in frames:
        waiting = frame if waiting is None else pd.concat([waiting, frame], ignore_index=True)
        last = waiting["key"].iloc[-1] if len(waiting) else None
        if len(waiting) >= COMPARED_AT_ONCE and waiting["key"].iloc[0] != last:
            done = (waiting["key"] != last).to_numpy()
            ready, waiting = waiting[done], waiting[~done]
            edges = np.flatnonzero(np.diff(ready["key"].to_numpy())) + 1
            cuts = [0, *[edges[i] for i in np.unique(np.searchsorted(
                edges, np.arange(COMPARED_AT_ONCE, len(ready), COMPARED_AT_ONCE)))
                if i < len(edges)], len(ready)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield _compared(ready.iloc[a:b])
    if waiting is not None and len(waiting):
        yield _compared(waiting)


def repeated_spans(texts: DataFrame, batches: int = BATCHES,
                   big_group: int = BIG_GROUP) -> DataFrame:
    """(_row, low, high): ranges of begins of windows that begin somewhere else, too."""
    row_type = texts.schema["_row"].dataType.simpleString()
    family = SuffixFamily()
    for batch in range(batches):
        family.add(texts.filter(F.pmod(F.xxhash64("_row"), F.lit(batches)) == batch))
    table = bit_table(family.repeated())

    near = cut_lineage(at_anchors(texts, table, "key bigint, whole bigint, low bigint, high bigint",
                                  _around))
    wholes = cut_lineage(near.groupBy("key", "whole").agg(F.count("*").alias("n")))
    copied = wholes.filter("n > 1").select("key", "whole")
    spans = near.join(copied, ["key", "whole"], "left_semi").select("_row", "low", "high")

    keys = cut_lineage(wholes.groupBy("key").agg(F.count("*").alias("wholes"), F.min("n").alias("n"))
                       .filter("wholes > 1 AND n = 1").select("key", "wholes"))
    small, big = keys.filter(F.col("wholes") <= big_group), keys.filter(F.col("wholes") > big_group)
    sent = at_anchors(texts, bit_table(small), "key bigint, whole bigint, low bigint, data binary",
                      _bytes_around)
    spans = spans.unionByName(
        sent.join(small.select("key"), "key", "left_semi").repartition("key")
        .sortWithinPartitions("key").mapInPandas(_in_key_order, f"_row {row_type}, low bigint, high bigint"))
    if not big.isEmpty():
        windows = cut_lineage(
            at_anchors(texts, bit_table(big),
                       "key bigint, whole bigint, begin bigint, window bigint", _each_window)
            .join(big.select("key"), "key", "left_semi")
            .dropDuplicates(["key", "whole", "window"]))
        again = cut_lineage(windows.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1")
                            .select("window"))
        spans = spans.unionByName(
            windows.join(again, "window", "left_semi")
            .select("_row", F.col("begin").alias("low"), F.col("begin").alias("high")))
    return spans


def remove_repeats(df: DataFrame, *, id: str = "doc_id", text: str = "text",
                   batches: int = BATCHES, big_group: int = BIG_GROUP) -> DataFrame:
    """Per row: id, n_bytes, n_removed, ``spans`` (maximal removed byte runs as begin and end pairs)
    and ``kept`` (the remaining bytes)."""
    kind = df.schema[id].dataType.simpleString()
    texts = df.select(F.col(id).alias("_row"), F.col(id).alias("_id"), F.col(text).alias("_text"))
    twice = texts.groupBy("_row").agg(F.count("*").alias("n")).filter("n > 1 OR _row IS NULL")
    if not twice.isEmpty():  # rows need a key of their own
        texts = cut_lineage(texts.withColumn("_row", F.expr("uuid()")))
    per_row = cut_lineage(
        repeated_spans(texts, batches, big_group).groupBy("_row")
        .agg(F.collect_list(F.struct("low", "high")).alias("ranges")))

    out_schema = arrow_schema(df.sparkSession, f"`{id}` {kind}, n_bytes bigint, n_removed bigint, "
                               "spans array<bigint>, kept binary")

    def cut(row):
        key, text, ranges = row
        raw = (text or "").encode()
        runs = covered(ranges or [])
        at, kept = 0, []
        for begin, end in runs:
            kept.append(raw[at:begin])
            at = end
        kept.append(raw[at:])
        return key, len(raw), sum(b - a for a, b in runs), [x for r in runs for x in r], b"".join(kept)

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = [cut([c[i].as_py() for c in part.columns]) for i in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), out_schema,
                                                         strict=True)], schema=out_schema)

    return (texts.join(per_row, "_row", "left").select("_id", "_text", "ranges")
            .mapInArrow(run, f"`{id}` {kind}, n_bytes bigint, n_removed bigint, "
                             "spans array<bigint>, kept binary"))


def covered(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes that windows beginning in these ranges cover."""
    out: list[list[int]] = []
    for low, high in sorted((r["low"], r["high"]) for r in ranges):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high + WINDOW)
        else:
            out.append([low, high + WINDOW])
    return [(a, b) for a, b in out]
