"""Near duplicates: n-gram Jaccard join by rare-first prefix filtering.

1. Every text becomes its set of hashed shingles. Equal sets are one *node* (a 64-bit hash of the
   set), so copies are never paired.
2. Shingles are ordered rare first, by counts over all documents in a table of fixed size
   (``COUNTERS``); any order is exact, a better one only makes lists shorter.
3. Two sets that are similar enough share a shingle in their prefixes. The prefix shingles of all
   nodes are indexed; shingles that occur once are dropped.
4. Nodes of a list are not all paired. Some nodes of each list, the pivots, are compared with all
   others of it that are in another component; they then leave the list, as all their pairs are
   decided. Lists that lie in one component are done, as no link can join anything there. Each round
   takes ``GROWTH`` times as many pivots as the one before, so lists of texts that are not linked end
   after few rounds, and a hot list of near copies costs about one comparison a member. The first
   pivots of a list are those with the fewest rarer shingles before it: what the others were copied
   from has no shingles of its own there.
5. A pair passes a length, a positional and a suffix filter (sizes of hash classes) and is verified
   once, on whole sets.
6. Components follow by taking smallest neighbours and jumping pointers, in tables.

The result is exact: documents i and j get the same component exactly if links connect them.

Nothing that grows with the corpus is collected or broadcast: the broadcasts are the counter table and
a bit table of fixed size that keeps sets which no pair asks for out of the shuffle. Null texts and
texts without words have no shingles and are their own component. The component of a row with a null
id counts the other ids (null if there is none). Repeated ids are separate rows with the same text rules.
Further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilltide.llm.common import arrow_schema, bounded_batches, forget_others
from skilltide.llm.shingles import shingle_set
from skilltide.operators.scale import cut_lineage

COUNTERS = 1 << 20
BLOCKS = 16
CLASSES = 32
GROWTH = 16
BIT_TABLE = 1 << 26


def prefix_length(n: int, percent: int) -> int:
    """Shingles of which two sets of similarity ``percent`` / 100 share one."""
    return n - (-(-percent * n // 100)) + 1 if n else 0


def node_of(shingles: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingles.tobytes(), digest_size=8).digest(), "little",
                          signed=True)


def class_sizes(shingles: np.ndarray) -> bytes:
    """Set size by hash class, as 32-bit integers."""
    return np.bincount((shingles >> np.uint64(20)).astype(np.int64) % CLASSES,
                       minlength=CLASSES).astype("<u4").tobytes()


def _batches(columns: dict[str, pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cells = list(zip(*rows, strict=True)) if rows else [[] for _ in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(cells, columns.values(), strict=True)],
        names=list(columns))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    forget_others()
    for batch in batches:
        for i in range(batch.num_rows):
            yield [c[i].as_py() for c in batch.columns]


def _texts_of(batches: Iterator[pa.RecordBatch], table: np.ndarray) -> Iterator[str]:
    """Texts whose hash has its bit set in the table."""
    forget_others()
    for batch in batches:
        bits = batch.column(2).to_numpy() % BIT_TABLE
        for i in np.flatnonzero(table[bits >> 3] >> (bits & 7).astype(np.uint8) & 1).tolist():
            yield batch.column(1)[i].as_py()


def described(texts: DataFrame, width: int) -> DataFrame:
    """Rows of documents (what 0: id, hash, node, n, classes) and of counters (what 1: block, counts)."""
    kind = texts.schema["_id"].dataType.simpleString()
    ddl = f"what int, _id {kind}, hash bigint, node bigint, n bigint, classes binary, block int, counts binary"
    schema = arrow_schema(texts.sparkSession, ddl)
    columns = {f.name: f.type for f in schema}

    def run(batches):
        counts = np.zeros(COUNTERS, np.uint32)
        rows, waiting, size = [], [], 0
        for key, text, hashed in _texts(batches):
            found = shingle_set(text, width)
            waiting.append(found >> np.uint64(44))
            size += len(found)
            if size > 1 << 18:
                counts += _bucket_counts(waiting)
                waiting, size = [], 0
            rows.append((0, key, hashed, node_of(found) if len(found) else None, len(found),
                         class_sizes(found), None, None))
            if len(rows) == 4096:
                yield _batches(columns, rows)
                rows = []
        if waiting:
            counts += _bucket_counts(waiting)
        for block, part in enumerate(np.split(counts, BLOCKS)):
            if part.any():
                rows.append((1, None, None, None, 0, None, block, zlib.compress(part.tobytes(), 1)))
        yield _batches(columns, rows)

    return texts.mapInArrow(run, ddl)


def _bucket_counts(buckets: list[np.ndarray]) -> np.ndarray:
    return np.bincount(np.concatenate(buckets).astype(np.int64),
                       minlength=COUNTERS).astype(np.uint32)


def _summed(frame: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(COUNTERS // BLOCKS, np.uint64)
    for data in frame["counts"]:
        total += np.frombuffer(zlib.decompress(data), np.uint32)
    top = np.minimum(total, 0xFFFFFFFF).astype(np.uint32)
    return pd.DataFrame({"block": [frame["block"].iloc[0]], "part": [0],
                         "counts": [zlib.compress(top.tobytes(), 1)]})


def shingle_counts(counters: DataFrame) -> np.ndarray:
    """The whole counter table, of fixed size; summed by block and part, then by block."""
    schema = "block int, part int, counts binary"
    parts = counters.select("block", F.pmod(F.xxhash64("counts"), F.lit(64)).cast("int")
                            .alias("part"), "counts")
    rows = (parts.groupBy("block", "part").applyInPandas(_summed, schema)
            .groupBy("block").applyInPandas(_summed, schema).collect())
    table = np.zeros((BLOCKS, COUNTERS // BLOCKS), np.uint32)
    for row in rows:
        table[row["block"]] = np.frombuffer(zlib.decompress(row["counts"]), np.uint32)
    return table.reshape(-1)


def prefix_index(texts: DataFrame, counts: np.ndarray, width: int, percent: int) -> DataFrame:
    """(shingle, node, n, pos) for the rare-first prefix of each node; once a task for copies."""
    shared = texts.sparkSession.sparkContext.broadcast(counts)
    names = ["shingle", "node", "n", "pos"]

    def run(batches):
        table, seen, parts, size = shared.value, set(), [], 0
        for _, text, _ in _texts(batches):
            found = shingle_set(text, width)
            node = node_of(found) if len(found) else None
            if node is None or node in seen:
                continue
            seen.add(node)
            often = table[(found >> np.uint64(44)).astype(np.int64)]
            first = np.argsort(often, kind="stable")[:prefix_length(len(found), percent)]
            parts.append((found[first].view(np.int64), node, len(found)))
            size += len(first)
            if size > 1 << 16:
                yield _index_rows(names, parts)
                parts, size = [], 0
        if parts:
            yield _index_rows(names, parts)

    return texts.mapInArrow(run, "shingle bigint, node bigint, n bigint, pos bigint")


def _index_rows(names: list[str], parts: list[tuple]) -> pa.RecordBatch:
    sizes = [len(p[0]) for p in parts]
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate([p[0] for p in parts])),
        pa.array(np.repeat(np.array([p[1] for p in parts], np.int64), sizes)),
        pa.array(np.repeat(np.array([p[2] for p in parts], np.int64), sizes)),
        pa.array(np.concatenate([np.arange(s) for s in sizes]))], names=names)


def needed_overlap(n_a, n_b, percent: int):
    """Least intersection of sets of these sizes at this similarity."""
    return F.ceil((n_a + n_b) * percent / F.lit(100.0 + percent) - 1e-6)


def candidate_pairs(lists: DataFrame, pivots: DataFrame, percent: int) -> DataFrame:
    """Pairs of a pivot and another node of its list that pass the length and positional filters.

    The positional filter takes the shared shingle as the first common one: no more than what
    follows it can be shared. A similar pair passes at its first common shingle; where another one
    fails the pair is not lost, as the list of the first one compares it too."""
    p = pivots.select("shingle", *[F.col(c).alias(f"p_{c}") for c in ("node", "n", "pos", "comp")])
    both = lists.join(p, "shingle").filter((F.col("comp") != F.col("p_comp")))
    small, large = F.least("n", "p_n"), F.greatest("n", "p_n")
    room = F.least(F.col("n") - F.col("pos"), F.col("p_n") - F.col("p_pos"))
    passed = both.filter((small * 100 >= large * percent)
                         & (room >= needed_overlap(F.col("n"), F.col("p_n"), percent)))
    return passed.select(F.least("node", "p_node").alias("a"),
                         F.greatest("node", "p_node").alias("b")).distinct()


def suffix_filter(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose hash classes have room for the needed overlap."""
    def side(name):
        return nodes.select(F.col("node").alias(name), F.col("n").alias(f"n_{name}"),
                            F.col("classes").alias(f"c_{name}"))

    def run(batches):
        for batch in batches:
            n_a, n_b = (batch.column(c).to_numpy() for c in ("n_a", "n_b"))
            c_a, c_b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4")
                        .reshape(-1, CLASSES) for c in ("c_a", "c_b"))
            room = np.minimum(c_a, c_b).sum(axis=1, dtype=np.int64)
            keep = room * (100 + percent) >= percent * (n_a + n_b)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "n_a", "n_b", "c_a", "c_b").mapInArrow(run, "a bigint, b bigint")


def node_sets(texts: DataFrame, hashes: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the nodes whose texts have the asked hashes (hash), as sorted 64-bit integers,
    once each. Texts of other hashes are passed over before they are cut into words; one that shares
    the bit of an asked one adds a row that nobody joins."""
    bits = hashes.select((F.pmod(F.col("hash"), F.lit(BIT_TABLE))).alias("bit"))
    maps = (bits.groupBy(F.bitmap_bucket_number(F.col("bit") + 1).alias("bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("bit") + 1)).alias("bits")))
    table = np.zeros(BIT_TABLE // 8, np.uint8)
    for row in maps.collect():
        at = (row["bucket"] - 1) * 4096
        table[at:at + 4096] = np.frombuffer(row["bits"], np.uint8)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table, seen, rows, size = shared.value, set(), [], 0
        columns = {"node": pa.int64(), "shingles": pa.binary()}
        for text in _texts_of(batches, table):
            found = shingle_set(text, width)
            node = node_of(found) if len(found) else None
            if node is not None and node not in seen:
                seen.add(node)
                rows.append((node, found.tobytes()))
                size += len(found)
                if size > 1 << 18:
                    yield _batches(columns, rows)
                    rows, size = [], 0
        yield _batches(columns, rows)

    return (texts.mapInArrow(run, "node bigint, shingles binary")
            .groupBy("node").agg(F.first("shingles").alias("shingles")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of at least this similarity, by their whole sets."""
    def run(batches):
        for batch in batches:
            keep = []
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("x", "y"))
                together = np.concatenate([a, b])
                together.sort()
                common = int(np.count_nonzero(together[1:] == together[:-1]))
                keep.append(100 * common >= percent * (len(together) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = (pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
              .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b"))
    return joined.select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def merged_components(components: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, comp) of all nodes that are linked, after more links between nodes.

    Each component takes the smallest one it is linked to; pointers are then followed to their ends
    by doubling, and links are relabelled, until none joins two components."""
    edges = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    known = components

    def relabelled(rows, column, labels):
        to = labels.select(F.col("node").alias(column), F.col("comp").alias("_to"))
        return (rows.join(to, column, "left")
                .withColumn(column, F.coalesce("_to", column)).drop("_to"))

    if known is not None:
        edges = relabelled(relabelled(edges, "u", known), "v", known)
    moved = None
    while True:
        edges = cut_lineage(edges.filter("u != v").select(
            F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
        if edges.isEmpty():
            break
        parent = cut_lineage(edges.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("comp")))
        while True:
            above = parent.select(F.col("node").alias("comp"), F.col("comp").alias("_up"))
            jumped = cut_lineage(parent.join(above, "comp", "left")
                                 .select("node", F.coalesce("_up", "comp").alias("comp"),
                                         F.col("_up").isNotNull().alias("_moved")))
            parent = jumped.select("node", "comp")
            if jumped.filter("_moved").isEmpty():
                break
        edges = relabelled(relabelled(edges, "u", parent), "v", parent)
        if moved is None:
            moved = parent
        else:
            moved = relabelled(moved, "comp", parent).select("node", "comp").unionByName(parent)
    if moved is None:
        return known if known is not None else links.select(
            F.col("a").alias("node"), F.col("b").alias("comp"))
    if known is not None:
        moved = (relabelled(known, "comp", moved).select("node", "comp")
                 .unionByName(moved.join(known.select("node"), "node", "left_anti")))
    return cut_lineage(moved.distinct())


def _open(lists: DataFrame) -> DataFrame:
    """Shingles whose nodes lie in more than one component."""
    ends = lists.groupBy("shingle").agg(F.min("comp").alias("x"), F.max("comp").alias("y"))
    return cut_lineage(ends.filter("x != y").select("shingle"))


def near_duplicates(df: DataFrame, *, id: str = "doc_id", text: str = "text", width: int = 5,
                    percent: int = 80) -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id that links reach, itself included)."""
    bounded_batches(df.sparkSession)
    texts = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"), F.xxhash64(text).alias("_hash"))
    facts = cut_lineage(described(texts, width))
    docs = facts.filter("what = 0").select("_id", "hash", "node", "n", "classes")
    counts = shingle_counts(facts.filter("what = 1"))
    index = cut_lineage(prefix_index(texts, counts, width, percent))

    often = cut_lineage(index.groupBy("shingle").agg(F.count("*").alias("k")).filter("k > 1")
                        .select("shingle"))
    lists = index.join(often, "shingle", "left_semi").withColumn("comp", F.col("node"))
    lists = cut_lineage(lists)
    open_lists = _open(lists)
    lists = cut_lineage(lists.join(open_lists, "shingle", "left_semi").distinct())
    nodes = (docs.filter("node is not null").groupBy("node")
             .agg(F.first("n").alias("n"), F.first("classes").alias("classes"), F.min("hash").alias("hash")))
    nodes = cut_lineage(nodes.join(lists.select("node").distinct(), "node", "left_semi"))

    components, decided, pivots_each = None, None, 1
    while not lists.isEmpty():
        order = Window.partitionBy("shingle").orderBy("pos", "n", "node")
        pivots = cut_lineage(lists.withColumn("_at", F.row_number().over(order))
                             .filter(F.col("_at") <= pivots_each).drop("_at"))
        pairs = candidate_pairs(lists, pivots, percent)
        if decided is not None:
            pairs = pairs.join(decided, ["a", "b"], "left_anti")
        pairs = cut_lineage(suffix_filter(cut_lineage(pairs), nodes, percent))
        left = lists.join(pivots.select("shingle", "node"), ["shingle", "node"], "left_anti")
        if not pairs.isEmpty():
            asked = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
            hashes = nodes.join(asked, "node", "left_semi").select("hash")
            # Written, as both sides of a pair would make the sets again.
            sets = cut_lineage(node_sets(texts, hashes, width))
            links = cut_lineage(verified(pairs, sets, percent))
            decided = pairs if decided is None else decided.unionByName(pairs)
            if not links.isEmpty():
                components = merged_components(components, links)
                now = components.select("node", F.col("comp").alias("_now"))
                left = left.join(now, "node", "left").withColumn(
                    "comp", F.coalesce("_now", "comp")).drop("_now")
        left = cut_lineage(left)
        lists = cut_lineage(left.join(_open(left), "shingle", "left_semi"))
        pivots_each *= GROWTH

    docs = docs.select("_id", "node", "n")
    if components is not None:
        docs = docs.join(components, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    else:
        docs = docs.withColumn("comp", F.col("node"))
    docs = cut_lineage(docs)
    first = cut_lineage(docs.filter("comp is not null").groupBy("comp")
                        .agg(F.min("_id").alias("first")))
    return (docs.join(first, "comp", "left")
            .select(F.col("_id").alias(id), F.col("n").alias("n_shingles"),
                    F.coalesce("first", "_id").alias("component_id")))
