"""Exact duplicates by an extendible-hash index on shared files; DataFrame functions only.

Texts are compared after every run of white space became one space. Their 64-bit hash is the key,
and its leading bits are an address. The directory starts as one bucket of all addresses; wherever a
bucket holds more than ``capacity`` keys the directory doubles there, splitting the bucket by the next
bit (``directory``).

A key that occurs once has no copies. Each row of another key is looked up in the directory: the depth
found there names its bucket, and its text travels, once, to the task that owns this range of keys. The
owner puts equal texts of a key together, comparing bytes, and writes its pages to the shared folder:
each row with the first row of its text, the text with that first row alone. A key of many rows is dealt
over as many pages as its count asks for (``SHARES``), so no page has many rows of one key. The pages
of a bucket are then joined into the index (bucket, depth, key, chain, keep_id, group_size, norm): one
entry for each text, different texts of one key forming a chain. Rows get their entry by way of their
page. Where a chain has one entry the key settles which it is, else bytes are compared along it.

No switch depends on the size, only the texts of repeated keys are shuffled, and the rows to be sent
are told to the scan by their places (``rows.py``).

Null texts count as empty. Of equal texts the smallest id stays (nulls last). A row with a null id is
reported under that id. Further columns are not read. An empty table has an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilltide.llm.common import text_or_empty
from skilltide.llm.rows import marked, with_places
from skilltide.operators.scale import cut_lineage, salted_join

CAPACITY = 512
# Bits of an address at most: with more than some 10^11 keys the buckets hold more than their capacity.
MAX_BITS = 30
# A key of more than PAGE rows is dealt over 8, 64, ... pages, each time as many as leave PAGE rows each.
PAGE = 128
SHARES = 8


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def address(key: Column, bits: int) -> Column:
    """The leading bits of a key."""
    return F.shiftrightunsigned(key, 64 - bits) if bits else F.lit(0).cast("long")


def directory(keys: DataFrame, bits: int, capacity: int = CAPACITY) -> DataFrame:
    """Address to bucket: (cell, bucket, depth).

    ``keys`` has one row for each different key. Addresses have ``bits`` bits, the most that the
    directory may double to. A bucket is the shortest prefix of addresses with few enough keys;
    its number is that prefix behind a leading one, so buckets of different depth differ."""
    cells = keys.groupBy(address(F.col("key"), bits).alias("cell")).agg(F.count("*").alias("n"))
    depths = cells.select("cell", "n", F.explode(F.sequence(F.lit(0), F.lit(bits))).alias("depth"))
    prefix = F.expr(f"shiftright(cell, {bits} - depth)")
    filled = (depths.groupBy("depth", prefix.alias("prefix")).agg(F.sum("n").alias("n"))
              .filter((F.col("n") <= capacity) | (F.col("depth") == bits)))
    return (depths.select("cell", "depth", prefix.alias("prefix"))
            .join(filled, ["depth", "prefix"])
            .groupBy("cell").agg(F.min_by(F.struct("depth", "prefix"), "depth").alias("b"))
            .select("cell", (F.expr("shiftleft(1L, b.depth)") + F.col("b.prefix")).alias("bucket"),
                    F.col("b.depth").alias("depth")))


def bucket_of(key: Column, depth: Column) -> Column:
    """The number ``directory`` gives the bucket of a key."""
    prefix = F.when(depth == 0, F.lit(0).cast("long")).otherwise(
        F.call_function("shiftrightunsigned", key, F.lit(64) - depth))
    return F.call_function("shiftleft", F.lit(1).cast("long"), depth) + prefix


def pages(texts: DataFrame) -> DataFrame:
    """(place, id, key, bucket, depth, norm, shares) to the same rows with ``head``, the first place of
    an equal text on the page, ``least`` and ``n``, the smallest id and the rows of that text there;
    ``norm`` stays with the head alone."""
    page = F.pmod(F.xxhash64("place"), F.col("shares"))
    same = Window.partitionBy("bucket", "page", "key", "norm")
    held = (texts.withColumn("page", page).repartition("bucket", "page")
            .withColumns({"head": F.min("place").over(same), "least": F.min("id").over(same),
                          "n": F.count(F.lit(1)).over(same)}))
    return held.select("bucket", "depth", "key", "place", "head", "least", "n",
                       F.when(F.col("place") == F.col("head"), F.col("norm")).alias("norm"))


def chains(heads: DataFrame) -> DataFrame:
    """The index: one entry for each text of a key, numbered along the chain; ``entries`` is its length."""
    texts = heads.groupBy("bucket", "depth", "key", "norm").agg(
        F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = Window.partitionBy("bucket", "key")
    return texts.repartition("bucket").withColumns({
        "chain": F.row_number().over(chain.orderBy(F.col("keep_id").asc_nulls_last(), "norm")),
        "entries": F.count(F.lit(1)).over(chain)})


def exact_duplicates(df: DataFrame, *, id: str = "doc_id", text: str = "text",
                     capacity: int = CAPACITY, key: Column | None = None) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256.

    ``key`` (long) is a Column over ``norm``; another one than the default is for tests of collisions."""
    key = F.xxhash64("norm") if key is None else key
    placed, at = with_places(df.select(F.col(id).alias("id"), F.col(text).alias("text")))
    texts = placed.select("id", F.col(at).alias("place"), normalised().alias("norm"))
    narrow = cut_lineage(texts.select("id", "place", key.alias("key"),
                                      F.sha2("norm", 256).alias("text_sha256")))

    keys = cut_lineage(narrow.groupBy("key").agg(F.count("*").alias("n")))
    bits = max(1, min(MAX_BITS, (max(1, keys.count()) * 4 // capacity).bit_length()))
    depths = directory(keys, bits, capacity).select("cell", "depth")
    level = F.least(F.lit(7), F.ceil(F.log(float(SHARES), F.col("n") / PAGE)).cast("int"))
    # What a row must know, in one byte: the depth of its bucket and the power of its shares.
    repeats = (keys.filter("n > 1").withColumn("cell", address(F.col("key"), bits)).join(depths, "cell")
               .select("key", (F.col("depth") * 8 + F.greatest(F.lit(0), level) + 1).alias("copies")))
    marks = salted_join(narrow.select("place", "key"), cut_lineage(repeats), "key", spread_on=["place"])
    sent, mark = marked(placed.withColumn("place", F.col(at)), at, marks.select("place", "copies"))

    depth = F.floor((F.col(mark) - 1) / 8).cast("int")
    shares = F.pow(F.lit(float(SHARES)), F.pmod(F.col(mark) - 1, F.lit(8))).cast("long")
    texts = sent.select("id", "place", normalised().alias("norm"), depth.alias("depth"),
                        shares.alias("shares")).withColumn("key", key)
    held = cut_lineage(pages(texts.withColumn("bucket", bucket_of(F.col("key"), F.col("depth")))))
    heads = held.filter("place = head")
    index = cut_lineage(chains(heads))

    entry = ["keep_id", "group_size"]
    settled = (heads.select("bucket", "key", "head")
               .join(index.filter("entries = 1").select("bucket", "key", *entry), ["bucket", "key"]))
    walked = (heads.select("bucket", "key", "norm", "head")
              .join(index.filter("entries > 1").select("bucket", "key", "norm", *entry),
                    ["bucket", "key", "norm"]))
    linked = settled.select("head", *entry).unionByName(walked.select("head", *entry))
    found = narrow.join(held.select("place", "head").join(linked, "head").drop("head"), "place", "left")
    single = F.col("group_size").isNull()
    keep = F.when(single, F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id), keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), "text_sha256")
