"""Drop and repeat rows of a large text table without moving the texts.

Decisions about rows are narrow and may be shuffled; the texts are only scanned. A row is known by its
place, the path of its file and its position in it, which Spark gives for a file source and which does
not depend on how the scan is split. Decisions are packed, one byte a row and at most PACK bytes a
piece, and the pieces of a bounded number of files at a time are broadcast to a scan of these files.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.operators.scale import cut_lineage

# Rows of one piece, and pieces broadcast at a time (at most 64 MB).
PACK = 4096
MAX_PIECES = 16_384


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def with_places(df: DataFrame) -> tuple[DataFrame, str]:
    """``df`` and a string column, whose name is returned, with the place ``path:position`` of a row.

    A frame that is no plain scan of files is written first."""
    key = free_name(df, "_place")
    place = F.concat_ws(":", F.col("_metadata.file_path"), F.col("_metadata.row_index").cast("string"))
    if "_metadata" not in {c.lower() for c in df.columns}:
        try:
            return df.withColumn(key, place), key
        except AnalysisException:
            return cut_lineage(df).withColumn(key, place), key
    hidden = free_name(df, "_metadata_")
    written = cut_lineage(df.withColumnsRenamed({c: hidden for c in df.columns if c.lower() == "_metadata"}))
    named = [F.col(hidden if c.lower() == "_metadata" else c).alias(c) for c in df.columns]
    return written.select(*named, place.alias(key)), key


def packed(copies: DataFrame) -> DataFrame:
    """(place, copies) to one row for every PACK rows of a file: path, piece, held (a byte a row)."""
    at = F.substring_index("place", ":", -1)
    placed = copies.select(
        F.expr("substring(place, 1, length(place) - length(substring_index(place, ':', -1)) - 1)").alias("path"),
        at.cast("bigint").alias("at"), F.col("copies").cast("int").alias("copies"))
    listed = (placed.groupBy("path", F.expr(f"at div {PACK}").alias("piece"))
              .agg(F.sort_array(F.collect_list(F.struct((F.col("at") % PACK).alias("pos"), "copies")))
                   .alias("l")))
    # Positions without a decision count as dropped.
    digits = F.expr(
        "array_join(transform(l, (s, i) -> concat("
        "repeat('00', cast(s.pos - if(i = 0, -1, l[i - 1].pos) - 1 as int)), "
        "if(s.copies < 256, lpad(hex(s.copies), 2, '0'), raise_error('a row is repeated over 255 times')))), '')")
    return listed.select("path", "piece", F.unhex(digits).alias("held"))


def marked(df: DataFrame, key: str, marks: DataFrame) -> tuple[DataFrame, str]:
    """The rows of ``df`` that ``marks`` (place, copies), narrow, names, with an int column, whose name
    is returned, that holds their number (1 to 255).

    ``df`` and ``key`` come from with_places; the other columns of ``df`` are returned."""
    pieces = cut_lineage(packed(marks))
    rounds = max(1, -(-pieces.count() // MAX_PIECES))
    path, piece, held = (free_name(df, n) for n in ("_path", "_piece", "_held"))
    pieces = pieces.toDF(path, piece, held)
    at = F.substring_index(key, ":", -1).cast("bigint")
    file = F.expr(f"substring(`{key}`, 1, length(`{key}`) - length(substring_index(`{key}`, ':', -1)) - 1)")
    placed = df.withColumns({path: file, piece: F.floor(at / PACK).cast("bigint")})
    byte = F.expr(f"substring(`{held}`, cast(cast(substring_index(`{key}`, ':', -1) as bigint) % {PACK} as int) + 1, 1)")
    mark = free_name(df, "_mark")
    out = []
    for i in range(rounds):
        mine = F.pmod(F.xxhash64(path), F.lit(rounds)) == i
        few = F.broadcast(pieces.filter(mine))
        found = placed.filter(mine).join(few, [path, piece])
        out.append(found.withColumn(mark, F.coalesce(F.conv(F.hex(byte), 16, 10).cast("int"), F.lit(0)))
                   .filter(F.col(mark) > 0)
                   .select(*[F.col(f"`{c}`") for c in df.columns if c != key], mark))
    return reduce(DataFrame.unionByName, out), mark


def repeated(df: DataFrame, key: str, copies: DataFrame) -> DataFrame:
    """Each row of ``df`` as often as ``copies`` (place, copies), narrow, says; none where it is not in it.
    A place has at most 255 copies. Otherwise as ``marked``."""
    found, mark = marked(df, key, copies)
    again = free_name(found, "_again")
    return found.withColumn(again, F.explode(F.array_repeat(F.lit(0), F.col(mark)))).drop(mark, again)
