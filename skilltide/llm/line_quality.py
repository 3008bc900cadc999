"""Quality rules: base counts of a text, and lines that many documents of a host share.

Lines are compared in lower case with single spaces, by a 64-bit hash. Per host, the documents that
hold a line are counted, a document once however often it has the line; a line held by more than
``max_share`` of the host's documents, and by at least ``min_docs``, is above the limit and is removed.
A document that keeps less than ``min_left`` of its words is depleted and rejected.

Lines are counted with partial sums, so a line that a third of all documents hold does not meet in one
task. Null texts have no words and fail
the base rules. A null host is a host of its own. Rows that share an id are judged each on its own.
Further columns are not read.
"""

from __future__ import annotations

from hashlib import blake2b

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.llm.common import map_texts
from skilltide.operators.scale import cut_lineage

MIN_DOCS = 20
MAX_SHARE = 0.05
MIN_LEFT = 1 / 3
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


def line_hash(words: list[bytes]) -> int:
    return int.from_bytes(blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of three that occur at least twice, the first occurrence included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    base = len(numbers)
    if base < 1 << 21:
        windows = (ids[:-2] * base + ids[1:-1]) * base + ids[2:]
    else:
        pairs = np.unique(ids[:-1] * base + ids[1:], return_inverse=True)[1]
        windows = pairs[:-1].astype(np.int64) * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    again = np.zeros(len(windows), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(3):
        covered[shift:shift + len(windows)] |= again
    return int(covered.sum())


def base_counts(text: str) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, different lines, their words."""
    raw = text.encode()
    words = raw.split()
    glued = raw.translate(None, SPACES)
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen, again, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        parts = line.split()
        if parts:
            again += line in seen
            seen.add(line)
            key = line_hash(line.decode().lower().encode().split())
            lines[key] = lines.get(key, 0) + len(parts)
    return (len(words), len(text) - (len(raw) - len(glued)), n_symbols, again, repeat_words(words),
            list(lines), list(lines.values()))


def quality(df: DataFrame, *, id: str = "doc_id", text: str = "text", host: str = "source",
            min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE,
            min_left: float = MIN_LEFT) -> DataFrame:
    """Per row: id, the base counts, base_failed, n_left (words of lines within the limit), kept."""
    kind = df.schema[id].dataType.simpleString()
    keyed = df.select(F.col(id).alias("_id"), F.col(host).cast("string").alias("_host"),
                      F.col(text).alias("_text"))

    def work():
        return lambda row: (row[0], row[1], *base_counts(row[2] or ""))

    docs = cut_lineage(map_texts(
        keyed, ["_id", "_host", "_text"],
        f"_id {kind}, _host string, n_words bigint, word_chars bigint, n_symbols bigint, "
        "n_dup_lines bigint, n_repeat_words bigint, lines array<bigint>, "
        "line_words array<bigint>", work).withColumn("_row", F.expr("uuid()")))

    hosts = docs.groupBy("_host").agg(F.count("*").alias("n_docs"))
    held = (docs.select("_host", F.explode("lines").alias("line")).groupBy("_host", "line")
            .agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs))
    above = cut_lineage(
        held.alias("l").join(hosts.alias("h"), F.col("l._host").eqNullSafe(F.col("h._host")))
        .filter(F.col("n") > F.col("n_docs") * max_share)
        .select(F.col("l._host").alias("in_host"), F.col("line").alias("gone")))
    lines = (docs.select("_row", "_host", F.explode(F.arrays_zip("lines", "line_words")).alias("z"))
             .select("_row", "_host", F.col("z.lines").alias("line"), F.col("z.line_words").alias("words")))
    removed = (lines.join(above, (F.col("line") == F.col("gone"))
                          & F.col("_host").eqNullSafe(F.col("in_host")), "left_semi")
               .groupBy("_row").agg(F.sum("words").alias("removed")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return (docs.join(removed, "_row", "left")
            .select(F.col("_id").alias(id), "n_words", "word_chars", "n_symbols", "n_dup_lines",
                    "n_repeat_words", failed.alias("base_failed"), left.alias("n_left"),
                    (~failed & (left >= F.col("n_words") * min_left)).alias("kept")))
