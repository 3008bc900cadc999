"""Exact token counts at every prefix of a text, by dynamic programming over byte-level BPE.

A sequence of tokens is the BPE encoding of its text exactly if every two neighbours are the
encoding of their concatenation. So the last token of each prefix follows from the last tokens
of shorter prefixes: it is the one vocabulary entry that ends there and fits behind the last token
of what precedes it. One pass gives the count at every prefix; how many tokens a truncated text has
or how much text fits a budget are then lookups.

Split rules: a text is first cut at special strings (each is one token), then by the pattern of the
vocabulary into pieces, and pieces are encoded on their own. A prefix may end inside a piece; where
the pattern would cut the shortened text otherwise (runs of white space before a word, shortened
contractions, a part of a special string) the count is the one of the shortened text.

Null texts count as empty: no bytes, no tokens, nothing fits or is cut. Rows with a null or repeated
id are counted like all others; other columns are not read.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Sequence

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from skilltide.llm.common import held, map_texts

# Fixed value: the pattern that cuts a text into pieces before the merges of byte-level BPE.
PIECES = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
CACHED = 150_000


class Recent(dict):
    """A dict of bounded size: entries not used while as many others came are forgotten."""

    def __init__(self, size: int = CACHED):
        super().__init__()
        self.size, self.older = size, {}

    def older_or_none(self, key):
        """What was known before; frequent keys are carried on."""
        value = self.older.get(key)
        return None if value is None else self.keep(key, value)

    def keep(self, key, value):
        if len(self) >= self.size:
            self.older = self.copy()
            self.clear()
        self[key] = value
        return value


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: the byte itself
    where it is printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class PrefixCounter:
    """Counts of one vocabulary file; keeps the counts of frequent pieces."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        symbols = byte_symbols()
        as_byte = {s: b for b, s in enumerate(symbols)}
        vocab = data["model"]["vocab"]
        self.ids = {bytes(as_byte[c] for c in name): number for name, number in vocab.items()}
        # Finds all entries in a text, of those with the same end the longest first.
        self.entries = ahocorasick.Automaton()
        for name, number in self.ids.items():
            self.entries.add_word(name.decode("latin-1"), (number, len(name)))
        self.entries.make_automaton()
        top = max(vocab.values()) + 1
        self.rank, self.left, self.right = [-1] * top, [-1] * top, [-1] * top
        self.ranks = {}
        for i, merge in enumerate(data["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            self.ranks[vocab[a] << 20 | vocab[b]] = i
            whole = vocab[a + b]
            self.rank[whole], self.left[whole], self.right[whole] = i, vocab[a], vocab[b]
        special = [t["content"] for t in data["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, special)) or r"(?!)")
        self.pieces = regex.compile(PIECES)
        self.gaps = regex.compile(r"(?<!\s)\s{2,}+(?=\S)")
        self.uneven = regex.compile(r"\s\x20|\x20\s|^\x20|\x20$")
        self.pairs: dict[int, bool] = {}
        self.known, self.chunks = Recent(), Recent(2 * CACHED)

    def _fits(self, left: int, right: int) -> bool:
        """``_apart``, kept for as many pairs as the other tables hold."""
        pair = left << 20 | right
        fits = self.pairs.get(pair)
        if fits is None:
            if len(self.pairs) >= 2 * CACHED:
                self.pairs.clear()
            fits = self.pairs[pair] = self._apart(left, right)
        return fits

    def _apart(self, left: int, right: int) -> bool:
        """Whether two tokens stay apart in the encoding of their concatenation.

        The merges that made them are undone from the last one on. At each moment the tokens at
        the join must not form a merge that comes before the one by which either grew; of equal
        merges the left one comes first."""
        ranks, rank = self.ranks, self.rank
        grew_left = grew_right = 1 << 60
        while True:
            cross = ranks.get(left << 20 | right)
            if cross is not None and cross < grew_left and cross <= grew_right:
                return False
            a, b = rank[left], rank[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                grew_left, left = a, self.right[left]
            else:
                grew_right, right = b, self.left[right]

    def _piece(self, piece: str) -> bytes:
        """Tokens of each prefix of a piece, by code point, as unsigned 32-bit integers."""
        data = piece.encode()
        size = len(data)
        count, last = [0] * (size + 1), [-1] * (size + 1)
        fits, pairs, done = self._fits, self.pairs, 0
        for at, (token, length) in self.entries.iter(data.decode("latin-1")):
            end = at + 1
            if end == done:
                continue
            start = end - length
            if start:
                apart = pairs.get(last[start] << 20 | token)
                if not (fits(last[start], token) if apart is None else apart):
                    continue
            last[end], count[end], done = token, count[start] + 1, end
        counts = count[1:] if len(piece) == size else [
            n for i, n in enumerate(count[1:], 1) if i == size or data[i] & 0xC0 != 0x80]
        if len(piece) == 3 and piece[0] == "'" and piece[1].isalpha():
            counts[1] = self.total(piece[:2])
        return array("I", counts).tobytes()

    def _counts(self, piece: str) -> bytes:
        hit = self.known.get(piece) or self.known.older_or_none(piece)
        if hit is None:
            hit = self._piece(piece)
            if len(piece) <= 64:
                self.known.keep(piece, hit)
        return hit

    def total(self, text: str) -> int:
        """Tokens of a short text without special strings."""
        return sum(int.from_bytes(self._counts(p)[-4:], "little")
                   for p in self.pieces.findall(text))

    def _part(self, text: str) -> tuple[np.ndarray, int]:
        """Counts of a part without special strings, and the place where its last piece begins."""
        if self.uneven.search(text) is None:
            return self._spaced(text)
        pieces = self.pieces.findall(text)
        counts, lengths = _laid_out([self._counts(p) for p in pieces])
        self._regap(text, counts)
        return counts, len(text) - int(lengths[-1])

    def _spaced(self, text: str) -> tuple[np.ndarray, int]:
        """The same where all spaces stand alone between other characters: no piece reaches
        beyond a space then, and what lies between two spaces is looked up at once."""
        first, *words = text.split(" ")
        chunks, add = self.chunks, self._chunk
        counts, lengths = _laid_out([self._chunk(first, "") if first else b"",
                                     *[chunks.get(w) or add(w, " ") for w in words]])
        tail = f" {words[-1]}" if words else first
        return counts, len(text) - len(self.pieces.findall(tail)[-1])

    def _chunk(self, word: str, space: str) -> bytes:
        hit = self.chunks.older_or_none(word) if space else None
        if hit is not None:
            return hit
        text = space + word
        pieces = self.pieces.findall(text)
        hit = self._counts(pieces[0])
        if len(pieces) > 1:
            counts = array("I", hit)
            for piece in pieces[1:]:
                done = counts[-1]
                counts.extend([done + n for n in array("I", self._counts(piece))])
            self._regap(text, counts)
            hit = counts.tobytes()
        if space and len(word) <= 64:
            self.chunks.keep(word, hit)
        return hit

    def _regap(self, text: str, counts) -> None:
        """A prefix that ends in white space has the whole run as one piece."""
        for gap in self.gaps.finditer(text):
            start = gap.start()
            counts[gap.end() - 1] = ((counts[start - 1] if start else 0)
                                     + int.from_bytes(self._counts(gap[0])[-4:], "little"))

    def counts(self, text: str) -> np.ndarray:
        """The number of tokens of text[:i + 1] at each i."""
        out, done, at = [], 0, 0
        marks = list(self.special.finditer(text))
        for mark in [*marks, None]:
            part = text[at:mark.start() if mark else len(text)]
            counts, tail, head = np.zeros(0, np.int64), 0, 0
            if part:
                counts, tail = self._part(part)
                head = int(counts[-1]) - int.from_bytes(self._counts(part[tail:])[-4:], "little")
                out.append(counts + done)
            if mark:
                total = int(counts[-1]) if part else 0
                shortened = [done + head + self.total(part[tail:] + mark[0][:k])
                             for k in range(1, len(mark[0]))]
                done += total + 1
                out.append(np.array([*shortened, done], np.int64))
                at = mark.end()
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _laid_out(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of neighbouring parts as counts of the whole, and the lengths of the parts."""
    inside = np.frombuffer(b"".join(parts), np.uint32)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    ends = np.cumsum(lengths)
    totals = np.where(lengths > 0, inside[ends - 1], 0).astype(np.int64)
    return inside + np.repeat(np.cumsum(totals) - totals, lengths), lengths


def counter(path: str) -> PrefixCounter:
    """One per Python worker and file."""
    return held(("counts", path), lambda: PrefixCounter(path))


def prefix_token_counts(df: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text",
                        budgets: Sequence[int] = (), keep: bool = True) -> DataFrame:
    """Per row: id, n_bytes, n_tokens, for each budget the code points of the longest prefix
    within it (``fits_<budget>``), and with ``keep`` the whole table: ``prefix_counts`` holds the
    count at every prefix as unsigned 32-bit integers (see ``tokens_at``)."""
    names = [f"fits_{b} bigint" for b in budgets] + (["prefix_counts binary"] if keep else [])
    kind = df.schema[id].dataType.simpleString()
    schema = ", ".join([f"`{id}` {kind}", "n_bytes bigint", "n_tokens bigint", *names])

    def work():
        prefix = counter(tokenizer)

        def each(row):
            body = row[1] or ""
            counts = prefix.counts(body)
            fits = []
            for budget in budgets:
                within = np.flatnonzero(counts <= budget)
                fits.append(int(within[-1]) + 1 if len(within) else 0)
            table = [counts.astype("<u4").tobytes()] if keep else []
            return (row[0], len(body.encode()), int(counts[-1]) if len(counts) else 0, *fits,
                    *table)
        return each

    return map_texts(df, [id, text], schema, work)


def tokens_at(prefix_counts: bytes, length: int) -> int:
    """Tokens of the first ``length`` code points, from the stored table."""
    return int.from_bytes(prefix_counts[4 * length - 4:4 * length], "little") if length else 0
