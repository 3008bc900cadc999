"""BPE encoding and decoding, with long unsplit text encoded as a tree of halves.

A text is cut at special strings, normalised and cut into pieces by the rules of the vocabulary
file. A piece of more than ``LEAF`` symbols is halved until its parts are short. Two encoded parts
are put together by encoding a growing window around the join again, until the window gives back the
outermost token on both sides (or reaches the end of the piece): as a sequence of tokens is an
encoding exactly if every two neighbours are, nothing outside the window can change then.

Very long pieces (``GIANT`` bytes without white space) are dealt out: their leaves are encoded in
different tasks and joined level by level, so that one such text does not hold a single task.

Null texts count as empty and give no ids. Rows with null or repeated ids are encoded like all
others; other columns are not read.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.llm.common import held, map_texts, text_or_empty
from skilltide.llm.token_counts import Recent, byte_symbols
from skilltide.operators.scale import cut_lineage

LEAF = 64
GIANT = 1 << 16
# Pieces and chunks that an encoder remembers of late, and as many from before.
KNOWN = 1 << 16
NEVER = 1 << 60


class TreeEncoder:
    """Encoder of a vocabulary file with word ends (``</w>`` on the last symbol of a piece)."""

    def __init__(self, path: str, leaf: int = LEAF):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        model = data["model"]
        self.leaf = leaf
        self.ids = dict(model["vocab"])
        self.end = model["end_of_word_suffix"] or ""
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
                  for m in model["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.names = [""] * (1 + max(*self.ids.values(), *(t["id"] for t in data["added_tokens"])))
        for name, number in self.ids.items():
            self.names[number] = name
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        for name, number in self.special.items():
            self.names[number] = name
        self.marks = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        split = data["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(split)
        self.symbols = byte_symbols()
        self.wide_space = regex.compile(r"[^\S\x00-\x7F]")
        self.known, self.chunks = Recent(KNOWN), Recent(KNOWN)

    def normalised(self, text: str) -> str:
        """Composed (NFC) and lower case, each character on its own."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def symbols_of(self, piece: str) -> list[str]:
        out = [self.symbols[b] for b in piece.encode()]
        out[-1] += self.end
        return out

    def merge(self, symbols: list[str]) -> list[str]:
        """Encode a run of symbols: lowest rank first, then leftmost."""
        if len(symbols) <= 24:
            return self._merge_few(list(symbols))
        ranks, n = self.ranks, len(symbols)
        names, after, ahead = list(symbols), list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(ranks[p], i, p) for i, p in enumerate(zip(names, names[1:], strict=False))
                if p in ranks]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if names[i] != pair[0] or j >= n or names[j] != pair[1]:
                continue
            names[i], names[j], after[i] = pair[0] + pair[1], "", after[j]
            if after[j] < n:
                ahead[after[j]] = i
            for k in (ahead[i], i):
                if k >= 0 and after[k] < n:
                    p = (names[k], names[after[k]])
                    if p in ranks:
                        heapq.heappush(heap, (ranks[p], k, p))
        return [x for x in names if x]

    def _merge_few(self, symbols: list[str]) -> list[str]:
        rank = self.ranks.get
        found = [rank(p, NEVER) for p in zip(symbols, symbols[1:], strict=False)]
        while found:
            best = min(found)
            if best == NEVER:
                break
            i = found.index(best)
            symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            del found[i]
            if i < len(found):
                found[i] = rank((symbols[i], symbols[i + 1]), NEVER)
            if i:
                found[i - 1] = rank((symbols[i - 1], symbols[i]), NEVER)
        return symbols

    def split_token(self, token: str) -> list[str]:
        """The symbols that a token was merged from."""
        if self.end and token.endswith(self.end):
            token = token[:-len(self.end)]
            return [*token[:-1], token[-1] + self.end]
        return list(token)

    def joined(self, left: list[str], right: list[str]) -> list[str]:
        """Encoding of two neighbouring parts from their own encodings."""
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            window = self.merge([s for t in (*a, *b) for s in self.split_token(t)])
            if ((len(a) == len(left) or window[0] == a[0])
                    and (len(b) == len(right) or window[-1] == b[-1])):
                return left[:len(left) - len(a)] + window + right[len(b):]
            width *= 2

    def tree(self, symbols: list[str]) -> list[str]:
        if len(symbols) <= self.leaf:
            return self.merge(symbols)
        half = len(symbols) // 2
        return self.joined(self.tree(symbols[:half]), self.tree(symbols[half:]))

    def as_bytes(self, tokens: list[str]) -> bytes:
        return array("I", [self.ids[t] for t in tokens]).tobytes()

    def as_tokens(self, data: bytes) -> list[str]:
        return [self.names[i] for i in np.frombuffer(data, "<u4").tolist()]

    def piece(self, piece: str) -> bytes:
        hit = self.known.get(piece) or self.known.older_or_none(piece)
        if hit is None:
            hit = self.as_bytes(self.tree(self.symbols_of(piece)))
            if len(piece) <= 64:
                self.known.keep(piece, hit)
        return hit

    def chunk(self, chunk: bytes) -> bytes:
        hit = self.chunks.older_or_none(chunk)
        if hit is None:
            hit = b"".join(map(self.piece, self.pieces.findall(chunk.decode())))
            if len(chunk) <= 64:
                self.chunks.keep(chunk, hit)
        return hit

    def parts(self, text: str) -> Iterator[str | bytes]:
        """Normalised text in order, special strings as the bytes of their ids."""
        at = 0
        for mark in [*self.marks.finditer(text), None]:
            yield self.normalised(text[at:mark.start() if mark else len(text)])
            if mark:
                yield np.array([self.special[mark[0]]], "<u4").tobytes()
                at = mark.end()

    def encode(self, text: str) -> bytes:
        """White space ends every piece, so what it separates is looked up at once."""
        get, chunk, out = self.chunks.get, self.chunk, []
        for part in self.parts(text):
            if isinstance(part, bytes):
                out.append(part)
                continue
            if not part.isascii() and self.wide_space.search(part):
                part = regex.sub(r"\s+", " ", part)
            out += [get(c) or chunk(c) for c in part.encode().split()]
        return b"".join(out)

    def decode(self, data: bytes) -> str:
        return " ".join(self.as_tokens(data))


class TokenNames:
    """What decoding needs of a vocabulary file: no merges and no encodings known from before."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        numbers = {**data["model"]["vocab"], **{t["content"]: t["id"] for t in data["added_tokens"]}}
        self.names = [""] * (1 + max(numbers.values()))
        for part in (data["model"]["vocab"].items(), ((t["content"], t["id"]) for t in data["added_tokens"])):
            for name, number in part:
                self.names[number] = name

    def decode(self, data: bytes) -> str:
        return " ".join([self.names[i] for i in np.frombuffer(data, "<u4").tolist()])


def encoder(path: str) -> TreeEncoder:
    """One per Python worker and file."""
    return held(("bpe", path), lambda: TreeEncoder(path))


def encode(df: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text",
           giant: int = GIANT) -> DataFrame:
    """Per row: id and ``ids``, the token ids as little-endian unsigned 32-bit integers."""
    kind = df.schema[id].dataType.simpleString()
    rows = df.select(F.col(id).alias("_id"), text_or_empty(text).alias("_text"))
    long = F.octet_length("_text") >= giant

    def work():
        made = encoder(tokenizer)
        return lambda row: (row[0], made.encode(row[1]))

    short = map_texts(rows.filter(~(long & _unbroken(giant))), ["_id", "_text"],
                      f"_id {kind}, ids binary", work)
    giants = rows.filter(long & _unbroken(giant))
    if not giants.isEmpty():
        short = short.unionByName(_encode_giants(giants, tokenizer, kind, giant))
    return short.select(F.col("_id").alias(id), "ids")


def _unbroken(giant: int):
    """Whether some run without white space may have ``giant`` bytes (four bytes a character)."""
    return F.exists(F.split("_text", r"\s+"), lambda run: F.octet_length(run) >= giant)


def _encode_giants(rows: DataFrame, tokenizer: str, kind: str, giant: int) -> DataFrame:
    """Leaves of giant pieces in tasks of their own, joined level by level.

    A row gets a key of its own here, as ids may repeat."""
    leaf = max(LEAF, giant // 4)
    rows = cut_lineage(rows.withColumn("_row", F.expr("uuid()")))
    schema = "_row string, part int, leaf int, leaves int, data binary, last boolean"

    def cut(batches):
        made = encoder(tokenizer)
        for frame in batches:
            for key, text in zip(frame["_row"], frame["_text"], strict=True):
                out, ready = [], []
                for piece in (p for part in made.parts(text) for p in (
                        [part] if isinstance(part, bytes) else made.pieces.findall(part))):
                    data = piece if isinstance(piece, bytes) else piece.encode()
                    if isinstance(piece, bytes) or len(data) < giant:
                        ready.append(data if isinstance(piece, bytes) else made.piece(piece))
                        continue
                    out.append((key, len(out), -1, 1, b"".join(ready), False))
                    part, ready, n = out[-1][1] + 1, [], -(-len(data) // leaf)
                    for i in range(n):
                        out.append((key, part, i, n, data[i * leaf:(i + 1) * leaf], i == n - 1))
                out.append((key, len(out) + 1, -1, 1, b"".join(ready), False))
                yield pd.DataFrame(out, columns=["_row", "part", "leaf", "leaves", "data", "last"])

    def encode_leaves(batches):
        made = encoder(tokenizer)
        for frame in batches:
            tokens = []
            for data, at, last in zip(frame["data"], frame["leaf"], frame["last"], strict=True):
                if at < 0:
                    tokens.append(data)
                    continue
                symbols = [made.symbols[b] for b in data]
                if last:
                    symbols[-1] += made.end
                tokens.append(made.as_bytes(made.tree(symbols)))
            yield frame.assign(data=tokens)

    def join_two(frame):
        made = encoder(tokenizer)
        frame = frame.sort_values("leaf")
        tokens = [made.as_tokens(x) for x in frame["data"]]
        whole = tokens[0] if len(tokens) == 1 else made.joined(tokens[0], tokens[1])
        first = frame.iloc[:1].copy()
        first["data"] = [made.as_bytes(whole)]
        first["leaf"] = first["leaf"] // 2
        return first

    parts = cut_lineage(rows.select("_row", "_text").mapInPandas(cut, schema))
    cells = max(2, rows.sparkSession.sparkContext.defaultParallelism)
    nodes = cut_lineage(parts.repartition(cells, "_row", "part", "leaf")
                        .mapInPandas(encode_leaves, schema))
    most = nodes.agg(F.max("leaves")).first()[0] or 1
    while most > 1:
        nodes = cut_lineage(
            nodes.filter("leaf < 0").unionByName(
                nodes.filter("leaf >= 0").groupBy("_row", "part", F.expr("leaf div 2"))
                .applyInPandas(join_two, schema)))
        most = -(-most // 2)
    whole = (nodes.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("part", "data")))
                                       .alias("parts"))
             .select("_row", F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["data"]))
                     .alias("ids")))
    return rows.select("_row", "_id").join(whole, "_row").select("_id", "ids")


def decode(df: DataFrame, tokenizer: str, *, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: id, ids and ``decoded``, the tokens with a space between.

    The ids are written first: encoder and decoder in one task would be two Python workers at
    once, and a lost decoder would encode again."""
    df = cut_lineage(df.select(id, ids))
    kind = df.schema[id].dataType.simpleString()

    def work():
        made = held(("names", tokenizer), lambda: TokenNames(tokenizer))
        return lambda row: (row[0], row[1], made.decode(row[1] or b""))

    return map_texts(df, [id, ids], f"`{id}` {kind}, `{ids}` binary, decoded string", work)
