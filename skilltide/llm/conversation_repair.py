"""Conversation structure repair: the cheapest edits that make the roles of a conversation legal.

Legal role initials are ``(s?(ua)+)?``: perhaps a system turn, then pairs of user and assistant, or
nothing. Edits: Keep costs 0, Rerole (to user or assistant) 2, Delete 3, Insert (an empty user or
assistant turn, anywhere) 2. Blank and duplicate rows must go; a truncated row that stays adds 1. Of
equally cheap edit strings the least in ASCII order is taken.

A row becomes one letter (initial of its role, and its first fault), a conversation the string of its
letters, its signature. Signatures are sorted from their ends and dealt out by ranges, so that
conversations with a common suffix meet and share its nodes: the suffix is solved once, and the best
audit suffix of a node and grammar state is taken over from the signature before. Nodes with the same
costs to go (up to a constant) are one node of the automaton, whatever their suffix; there are a few
dozen, each solved once a task for every letter and grammar state. A signature that a third of all
conversations have is dealt out over many ranges; only a range's first signature is solved anew.

Duplicates are found by two aggregates with partial sums. What grows with one conversation in one task
is a byte a row (as its audit has) and some twenty in the automaton; its texts pass through a task as a
stream, in order, as a digest over all of them needs, and may spill but are not held.

Rows are taken by turn (nulls first), then role, then digest. A null text or role is one space, a null
conversation a conversation of its own; any initial but s, u, a can only be reroled or deleted. Equal
rows are duplicates. Texts may be empty or very long; further columns are not read. An empty table gives
no conversations but those of ``also``.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.llm.common import arrow_schema, bounded_batches
from skilltide.operators.scale import cut_lineage

BLANKS = " \t\n\x0b\x0c\r"
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1
# Grammar states: nothing yet, system seen, user seen, pair complete.
STATES = range(4)
# The state after a user or assistant turn where one is due, and which it is.
DUE = {0: (2, "user"), 1: (2, "user"), 2: (3, "assistant"), 3: (2, "user")}
# States after a turn that stays, by its initial.
STAYS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
GONE = "x"  # the letter of rows that must be deleted
LEGAL = {"su", "ua", "au"}
ROWS = 1024


class Automaton:
    """Nodes are costs to go from the four grammar states, less their least; node 0 is the end."""

    def __init__(self) -> None:
        self.costs: list[tuple[int, ...]] = []
        self.ids: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[str, int], tuple[int, int, list[tuple[str, int]]]] = {}
        self.end, self.end_moves = self._solved([{0: ("", 0, 0), 3: ("", 0, 3)}.get(q) for q in STATES])[::2]

    def _solved(self, options: list) -> tuple[int, int, list[tuple[str, int]]]:
        """Adds inserts to the best step of every state: node, least cost, edits and next state."""
        costs = [o[1] if o else 1 << 30 for o in options]
        for _ in STATES:
            costs = [min(costs[q], INSERT + costs[DUE[q][0]]) for q in STATES]
        moves = []
        for q in STATES:
            edits, at = "", q
            while True:
                inserted = INSERT + costs[DUE[at][0]] == costs[at]
                own = options[at] if options[at] and options[at][1] == costs[at] else None
                if own and not (inserted and own[0] > "I"):
                    moves.append((edits + own[0], own[2]))
                    break
                edits, at = edits + "I", DUE[at][0]
        least = min(costs)
        node = tuple(c - least for c in costs)
        if node not in self.ids:
            self.ids[node] = len(self.costs)
            self.costs.append(node)
        return self.ids[node], least, moves

    def step(self, letter: str, node: int) -> tuple[int, int, list[tuple[str, int]]]:
        """The node before ``letter``: its id, what it adds to the cost, edits and next state."""
        found = self.steps.get((letter, node))
        if found is None:
            after, options = self.costs[node], []
            for q in STATES:
                ways = [(DELETE + after[q], "D", q)]
                if letter != GONE:
                    cut = CUT * letter.isupper()
                    due = DUE[q][0]
                    ways.append((REROLE + cut + after[due], "R", due))
                    kept = STAYS.get((q, letter.lower()))
                    if kept is not None:
                        ways.append((cut + after[kept], "K", kept))
                cost, edit, to = min(ways)
                options.append((edit, cost, to))
            found = self.steps[letter, node] = self._solved(options)
        return found


class Solver:
    """Costs and audits of signatures that come sorted from their ends."""

    def __init__(self) -> None:
        self.automaton = Automaton()
        self.last, self.nodes, self.sums = b"", array("H", [self.automaton.end]), array("q", [0])
        self.states, self.places, self.audit = bytearray(), array("q"), None

    def solve(self, reversed_: bytes) -> tuple[int, str]:
        shared = common_prefix(self.last, reversed_)
        if self.audit is not None and shared == len(reversed_) == len(self.last):
            return self.cost, self.audit
        del self.nodes[shared + 1:], self.sums[shared + 1:]
        for letter in reversed_[shared:].decode():
            node, more, _ = self.automaton.step(letter, self.nodes[-1])
            self.nodes.append(node)
            self.sums.append(self.sums[-1] + more)
        self.cost = self.sums[-1] + self.automaton.costs[self.nodes[-1]][0]
        self._walk(reversed_, shared)
        self.last = reversed_
        return self.cost, self.audit

    def _walk(self, letters: bytes, shared: int) -> None:
        """Edits from the first row on; from a node and state of the walk before, its audit suffix."""
        size = len(letters)
        states, places, edits, state, at = bytearray(size + 1), array("q", bytes(8 * (size + 1))), [], 0, 0
        for depth in range(size, -1, -1):
            if self.audit is not None and depth <= shared and self.states[depth] == state:
                shift = at - self.places[depth]
                edits.append(self.audit[self.places[depth]:])
                states[:depth + 1] = self.states[:depth + 1]
                places[:depth + 1] = array("q", [p + shift for p in self.places[:depth + 1]])
                break
            states[depth], places[depth] = state, at
            if depth:
                move, state = self.automaton.step(chr(letters[depth - 1]), self.nodes[depth - 1])[2][state]
            else:
                move, state = self.automaton.end_moves[state]
            edits.append(move)
            at += len(move)
        self.states, self.places, self.audit = states, places, "".join(edits)


def common_prefix(a: bytes, b: bytes) -> int:
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while low < high - 1:  # a[:low] is common, a[:high] is not
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def batched(rows: Iterator[tuple], schema: pa.Schema, weight: Callable[[tuple], int]) -> Iterator[pa.RecordBatch]:
    """Rows as batches bounded in rows and in what ``weight`` counts."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(v, f.type) for v, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for row in rows:
        held.append(row)
        size += weight(row)
        if len(held) >= ROWS or size > 1 << 21:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def values(batches: Iterator[pa.RecordBatch], part: int = 256) -> Iterator[tuple]:
    for batch in batches:
        for start in range(0, batch.num_rows, part):
            yield from zip(*[c.to_pylist() for c in batch.slice(start, part).columns], strict=True)


def mapped(df: DataFrame, schema: str, rows: Callable[[Iterator[tuple]], Iterator[tuple]],
           weight: Callable[[tuple], int]) -> DataFrame:
    out = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(lambda batches: batched(rows(values(batches)), out, weight), schema)


class Conversation:
    """Counts and letters of one conversation, fed with its rows in order."""

    def __init__(self, conv: object) -> None:
        self.conv, self.letters, self.before = conv, bytearray(), None
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, copies: int, initial: str, blank: bool, cut: bool, again: bool) -> None:
        if not copies:
            return
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        fresh = 0 if blank or again else 1
        self.blank += copies * blank
        self.duplicate += 0 if blank else copies - fresh
        self.truncated += fresh * cut
        self.illegal += (self.before is not None and self.before + initial not in LEGAL)
        self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        self.before = initial
        if fresh:
            letter = initial if initial in ("s", "u", "a") else "o"
            self.letters += (letter.upper() if cut else letter).encode()
        self.letters += GONE.encode() * (copies - fresh)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal,
                bytes(reversed(self.letters)))


def signatures(rows: Iterator[tuple]) -> Iterator[tuple]:
    now = None
    for conv, *facts in rows:
        if now is None or now.conv != conv:
            if now is not None:
                yield now.row()
            now = Conversation(conv)
        now.add(*facts)
    if now is not None:
        yield now.row()


def solutions(rows: Iterator[tuple]) -> Iterator[tuple]:
    solver = Solver()
    for *summary, letters in rows:
        yield (*summary, *solver.solve(letters))


class Repaired:
    """A repaired table: ``summary`` has a row for each conversation (id, gaps, blank, duplicate,
    truncated, illegal, cost, audit); ``rows()`` the edits in order, ``digests()`` their digest."""

    def __init__(self, ordered: DataFrame, summary: DataFrame, conversation: str, kind: str) -> None:
        self.summary, self._ordered, self._name, self._kind = summary, ordered, conversation, kind

    def rows(self) -> DataFrame:
        """Conversation id, step (from 0), edit (K, R, D or I), turn, role and text: of the row that
        stays, of the row that is deleted, or of the one inserted (its turn is null)."""

        def edits(stream: Iterator[tuple]) -> Iterator[tuple]:
            for conv, _, changes in conversations(stream):
                for step, (edit, turn, role, text) in enumerate(changes):
                    yield conv, step, edit, turn, role, text

        return mapped(self._ordered, f"`{self._name}` {self._kind}, step bigint, edit string, turn bigint, "
                      "role string, text string", edits, lambda r: len(r[4]) + len(r[5]))

    def digests(self) -> DataFrame:
        """The summary with ``repaired_sha256``, over ``role:text`` of what is left, newline-joined."""

        def digested(stream: Iterator[tuple]) -> Iterator[tuple]:
            for conv, summary, changes in conversations(stream):
                found, joint = sha256(), b""
                for edit, _, role, text in changes:
                    if edit != "D":
                        found.update(joint + f"{role}:{text}".encode())
                        joint = b"\n"
                yield (conv, *summary, found.hexdigest())

        return mapped(self._ordered, f"`{self._name}` {self._kind}, gaps bigint, blank bigint, "
                      "duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
                      "repaired_sha256 string", digested, lambda r: len(r[7]))


def conversations(stream: Iterator[tuple]) -> Iterator[tuple]:
    """Per conversation: id, summary, and its edits, which must be taken before the next one's."""
    head = next(stream, None)
    while head is not None:
        conv, _, summary, *_ = head
        summary = tuple(summary.values())
        following: list = []
        changes = edited(stream, conv, summary[-1], following)
        yield conv, summary, changes
        for _ in changes:
            pass
        head = following[0] if following else None


def edited(stream: Iterator[tuple], conv: object, audit: str, following: list) -> Iterator[tuple]:
    state, rest = 0, iter(audit)

    def inserts() -> Iterator[tuple]:
        nonlocal state, edit
        while (edit := next(rest, "")) == "I":
            state, role = DUE[state]
            yield "I", None, role, ""

    edit = ""
    for row in stream:
        if row[1] == 0:
            following.append(row)
            break
        _, _, _, turn, role, text = row
        yield from inserts()
        if edit == "K":
            state = STAYS[state, role[:1]]
        elif edit == "R":
            state, role = DUE[state]
        yield edit, turn, role, text
    yield from inserts()


def repair(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role",
           text: str = "text", also: DataFrame | None = None) -> Repaired:
    """Repairs all conversations of ``df``; ``also`` has ids of conversations that may have no rows."""
    bounded_batches(df.sparkSession)
    kind = df.schema[conversation].dataType.simpleString()
    spoken = df.select(F.col(conversation).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
                       F.coalesce(F.col(role), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text), F.lit(" ")).alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    spoken = spoken.withColumn("digest", digest)
    last = F.expr("substring(ended, -1, 1)")
    facts = (spoken.withColumn("ended", F.rtrim("text", F.lit(BLANKS)))
             .select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"),
                     (F.col("ended") == "").alias("blank"),
                     ((F.col("ended") != "") & ~last.isin(".", "!", "?")).alias("cut"))
             .groupBy("conv", "turn", "role", "digest")
             .agg(F.count("*").alias("copies"), F.max("initial").alias("initial"),
                  F.max("blank").alias("blank"), F.max("cut").alias("cut")))
    facts = cut_lineage(facts)
    place = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    first = (facts.filter("NOT blank").groupBy("conv", "digest")
             .agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"))
    marked = facts.alias("l").join(
        first.alias("r"), F.col("l.conv").eqNullSafe(F.col("r.conv")) & (F.col("l.digest") == F.col("r.digest")),
        "left").select(
            F.col("l.conv").alias("conv"), F.col("l.turn").alias("turn"), "copies", "initial", "blank", "cut",
            (F.col("first").isNotNull()
             & (F.struct(F.col("l.turn").isNotNull().alias("known"), F.col("l.turn").alias("turn"))
                > F.col("first"))).alias("again"), F.col("l.role").alias("role"), F.col("l.digest").alias("digest"))
    if also is not None:
        no = F.lit(False)
        marked = marked.unionByName(also.select(F.col(also.columns[0]).cast(kind).alias("conv")).distinct().select(
            "conv", F.lit(None).cast("bigint").alias("turn"), F.lit(0).cast("bigint").alias("copies"),
            F.lit("").alias("initial"), no.alias("blank"), no.alias("cut"), no.alias("again"),
            F.lit("").alias("role"), F.lit(b"").alias("digest")))
    in_order = ["conv", F.asc_nulls_first("turn"), "role", "digest"]
    narrow = ["conv", "turn", "copies", "initial", "blank", "cut", "again"]
    counts = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
    signed = cut_lineage(mapped(
        marked.repartition("conv").sortWithinPartitions(*in_order).select(*narrow),
        f"conv {kind}, {counts}, letters binary", signatures, lambda r: len(r[6])))
    solved = cut_lineage(mapped(
        signed.repartitionByRange("letters", "conv").sortWithinPartitions("letters"),
        f"conv {kind}, {counts}, cost bigint, audit string", solutions, lambda r: len(r[7])))
    summary = solved.select(F.col("conv").alias(conversation), *solved.columns[1:])

    heads = solved.select(
        "conv", F.lit(0).alias("kind"), F.struct(*solved.columns[1:]).alias("summary"),
        F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"),
        F.lit("").alias("text"))
    rows = spoken.select("conv", F.lit(1).alias("kind"), F.lit(None).alias("summary"), "turn", "role",
                         "digest", "text")
    ordered = (heads.unionByName(rows).repartition("conv")
               .sortWithinPartitions("conv", "kind", *in_order[1:])
               .select("conv", "kind", "summary", "turn", "role", "text"))
    return Repaired(ordered, summary, conversation, kind)
