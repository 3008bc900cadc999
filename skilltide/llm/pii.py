"""Personal data: keyed surrogates of the same type, format, script and gender.

Detected are e-mail addresses, phone numbers, IPv4 addresses, payment cards (16 digits or Luhn-valid),
social security numbers, IBANs and names behind a form of address. An entity's key is its value without
format (lower case, digits only), so all spellings of one entity get one surrogate everywhere.

A name is replaced word by word, the last word as a family name without gender, the first by the gender
that a form of address tells anywhere in the document. So "Mr John Smith", "Dr John Smith" and "Mr Smith"
share their surrogates. Within a document, family names that such a name introduced are also replaced
where they stand alone behind it, and the whole name where it stands without a form of address.

A surrogate is made from a keyed hash (HMAC) of type and key: digits stay digits at the same places,
letters stay letters of their script and case, addresses stay valid addresses, a card that passes the
Luhn check still does, and a name stays a name of its script and gender.

Two entities must not meet in one surrogate, and no surrogate may be an entity of the corpus. All
different entities are brought together with their surrogates in Spark; of those that collide all but
the first are drawn again (``attempt``) until none collide. Names grow by a syllable with each draw, so
they never run out; a format of digits with nearly all values in use (``MAX_DRAWS``) is an error, and
after ``AVOID_DRAWS`` draws real values are allowed. The redrawn ones, a small share, are broadcast up to
``MAX_BROADCAST`` rows and else joined to the documents that hold them; all others are made again from
the key alone in the second scan. All patterns take time in proportion to the text.

Null texts stay null. Rows with null or repeated ids are treated like all others; further columns are
not read.
"""

from __future__ import annotations

import hmac
import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skilltide.llm.common import arrow_schema, bounded_batches
from skilltide.operators.scale import cut_lineage

AVOID_DRAWS = 8
MAX_DRAWS = 40
# Redrawn entities up to this many are broadcast (some 20 MB).
MAX_BROADCAST = 200_000
# Syllables of the first draw of a name's word.
SYLLABLES_FIRST = 5

# Forms of address by the gender they tell.
MALE = ("Mr", "Herr", "Sr", "Señor", "Monsieur", "Don", "господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "Doña", "госпожа")
OPEN = ("Dr", "Prof", "Dra")
TITLES = "|".join(sorted((*MALE, *FEMALE, *OPEN), key=len, reverse=True))

# The first of these that matches at a place tells the type; addresses with an @ come before them.
TYPES = {
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d.]*\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d-])\d{4}(?:[ -]?\d{4}){3}(?![\d-]*\d)|(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "phone": r"(?<![\w.+(-])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)"
             r"|(?<![\w.+-])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)"
             r"|(?<![\w.+-])\d{3}[ .-]\d{3}[ .-]\d{4}(?!\d)",
    "name": rf"(?<=\b(?:{TITLES})\.?[ ])\p{{Lu}}[\p{{Ll}}\p{{Lu}}'’-]+(?:[ ]\p{{Lu}}[\p{{Ll}}'’-]+)?",
}
LOCAL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*+")
DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")
RUN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@")
ENTITY = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in TYPES.items()))
CAPITALIZED = regex.compile(r"(?<![\p{L}\p{N}_])\p{Lu}[\p{L}'’-]+")
HINT = regex.compile(rf"[@\d]|\b(?:{TITLES})\b")
SYLLABLES = {
    "latin": ("ba be bi bo da de di do fa fe ga ge ka ke ki la le li lo lu ma me mi mo na ne ni no "
              "ra re ri ro sa se si so ta te ti to va ve vi").split(),
    "cyrillic": ("ба бе би бо да де ди до га ка ке ла ле ли ло ма ме ми мо на не ни но ра ре ри ро "
                 "са се си со та те ти то ва ве ви").split(),
    "greek": "βα βε δα δι κα κο λα λε λι μα με μι να νε νι πα πε ρα ρε ρι σα σε τα τε τι".split(),
}
ENDINGS = {"latin": {"m": "n", "f": "na", "o": "le"}, "cyrillic": {"m": "н", "f": "на", "o": "ко"},
           "greek": {"m": "ος", "f": "α", "o": "ι"}}


def luhn(digits: str) -> bool:
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4)
                for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def script_of(word: str) -> str:
    if regex.search(r"\p{Cyrillic}", word):
        return "cyrillic"
    return "greek" if regex.search(r"\p{Greek}", word) else "latin"


def gender_of(text: str, start: int) -> str:
    title = regex.search(r"(\w+)\.?\s$", text[max(0, start - 20):start])
    word = title[1] if title else ""
    return "m" if word in MALE else "f" if word in FEMALE else "o"


def matches(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, type), left to right: at each place an e-mail address, else the other types.

    Addresses are found from their @, so that long runs without one are passed once."""
    at, other = 0, None
    done = False
    for run in RUN.finditer(text):
        sign = run.end() - 1
        domain = DOMAIN.match(text, sign + 1)
        if domain is None:
            continue
        while True:
            first = LOCAL.search(text, max(at, run.start()), sign)
            if not done and (other is None or other.start() < at):
                other = ENTITY.search(text, at)
                done = other is None
            if first is not None and (done or first.start() <= other.start()):
                yield first.start(), domain.end(), "email"
                at = domain.end()
                break
            if done or other.start() >= sign:
                break
            yield other.start(), other.end(), other.lastgroup
            at = other.end()
            if at > sign:
                break
    for other in ENTITY.finditer(text, at):
        yield other.start(), other.end(), other.lastgroup


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, key) of all entities, left to right without overlap."""
    if HINT.search(text) is None:
        return []
    found, names = [], []
    for start, end, kind in matches(text):
        value = text[start:end]
        if kind == "name":
            end -= 2 * value.endswith(("'s", "’s"))
            names.append((start, end, gender_of(text, start)))
            continue
        if kind == "card":
            digits = regex.sub(r"\D", "", value)
            if len(digits) != 16 and not luhn(digits):
                continue
            key = digits
        elif kind == "phone":  # the country code, which stays, and the rest
            code = regex.match(r"\+(\d{1,3})\D", value)
            rest = regex.sub(r"\D", "", value[code.end(1):] if code else value)
            key = f"{code[1] if code else ''}-{rest}"
        elif kind == "ssn":
            key = regex.sub(r"\D", "", value)
        else:
            key = value.replace(" ", "").lower()
        found.append((start, end, kind, key))
    if not names:
        return found
    return sorted([*found, *_named(text, names, found)])


def _named(text: str, names: list[tuple[int, int, str]], others: list) -> list[tuple[int, int, str, str]]:
    """Names behind a form of address, and later mentions of them without one."""
    genders, families = {}, {}
    for start, end, gender in names:
        *first, family = text[start:end].split(" ")
        if family not in (*MALE, *FEMALE, *OPEN):
            families.setdefault(family, set()).update(first)
        if first and gender != "o":
            genders.setdefault(first[0].lower(), gender)

    def key(words: str) -> str:
        *first, family = words.split(" ")
        return " ".join([f"{genders.get(w.lower(), 'o')}:{w.lower()}" for w in first]
                        + [f"o:{family.lower()}"])

    spans = [(a, b, "name", key(text[a:b])) for a, b, _ in names]
    taken = sorted([(a, b) for a, b, *_ in others] + [(a, b) for a, b, _ in names])
    known, at, last = names[0][1], 0, None
    for match in CAPITALIZED.finditer(text, known):
        while at < len(taken) and taken[at][1] <= match.start():
            at += 1
        if at < len(taken) and taken[at][0] < match.end():
            last = None
            continue
        word = match[0]
        if word not in families:
            word = regex.split("['’]", word)[0]
        if word in families:
            first, start = last, match.start()
            if first and first[1] + 1 == start and text[first[1]] == " " and text[slice(*first)] in families[word]:
                start = first[0]
            spans.append((start, match.start() + len(word), "name", key(text[start:match.start() + len(word)])))
            last = None
        else:
            last = match.span()
    return spans


def units(kind: str, key: str) -> list[tuple[str, str]]:
    """What is drawn on its own: each word of a name, else the whole entity."""
    return [(kind, part) for part in key.split(" ")] if kind == "name" else [(kind, key)]


class Surrogates:
    def __init__(self, secret: bytes):
        self.secret = secret

    def draws(self, kind: str, key: str, attempt: int) -> Iterator[int]:
        count = 0
        while True:
            text = f"{kind}\0{key}\0{attempt}\0{count}".encode()
            yield from hmac.new(self.secret, text, sha256).digest()
            count += 1

    def key(self, kind: str, key: str, attempt: int = 0) -> str:
        """The key of the surrogate, in the alphabet of the entity's key."""
        draw = self.draws(kind, key, attempt)
        if kind == "ip":
            return ".".join(str(1 + next(draw) % 254) for _ in range(4))
        if kind == "name":
            return f"{key[0]}:{self._name(key[2:], key[0], draw, SYLLABLES_FIRST + attempt)}"
        keep = key.rindex(".") if kind == "email" else len(key)
        fixed = {"iban": 2, "phone": key.find("-")}.get(kind, 0)
        out = []
        for i, c in enumerate(key):
            n = next(draw) * 256 + next(draw)
            if i >= keep or i < fixed:
                out.append(c)
            elif c.isdigit():
                out.append(str(n % 10))
            elif c.isalpha():
                out.append(chr(97 + n % 26))
            else:
                out.append(c)
        if kind == "card" and luhn(key):
            out[-1] = next(d for d in "0123456789" if luhn("".join(out[:-1]) + d))
        return "".join(out)

    def _name(self, word: str, gender: str, draw: Iterator[int], size: int) -> str:
        script = script_of(word)
        parts = SYLLABLES[script]
        return "".join(parts[next(draw) % len(parts)] for _ in range(size)) + ENDINGS[script][gender]

    @staticmethod
    def formatted(kind: str, original: str, key: str) -> str:
        """The surrogate in the format and case of the original."""
        if kind == "ip":
            return key
        if kind == "name":
            words = [w[2:].upper() if len(o) > 1 and o.isupper() else w[2:].capitalize()
                     for w, o in zip(key.split(" "), original.split(" "), strict=True)]
            return " ".join(words)
        rest = iter(key.replace("-", "") if kind == "phone" else key)
        digits_only = kind in ("card", "phone", "ssn")
        return "".join(
            c if (digits_only and not c.isdigit()) or (kind == "iban" and c == " ")
            else (s.upper() if c.isupper() else s)
            for c in original
            for s in ([""] if (digits_only and not c.isdigit()) or (kind == "iban" and c == " ")
                      else [next(rest)]))


def entity_table(texts: DataFrame, secret: bytes) -> DataFrame:
    """(kind, key, surrogate) of the different entities, sent once a task each."""
    schema = pa.schema([("kind", pa.string()), ("key", pa.string()), ("surrogate", pa.string())])

    def run(batches):
        made = Surrogates(secret)
        for batch in batches:
            found = {unit for i in range(batch.num_rows)
                     for _, _, k, v in entities(batch.column(0)[i].as_py() or "") for unit in units(k, v)}
            rows = [(k, v, made.key(k, v)) for k, v in sorted(found)]
            if rows:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.string()) for c in zip(*rows, strict=True)], schema=schema)

    return texts.select("_text").mapInArrow(run, "kind string, key string, surrogate string").distinct()


def redrawn(table: DataFrame, secret: bytes) -> DataFrame:
    """(kind, key, surrogate) of the entities whose first surrogate collided, without collisions."""
    def draw(attempt):
        def run(batches):
            made = Surrogates(secret)
            for batch in batches:
                kinds, keys = batch.column("kind").to_pylist(), batch.column("key").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("kind"), batch.column("key"),
                     pa.array([made.key(k, v, attempt) for k, v in zip(kinds, keys, strict=True)],
                              pa.string())], names=["kind", "key", "surrogate"])
        return run

    real = table.select("kind", F.col("key").alias("surrogate"), F.lit(True).alias("real"))
    now, attempt, changed = table.withColumn("drawn", F.lit(0)), 0, None
    while True:
        judged = (now.join(real, ["kind", "surrogate"], "left")
                  .withColumn("place", F.row_number().over(
                      Window.partitionBy("kind", "surrogate").orderBy("drawn", "key"))))
        # Where nearly all values of a format are taken, real ones are no longer avoided.
        avoid = F.col("real") if attempt < AVOID_DRAWS else F.lit(False)
        bad = cut_lineage(judged.filter((F.col("place") > 1) | F.coalesce(avoid, F.lit(False)))
                          .select("kind", "key"))
        if bad.isEmpty():
            break
        attempt += 1
        if attempt > MAX_DRAWS:
            raise ValueError("an entity format has too few values to keep surrogates distinct")
        again = cut_lineage(bad.mapInArrow(draw(attempt), "kind string, key string, surrogate string")
                            .withColumn("drawn", F.lit(attempt)))
        now = cut_lineage(now.join(bad, ["kind", "key"], "left_anti").unionByName(again))
        changed = now.filter("drawn > 0")
    return (now.limit(0) if changed is None else changed).select("kind", "key", "surrogate")


def replace(df: DataFrame, secret: bytes, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, text (with surrogates), n_entities and ``spans`` (kind:start:end in the input)."""
    bounded_batches(df.sparkSession)
    kind = df.schema[id].dataType.simpleString()
    texts = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"))
    table = cut_lineage(entity_table(texts, secret))
    changed = cut_lineage(redrawn(table, secret))
    ddl = f"`{id}` {kind}, `{text}` string, n_entities bigint, spans string"
    schema = arrow_schema(df.sparkSession, ddl)
    few = changed.limit(MAX_BROADCAST + 1).collect()
    shared = {}
    if len(few) <= MAX_BROADCAST:
        shared = {(r["kind"], r["key"]): r["surrogate"] for r in few}
        rows = texts.withColumn("_changed", F.lit(None).cast(
            "array<struct<kind:string,key:string,surrogate:string>>"))
    else:
        rows = _with_changed(texts, changed)
    shared = df.sparkSession.sparkContext.broadcast(shared)

    def run(batches):
        made, redrawn_ = Surrogates(secret), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                out = []
                for i in range(part.num_rows):
                    key, body, other = (c[i].as_py() for c in part.columns)
                    known = {(x["kind"], x["key"]): x["surrogate"] for x in other or []} or redrawn_
                    pieces, spans, at = [], [], 0
                    for a, b, k, v in entities(body or ""):
                        value = " ".join(known.get(u) or made.key(*u) for u in units(k, v))
                        pieces += [body[at:a], made.formatted(k, body[a:b], value)]
                        spans.append(f"{k}:{a}:{b}")
                        at = b
                    new = None if body is None else "".join([*pieces, body[at:]])
                    out.append((key, new, len(spans), ",".join(spans)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema,
                                                         strict=True)], schema=schema)

    return rows.select("_id", "_text", "_changed").mapInArrow(run, ddl)


def _with_changed(texts: DataFrame, changed: DataFrame) -> DataFrame:
    """Texts with the redrawn surrogates they need, joined by a hash of the text."""
    names = "kind string, key string"

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                found = sorted({unit for _, _, k, v in entities(batch.column(1)[i].as_py() or "")
                                for unit in units(k, v)})
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[i].as_py()] * len(found), pa.string()),
                         *[pa.array(c, pa.string()) for c in zip(*found, strict=True)]],
                        names=["_print", "kind", "key"])

    printed = texts.withColumn("_print", F.sha2("_text", 256))
    held = (printed.select("_print", "_text").mapInArrow(run, f"_print string, {names}")
            .join(changed, ["kind", "key"]).groupBy("_print")
            .agg(F.collect_set(F.struct("kind", "key", "surrogate")).alias("_changed")))
    return printed.join(cut_lineage(held), "_print", "left")
