"""Text functions as pure Column expressions (whole-stage codegen, no Python)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The seniority tags with their patterns, in priority order, and the year token.
SENIORITY_RULES: Sequence[tuple[str, str]] = (
    ("intern", r"\bintern(ship)?\b"),
    ("new_grad", r"\b(new[\s\-]?grad(uate)?|graduate)\b"),
    ("entry", r"\b(junior|jr\.?|entry[\s\-]?level|associate)\b"),
    ("senior", r"\b(senior|sr\.?|lead|staff|principal)\b"),
)
YEAR_PATTERN = r"\b(20\d{2})\b"
# The same, for whole texts: the digits are tried first, as a Unicode \b is slow at every character.
_YEAR_IN_TEXT = r"20(?<=\b20)\d{2}\b"
# What a title key may hold, listed: a class of ranges is tried one after the other.
_KEY_CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789 &+/#-"

# Head nouns that are rewritten, and what they become.
HEAD_NOUNS = ("developer", "programmer", "swe")
HEAD_NOUN_TARGET = "engineer"

# Acronyms that stay upper case in display titles.
DISPLAY_ACRONYMS = ("ml", "qa", "ai", "ios", "llm", "nlp", "sre")

# Java regexes see Unicode in \b \w \s \d only under this flag.
_U = "(?U)"
_IU = "(?iU)"

# Every white space character of Unicode, listed: much faster than \s under the flag.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# One of them, for whole texts. Nearly all characters of a text are others; those are told first and by one
# lookup, as Java keeps listed characters in a bit set but tries ranges one after the other.
_OTHERS = "".join(rf"\x{i:02x}" for i in (*range(0x21, 0x7F), *range(0xA1, 0x100)))
_ONE_SPACE = rf"[[^[{_OTHERS}][\u0100-\u167f\u3001-\x{{10ffff}}]]&&[{SPACE}]]"
# A run of white space that is not a single blank already.
UNEVEN_SPACE = rf"{_ONE_SPACE}(?:(?<!\x20)|{_ONE_SPACE}){_ONE_SPACE}*+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bind(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value computed once. An expression read inside a lambda would otherwise be
    computed again for every element."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def strip(c: Column | str) -> Column:
    """Trim every kind of white space, not just the blank."""
    return F.regexp_replace(_col(c), f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapse_spaces(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), UNEVEN_SPACE, " ")


def normalize_query(c: Column | str) -> Column:
    """Lower-case words joined by one blank."""
    return F.trim(collapse_spaces(F.lower(_col(c))))


def slug(c: Column | str, fallback: str = "untitled") -> Column:
    body = F.regexp_replace(F.lower(strip(c)), "[^A-Za-z0-9]+", "_")
    body = F.regexp_replace(body, "^_+|_+$", "")
    return F.coalesce(F.nullif(body, F.lit("")), F.lit(fallback))


def seniority(c: Column | str, rules: Iterable[tuple[str, str]] = SENIORITY_RULES) -> Column:
    """Tag of the first rule that matches; 'unknown' for no match, '' and NULL."""
    title, tag = _col(c), None
    for name, pattern in rules:
        hit = title.rlike(_IU + pattern)
        tag = F.when(hit, name) if tag is None else tag.when(hit, name)
    return F.lit("unknown") if tag is None else tag.otherwise("unknown")


def year_token(c: Column | str, pattern: str = YEAR_PATTERN) -> Column:
    """First year written in the text, else NULL."""
    found = F.regexp_extract(_col(c), _U + pattern, 1)
    return F.nullif(found, F.lit("")).try_cast("int")


def posting_year(title: Column | str, posted: Column | str | None = None) -> Column:
    """Year of the title, else of the posting date, else NULL."""
    written = year_token(title)
    return written if posted is None else F.coalesce(written, F.year(_col(posted)))


def query_seniority_filter(c: Column | str) -> Column:
    """Seniority asked for by a query; 'unknown' means no filter (NULL)."""
    return F.nullif(seniority(c), F.lit("unknown"))


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves composed letters apart under NFKC, so the values are composed here.
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t)
                     for t in texts.to_pylist()], pa.string())


def nfkc(c: Column | str) -> Column:
    """Compatibility composition. Spark has no built-in; only non-ASCII values leave the JVM."""
    text = _col(c)
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def title_key(c: Column | str, *, rules: Iterable[tuple[str, str]] = SENIORITY_RULES,
              ascii_only: bool = False, strip_levels: bool = False) -> Column:
    """Stable key of a raw title: brackets, tail after '|', seniority, year, punctuation gone.

    ``ascii_only`` skips the Unicode composition and so keeps the plan free of Python.
    ``strip_levels`` also drops a trailing I/II/III level.
    """
    text = F.lower(_col(c) if ascii_only else nfkc(c))
    text = F.regexp_replace(text, r"[\(\[][^\)\]]*[\)\]]", " ")
    text = F.substring_index(text, "|", 1)
    for _, pattern in rules:
        text = F.regexp_replace(text, _IU + pattern, "")
    text = F.regexp_replace(text, _U + _YEAR_IN_TEXT, "")
    if strip_levels:
        text = F.regexp_replace(text, r"\b(i{1,3}|iv)\s*$", "")
    text = F.regexp_replace(text, f"[^{_KEY_CHARACTERS}]", " ")
    text = F.regexp_replace(text, r"(^| )-+( |$)", " ")
    return F.trim(F.regexp_replace(text, "  +", " "))


def rewrite_head_noun(c: Column | str) -> Column:
    """Rewrite the last word, so that spellings of one role meet in one canonical title."""
    return F.regexp_replace(_col(c), rf"(^|\s)({'|'.join(HEAD_NOUNS)})$", f"$1{HEAD_NOUN_TARGET}")


def display_title(c: Column | str, acronyms: Sequence[str] = DISPLAY_ACRONYMS) -> Column:
    words = F.split(_col(c), " ")
    shown = F.transform(words, lambda w: F.when(w.isin(*acronyms), F.upper(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), w.substr(F.lit(2), F.length(w)))))
    return F.array_join(shown, " ")


def trigrams(c: Column | str) -> Column:
    """Distinct 3-grams of the lower-cased alphanumeric words, padded '  word '."""
    words = F.array_distinct(F.filter(F.split(F.lower(_col(c)), r"[^\p{L}\p{N}]+"), lambda w: w != ""))
    padded = F.transform(words, lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(
        F.sequence(F.lit(1), F.length(w) - 2), lambda i: w.substr(i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two distinct-element arrays; 0 when both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


def trigram_similarity(a: Column | str, b: Column | str) -> Column:
    return bind(trigrams(a), lambda x: bind(trigrams(b), lambda y: jaccard(x, y)))
