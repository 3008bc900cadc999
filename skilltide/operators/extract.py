"""Skill extraction and text embedding: pluggable, with Spark-native defaults."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skills import (
    MAX_LITERAL_ALIASES,
    bare_skills,
    clean_skills,
    parse_skills_json,
)
from ..functions.text import _col, bind
from ..functions.vectors import hashed_trigram_vector
from ..vocabulary import CANONICAL_SKILLS, TECH_CAPITALIZATION
from .scale import cut_lineage, salted_join

Extractor = Callable[[str], str]
Embedder = Callable[[Sequence[str]], Sequence[Sequence[float]]]

# Words that travel with the place before them.
CARRIED = 4
# Characters of a word, the frequent ones listed, which Java looks up in one step; '.', '/' and '-' only inside.
_IN_WORD = r"[[abcdefghijklmnopqrstuvwxyz0123456789_+#][\p{L}\p{N}]]"
WORD = rf"{_IN_WORD}++(?:[./-]++{_IN_WORD}++)*+"


def known_spellings() -> list[str]:
    return sorted({*CANONICAL_SKILLS, *TECH_CAPITALIZATION})


def text_words(c: Column | str) -> Column:
    """Lower-case words of a whole text; they keep '+', '#' and inner '.', '/', '-'."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), F.lit(0))


def word_grams(c: Column | str, longest: int = 3) -> Column:
    """Runs of 1..longest words of a whole text.

    Each run is the shorter run before it and one more word, so the work is linear in the text.
    """
    words = text_words(c)

    def longer(words: Column, shorter: Column, n: int) -> Column:
        following = F.slice(words, F.lit(n), F.size(words))
        return F.zip_with(shorter, following, lambda a, b: F.concat(a, F.lit(" "), b))

    def grow(words: Column, runs: list[Column], n: int) -> Column:
        if n > longest:
            return F.filter(F.concat(*runs), lambda g: g.isNotNull())
        return bind(longer(words, runs[-1], n), lambda r: grow(words, [*runs, r], n + 1))

    return bind(words, lambda ws: grow(ws, [ws], 2))


def gazetteer_skills(c: Column | str, spellings: Sequence[str]) -> Column:
    """Known spellings that occur in a text, row by row without a shuffle.

    The list rides in the plan as hash sets; a larger one belongs in ``gazetteer_join``. Each word of a
    text is looked up once, among the first words of all spellings; a run of several words is formed only
    where its first two words are those of a spelling of that length.
    """
    if len(spellings) > MAX_LITERAL_ALIASES:
        raise ValueError("use gazetteer_join for a large vocabulary")
    heads: dict[int, set[tuple[str, ...]]] = {}
    for spelling in spellings:
        words = spelling.split(" ")
        heads.setdefault(len(words), set()).add(tuple(words[:2]))
    firsts = sorted({head[0] for every in heads.values() for head in every})

    def runs(words: Column, places: Column, length: int) -> Column:
        if length == 1:
            return F.transform(places, lambda i: F.get(words, i))
        first, second = (sorted(set(part)) for part in zip(*heads[length]))
        fits = F.filter(places, lambda i: F.get(words, i).isin(first) & F.get(words, i + 1).isin(second))
        return F.transform(fits, lambda i: F.concat_ws(" ", F.slice(words, i + 1, F.lit(length))))

    def formed(words: Column) -> Column:
        # The last place is behind the text, where no word is found.
        places = F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: F.get(words, i).isin(firsts))
        return bind(places, lambda at: F.concat(
            F.slice(words, 1, 0), *[runs(words, at, n) for n in sorted(heads)]))

    found = bind(text_words(c), formed)
    return F.array_sort(F.array_distinct(F.filter(found, lambda g: g.isin(list(spellings)))))


def spelling_starts(texts: DataFrame, spellings: DataFrame, longest: int | None = None) -> DataFrame:
    """(_row, at, lengths) of texts (_row, words): the places where a spelling may begin, by its first
    word, and the lengths of those that do. One row a word and no more, whatever the spellings' lengths;
    frequent words are dealt over many tasks."""
    return _starts(texts, spellings, longest).drop("word")


def _starts(texts: DataFrame, spellings: DataFrame, longest: int | None, *keep: Column) -> DataFrame:
    """The same with the first word and further columns of a row, which may use ``at`` and ``words``."""
    words = spellings.select(F.split("spelling", " ").alias("w")).select(
        F.col("w")[0].alias("word"), F.size("w").alias("n"))
    if longest is not None:
        words = words.filter(F.col("n") <= longest)
    # Written, so that Spark sees its true size: a small one is broadcast and no word is shuffled.
    starts = cut_lineage(words.groupBy("word").agg(F.array_sort(F.collect_set("n")).alias("lengths")))
    places = texts.select("*", F.posexplode("words").alias("at", "word")).select("_row", "at", "word", *keep)
    return salted_join(places, starts, "word", spread_on=["_row", "at"])


def gazetteer_join(texts: DataFrame, spellings: DataFrame, *, id_col: str, text_col: str,
                   longest: int | None = None) -> DataFrame:
    """(id, skill) for a vocabulary of any size: (spelling, skill) joined to the word runs that begin
    with the first word of a spelling and are as long as it, at most ``longest`` words if given.

    A place carries the words behind it, up to CARRIED and as many as the spellings have, so that no
    text is moved; only for longer spellings, if there are any, starts are brought back to the texts."""
    keyed = cut_lineage(texts.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("id"),
                                     text_words(text_col).alias("words")))
    spellings = cut_lineage(spellings)
    length = F.size(F.split("spelling", " "))
    most = spellings.agg(F.max(length)).first()[0] or 1
    most = most if longest is None else min(most, longest)
    carried = min(CARRIED, most - 1)
    behind = F.slice("words", F.col("at") + 2, F.lit(carried)).alias("behind")
    near = _starts(keyed, spellings, min(most, CARRIED + 1), F.col("id"), behind)
    runs = near.select("id", "word", "behind", F.explode("lengths").alias("n")).select("id", F.array_join(
        F.concat(F.array("word"), F.slice("behind", F.lit(1), F.col("n") - 1)), " ").alias("spelling"))
    if most > CARRIED + 1:
        starts = (spelling_starts(keyed, spellings.filter(length > CARRIED + 1), longest).groupBy("_row")
                  .agg(F.collect_list(F.struct("at", "lengths")).alias("starts")))
        run = F.flatten(F.transform("starts", lambda s: F.transform(s["lengths"], lambda n: F.array_join(
            F.slice("words", s["at"] + 1, n), " "))))
        runs = runs.unionByName(keyed.join(starts, "_row").select(
            "id", F.explode(F.array_distinct(run)).alias("spelling")))
    return (runs.join(spellings, "spelling").select(F.col("id").alias(id_col), "skill").distinct())


def _regrouped(keyed: DataFrame, found: DataFrame, out: str) -> DataFrame:
    """Rows with the sorted set of their found (_row, skill); bounded by what one row holds."""
    sets = found.groupBy("_row").agg(F.array_sort(F.collect_set("skill")).alias(out))
    return keyed.drop(out).join(sets, "_row", "left").withColumn(
        out, F.coalesce(out, F.array().cast("array<string>"))).drop("_row")


def with_clean_skills(df: DataFrame, raw_col: str,
                      canonical: Mapping[str, str] = CANONICAL_SKILLS,
                      capitalization: Mapping[str, str] = TECH_CAPITALIZATION, *,
                      out: str = "skills") -> DataFrame:
    """Add ``clean_skills`` for alias tables of any size: small ones ride in the plan, larger
    ones are joined, with equal results."""
    if max(len(canonical), len(capitalization)) <= MAX_LITERAL_ALIASES:
        return df.withColumn(out, clean_skills(raw_col, canonical, capitalization))
    keyed = cut_lineage(df.withColumn("_row", F.expr("uuid()")))
    raw = keyed.select("_row", F.explode(raw_col).alias("raw")).filter(F.col("raw").isNotNull())
    named = raw.select("_row", F.explode(bare_skills("raw")).alias("skill"))
    for table in (canonical, capitalization):
        aliases = alias_frame(df, [table]).toDF("skill", "_alias")
        named = named.join(aliases, "skill", "left").select(
            "_row", F.coalesce("_alias", "skill").alias("skill"))
    return _regrouped(keyed, named, out)


def with_extracted(df: DataFrame, text_col: str, extractor: Extractor | None = None, *,
                   spellings: Sequence[str] | None = None, out: str = "raw_skills"
                   ) -> DataFrame:
    """Add the raw skills of a description.

    ``extractor`` maps a text to JSON {"skills": [...]}; it runs in Python workers, per row,
    and a reply that is not JSON or a failure leaves NULL, for the dead-letter route. Without
    one, the known spellings are looked up inside the JVM.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    if extractor is None:
        known = spellings or known_spellings()
        if len(known) <= MAX_LITERAL_ALIASES:
            return df.withColumn(out, gazetteer_skills(text, known))
        keyed = cut_lineage(df.withColumn("_row", F.expr("uuid()")))
        return _regrouped(keyed, gazetteer_join(
            keyed, alias_frame(df, [{s: s for s in known}]), id_col="_row", text_col=text_col,
            longest=max(len(s.split(" ")) for s in known)), out)

    @F.pandas_udf("string")
    def reply(texts: pd.Series) -> pd.Series:
        def attempt(value: str) -> str | None:
            try:
                return extractor(value)
            except Exception:
                return None

        return texts.map(attempt)

    return df.withColumn("_reply", reply(text)).withColumn(
        out, parse_skills_json("_reply")).drop("_reply")


def with_embedding(df: DataFrame, text_col: str, embedder: Embedder | None = None, *,
                   dim: int = 64, out: str = "title_embedding") -> DataFrame:
    """Add the vector of a text: from ``embedder`` (one call per Arrow batch), else hashed
    trigrams inside the JVM."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    if embedder is None:
        return df.withColumn(out, hashed_trigram_vector(text, dim))

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[float(x) for x in v] for v in embedder(list(texts))])

    return df.withColumn(out, vectors(text))


def alias_frame(df: DataFrame, tables: Sequence[Mapping[str, str]]) -> DataFrame:
    """Alias tables as a (spelling, skill) DataFrame; later tables win."""
    merged: dict[str, str] = {}
    for table in tables:
        merged.update(table)
    return df.sparkSession.createDataFrame(sorted(merged.items()), "spelling string, skill string")
