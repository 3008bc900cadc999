"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts hashed n-grams of 1 to ``ORDERS`` characters per language in every task and sums the
counts in Spark; the matrix of log probabilities (languages x buckets) is broadcast. Prediction takes
the n-grams of a whole text as indices into that matrix and sums the rows of each text (a sparse
batch times the matrix) in numpy. Long texts are summed in slices.

Only the text is an input. A text that is null or has no letter gets ``und`` with score 0. Training
leaves out rows with a null language or text; when nothing is left to learn from, every text gets
``und``. Equal scores go to the first language in code point order. Rows with null or repeated ids
are predicted like all others; further columns are not read.

Bound of the training sample: ``MAX_PER_LANGUAGE`` rows a language on average, chosen by a hash of
their id (all rows of a language with fewer). The number of languages must be modest, as for codes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skilltide.llm.common import map_texts

ORDERS = 3
BITS = 15
MAX_PER_LANGUAGE = 4000
SLICE = 1 << 19
MULTIPLIERS = (2654435761, 2246822519, 3266489917, 668265263)
LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    languages: list[str]
    log_probability: np.ndarray    # (buckets, languages), float32
    prior: np.ndarray


def hashed_ngrams(text: str) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of a text in lower case, slice by slice.

    The text ends in zeros, so that each of its characters begins an n-gram of every order."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for start in range(0, len(codes), SLICE):
        part = codes[start:start + SLICE + ORDERS - 1]
        size = min(SLICE, len(codes) - start)
        if len(part) < size + ORDERS - 1:
            part = np.concatenate([part, np.zeros(size + ORDERS - 1 - len(part), np.uint32)])
        mixed = np.zeros(size, np.uint32)
        for order in range(ORDERS):
            mixed = (mixed ^ part[order:order + size]) * np.uint32(MULTIPLIERS[order])
            mixed = mixed ^ (mixed >> np.uint32(13))
            yield ((mixed * np.uint32(MULTIPLIERS[3])) >> np.uint32(32 - BITS)).astype(np.int32)


def train(df: DataFrame, *, id: str = "doc_id", text: str = "text", lang: str = "lang",
          max_per_language: int = MAX_PER_LANGUAGE) -> LanguageModel:
    """Learn from the labelled rows of ``df`` (see the bound above)."""
    labelled = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"),
                         F.col(lang).alias("_lang")).dropna(subset=["_text", "_lang"])
    sizes = {r["_lang"]: r["n"] for r in
             labelled.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), np.zeros(0))
    share = F.create_map(*[F.lit(x) for name in languages for x in (
        name, min(1.0, max_per_language / sizes[name]))])[F.col("_lang")]
    draw = F.pmod(F.xxhash64(F.lit(17), F.col("_id")), F.lit(1_000_000)) / 1_000_000
    sample = labelled.filter(draw < share).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                mine = counts.setdefault(name, np.zeros(1 << BITS, np.int64))
                for buckets in hashed_ngrams(batch.column(1)[i].as_py()):
                    mine += np.bincount(buckets, minlength=1 << BITS)
        for name, mine in counts.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(mine[at])], names=["lang", "bucket", "n"])

    rows = (sample.mapInArrow(count, "lang string, bucket int, n bigint")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    place = {name: i for i, name in enumerate(languages)}
    totals = np.ones((1 << BITS, len(languages)))
    np.add.at(totals, (rows["bucket"].to_numpy(),
                       np.array([place[x] for x in rows["lang"].to_pylist()], np.int64)),
              rows["n"].to_numpy())
    all_rows = sum(sizes.values())
    return LanguageModel(languages,
                         np.log(totals / totals.sum(axis=0)).astype(np.float32),
                         np.log([sizes[name] / all_rows for name in languages]))


def predict(df: DataFrame, model: LanguageModel, *, id: str = "doc_id",
            text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, lang_pred, score (posterior probability of that language), columns to carry."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = df.schema[id].dataType.simpleString()

    def work():
        model = shared.value

        def each(row):
            body = row[1]
            if not body or not model.languages or LETTER.search(body) is None:
                return row[0], "und", 0.0, *row[2:]
            score = model.prior.copy()
            for buckets in hashed_ngrams(body):
                score += model.log_probability[buckets].sum(axis=0, dtype=np.float64)
            best = int(np.argmax(score))
            return (row[0], model.languages[best],
                    round(1.0 / float(np.exp(score - score[best]).sum()), 6), *row[2:])
        return each

    more = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry]
    return map_texts(df, [id, text, *carry],
                     ", ".join([f"`{id}` {kind}", "lang_pred string", "score double", *more]), work)


def held_out(id: str = "doc_id"):
    """The fold that is never learnt from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % 3 == 1, F.lit(False))


def accuracy(predicted: DataFrame, truth: DataFrame, *, id: str = "doc_id") -> float:
    """Share of labelled rows whose prediction is their label."""
    hits = predicted.join(truth.select(id, "lang").dropna(), id)
    value = hits.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    return math.nan if value is None else value
