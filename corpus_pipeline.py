"""Corpus pipeline: language ID, exact dedup, near-duplicate join, mixing, BPE encoding.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written as Parquet and read again as
the documents of the next one. All but the last return the columns of the documents.

Stages that drop or repeat rows decide by the place of a row in its file, so null and repeated ids and
columns of any name stay as they are, and only decisions are shuffled, never texts (skilltide.llm.rows).
Tables that a stage's operator writes on its way are removed when its decisions are made. An empty
table stays empty. Null texts have no language and go with the first stage; given to a later stage by
itself, null and empty texts are one text for exact dedup, have no near copies, and are kept by the mix.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skilltide.llm import bpe, exact_dedup, language_id, mixing, ngram_join
from skilltide.llm.common import documents
from skilltide.llm.rows import repeated, with_places
from skilltide.operators.scale import cut_lineage, only_result


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without any letter (or text), for which no language can be told."""
    model = language_id.train(docs.filter(~language_id.held_out()))
    placed, key = with_places(docs)
    told = language_id.predict(placed.select(F.col(key).alias("place"), "text"), model, id="place")
    return repeated(placed, key, told.filter("lang_pred <> 'und'").select("place", F.lit(1).alias("copies")))


def one_of_each(placed: DataFrame, key: str, groups: DataFrame) -> DataFrame:
    """(place, copies): of every group (place, group) the row of the smallest id; null ids are last."""
    ids = placed.select(F.col(key).alias("place"), "doc_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "place"))
    return (groups.join(ids, "place").groupBy("group").agg(first.alias("first"))
            .select(F.col("first.place").alias("place"), F.lit(1).alias("copies")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of equal texts."""
    placed, key = with_places(docs)
    groups = only_result(lambda: exact_dedup.exact_duplicates(placed, id=key).select(
        F.col(key).alias("place"), F.col("keep_id").alias("group")))
    return repeated(placed, key, one_of_each(placed, key, groups))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of every near-duplicate component."""
    placed, key = with_places(docs)
    groups = only_result(lambda: ngram_join.near_duplicates(placed, id=key).select(
        F.col(key).alias("place"), F.col("component_id").alias("group")))
    return repeated(placed, key, one_of_each(placed, key, groups))


def identity() -> Column:
    """Id and digest of the text: names a row alike in every run, wherever it is stored."""
    return F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                       F.sha2(F.coalesce("text", F.lit("")), 256))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document as often as the mix takes it, begun rounds counting whole: texts are
    never cut. Documents that it does not take go, those without words stay. Rows of one id and text
    are repeated alike."""
    placed, key = with_places(docs)
    rounds = F.when(F.col("size") == 0, 1).otherwise(F.ceil(F.col("taken") / F.col("size"))).cast("int")
    named = placed.select(identity().alias("name"), "text", "source")
    copies = only_result(lambda: mixing.mix(named, id="name").groupBy("name")
                         .agg(F.max(rounds).alias("copies")))
    places = placed.select(F.col(key).alias("place"), identity().alias("name"))
    return repeated(placed, key, places.join(copies.filter("copies > 0"), "name").select("place", "copies"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with digests of the ids and of the decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.decode(bpe.encode(docs, path), path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids",
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", known_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("mixing", mixed),
    ("bpe", encoded),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
