"""Small helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What separates words: space and the ASCII controls 9 to 13 (also what bytes.split() splits at).
WORD = r"[^\x20\x09-\x0D]+"
# Bytes of an Arrow batch: rows alone do not bound it, as 10,000 long texts fill gigabytes.
BATCH_BYTES = "4m"

_held: dict[tuple, object] = {}
_asked: set[tuple] = set()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(text: str = "text") -> Column:
    return F.coalesce(F.col(text), F.lit(""))


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches that go to Python in bytes; a longer text is a batch by itself."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def held(key: tuple, make: Callable[[], object]):
    """An object that later tasks of the same operator in this Python worker use again."""
    _asked.add(key)
    if key not in _held:
        _held[key] = make()
    return _held[key]


def forget_others() -> None:
    """Drop what this task did not ask for. Python workers are reused by the stages that follow, so
    the vocabulary of one operator would else stay in memory beside the work of all later ones."""
    for key in _held.keys() - _asked:
        del _held[key]
    _asked.clear()
    pa.default_memory_pool().release_unused()


def map_texts(df: DataFrame, columns: list[str], schema: str,
              work: Callable[[], Callable[[list], tuple | None]]) -> DataFrame:
    """One output row for each input row, in Arrow batches.

    ``work()`` is called once a task and gives a function from the values of ``columns`` to the
    tuple of output values. Values are taken out of a batch one row at a time, and results leave
    in small batches, so that memory holds one batch and not a partition.
    """
    bounded_batches(df.sparkSession)
    out_schema = arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = work()
        forget_others()
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                rows = [each([c[i].as_py() for c in part.columns]) for i in range(part.num_rows)]
                cells = list(zip(*rows, strict=True)) if rows else [[] for _ in out_schema]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v, f.type) for v, f in zip(cells, out_schema, strict=True)],
                    schema=out_schema)

    return df.select(*columns).mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    return to_arrow_schema(StructType.fromDDL(ddl))
