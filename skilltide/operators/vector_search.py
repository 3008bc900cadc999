"""Exact vector search of a query block over a whole corpus.

The corpus is scanned where it lies: no shuffle of vectors, no pairs. Every task multiplies its
Arrow batches with the broadcast query block and keeps its own best rows; only those are
shuffled. The query block is bounded; queries that do not fit into one are joined as a table
(see ``vector_join``), so that their number is not bounded by the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import round_vector
from .scale import top_k_per_group
from .vector_join import vector_join

# A query block is at most this many vector cells (32 MB of doubles) on driver and executors,
# and so many queries that a task holds no more than this many best rows at a time.
MAX_BLOCK_CELLS = 4_000_000
MAX_TASK_ROWS = 2_000_000
# Scores are computed in tiles of this many corpus rows by this many queries (32 MB).
TILE_ROWS = 4096
TILE_QUERIES = 1024
# Equal vectors must tie whatever batch they are in, so scores are ranked at nine decimals.
SCORE_DECIMALS = 9


@dataclass(frozen=True)
class _Block:
    ids: list[Any]
    vectors: np.ndarray
    seniority: np.ndarray
    year: np.ndarray


def _of_size(vector: str, dim: int) -> Column:
    """Rows with a vector; one of another size is an error, as its rows would be lost unseen."""
    wrong = F.raise_error(F.concat(F.lit(f"{vector} needs {dim} values, has "),
                                   F.size(vector).cast("string"))).cast("boolean")
    return F.when(F.col(vector).isNull(), False).when(F.size(vector) == dim, True).otherwise(wrong)


def _block(queries: DataFrame, dim: int, faceted: bool, k: int | None) -> _Block | None:
    """All queries as one block; None if they are more than a block may hold."""
    limit = max(1, min(MAX_BLOCK_CELLS // dim, MAX_TASK_ROWS // (k or 1)))
    columns = ["query_id", "query_vector"]
    columns += ["seniority_filter", "year_floor"] if faceted else []
    rows = (queries.select(*columns).filter(_of_size("query_vector", dim)).limit(limit + 1).collect())
    if len(rows) > limit:
        return None
    vectors = np.round(np.array([r["query_vector"] for r in rows], dtype=np.float64).reshape(-1, dim), 6)
    lengths = np.linalg.norm(vectors, axis=1, keepdims=True)
    return _Block(
        [r["query_id"] for r in rows],
        np.divide(vectors, lengths, out=np.zeros_like(vectors), where=lengths > 0),
        np.array([r["seniority_filter"] if faceted else None for r in rows], dtype=object),
        np.array([r["year_floor"] if faceted and r["year_floor"] is not None else np.nan
                  for r in rows], dtype=np.float64))


def _allowed(batch: pa.RecordBatch, block: _Block, part: slice) -> np.ndarray:
    level = np.array(batch.column(2).to_pylist(), dtype=object)[:, None]
    year = batch.column(3).to_numpy(zero_copy_only=False).astype(np.float64)[:, None]
    wanted, floor = block.seniority[None, part], block.year[None, part]
    no_level = np.array([s is None for s in block.seniority[part]])[None, :]
    return (no_level | (level == wanted) | (level == "unknown")) & (
        np.isnan(floor) | (year >= floor))


def _best(frame: pd.DataFrame, k: int) -> pd.DataFrame:
    frame = frame.sort_values(["q", "score", "id"], ascending=[True, False, True])
    return frame[frame.groupby("q").cumcount() < k]


def _scan_block(corpus: DataFrame, block: _Block, dim: int, k: int | None,
                floor: float | None, inclusive: bool, faceted: bool,
                schema: T.StructType) -> DataFrame:
    shared = corpus.sparkSession.sparkContext.broadcast(block)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        floors = np.full(len(block.ids), -np.inf)
        kept: list[pd.DataFrame] = []
        held = 0
        query_type = out_types[0]
        id_type = None

        def emit(frame: pd.DataFrame) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([
                pa.array([block.ids[q] for q in frame["q"]], type=query_type),
                pa.array(frame["id"].tolist(), type=id_type),
                pa.array(frame["score"].to_numpy(), type=pa.float64())],
                names=["query_id", "posting_id", "score"])

        tiles = ((batch.slice(at, TILE_ROWS), slice(q, q + TILE_QUERIES))
                 for batch in batches for at in range(0, batch.num_rows, TILE_ROWS)
                 for q in range(0, len(block.ids), TILE_QUERIES))
        for batch, part in tiles:
            id_type = batch.schema.field(0).type
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            rows = np.round(flat.astype(np.float64).reshape(batch.num_rows, dim), 6)
            lengths = np.linalg.norm(rows, axis=1, keepdims=True)
            rows = np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)
            scores = np.round(rows @ block.vectors[part].T, SCORE_DECIMALS)
            # A vector without length has no direction and so no score.
            scores[lengths[:, 0] == 0] = -np.inf
            if faceted:
                scores[~_allowed(batch, block, part)] = -np.inf
            if floor is not None:
                scores[scores < floor if inclusive else scores <= floor] = -np.inf
            if k is not None and len(scores) > k:
                place = len(scores) - k
                floors[part] = np.maximum(floors[part],
                                          np.partition(scores, place, axis=0)[place])
            row, query = np.nonzero((scores >= floors[None, part]) & (scores > -np.inf))
            ids = batch.column(0).take(pa.array(row)).to_pandas()
            found = pd.DataFrame({"q": query + part.start, "id": ids.to_numpy(),
                                  "score": scores[row, query]})
            if k is None:
                if len(found):
                    yield emit(found)
                continue
            kept.append(found)
            held += len(found)
            if held > 4 * k * len(block.ids) + 100_000:
                best = _best(pd.concat(kept), k)
                full = best.groupby("q")["score"].agg(["size", "min"])
                full = full[full["size"] == k]
                floors[full.index] = np.maximum(floors[full.index], full["min"])
                kept, held = [best], len(best)
        if kept and held:
            yield emit(_best(pd.concat(kept), k))

    out_types = [_arrow_type(schema["query_id"].dataType)]
    return corpus.mapInArrow(scan, schema)


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def vector_search(corpus: DataFrame, queries: DataFrame, *, dim: int, k: int | None = None,
                  floor: float | None = None, inclusive: bool = False,
                  id_col: str = "posting_id", vector_col: str = "title_embedding",
                  faceted: bool = True) -> DataFrame:
    """(query_id, posting_id, score): cosine of every query with the corpus.

    ``k`` keeps the best k of a query (ties by id), ``floor`` those above it. Rows without a
    vector never match. ``faceted`` applies the queries' seniority_filter and year_floor before
    anything is cut off.
    """
    if k is None and floor is None:
        raise ValueError("give k or floor: all pairs are never formed")
    schema = T.StructType([
        T.StructField("query_id", queries.schema["query_id"].dataType),
        T.StructField("posting_id", corpus.schema[id_col].dataType),
        T.StructField("score", T.DoubleType())])
    block = _block(queries, dim, faceted, k)
    if block is None:
        return vector_join(corpus, queries, dim=dim, k=k, floor=floor, inclusive=inclusive,
                           id_col=id_col, vector_col=vector_col, faceted=faceted)
    if not block.ids:
        return corpus.sparkSession.createDataFrame([], schema)
    scanned = [F.col(id_col).alias("posting_id"), round_vector(vector_col).alias("v")]
    facets: Sequence[str] = ["seniority", "posting_year"] if faceted else []
    rows = corpus.filter(_of_size(vector_col, dim)).select(*scanned, *facets)
    out = _scan_block(rows, block, dim, k, floor, inclusive, faceted, schema)
    if k is None:
        return out
    return top_k_per_group(out, ["query_id"], [F.desc("score"), F.asc("posting_id")], k,
                           spread_on=["posting_id"])
