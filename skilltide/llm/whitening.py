"""Embedding whitening by a covariance weighted with multiplicities.

Equal vectors are grouped first, so that each distinct vector is centred, multiplied and whitened once
and carries as its weight the number of its rows (``weights="rows"``) or one (``weights="one"``). The
covariance is a weighted centred GEMM: each task multiplies its batches, and the matrices of the tasks
are added in two steps. Only what depends on the number of dimensions reaches the driver: the sums, the
covariance and its eigenvectors. Results go back to the rows by the SHA-256 of the vector; vectors with
more than a 512th of all rows, of which there are fewer than 512, are broadcast, all others join.

Sums are exact integers and vectors are centred on their integer part, so large offsets cost no digits.

Rows with a null or empty vector, or one with a null entry, are left out. Vectors of another length than
the most frequent one (of equally frequent ones the longest) have no covariance with it and are left out
too. A null or repeated id is kept as it is; further columns are not read. A component without variance
(below 1e-10 of the total) is returned with a null ``whitened``; without any variance ``explained`` is
null too, and ``identity_error`` is null if no component has variance. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skilltide.llm.common import bounded_batches
from skilltide.operators.scale import cut_lineage

COMPONENTS = 8
# A component with less than this share of the variance counts as flat.
FLAT = 1e-10
# Vectors with more than 1/HEAVY of all rows: fewer than HEAVY of them, so they can be broadcast.
HEAVY = 512
# Matrices of the tasks are first added in so many slices a row.
SLICES = 64
INT = pa.decimal128(38, 0)
BEYOND = Decimal(10) ** 38


def quantised(vector: str = "embedding", *, scale: int = 1024, offset: int = 100_000) -> Column:
    """Vector of longs floor(scale * entry) + offset; null where the vector is null or holds a null, NaN
    or infinite entry. Products beyond 2^62 in size are held at that bound."""
    bound = float(2 ** 62)

    def whole(entry: Column) -> Column:
        scaled = F.greatest(F.least(entry.cast("double") * scale, F.lit(bound)), F.lit(-bound))
        return F.floor(scaled).cast("bigint") + offset

    finite = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < float("inf")))
    return F.when(F.col(vector).isNotNull() & F.coalesce(finite, F.lit(False)),
                  F.transform(vector, whole))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def exact_sums(x: np.ndarray, weights: np.ndarray) -> list[int]:
    """Weighted sums of the columns as exact integers."""
    largest = max(abs(int(x.max())), abs(int(x.min())))
    if largest * int(weights.sum(dtype=object)) < 2 ** 62:
        return [int(v) for v in weights @ x]
    return [int(v) for v in weights.astype(object) @ x.astype(object)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """Sum over the dimensions of (n*x - S)^2, exact; null where it has more than 38 digits."""
    largest = max(abs(int(x.max())), abs(int(x.min())))
    away = n * largest + max(map(abs, sums))
    if away * away * len(sums) < 2 ** 62:
        off = n * x - np.array(sums, np.int64)
        found = (off * off).sum(axis=1).tolist()
    else:
        off = n * x.astype(object) - np.array(sums, object)
        found = (off * off).sum(axis=1).tolist()
    return [d if (d := Decimal(int(v))) < BEYOND else None for v in found]


def fit_sums(groups: DataFrame, dims: int) -> tuple[int, list[int]]:
    """The weight of the fit list and the weighted sum of every dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, [0] * dims
        for batch in batches:
            if batch.num_rows:
                weights = batch.column(1).to_numpy()
                total += int(weights.sum(dtype=object))
                sums = [a + b for a, b in zip(sums, exact_sums(matrix(batch.column(0), dims), weights))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(-1, dims), pa.int32()), pa.array(map(Decimal, [total, *sums]), INT)],
            names=["j", "total"])

    parts = groups.select("x", "w").mapInArrow(run, "j int, total decimal(38,0)")
    found = {r["j"]: int(r["total"]) for r in parts.groupBy("j").agg(F.sum("total").alias("total"))
             .collect()}
    return found[-1], [found[j] for j in range(dims)]


def centre(x: np.ndarray, base: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """x - mean, the mean split into its integer part and the rest below one."""
    if max(abs(int(x.max())), abs(int(x.min()))) < 2 ** 61:
        return (x - base).astype(np.float64) - rest
    return (x.astype(object) - base.astype(object)).astype(np.float64) - rest


def mean_parts(n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
    base = [s // n for s in sums]
    return (np.array(base, np.int64),
            np.array([float(Fraction(s - b * n, n)) for s, b in zip(sums, base)]))


def added(parts: DataFrame, *by: str) -> DataFrame:
    """Rows of matrices, added by key in the order of their tasks."""
    names = ["i", "part", "row"]

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table["part"].to_numpy(), kind="stable")
        rows = table["row"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        return pa.table([table["i"].slice(0, 1), table["part"].slice(0, 1),
                         pa.array([rows[order].sum(axis=0)], pa.list_(pa.float64()))], names=names)

    return parts.groupBy(*by).applyInArrow(run, "i int, part int, row array<double>")


def covariance(groups: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the fit list, divisor n: one weighted product a batch, one matrix a task."""
    dims = len(sums)
    base, rest = mean_parts(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                off = centre(matrix(batch.column(0), dims), base, rest)
                found += (off * batch.column(1).to_numpy()[:, None]).T @ off
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dims), pa.int32()), pa.array([part] * dims, pa.int32()),
             pa.array(list(found), pa.list_(pa.float64()))], names=["i", "part", "row"])

    parts = (groups.select("x", "w").mapInArrow(run, "i int, part int, row array<double>")
             .withColumn("slice", F.col("part") % SLICES))
    rows = added(added(parts, "i", "slice"), "i").collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])]) / n


def components_of(cov: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors as columns, their largest entry positive."""
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), range(vectors.shape[1])])
    return values, vectors * np.where(signs == 0, 1, signs)


def whitened_groups(groups: DataFrame, n: int, sums: list[int], projection: np.ndarray) -> DataFrame:
    """Per distinct vector: key, rows, fit weight, projections and exact deviation."""
    dims = len(sums)
    base, rest = mean_parts(n, sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), dims)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(1), batch.column(2), batch.column(3),
                     pa.array(list(centre(x, base, rest) @ projection), pa.list_(pa.float64())),
                     pa.array(deviations(x, n, sums), INT)],
                    names=["key", "rows", "w", "y", "deviation"])

    return groups.select("x", "key", "rows", "w").mapInArrow(
        run, "key binary, rows bigint, w bigint, y array<double>, deviation decimal(38,0)")


def identity_error(white: DataFrame, n: int, live: int) -> float | None:
    """Largest absolute entry of the covariance of the whitened fit list minus the identity."""
    if not live:
        return None
    y, w = [F.col("y")[i] for i in range(live)], F.col("w").cast("double")
    means = white.agg(*[F.sum(w * c).alias(f"m{i}") for i, c in enumerate(y)]).first()
    off = [c - means[i] / n for i, c in enumerate(y)]
    pairs = [(i, j) for i in range(live) for j in range(i, live)]
    products = white.agg(*[F.sum(w * off[i] * off[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(products[f"c{i}_{j}"] / n - (i == j)) for i, j in pairs)


def whiten(df: DataFrame, *, id: str = "vec_id", vector: str = "x", components: int = COMPONENTS,
           weights: str = "rows") -> DataFrame:
    """Per row of ``df`` and component: id, component (from 1), n (weight of the fit list), deviation
    (decimal), whitened, explained, identity_error. ``vector`` is an array of longs."""
    if weights not in ("rows", "one"):
        raise ValueError("weights is 'rows' or 'one'")
    spark = df.sparkSession
    bounded_batches(spark)
    kind = df.schema[id].dataType.simpleString()
    schema = (f"`{id}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, "
              "explained double, identity_error double")
    vectors = (df.select(F.col(id).alias("id"), F.col(vector).cast("array<bigint>").alias("x"))
               .filter(F.col("x").isNotNull() & (F.size("x") > 0) & ~F.exists("x", lambda c: c.isNull())))
    key = F.unhex(F.sha2(F.col("x").cast("string"), 256))
    groups = cut_lineage(vectors.groupBy("x").agg(F.count("*").alias("rows"))
                         .select("x", key.alias("key"), "rows",
                                 (F.col("rows") if weights == "rows" else F.lit(1).cast("bigint"))
                                 .alias("w")))
    most = (groups.groupBy(F.size("x").alias("dims")).agg(F.sum("rows").alias("rows"))
            .orderBy(F.desc("rows"), F.desc("dims")).first())
    if most is None:
        return spark.createDataFrame([], schema)
    dims, n_rows = most["dims"], most["rows"]
    groups = groups.filter(F.size("x") == dims)
    n, sums = fit_sums(groups, dims)
    cov = covariance(groups, n, sums)
    trace = float(np.trace(cov))
    values, axes = components_of(cov, min(components, dims))
    live = int((values > FLAT * trace).sum())
    white = cut_lineage(whitened_groups(groups, n, sums, axes[:, :live] / np.sqrt(values[:live])))
    error = identity_error(white, n, live)

    rows = cut_lineage(vectors.filter(F.size("x") == dims).select("id", key.alias("key")))
    light = white.select("key", "y", "deviation")
    heavy = white.filter(F.col("rows") > n_rows / HEAVY)
    hot = rows.join(F.broadcast(heavy.select("key", "y", "deviation")), "key")
    cold = (rows.join(F.broadcast(heavy.select("key")), "key", "left_anti").join(light, "key"))
    shares = F.array(*[F.lit(max(float(v), 0.0) / trace if trace > 0 else None).cast("double")
                       for v in values])
    flat = F.array_repeat(F.lit(None).cast("double"), len(values) - live)
    return (hot.unionByName(cold)
            .select("id", "deviation", F.posexplode(F.concat("y", flat)).alias("c", "whitened"))
            .select(F.col("id").alias(id), (F.col("c") + 1).cast("int").alias("component"),
                    F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                    shares[F.col("c")].alias("explained"),
                    F.lit(error).cast("double").alias("identity_error")))
