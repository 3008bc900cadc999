"""Whitening against a plain numpy version, with hot vectors, nulls and flat components."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skilltide.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, x string, key string, rows int"


def table(seed=1, n=300, dims=12):
    rng = np.random.default_rng(seed)
    mix = rng.normal(size=(dims, dims))
    vectors = (rng.normal(size=(n, dims)) @ mix * 0.1).astype(np.float32).tolist()
    vectors += [vectors[0]] * (n // 2) + [vectors[1]] * 3  # a hot vector and copies
    bad = [None, [None] * dims, [math.nan] + [0.0] * (dims - 1), [math.inf] + [0.0] * (dims - 1), [], [1.0]]
    rows = [(i, v, "clash", "clash", 1) for i, v in enumerate(vectors + bad)]
    return rows + [(None, vectors[2], "clash", "clash", 1), rows[5]]


def brute(rows, dims=12, components=8, one=False):
    kept = [(i, [math.floor(1024 * float(np.float32(c))) + 100000 for c in v]) for i, v, *_ in rows
            if v and len(v) == dims and all(c is not None and math.isfinite(c) for c in v)]
    fit = [x for _, x in kept]
    if one:
        fit = [list(x) for x in dict.fromkeys(map(tuple, fit))]
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    mean = np.array(sums) / n
    off = np.array(fit) - mean
    cov = off.T @ off / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    out = []
    for i, x in kept:
        deviation = sum((n * c - s) ** 2 for c, s in zip(x, sums))
        y = (np.array(x) - mean) @ axes / np.sqrt(values)
        out += [(i, c + 1, n, deviation, y[c], values[c] / np.trace(cov)) for c in range(len(values))]
    return out


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("q", whitening.quantised()).drop("x")
    return whitening.whiten(df.repartition(5), vector="q", **options).collect()


@pytest.mark.parametrize("one", [False, True])
def test_matches_numpy(spark, one):
    rows = table()
    got = run(spark, rows, weights="one" if one else "rows")
    want = brute(rows, one=one)
    order = lambda r: (r[0] is None, r[0] or 0, r[3], r[1])
    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:4] for r in got] == [r[:4] for r in want]
    for c in range(1, 9):  # either sign, the same for all rows
        a, b = (np.array([r[4] for r in x if r[1] == c]) for x in (got, want))
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-8
    assert np.allclose([r[5] for r in got], [r[5] for r in want], rtol=1e-9)
    assert all(r[6] < 1e-8 for r in got) and len({r[6] for r in got}) == 1


def test_flat_equal_and_empty(spark):
    rows = [(i, [0.1 * (i % 3), 0.2, 0.3], "", "", 1) for i in range(9)]
    got = run(spark, rows)
    assert {r["component"] for r in got} == {1, 2, 3}
    assert all((r["whitened"] is None) == (r["component"] > 1) for r in got)
    same = run(spark, [(i, [0.5, 0.5], "", "", 1) for i in range(4)])
    assert len(same) == 8 and all(r["whitened"] is r["explained"] is r["identity_error"] is None
                                  and r["deviation"] == 0 for r in same)
    assert run(spark, []) == []
    assert run(spark, [(1, None, "", "", 1), (2, [], "", "", 1)]) == []


def test_huge_values_are_exact(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-3e9, 3e9), 1e30 if i == 7 else rng.random()], "", "", 1) for i in range(40)]
    got = {r["vec_id"]: r["deviation"] for r in run(spark, rows)}
    x = [[math.floor(max(-2.0 ** 62, min(2.0 ** 62, 1024 * float(np.float32(c))))) + 100000 for c in r[1]]
         for r in rows]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    for i, v in enumerate(x):
        want = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        assert (int(got[i]) if got[i] is not None else None) == (want if want < 10 ** 38 else None)


def test_query(spark, sf_dir):
    found = queries.op11_whitening(spark, sf_dir)
    assert dict(found.dtypes)["deviation"] == "bigint"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").count()
    got = found.agg(F.count("*").alias("n"), F.max("identity_error").alias("e")).first()
    assert got["n"] == rows * 8 and got["e"] < 1e-6
