"""Whitening against exact moments and numpy's decomposition of the covariance."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import whitening
from folioflow.llm.queries import QUERIES


def plain(vectors):
    """Distinct x-vectors, their sums, components, variances and trace by the covariance itself."""
    ok = [v for v in vectors if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    xs = [tuple(math.floor(256 * float(c)) for c in v) for v in ok]
    fit = sorted(set(xs))
    n, d = len(fit), len(fit[0])
    sums = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - sums[j], n)) for j in range(d)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return xs, fit, sums, e[::-1], v[:, ::-1]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>").repartition(5)


def test_query_equals_the_covariance(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    xs, fit, sums, e, v = plain([r.embedding for r in rows])
    n = len(fit)
    got = {(r.vec_id, r.component): r for r in QUERIES["op11_whitening"](spark, sf).collect()}
    kept = [r for r in rows if r.embedding is not None and all(c is not None and math.isfinite(c) for c in r.embedding)]
    assert len(got) == 4 * len(kept)
    far = np.array([[n * x[j] - sums[j] for j in range(len(sums))] for x in xs])
    want = far / n @ v[:, :4] / np.sqrt(e[:4])
    signs = np.sign([sum(got[kept[i].vec_id, k + 1].whitened * want[i, k] for i in range(200)) for k in range(4)])
    for i, r in enumerate(kept):
        for k in range(4):
            g = got[r.vec_id, k + 1]
            assert g.n == n and g.deviation == int((far[i].astype(object) ** 2).sum())
            assert abs(g.whitened - signs[k] * want[i, k]) < 1e-9
            assert abs(g.explained / (e[k] / e.sum()) - 1) < 1e-12 and g.identity_error < 1e-12


def test_ill_conditioned_columns_are_as_exact_as_by_qr():
    rnd = np.random.default_rng(3)
    n, d = 4000, 24
    x = rnd.normal(size=(n, d)) @ np.diag(10.0 ** -np.linspace(0, 12, d)) @ np.linalg.qr(rnd.normal(size=(d, d)))[0]
    x -= x.mean(0)

    def gram(factors):
        y = x
        for r in factors:
            y = whitening._solved(y, r)
        return y.T @ y

    r, passes = whitening.orthogonalised(gram, n, d)
    got, want = np.linalg.svd(r, compute_uv=False), np.linalg.svd(x, compute_uv=False)
    assert passes <= 5
    assert np.abs(got - want).max() < 1e-14 * want[0] * d  # the covariance itself would lose all under 1e-8 of the largest


def test_few_dimensions_and_repeated_rows(spark):
    rnd = np.random.default_rng(1)
    flat = rnd.normal(size=(300, 2)) @ rnd.normal(size=(2, 6))
    flat = np.round(flat * 8) / 8
    flat[:, 5] = 0.25  # one constant dimension
    flat[:, 4] = flat[:, 0]  # and one that repeats another
    vectors = [*flat.tolist(), *[flat[0].tolist()] * 400, None, [None] * 6, [math.nan] + [0.0] * 5, [math.inf] + [0.0] * 5]
    xs, fit, _, e, _ = plain(vectors)
    model = whitening.fit(frame(spark, vectors), F.col("embedding"), 6)
    rank = int((e > 1e-9 * e[0]).sum())
    assert model.n == len(fit) and model.components.shape == (6, rank)
    assert np.allclose(model.variances, e[:rank], rtol=1e-10) and model.identity_error < 1e-10
    out = whitening.apply(frame(spark, vectors), F.col("embedding"), model)
    assert out.count() == 700


def test_odd_tables(spark):
    empty = frame(spark, [])
    model = whitening.fit(empty, F.col("embedding"))
    assert model.n == 0 and whitening.apply(empty, F.col("embedding"), model).count() == 0
    one = frame(spark, [[1.0, 2.0]] * 5 + [None])
    model = whitening.fit(one, F.col("embedding"))
    assert model.n == 1 and [r.whitened for r in whitening.apply(one, F.col("embedding"), model).collect()] == [[]] * 5
    clash = frame(spark, [[0.0, 1.0], [1.0, 0.5], [2.0, 0.5], [-3.0, 4.0]]).withColumn("whitened", F.lit("x")).withColumn("deviation", F.lit(None).cast("int"))
    model = whitening.fit(clash, F.col("embedding"))
    rows = whitening.apply(clash, F.col("embedding"), model)
    assert rows.columns == ["vec_id", "embedding", "whitened", "deviation"] and all(len(r.whitened) == 2 for r in rows.collect())
    with pytest.raises(Exception, match="length"):
        whitening.fit(frame(spark, [[1.0], [1.0, 2.0]]), F.col("embedding"))


def test_numbers_beyond_64_bits_stay_exact(spark):
    vectors = [[float(2**40 + i * 2**32), float(-i)] for i in range(50)]
    xs, fit, sums, _, _ = plain(vectors)
    model = whitening.fit(frame(spark, vectors), F.col("embedding"))
    assert model.sums == sums
    got = {r.vec_id: int(r.deviation) for r in whitening.apply(frame(spark, vectors), F.col("embedding"), model).collect()}
    assert got == {i: sum((len(fit) * x[j] - sums[j]) ** 2 for j in range(2)) for i, x in enumerate(xs)}
