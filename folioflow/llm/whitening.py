"""Whitening of embeddings by shifted CholeskyQR.

The centred rows X of the fit list (n rows, d columns, n much larger than d) are never gathered. A pass over them sums
the Gram matrix of Q = X R1^-1 ... Rk^-1, where each task solves the triangular systems for its own rows; the Cholesky
factor of the sum is the next R. The first Gram matrix gets a shift on its diagonal, since its condition is the square
of that of X and it need not be positive definite in double precision; so do later ones that are singular still. The
passes end when Q is orthonormal, usually with the third: the product R of all factors is then that of the QR
decomposition of X, as exact as by Householder reflections, and the singular value decomposition of the small R gives
the components and their variances without a covariance matrix ever being formed.

What reaches the driver is d sums and d x d matrices, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioflow.llm.arrow import append_columns, written

#: Entries are taken in steps of a 256th.
STEPS = 256
#: Columns that a triangular solve does at once; passes after which it gives up.
BLOCK, PASSES = 32, 12
_UNIT = 2.0**-53
_ROUND = 1 << 62  # sums of products under it are exact in 64 bits


@dataclass(frozen=True)
class Whitening:
    """n distinct vectors and their sums a dimension; components (d x k), their variances, that of all, and what whitening is off by."""

    n: int
    sums: list[int]
    components: np.ndarray
    variances: np.ndarray
    trace: float
    identity_error: float
    passes: int


def usable(vector: Column) -> Column:
    """Whether a vector is not null and every entry is a finite number."""
    return F.coalesce(F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))), F.lit(False))


def stepped(vector: Column) -> Column:
    """The entries as whole numbers of steps, rounded down."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long"))


def _rows(x: pa.Array, d: int) -> np.ndarray:
    flat = x.flatten().to_numpy(zero_copy_only=False)
    if len(flat) != len(x) * d or (len(x) and np.ptp(np.asarray(x.value_lengths()))):
        raise ValueError(f"vectors of another length than {d}")
    return flat.reshape(len(x), d)


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly; Python's numbers where 64 bits don't suffice."""
    top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if n * top + max(map(abs, sums), default=0) < _ROUND:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return _scaled(x, n, sums).astype(np.float64) / n


def _solved(y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """y r^-1 for an upper triangular r, by substitution, a block of columns at once."""
    y = y.copy()
    d = len(r)
    for a in range(0, d, BLOCK):
        b = min(a + BLOCK, d)
        y[:, a:b] -= y[:, :a] @ r[:a, a:b]
        for j in range(a, b):
            y[:, j] = (y[:, j] - y[:, a:j] @ r[a:j, j]) / r[j, j]
    return y


def _summed(fit: DataFrame, d: int, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of q^T q over all rows q = of(x): a task adds its rows' up and gives a matrix, and Spark adds these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                q = of(_rows(b.column(0), d))
                total = q.T @ q if total is None else total + q.T @ q
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total))], names=["i", "entries"])

    parts = fit.select("x").mapInArrow(run, "i int, entries array<double>")
    entries = parts.select("i", F.posexplode("entries").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    size = 1 + max(r["i"] for r in entries)
    out = np.zeros((size, size))
    for r in entries:
        out[r["i"], r["j"]] = r["v"]
    return (out + out.T) / 2


def _moments(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and their exact sums a dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            if b.num_rows:
                x = _rows(b.column(0), len(b.column(0)[0]))
                top = max(int(x.max(initial=0)), -int(x.min(initial=0)))
                own = (x if top * len(x) < _ROUND else x.astype(object)).sum(0).tolist()
                if sums is not None and len(own) != len(sums):
                    raise ValueError("vectors of different lengths")
                sums = own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([n] * len(sums)), pa.array([Decimal(s) for s in sums], pa.decimal128(38, 0))], names=["i", "n", "s"])

    found = fit.select("x").mapInArrow(run, "i int, n long, s decimal(38,0)").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("i").collect()
    if len({r["n"] for r in found}) > 1:
        raise ValueError("vectors of different lengths")
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found]


def orthogonalised(gram: Callable[[list[np.ndarray]], np.ndarray], n: int, d: int) -> tuple[np.ndarray, int]:
    """R of the QR decomposition and the number of passes; gram(factors) sums q^T q for the rows behind these triangular solves.

    Where columns depend on others, their singular values in R come out as nothing beside the largest.
    """
    factors: list[np.ndarray] = []
    whole = np.eye(d)
    for k in range(1, PASSES + 1):
        g = gram(factors)
        spread = np.linalg.eigvalsh(g)
        shift = min(0.1, 11 * (n * d + d * (d + 1)) * _UNIT) * max(spread[-1], np.finfo(float).tiny)
        while True:
            try:
                r = np.linalg.cholesky(g + shift * np.eye(d) if k == 1 or spread[0] < 10 * shift else g).T
                break
            except np.linalg.LinAlgError:
                shift *= 10
        factors.append(r)
        whole = r @ whole
        sizes = np.linalg.svd(whole, compute_uv=False)
        if (np.abs(spread - 1) < 1e-12 * d).sum() >= (sizes > _least(d) * sizes[0]).sum():
            break
    return whole, k


def _least(d: int) -> float:
    """A singular value of under so much of the largest is one of rounding."""
    return 64 * d * _UNIT


def fit(df: DataFrame, vector: Column, most: int = 4) -> Whitening:
    """The first components of the vectors' covariance, each distinct vector of whole steps counted once.

    Rows whose vector is null or has an entry that is null or not finite are left out. There are fewer than most
    components where the vectors span fewer dimensions, and none for fewer than two distinct vectors or an empty table.
    Vectors of different lengths are an error. Each distinct vector is written once; then a pass sums the moments, about
    three the Gram matrices, and one what the whitened list's covariance is off the identity by.
    """
    rows = written(df.filter(usable(vector)).select(stepped(vector).alias("x")).distinct(), "fit-list")
    n, sums = _moments(rows)
    d = len(sums)
    none = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0.0, 0)
    if n < 2 or not d:
        return none

    def gram(factors: list[np.ndarray]) -> np.ndarray:
        def q(x: np.ndarray) -> np.ndarray:
            y = _centred(x, n, sums)
            for r in factors:
                y = _solved(y, r)
            return y

        return _summed(rows, d, q)

    r, passes = orthogonalised(gram, n, d)
    _, sizes, across = np.linalg.svd(r)
    k = min(most, int((sizes > _least(d) * sizes[0]).sum()))
    parts = across[:k].T
    parts = parts * np.sign(parts[np.abs(parts).argmax(0), np.arange(k)])  # the largest entry is positive
    variances = sizes**2 / n
    made = Whitening(n, sums, parts, variances[:k], float(variances.sum()), 0.0, passes)
    if not k:
        return none
    off = _summed(rows, d, lambda x: whitened(x, made)) / n - np.eye(k)
    return Whitening(n, sums, parts, variances[:k], made.trace, float(np.abs(off).max()), passes)


def whitened(x: np.ndarray, model: Whitening) -> np.ndarray:
    return _centred(x, model.n, model.sums) @ model.components / np.sqrt(model.variances)


def apply(df: DataFrame, vector: Column, model: Whitening) -> DataFrame:
    """df's usable rows with whitened (array<double>, a component each) and deviation (decimal: the sum over dimensions of (n*x-S)^2, exact).

    One narrow pass. Other rows go, as in fit; columns of these names are replaced.
    """
    fields = T.StructType([T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.DecimalType(38, 0))])

    def make():
        d = len(model.sums)

        def work(x: pa.Array):
            far = _scaled(rows := _rows(x, d), model.n, model.sums)
            top = max(int(far.max(initial=0)), -int(far.min(initial=0)))
            if top * top * d >= _ROUND:
                far = far.astype(object)
            return list(whitened(rows, model)), pa.array([Decimal(int(s)) for s in (far * far).sum(1)], pa.decimal128(38, 0))

        return work

    return append_columns(df.filter(usable(vector)), make, fields, {"x": stepped(vector)})
