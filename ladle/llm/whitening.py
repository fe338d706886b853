"""Whitening of embeddings by the eigenvectors of their covariance.

Sums and centred products are gathered over all vectors as one small table. The eigenvectors start in
float32 and are corrected by matrix multiplications in higher precision (Ogita and Aishima, 2018);
eigenvalues too close to be told apart by a step are separated by a small problem of their own (2019).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.llm.storage import bound_batches, discard, materialize

#: Entries become floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
#: Larger integers than that count as it, so that n * x stays a long for two billion vectors.
LIMIT = 1 << 31
#: Dimensions at most: the driver holds a few square matrices of that size.
MAX_DIMENSIONS = 4_096
#: Corrections in each precision at most; each doubles the digits that are right.
STEPS = 6
#: Rows multiplied at a time.
ROWS = 4_096


def integers(column: pa.Array, dimensions: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows that count, their first entry, their length, all entries as integers) of a list column.

    A row counts if it is not null and has finite entries only, and dimensions of them if that is given."""
    column = column.cast(pa.list_(pa.float64()))
    at = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    length = np.diff(at)
    good = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & ((length > 0) if dimensions is None else (length == dimensions)))
    x = np.floor(SCALE * np.where(np.isfinite(values), values, 0.0)) + SHIFT
    return good, at[good], length[good], np.clip(x, -LIMIT, LIMIT).astype(np.int64)


def _matrices(batches, dimensions: int):
    """(ids, integer vectors as rows of a matrix), a few thousand at a time."""
    for batch in batches:
        good, at, _, x = integers(batch.column(1), dimensions)
        for k in range(0, len(good), ROWS):
            yield batch.column(0).take(pa.array(good[k : k + ROWS])), x[at[k : k + ROWS, None] + np.arange(dimensions)]


def _totals(batches):
    """Number of vectors and sums of entries by length, of a partition."""
    found: dict[int, list] = {}
    for batch in batches:
        _, at, length, x = integers(batch.column(0))
        for d in np.unique(length).tolist():
            own = found.setdefault(d, [0, np.zeros(d, np.int64)])
            first = at[length == d]
            for k in range(0, len(first), ROWS):
                own[0] += len(first[k : k + ROWS])
                own[1] += x[first[k : k + ROWS, None] + np.arange(d)].sum(axis=0)
    for d, (n, sums) in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(sums)], ["length", "place", "n", "total"])


def _products(dimensions: int, width: int, row: Callable[[np.ndarray], np.ndarray]):
    """Sums of y and of its products with itself over a partition, where y = row(vectors) has width columns."""

    def run(batches):
        sums, products, any_row = np.zeros(width), np.zeros((width, width)), False
        for _, x in _matrices(batches, dimensions):
            y = row(x)
            sums += y.sum(axis=0)
            products += y.T @ y
            any_row = True
        if any_row:
            up = np.triu_indices(width)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + len(up[0]))), pa.array(np.concatenate([sums, products[up]]))], ["place", "total"])

    return run


def _covariance(given: DataFrame, dimensions: int, width: int, row, n: int) -> np.ndarray:
    """Covariance of row(vectors), divisor n. The rows are near their mean already; what is left of it is taken off exactly."""
    partial = given.mapInArrow(_products(dimensions, width, row), "place long, total double")
    found = partial.groupBy("place").agg(F.sum("total").alias("total")).toPandas().sort_values("place")["total"].to_numpy()
    sums = found[:width].astype(np.longdouble)
    products = np.zeros((width, width), np.longdouble)
    products[np.triu_indices(width)] = found[width:]
    products = products + np.triu(products, 1).T
    return (products - np.outer(sums, sums) / n) / n


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One step: (vectors, their eigenvalues, the size of the correction, the gap below which eigenvalues are alike)."""
    r = np.eye(len(a), dtype=a.dtype) - x.T @ x
    s = x.T @ (a @ x)
    # rounding that isn't symmetric would be divided by small gaps and spoil the right angles
    s, r = (s + s.T) / 2, (r + r.T) / 2
    value = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(np.diag(s))
    alike = 2 * (np.sqrt((off * off).sum()) + np.abs(value).max() * np.sqrt((r * r).sum()))
    gap = value[None, :] - value[:, None]
    apart = np.abs(gap) > alike
    e = np.where(apart, (s + value[None, :] * r) / np.where(apart, gap, 1), r / 2)
    return x + x @ e, value, float(np.abs(e).max()), float(alike)


def _separated(a: np.ndarray, x: np.ndarray, value: np.ndarray, alike: float) -> np.ndarray:
    """Each run of eigenvalues that are alike is turned onto the eigenvectors of its own small matrix, taken about the run's mean."""
    order = np.argsort(value)
    runs = np.split(order, np.flatnonzero(np.diff(value[order]) > alike) + 1)
    for run in (r for r in runs if len(r) > 1):
        own = x[:, run]
        small = own.T @ (a @ own - value[run].mean() * own)
        small = (small + small.T) / 2
        if size := np.abs(small).max():
            _, turn = np.linalg.eigh((small / size).astype(np.float64))
            x[:, run] = own @ turn.astype(x.dtype)
    return x


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues from the largest on, unit eigenvectors as columns) of a symmetric matrix.

    float32 vectors, corrected in float64 and then in the platform's extended precision, until a step changes
    nothing more. Vectors of equal eigenvalues are any basis of their space."""
    size = np.abs(v).max() or 1
    a = np.asarray(v, np.longdouble) / size
    x = np.linalg.eigh(a.astype(np.float32))[1]
    for kind in (np.float64, np.longdouble):
        own, x = a.astype(kind), x.astype(kind)
        for _ in range(STEPS):
            x, value, change, alike = _corrected(own, x)
            x = _separated(own, x, value, alike)
            if change <= 64 * np.finfo(kind).eps:
                break
    x = x / np.sqrt((x * x).sum(axis=0))
    value = (x * (a @ x)).sum(axis=0)
    order = np.argsort(-value, kind="stable")
    return (value[order] * size).astype(np.float64), x[:, order].astype(np.float64)


def squares(d: np.ndarray) -> list[int]:
    """Exact sum of squares of each row of 63-bit integers, from three limbs of 21 bits."""
    d = np.abs(d)
    low, mid, high = d & 0x1FFFFF, (d >> 21) & 0x1FFFFF, d >> 42
    terms = [(high * high).sum(1), 2 * (high * mid).sum(1), (2 * high * low + mid * mid).sum(1), 2 * (mid * low).sum(1), (low * low).sum(1)]
    total = terms[0].astype(object)
    for t in terms[1:]:
        total = total * (1 << 21) + t.astype(object)
    return total.tolist()


def _whitened(n: int, sums: list[int], turn: np.ndarray):
    def run(batches):
        import decimal

        total = np.array(sums, np.int64)
        for ids, x in _matrices(batches, len(sums)):
            far = n * x - total
            deviation = pa.array([decimal.Decimal(s) for s in squares(far)], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([ids, deviation, pa.array(list((far / n) @ turn), pa.list_(pa.float64()))], ["id", "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8) -> DataFrame:
    """The whitened coordinates of each vector: (id_col, n, deviation, whitened, explained, identity_error).

    A row whose vector is null, empty or holds a null or non-finite entry is left out, as is one whose length is not
    that of most vectors (the longer in a tie). Other rows give a row each, repeated rows and null ids too. Entries become
    integers x = floor(1024 * c) + 100000, of 2 ** 31 at most in size; n is the number of these vectors and S their sums, deviation
    the sum of (n * x - S) ** 2 (decimal, exact). whitened[k - 1] is x - S / n on the k-th unit eigenvector of the covariance over the
    root of its eigenvalue, explained[k - 1] the eigenvalue's share of the trace, identity_error the largest entry of whitened's
    covariance minus the identity. There are components of these, or as many as dimensions. A component without variance
    (under 2 ** -48 of the trace for each dimension) has null whitened and isn't in identity_error. No vectors give no rows.
    """
    spark = rows.sparkSession
    bound_batches(spark)
    given = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
    kind = dict(given.dtypes)["id"]
    counted = given.select("vector").mapInArrow(_totals, "length long, place long, n long, total long").groupBy("length", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    counted = materialize(counted, "vector_totals")
    most = counted.where("place = 0").orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        discard(counted)
        return spark.createDataFrame([], f"{id_col} {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double")
    n, d = most["n"], most["length"]
    if d > MAX_DIMENSIONS:
        raise ValueError(f"vectors have {d} dimensions, of {MAX_DIMENSIONS} at most")
    sums = [int(r["total"]) for r in counted.where(F.col("length") == d).orderBy("place").collect()]
    discard(counted)
    middle = np.array([round(s / n) for s in sums], np.int64)
    v = _covariance(given, d, d, lambda x: (x - middle).astype(np.float64), n)
    value, vector = eigen(v)
    k, trace = min(components, d), float(np.trace(v))
    varied = [bool(e > trace * d * 2.0**-48) for e in value[:k]]
    turn = np.column_stack([vector[:, i] / np.sqrt(value[i]) if varied[i] else np.zeros(d) for i in range(k)])
    total = np.array(sums, np.int64)
    of_whitened = _covariance(given, d, k, lambda x: ((n * x - total) / n) @ turn, n)
    error = float(max((abs(of_whitened[i, j] - (i == j)) for i in range(k) for j in range(k) if varied[i] and varied[j]), default=0.0))
    explained = [float(value[i] / trace) if varied[i] else 0.0 for i in range(k)]
    out = given.mapInArrow(_whitened(n, sums, turn), f"id {kind}, deviation decimal(38,0), whitened array<double>")
    whitened = F.col("whitened") if all(varied) else F.transform("whitened", lambda w, i: F.when(F.element_at(F.lit(varied), i + 1), w))
    return out.select(F.col("id").alias(id_col), F.lit(n).cast("long").alias("n"), "deviation", whitened.alias("whitened"), F.lit(explained).alias("explained"), F.lit(error).alias("identity_error"))
