"""Embedding whitening: a distributed centred covariance, its leading eigenpairs by Householder, Sturm counts and inverse iteration, and a projection.

Only the sums and the covariance of the dimensions (d and d * d numbers) reach the driver; vectors never do.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Entries of at least this size have no quantised value that a long could hold with room for sums.
HUGE = float(1 << 50)
#: Eigenvalues up to this part of the largest one are rounding errors of it.
NOTHING = 1e-10
EPS = float(np.finfo(np.float64).eps)


def quantised(embeddings: DataFrame, vector_col: str, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """``embeddings`` with ``x``, the array of floor(scale * c) + offset as longs. Rows whose vector is null or empty, or has a null, non-finite or huge (2^50 or more) entry go."""
    x = F.transform(vector_col, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long") + F.lit(offset).cast("long"))
    fine = F.forall(vector_col, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < HUGE)) & (F.size(vector_col) > 0)
    return embeddings.where(F.coalesce(fine, F.lit(False))).withColumn("x", x)


def fit_list(rows: DataFrame) -> DataFrame:
    """Each distinct ``x`` once, written; of vectors of several lengths those of the commonest (of equally common ones the longest)."""
    every = cut(rows.select("x").distinct())
    lengths = every.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d"))
    first = lengths.first()
    return every.where(F.size("x") == (first["d"] if first else 0))


def column_sums(fit: DataFrame) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums = 0, None
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                own = [int(x[:, j].sum(dtype=np.int64)) if _fits(x) else sum(map(int, x[:, j])) for j in range(x.shape[1])]
                n, sums = n + len(x), own if sums is None else [a + b for a, b in zip(sums, own, strict=True)]
        if n:
            yield pd.DataFrame({"j": range(len(sums)), "n": n, "s": [str(s) for s in sums]})

    parts = fit.mapInPandas(run, "j int, n long, s string")
    found = parts.groupBy("j").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).orderBy("j").collect()
    return (found[0]["n"] if found else 0), [int(r["s"]) for r in found]


def _fits(x: np.ndarray) -> bool:
    """Whether the sum of the rows stays within a long."""
    return int(np.abs(x).max()) * len(x) < 1 << 62


@dataclass(frozen=True)
class Centre:
    """The mean S / n as a whole number and a remainder of at most a half, so that x - S / n loses no digits."""

    whole: np.ndarray
    rest: np.ndarray

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        whole = [(2 * s + n) // (2 * n) for s in sums]
        return cls(np.array(whole, dtype=np.int64), np.array([(s - n * w) / n for s, w in zip(sums, whole, strict=True)]))

    def apart(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.rest


def covariance(fit: DataFrame, n: int, form: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The mean product of every two columns of ``form(x)`` (centred rows) over the fit list. A task adds up its products and gives one row per pair of columns; Spark adds those."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch):
                y = form(np.stack(batch["x"].to_numpy()))
                total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            i, j = np.triu_indices(len(total))
            yield pd.DataFrame({"i": i, "j": j, "v": total[i, j]})

    found = fit.mapInPandas(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    d = int(found["j"].max()) + 1 if len(found) else 0
    out = np.zeros((d, d))
    out[found["i"], found["j"]] = out[found["j"], found["i"]] = found["v"] / n
    return out


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Householder's reduction: the diagonal and its neighbour of Q' a Q, and the unit vectors v_0, v_1, ... with Q = (1 - 2 v_0 v_0') (1 - 2 v_1 v_1') ..."""
    a, d, mirrors = a.copy(), len(a), []
    for k in range(d - 2):
        v = np.zeros(d)
        v[k + 1 :] = a[k + 1 :, k]
        v[k + 1] += np.copysign(np.sqrt(v @ v), v[k + 1])
        size = np.sqrt(v @ v)
        if size:
            v /= size
            p = a @ v
            w = p - (v @ p) * v
            a -= 2 * (np.outer(v, w) + np.outer(w, v))
        mirrors.append(v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), mirrors


def count_below(diagonal: np.ndarray, beside: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many eigenvalues of a tridiagonal matrix lie below each of ``at``: the negative pivots of its factorisation (Sturm's count)."""
    least = np.finfo(np.float64).tiny * max(1.0, (beside**2).max(initial=0.0))
    count, pivot = np.zeros(len(at), dtype=int), np.ones(len(at))
    for k, here in enumerate(diagonal):
        pivot = here - at - (beside[k - 1] ** 2 / pivot if k else 0.0)
        pivot = np.where(np.abs(pivot) < least, -least, pivot)
        count += pivot < 0
    return count


def leading_eigenvalues(diagonal: np.ndarray, beside: np.ndarray, most: int) -> np.ndarray:
    """The ``most`` largest eigenvalues, falling, each halved down from Gershgorin's bounds to the last digit."""
    d = len(diagonal)
    reach = np.abs(np.r_[0, beside]) + np.abs(np.r_[beside, 0])
    wanted = np.arange(d - 1, d - 1 - min(most, d), -1)  # the k-th from below has k below it
    low, high = np.full(len(wanted), (diagonal - reach).min()), np.full(len(wanted), (diagonal + reach).max())
    slack = 4 * EPS * max(abs(low).max(initial=0.0), abs(high).max(initial=0.0))
    low, high = low - slack, high + slack
    for _ in range(120):
        middle = (low + high) / 2
        under = count_below(diagonal, beside, middle) <= wanted
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def _solve(diagonal: np.ndarray, beside: np.ndarray, shift: float, b: np.ndarray) -> np.ndarray:
    """(T - shift) x = b by elimination with row exchanges; a pivot of nothing is taken as a very small one."""
    d = len(diagonal)
    tiny = EPS * max(np.abs(diagonal).max() + 2 * np.abs(beside).max(initial=0.0), np.finfo(np.float64).tiny)
    main, up, upper, b = diagonal - shift, np.r_[beside, 0.0], np.zeros(d), b.copy()
    for k in range(d - 1):
        low = beside[k]
        if abs(main[k]) >= abs(low):
            f = low / (main[k] if main[k] else tiny)
            main[k + 1], b[k + 1] = main[k + 1] - f * up[k], b[k + 1] - f * b[k]
        else:  # the row below comes up
            f = main[k] / low
            main[k], up[k], upper[k], main[k + 1], up[k + 1] = low, main[k + 1], up[k + 1], up[k] - f * main[k + 1], -f * up[k + 1]
            b[k], b[k + 1] = b[k + 1], b[k] - f * b[k + 1]
    x = np.zeros(d)
    for k in range(d - 1, -1, -1):
        rest = b[k] - (up[k] * x[k + 1] if k + 1 < d else 0.0) - (upper[k] * x[k + 2] if k + 2 < d else 0.0)
        x[k] = rest / (main[k] if abs(main[k]) > tiny else np.copysign(tiny, main[k]))
    return x


def inverse_iteration(diagonal: np.ndarray, beside: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Unit eigenvectors as rows. A vector is kept at right angles to those before it whose eigenvalues are close (one thousandth of the largest): its cluster."""
    rng, size = np.random.default_rng(0), max(np.abs(values).max(initial=0.0), np.finfo(np.float64).tiny)
    found: list[np.ndarray] = []
    for k, value in enumerate(values):
        first = k
        while first and values[first - 1] - values[first] < 1e-3 * size:
            first -= 1
        shift = value - (k - first) * 4 * EPS * size  # equal eigenvalues are told apart
        x = rng.standard_normal(len(diagonal))
        for _ in range(4):
            x = _solve(diagonal, beside, shift, x / np.sqrt(x @ x))
            for _ in range(2):
                for y in found[first:k]:
                    x = x - (x @ y) * y
        found.append(x / np.sqrt(x @ x))
    return np.array(found).reshape(len(values), len(diagonal))


def eigenpairs(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The leading eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as rows, whose largest entry is positive. Eigenvalues that are rounding errors go."""
    if not len(a) or not np.abs(a).max():
        return np.zeros(0), np.zeros((0, len(a)))
    diagonal, beside, mirrors = tridiagonal(a)
    values = leading_eigenvalues(diagonal, beside, most)
    values = values[values > NOTHING * values[0]]
    vectors = inverse_iteration(diagonal, beside, values)
    for v in reversed(mirrors):
        vectors = vectors - 2 * np.outer(vectors @ v, v)
    top = np.abs(vectors).argmax(axis=1)
    return values, vectors * np.sign(vectors[np.arange(len(values)), top])[:, None]


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: number and sums of the fit list, eigenvalues, components (rows) and trace of its covariance, and how far the whitened fit list is from identity covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    trace: float
    identity_error: float

    def project(self) -> Callable[[np.ndarray], np.ndarray]:
        centre, onto = Centre.of(self.n, self.sums), self.components.T / np.sqrt(self.values)
        return lambda x: centre.apart(x) @ onto


def fit_whitening(fit: DataFrame, components: int = 16) -> Whitening:
    """Fit on all rows of ``fit`` (x). Three passes: sums, centred covariance, covariance of the whitened rows. An empty table, or one whose vectors are all equal, has no components."""
    n, sums = column_sums(fit)
    if not n:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0.0)
    centre = Centre.of(n, sums)
    v = covariance(fit, n, centre.apart)
    values, vectors = eigenpairs(v, components)
    out = Whitening(n, sums, values, vectors, float(np.trace(v)), 0.0)
    if not len(values):
        return out
    error = float(np.abs(covariance(fit, n, out.project()) - np.eye(len(values))).max())
    return Whitening(n, sums, values, vectors, out.trace, error)


def _deviations(x: np.ndarray, n: int, sums: list[int], centre: Centre) -> list[int | None]:
    """The sum of (n * x - S)^2 of each row, exact; None beyond a long."""
    left = np.array([s - n * int(w) for s, w in zip(sums, centre.whole, strict=True)], dtype=object)
    far = x - centre.whole
    bound = n * int(np.abs(far).max(initial=0)) + n
    if bound * bound * x.shape[1] < 1 << 63:
        y = n * far - left.astype(np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = [sum((n * int(a) - b) ** 2 for a, b in zip(row, left, strict=True)) for row in far]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, model: Whitening, id_col: str) -> DataFrame:
    """(id, deviation, whitened array<double>) of each row of ``rows`` (id, x) whose ``x`` has the model's length; the model, d * components numbers, is broadcast."""
    d, shared = len(model.sums), rows.sparkSession.sparkContext.broadcast((model.n, model.sums, model.values, model.components))
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, values, vectors = shared.value
        centre, onto = Centre.of(n, sums), vectors.T / np.sqrt(values)
        for batch in batches:
            if len(batch):
                x = np.stack(batch["x"].to_numpy())
                yield pd.DataFrame({"id": batch["id"], "deviation": pd.array(_deviations(x, n, sums, centre), dtype="Int64"), "whitened": list(centre.apart(x) @ onto)})

    fitting = rows.where((F.size("x") == d) & F.lit(len(model.values) > 0)).select(F.col(id_col).alias("id"), "x")
    return fitting.mapInPandas(run, f"id {kind}, deviation long, whitened array<double>").withColumnRenamed("id", id_col)


def whitened_embeddings(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 16, scale: int = 64, offset: int = 1_000_000) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error): a row per vector and component, components numbered from 1 by falling eigenvalue.

    The fit list holds each distinct quantised vector once, so repeated rows (however many) weigh as one, and each of them is whitened.
    Dropped are rows whose vector is null, empty, or holds a null, non-finite or huge (2^50 or more) entry, and rows of another length than
    the commonest (of equally common lengths the longest). Null and repeated ids stay as they are; other columns are ignored. There are as many components as
    the covariance has eigenvalues above rounding, so none for an empty table or when all vectors are equal, and then no rows. Equal
    eigenvalues have components at right angles, of which any rotation would do. ``deviation`` is null beyond a long.
    """
    rows = quantised(embeddings.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")), "vector", scale, offset).select(F.col("id").alias(id_col), "x")
    model = fit_whitening(fit_list(rows), components)
    each = whiten(rows, model, id_col).select(id_col, "deviation", F.posexplode("whitened").alias("k", "whitened"))
    shares = F.array(*(F.lit(float(e / model.trace)) for e in model.values)) if len(model.values) else F.array().cast("array<double>")
    return each.select(id_col, (F.col("k") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("k")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
