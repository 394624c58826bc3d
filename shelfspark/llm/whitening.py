"""Operator 12: embedding whitening by Golub-Kahan-Lanczos bidiagonalisation.

A vector that is null, empty, or holds null, non-finite or unrepresentable entries (of 2**43 or more) is left
out, and so is one whose length is not the most frequent one (of equal counts the longer). Each entry c
becomes the long ``floor(1024 * c) + 100000``; the fit list is all remaining rows, repeated ones each time.
A null id stays null.

One distributed pass a step: every task centres its rows (``(n * x - S) / n``, from exact integers), multiplies
them by the newest right vector, ``w = X v - beta * u``, and returns the sums of ``X' w``, of ``U' w`` for the
full reorthogonalisation, and of ``w' w``. The left vectors, one entry a row, are never stored: ``u_j`` is
``X V t_j`` with a small triangle of coefficients, so a lost executor costs its rows again and nothing else.
The driver holds vectors of the length of one row only. A step that finds nothing new (an invariant
subspace, repeated eigenvalues) goes on from a fresh vector. It ends after as many steps as there are
dimensions, or once the wanted values have converged and what is left of the trace is below the least.
"""

from __future__ import annotations

import decimal
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.llm.common import query, stage

COMPONENTS = 8
SCALE, SHIFT = 1024, 100_000
#: Larger entries have no exact integer form in a double after scaling.
LARGEST = float(1 << 43)
#: Partial sums of all tasks are added up by so many tasks, whose sums the driver reads.
ADDERS = 8
EXACT = 1 << 62
DIGITS = 38


@dataclass
class Whitening:
    """What was learned: one row of ``components`` a component, by falling eigenvalue."""

    n: int
    sums: np.ndarray  # per dimension, exact
    components: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def dims(self) -> int:
        return len(self.sums)

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values


def scaled(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """``vec_id`` and ``x`` (array of long) of the rows that are kept, written once."""
    sound = F.forall(F.col("v"), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    rows = (table.select(table[id_col].alias("vec_id"), table[vec_col].cast("array<double>").alias("v"))
            .filter(F.col("v").isNotNull() & (F.size("v") > 0) & sound)
            .select("vec_id", F.transform("v", lambda c: F.floor(c * SCALE) + SHIFT).alias("x")))
    rows = stage(rows, "scaled")
    common = (rows.groupBy(F.size("x").alias("dims")).count()
              .orderBy(F.desc("count"), F.desc("dims")).first())
    return rows if common is None else rows.filter(F.size("x") == common["dims"])


def matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def added(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], dims: int, kind: str) -> np.ndarray:
    """The sum of the vectors that ``part`` makes of blocks of rows: per task, by ``ADDERS``, in the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [part(matrix(batch, dims)) for batch in batches if batch.num_rows]
        if sums:
            yield pa.RecordBatch.from_pydict({"v": [sum(sums[1:], sums[0])]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for v in batch.column("v"):
                v = v.values.to_numpy(zero_copy_only=False)
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total]})
    shape = f"v array<{kind}>"
    found = rows.select("x").mapInArrow(run, shape).repartition(ADDERS).mapInArrow(add, shape).collect()
    return sum(np.array(r["v"], np.int64 if kind == "long" else float) for r in found)


def centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    if n * int(np.abs(x).max(initial=1)) < EXACT:
        return (n * x - sums) / n
    return x - np.array([int(s) / n for s in sums])


def _fresh(v: np.ndarray, seed: int) -> np.ndarray:
    """A unit vector orthogonal to the columns of ``v``."""
    new = np.random.default_rng(seed).standard_normal(v.shape[0])
    for _ in range(3):
        new -= v @ (v.T @ new)
        new /= np.linalg.norm(new)
    return new


def fit(rows: DataFrame, components: int = COMPONENTS, tolerance: float = 1e-14) -> Whitening:
    """Learn from all ``rows`` of ``scaled``."""
    first = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d = first["n"], first["d"] or 0
    if not n:
        return Whitening(0, np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0)
    sums = added(rows, lambda x: x.sum(axis=0), d, "long")
    trace = float(added(rows, lambda x: np.array([(centred(x, n, sums) ** 2).sum()]), d, "double")[0]) / n
    if trace <= 0:
        return Whitening(n, sums, np.zeros((0, d)), np.zeros(0), 0.0)

    least = 1e-13 * np.sqrt(trace * n)
    right = _fresh(np.zeros((d, 0)), 0)[:, None]  # V
    left = np.zeros((0, 0))  # column j: u_j = X V left[:, j]
    back = np.zeros((d, 0))  # X' U
    bidiagonal = np.zeros((d, d))
    beta = 0.0
    for k in range(d):
        def step(x, v=right, t=left, b=beta):
            c = centred(x, n, sums)
            y = c @ v
            u = y[:, :-1] @ t
            w = y[:, -1] - b * u[:, -1] if b else y[:, -1]
            return np.concatenate([c.T @ w, u.T @ w, [w @ w]])
        got = added(rows, step, d, "double")
        product, again, square = got[:d], got[d:-1], got[-1]
        alpha = float(np.sqrt(max(square - again @ again, 0.0)))
        column = np.zeros(k + 1)
        column[k] = 1.0
        column[:k] -= left @ again
        if beta:
            column[:k] -= beta * left[:, -1]
        left = np.pad(left, ((0, 1), (0, 1)))
        if alpha > least:
            left[:, -1] = column / alpha
            z = (product - back @ again) / alpha
        else:  # nothing of X along this vector
            alpha, z = 0.0, np.zeros(d)
        back = np.column_stack([back, z])
        bidiagonal[k, k] = alpha
        bidiagonal[:k, k] += again
        if k:
            bidiagonal[k - 1, k] += beta
        if k + 1 == d:
            break
        rest = z - alpha * right[:, -1]
        for _ in range(2):
            rest -= right @ (right.T @ rest)
        beta = float(np.linalg.norm(rest))
        small_left, values, _ = np.linalg.svd(bidiagonal[:k + 1, :k + 1])
        if k + 1 >= components and trace - (values ** 2).sum() / n < values[components - 1] ** 2 / n and (
                beta * np.abs(small_left[k, :components])).max() <= tolerance * values[0]:
            break
        if beta > least:
            rest /= beta
        else:
            beta, rest = 0.0, _fresh(right, k + 1)
        right = np.column_stack([right, rest])
    size = right.shape[1]
    _, values, small = np.linalg.svd(bidiagonal[:size, :size])
    keep = np.flatnonzero(values > max(least, 1e-9 * values[0]))[:components]
    return Whitening(n, sums, (right @ small[keep].T).T, values[keep] ** 2 / n, trace)


def _digits(t: np.ndarray) -> pa.Array:
    """Exact row sums of the squares of ``t``; null beyond 38 digits."""
    kind = pa.decimal128(DIGITS, 0)
    if float(np.abs(t).max(initial=0)) ** 2 * t.shape[1] < EXACT:
        return pa.array((t * t).sum(axis=1).astype(np.int64)).cast(kind)
    exact = (t.astype(object) ** 2).sum(axis=1)
    return pa.array([decimal.Decimal(v) if v < 10 ** DIGITS else None for v in exact], kind)


def whiten(rows: DataFrame, model: Whitening) -> DataFrame:
    """``vec_id``, ``deviation`` (sum of ``(n*x - S)**2``, decimal), ``whitened`` (array by component)."""
    n, sums, dims = model.n, model.sums, model.dims
    turn = model.components.T / np.sqrt(model.values)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch, dims)
            w = centred(x, n, sums) @ turn
            fits = n * int(np.abs(x).max()) < EXACT
            t = n * x - sums if fits else n * x.astype(object) - sums.astype(object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), _digits(t), pa.ListArray.from_arrays(
                    np.arange(0, w.size + 1, max(w.shape[1], 1), dtype=np.int32)
                    if w.size else np.zeros(len(x) + 1, np.int32), w.ravel())],
                names=["vec_id", "deviation", "whitened"])
    return rows.mapInArrow(run, f"vec_id {kind}, deviation decimal({DIGITS},0), whitened array<double>")


def identity_error(rows: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened rows less the identity."""
    n, sums, k = model.n, model.sums, len(model.values)
    if not k:
        return 0.0
    turn = model.components.T / np.sqrt(model.values)

    def part(x: np.ndarray) -> np.ndarray:
        w = centred(x, n, sums) @ turn
        return np.concatenate([(w.T @ w).ravel(), w.sum(axis=0)])
    got = added(rows, part, model.dims, "double")
    mean = got[k * k:] / n
    return float(np.abs(got[:k * k].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


@query("op12_whitening")
def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = scaled(spark.read.parquet(f"{folder}/embeddings.parquet"))
    model = fit(rows)
    explained = F.lit(model.explained.tolist()).cast("array<double>")
    return (whiten(rows, model)
            .select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"),
                    F.posexplode("whitened").alias("at", "whitened"))
            .select("vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"),
                    "deviation", "whitened", explained[F.col("at")].alias("explained"),
                    F.lit(identity_error(rows, model)).alias("identity_error")))
