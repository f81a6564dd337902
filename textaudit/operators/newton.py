"""Linear classifiers by Newton steps over a distributed table.

The objective is ``|w|^2 / 2 + C * sum(weight * loss(y * (w.x + b)))``. A pass over the table gives
its value and gradient, summed up inside each task and then across tasks, so what moves is a
vector a task. Few dimensions: the pass also sums the Gram matrix of the curvature, and the step
is the exact Newton step. Many (a vocabulary): the curvature is that of a bounded sample of rows,
inverted by conjugate gradients on the driver, and corrected by the gradients of the last steps
(two-loop recursion); the gradient, hence the solution, is always that of all rows. A fit takes
as many passes as steps, some ten, where first-order methods take hundreds."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved_table

#: Dimensions up to which the Gram matrix is summed (its square is what a task sends), rows of the
#: curvature sample, remembered steps, and passes after which a fit gives up.
GRAM_MOST, SAMPLE_ROWS, MEMORY, MOST_PASSES = 256, 2048, 8, 60


# --- losses: value, slope and curvature by the decision value --------------------------------
def _logistic(y, z):
    m = y * z
    p = 1 / (1 + np.exp(np.clip(m, -700, 700)))
    return np.logaddexp(0, -m), -y * p, p * (1 - p)


def _squared_hinge(y, z):
    gap = np.maximum(0, 1 - y * z)
    return gap * gap, -2 * y * gap, 2.0 * (gap > 0)


LOSSES: dict[str, Callable] = {"logistic": _logistic, "squared_hinge": _squared_hinge}


@dataclass
class Fit:
    """Coefficients and intercept, the objective, the largest entry of its gradient, and the
    passes over the table that were taken."""

    coefficients: np.ndarray
    intercept: float
    value: float
    slope: float
    passes: int


class Matrix:
    """Rows of a batch: a dense block, or indices and values with the row of each."""

    def __init__(self, vectors, columns: int):
        # the struct behind a vector: type (0 sparse, 1 dense), size, indices, values
        kind = vectors.field("type").to_numpy(zero_copy_only=False)
        sizes = vectors.field("values").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.n, self.columns = len(kind), columns
        self.value = vectors.field("values").flatten().to_numpy()
        self.row = self.index = None
        if (kind == 1).all():
            self.value = self.value.reshape(self.n, columns)
            return
        self.row = np.repeat(np.arange(self.n), sizes)
        start = np.cumsum(sizes) - sizes
        self.index = np.arange(len(self.row)) - np.repeat(start, sizes)  # right for dense rows
        sparse = np.repeat(kind == 0, sizes)
        self.index[sparse] = vectors.field("indices").flatten().to_numpy()

    def times(self, w: np.ndarray) -> np.ndarray:
        if self.index is None:
            return self.value @ w
        return np.bincount(self.row, self.value * w[self.index], self.n)

    def turned(self, u: np.ndarray) -> np.ndarray:
        if self.index is None:
            return self.value.T @ u
        return np.bincount(self.index, self.value * u[self.row], self.columns)

    def dense(self) -> np.ndarray:
        if self.index is None:
            return self.value
        out = np.zeros((self.n, self.columns))
        np.add.at(out, (self.row, self.index), self.value)
        return out


def _sums(rows: DataFrame, w: np.ndarray, columns: int, loss: str, gram: bool) -> tuple[float, np.ndarray, np.ndarray | None]:
    """One pass: the weighted loss, its gradient and, if wanted, its curvature, over all rows
    (intercept last)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    sent = rows.sparkSession.sparkContext.broadcast(w)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        here, total = sent.value, np.zeros(columns + 2 + ((columns + 1) ** 2 if gram else 0))
        for batch in batches:
            y, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("y", "weight"))
            x = Matrix(batch.column("features"), columns)
            value, slope, curve = LOSSES[loss](y, x.times(here[:-1]) + here[-1])
            total[0] += c @ value
            total[1:columns + 1] += x.turned(c * slope)
            total[columns + 1] += c @ slope
            if gram:
                full = np.c_[x.dense(), np.ones(x.n)]
                total[columns + 2:] += (full.T @ (full * (c * curve)[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["sums"])

    parts = rows.mapInArrow(run, "sums array<double>")
    whole = np.array(parts.agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("s")).first()["s"])
    sent.unpersist()
    return whole[0], whole[1:columns + 2], whole[columns + 2:].reshape(columns + 1, columns + 1) if gram else None


def conjugate(product: Callable, right: np.ndarray, scale: np.ndarray, tol: float, most: int = 250) -> np.ndarray:
    """Solve ``product(x) = right`` for a positive definite map by conjugate gradients, with the
    diagonal ``scale`` as preconditioner."""
    x = np.zeros_like(right)
    r = right.copy()
    z = r / scale
    p, rz, goal = z.copy(), r @ z, tol * np.sqrt(right @ right)
    for _ in range(most):
        if np.sqrt(r @ r) <= goal or rz == 0:
            break
        q = product(p)
        step = rz / (p @ q)
        x += step * p
        r -= step * q
        z = r / scale
        rz, old = r @ z, rz
        p = z + rz / old * p
    return x


class _Sample:
    """Curvature of a bounded sample of rows, scaled to the weight of all."""

    def __init__(self, rows: DataFrame, columns: int, loss: str, c: float, ridge: np.ndarray, n_rows: int, mass: float):
        near = rows if n_rows <= SAMPLE_ROWS else rows.orderBy("place").limit(SAMPLE_ROWS)
        table = near.select("y", "weight", "features").toArrow().combine_chunks()
        vectors = table["features"].combine_chunks()
        self.x = Matrix(getattr(vectors, "storage", vectors), columns)
        self.y, self.weight = table["y"].to_numpy(), table["weight"].to_numpy()
        self.weight = self.weight * c * mass / max(self.weight.sum(), 1e-300)
        self.loss, self.ridge = LOSSES[loss], ridge

    def at(self, w: np.ndarray) -> None:
        self.curve = self.weight * self.loss(self.y, self.x.times(w[:-1]) + w[-1])[2]
        squares = self.x.value * self.x.value
        if self.x.index is None:
            own = squares.T @ self.curve
        else:
            own = np.bincount(self.x.index, squares * self.curve[self.x.row], self.x.columns)
        self.scale = np.r_[own, self.curve.sum()] + self.ridge + 1e-12

    def product(self, v: np.ndarray) -> np.ndarray:
        u = self.curve * (self.x.times(v[:-1]) + v[-1])
        return np.r_[self.x.turned(u), u.sum()] + (self.ridge + 1e-12) * v

    def solve(self, right: np.ndarray, tol: float) -> np.ndarray:
        return conjugate(self.product, right, self.scale, tol)


def _corrected(right: np.ndarray, solve: Callable, steps: list) -> np.ndarray:
    """Two-loop recursion: ``solve`` corrected by ``(step, change of the gradient)`` pairs."""
    q, kept = right.copy(), []
    for s, g in reversed(steps):
        a = (s @ q) / (s @ g)
        q = q - a * g
        kept.append(a)
    out = solve(q)
    for (s, g), a in zip(steps, reversed(kept)):
        out = out + (a - (g @ out) / (s @ g)) * s
    return out


def fit_linear(train: DataFrame, loss: str, label: str = "label", features: str = "features", weight: str | None = None,
               c: float = 1.0, key: str | None = None, regularise_intercept: bool = False, tol: float = 1e-6,
               most: int = MOST_PASSES, gram_most: int = GRAM_MOST) -> Fit:
    """Fit of ``train`` (0/1 ``label``, vector ``features``, optional row ``weight``) for ``loss``
    (``logistic`` or ``squared_hinge``). The intercept is a constant feature, regularised or not. Ends
    when no entry of the gradient exceeds ``tol`` times the largest at the start. Rows with a null
    label or null features are left out; a table without rows gives zeros."""
    place = F.xxhash64(key) if key else F.monotonically_increasing_id()
    # the filter reads the saved features: put before, it would compute them a second time
    rows = saved_table(train.select((2 * F.col(label).cast("double") - 1).alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
                                    F.col(features).alias("features"), place.alias("place")), "fit").where("y IS NOT NULL AND features IS NOT NULL")
    first = rows.select("features").first()
    if first is None:
        return Fit(np.zeros(0), 0.0, 0.0, 0.0, 0)
    columns = first["features"].size
    ridge = np.r_[np.ones(columns), float(regularise_intercept)]
    gram = columns <= gram_most
    n_rows, mass = rows.agg(F.count("*"), F.sum("weight")).first()
    sample = None if gram else _Sample(rows, columns, loss, c, ridge, n_rows, mass)

    def at(w: np.ndarray):
        value, slope, curve = _sums(rows, w, columns, loss, gram)
        return c * value + ridge @ (w * w) / 2, c * slope + ridge * w, None if curve is None else c * curve + np.diag(ridge + 1e-12)

    w, steps, passes = np.zeros(columns + 1), [], 1
    value, slope, curve = at(w)
    begun = np.abs(slope).max()
    while passes < most and np.abs(slope).max() > tol * max(begun, 1e-300):
        if gram:
            d = np.linalg.solve(curve, -slope)
        else:
            sample.at(w)
            rough = min(0.05, np.abs(slope).max() / begun)
            d = _corrected(-slope, lambda q: sample.solve(q, rough), steps)
            if d @ slope >= 0:
                steps, d = [], sample.solve(-slope, rough)
        size = 1.0
        while True:
            tried = at(w + size * d)
            passes += 1
            if tried[0] <= value + 1e-4 * size * (d @ slope) + 1e-12 * abs(value) or passes >= most:
                break
            size /= 2
        if tried[0] > value + 1e-9 * abs(value):
            break
        moved, change = size * d, tried[1] - slope
        if moved @ change > 1e-12 * np.sqrt((moved @ moved) * (change @ change)):
            steps = [*steps, (moved, change)][-MEMORY:]
        w, (value, slope, curve) = w + moved, tried
    return Fit(w[:-1], float(w[-1]), float(value), float(np.abs(slope).max()), passes)


@dataclass
class _Run:
    """One regularisation: the accepted weights with their objective, the step tried next, and the
    best score so far with the epochs since."""

    c: float
    w: np.ndarray
    tried: np.ndarray
    direction: np.ndarray
    value: float = float("inf")
    slope: np.ndarray | None = None
    size: float = 1.0
    epoch: int = -1
    best: float = -1.0
    stale: int = 0
    open: bool = True


def fit_runs(train: DataFrame, held: str, cs, loss: str = "squared_hinge", label: str = "label", features: str = "features", weight: str | None = None,
             regularise_intercept: bool = True, tol: float = 1e-6, patience: int = 3, most: int = MOST_PASSES) -> tuple[DataFrame, dict[float, Fit]]:
    """Fits for several ``cs`` at once, with their history: ``(run, c, epoch, loss, precision, recall,
    f1)``, a row for each accepted step of each run, measured on the rows where ``held`` is true (the
    others are fitted). Every pass over the table serves all runs that are still open. A run ends
    when its gradient vanishes or when ``patience`` epochs have not raised its F1. For features of
    at most ``GRAM_MOST`` dimensions."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    spark = train.sparkSession
    rows = saved_table(train.select((2 * F.col(label).cast("double") - 1).alias("y"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"),
                                    F.col(held).alias("held"), F.col(features).alias("features")), "runs").where("y IS NOT NULL AND features IS NOT NULL")
    first = rows.select("features").first()
    schema = "run int, c double, epoch int, loss double, precision double, recall double, f1 double"
    if first is None:
        return spark.createDataFrame([], schema), {}
    d = first["features"].size
    if d > GRAM_MOST:
        raise ValueError(f"{d} features; runs are fitted together for at most {GRAM_MOST}")
    ridge = np.r_[np.ones(d), float(regularise_intercept)] + 1e-12
    wide = 4 + (d + 1) + (d + 1) ** 2

    def measured(ws: list[np.ndarray]) -> np.ndarray:
        sent = spark.sparkContext.broadcast(np.array(ws))

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa
            total = np.zeros((len(sent.value), wide))
            for batch in batches:
                y, c = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("y", "weight"))
                out = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
                x = np.c_[Matrix(batch.column("features"), d).dense(), np.ones(len(y))]
                for row, w in zip(total, sent.value):
                    z = x @ w
                    yes = z[out] >= 0
                    row[:3] += (yes & (y[out] > 0)).sum(), (yes & (y[out] < 0)).sum(), (~yes & (y[out] > 0)).sum()
                    value, slope, curve = LOSSES[loss](y[~out], z[~out])
                    own, u = x[~out], c[~out]
                    row[3] += u @ value
                    row[4:d + 5] += own.T @ (u * slope)
                    row[d + 5:] += (own.T @ (own * (u * curve)[:, None])).ravel()
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel()], pa.list_(pa.float64()))], names=["sums"])

        parts = rows.mapInArrow(run, "sums array<double>")
        got = parts.agg(vector_to_array(Summarizer.sum(array_to_vector("sums"))).alias("s")).first()["s"]
        sent.unpersist()
        return np.array(got).reshape(len(ws), wide)

    runs = [_Run(float(c), np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)) for c in cs]
    history, fits, passes, begun = [], {}, 0, {}
    while passes < most and any(r.open for r in runs):
        active = [(i, r) for i, r in enumerate(runs) if r.open]
        passes += 1
        for (i, r), sums in zip(active, measured([r.tried for _, r in active])):
            value = r.c * sums[3] + ridge @ (r.tried * r.tried) / 2
            if r.slope is not None and value > r.value + 1e-4 * r.size * (r.direction @ r.slope) + 1e-12 * abs(r.value):
                r.size /= 2  # the step was too long
                r.tried, r.open = r.w + r.size * r.direction, r.size > 1e-9
                continue
            r.w, r.value, r.epoch = r.tried, value, r.epoch + 1
            r.slope = r.c * sums[4:d + 5] + ridge * r.w
            begun.setdefault(i, np.abs(r.slope).max())
            tp, fp, fn = sums[:3]
            f1 = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
            history.append((i, r.c, r.epoch, float(value), float(tp / (tp + fp)) if tp else 0.0, float(tp / (tp + fn)) if tp else 0.0, float(f1)))
            r.best, r.stale = (f1, 0) if f1 > r.best else (r.best, r.stale + 1)
            fits[r.c] = Fit(r.w[:-1], float(r.w[-1]), float(value), float(np.abs(r.slope).max()), passes)
            if fits[r.c].slope <= tol * max(begun[i], 1e-300) or r.stale >= patience:
                r.open = False
                continue
            curve = r.c * sums[d + 5:].reshape(d + 1, d + 1) + np.diag(ridge)
            r.direction, r.size = np.linalg.solve(curve, -r.slope), 1.0
            r.tried = r.w + r.direction
    return spark.createDataFrame(sorted(history), schema), fits
