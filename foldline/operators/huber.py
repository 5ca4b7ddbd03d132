"""Huber regression on random Fourier features: Newton's method over scans of the raw columns.

The features of a row, many times its columns, exist inside an Arrow batch only. Every scan gives the
objective, its gradient and its Hessian at one point, one small matrix a task; nothing is cached.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldline.operators.moments import Moments

EPSILON = 1.35  # residuals beyond so many scales count linearly
MAX_SCANS = 100
TOLERANCE = 1e-9  # of the objective, relative


def _waves(batch: pa.RecordBatch, k: int, w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, labels) of a batch; a missing value is an error."""
    cols = np.stack([batch.column(f"__h{i}").to_numpy(zero_copy_only=False) for i in range(k + 1)], axis=1).astype(float)
    if np.isnan(cols).any():
        raise ValueError("SVR: missing values in the features or the label")
    return np.cos(cols[:, :k] @ w.T + b), cols[:, k]


def _scan(src: DataFrame, one, start, add, pack, unpack) -> bytes | None:
    """``add(state, one(batch))`` over all batches, then over the tasks' states in one task: one packed state."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            if batch.num_rows:
                state = add(state, one(batch))
        yield pa.RecordBatch.from_arrays([pa.array([pack(state)], pa.binary())], names=["state"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = start()
        for batch in batches:
            for raw in batch.column("state"):
                state = add(state, unpack(raw.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array([pack(state)], pa.binary())], names=["state"])

    row = src.mapInArrow(part, "state binary").repartition(1).mapInArrow(whole, "state binary").first()
    return bytes(row["state"]) if row else None


def _add_moments(held: Moments, more: tuple) -> Moments:
    held.add(*more)
    return held


def fit_huber(df: DataFrame, x: Sequence[str], label: str, w: np.ndarray, b: np.ndarray, penalty: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients of cos(x . w + b): mean Huber loss with its scale, and a ridge on standardised features.

    Minimises mean((s + H(r / s) s) / 2) + penalty / 2 * |coefficients of standardised features|^2 over coefficients,
    intercept and scale s, as MLlib's ``loss="huber"`` does. Starts at least squares; a step that does not
    lower the objective, which is convex, is halved.
    """
    k, d = len(x), len(b)
    src = df.select(*[F.col(c).cast("double").alias(f"__h{i}") for i, c in enumerate([*x, label])])

    def batch_moments(batch: pa.RecordBatch) -> tuple:
        z, y = _waves(batch, k, w, b)
        own = Moments(d + 1)
        own.add_rows(np.column_stack([z, y]))
        return own.n, own.mean, own.products

    raw = _scan(src, batch_moments, lambda: Moments(d + 1), _add_moments, Moments.packed, lambda r: Moments.parts(r, d + 1))
    m = Moments.unpacked(raw, d + 1) if raw else Moments(d + 1)
    if not m.n:
        raise ValueError("SVR: no rows to fit on")
    sd = np.sqrt(np.maximum(np.diag(m.products), 0) / max(m.n - 1, 1))
    level = m.mean[-1]
    if sd[-1] == 0:
        return float(level), np.zeros(d)
    scale = np.divide(1.0, sd[:-1], out=np.zeros(d), where=sd[:-1] > 0)  # a constant feature has no say
    ridge = penalty * np.eye(d)
    xx = m.products[:-1, :-1] * np.outer(scale, scale) / m.n
    beta = np.linalg.lstsq(xx + ridge, m.products[:-1, -1] * scale / m.n, rcond=None)[0]
    rest = m.products[-1, -1] / m.n - 2 * beta @ (m.products[:-1, -1] * scale / m.n) + beta @ xx @ beta
    floor = 1e-9 * sd[-1]
    at = np.concatenate([beta, [0.0], [max(np.sqrt(max(rest, 0.0)), floor)]])  # coefficients, intercept, scale
    mean = m.mean[:-1]

    def measure(at: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        beta, s = at[:d], at[-1]

        def one(batch: pa.RecordBatch) -> np.ndarray:
            z, y = _waves(batch, k, w, b)
            z = np.column_stack([(z - mean) * scale, np.ones(len(y))])
            r = y - level - z @ at[:-1]
            near = np.abs(r) <= EPSILON * s
            inner, far = z[near], ~near
            q = r[near] / s
            loss = 0.5 * (len(y) * s + s * (q @ q) + 2 * EPSILON * np.abs(r[far]).sum() - far.sum() * s * EPSILON**2)
            slope = -(inner.T @ q + EPSILON * (np.sign(r[far]) @ z[far]))
            by_s = 0.5 * (len(y) - q @ q - far.sum() * EPSILON**2)
            bend = np.empty((d + 2, d + 2))
            bend[:-1, :-1] = inner.T @ inner / s
            bend[-1, :-1] = bend[:-1, -1] = inner.T @ q / s
            bend[-1, -1] = q @ q / s
            return np.concatenate([[loss], slope, [by_s], bend.ravel()])

        size = 1 + (d + 2) + (d + 2) ** 2
        raw = _scan(src, one, lambda: np.zeros(size), np.add, np.ndarray.tobytes, np.frombuffer)
        sums = np.frombuffer(raw) / m.n
        slope, bend = sums[1 : d + 3].copy(), sums[d + 3 :].reshape(d + 2, d + 2).copy()
        slope[:d] += penalty * beta
        bend[:d, :d] += ridge
        return float(sums[0] + 0.5 * penalty * beta @ beta), slope, bend

    value, slope, bend = measure(at)
    step, share = None, 1.0
    for _ in range(MAX_SCANS):
        if step is None:
            step, share = -np.linalg.lstsq(bend, slope, rcond=None)[0], 1.0
        to = at + share * step
        to[-1] = max(to[-1], at[-1] / 4, floor)
        found = measure(to)
        gain = value - found[0]
        if gain >= 0:
            at, (value, slope, bend), step = to, found, None
        else:
            share /= 2
        if abs(gain) <= TOLERANCE * abs(value) or share < 1e-4:
            break
    coef = at[:d] * scale
    return float(level + at[d] - coef @ mean), coef
