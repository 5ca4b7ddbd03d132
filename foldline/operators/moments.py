"""Means and comoments of any number of columns from one scan, and the linear models they give exactly."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SHARES = 256  # of the tasks' buffers that are added up side by side
HELD_BYTES = 1 << 26  # of open buffers in a task before they are passed on


class Moments:
    """Count, means and centred sums of products of some columns; mergeable, and stable far from zero."""

    def __init__(self, size: int):
        self.n = 0
        self.mean = np.zeros(size)
        self.products = np.zeros((size, size))

    def add(self, n: int, mean: np.ndarray, products: np.ndarray) -> None:
        if not n:
            return
        total = self.n + n
        gap = mean - self.mean
        self.products += products + np.outer(gap, gap) * (self.n * n / total)
        self.mean = self.mean + gap * (n / total)
        self.n = total

    def add_rows(self, rows: np.ndarray) -> None:
        mean = rows.mean(axis=0)
        off = rows - mean
        self.add(len(rows), mean, off.T @ off)

    def mapped(self, matrix: np.ndarray, offset: np.ndarray) -> Moments:
        """The moments of ``matrix @ columns + offset``."""
        out = Moments(len(offset))
        out.add(self.n, matrix @ self.mean + offset, matrix @ self.products @ matrix.T)
        return out

    def packed(self) -> bytes:
        """Count, means and the upper triangle as one buffer."""
        upper = self.products[np.triu_indices(len(self.mean))]
        return np.concatenate([[self.n], self.mean, upper]).tobytes()

    @staticmethod
    def parts(raw: bytes, size: int) -> tuple[int, np.ndarray, np.ndarray]:
        flat = np.frombuffer(raw)
        upper = np.zeros((size, size))
        upper[np.triu_indices(size)] = flat[size + 1 :]
        return int(flat[0]), flat[1 : size + 1], upper + np.triu(upper, 1).T

    @classmethod
    def unpacked(cls, raw: bytes, size: int) -> Moments:
        out = cls(size)
        out.add(*cls.parts(raw, size))
        return out


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by, n, moments): one buffer for every value of ``by``; rows with a NULL or NaN are left out.

    Every task adds its rows up in matrix products over Arrow batches, one
    buffer a group, and passes them on before they take too much memory.
    Buffers then meet one after another, first by group and share of the tasks,
    then by group: a task holds the sum and one more. For k columns a buffer
    has k(k+1)/2 numbers. Use it where ``by`` has few values or k is large;
    ``gram`` has the same sums as columns.
    """
    size, by = len(columns), list(by)
    src = df.select(*by, *(F.col(c).cast("double").alias(f"__m{i}") for i, c in enumerate(columns)))
    keys = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.select(*by).schema]

    def batch(held: dict[tuple, Moments], types: list[pa.DataType]) -> pa.RecordBatch:
        cols = [pa.array([k[i] for k in held], t) for i, t in enumerate(types)]
        sums = [pa.array([m.n for m in held.values()], pa.int64()), pa.array([m.packed() for m in held.values()], pa.binary())]
        return pa.RecordBatch.from_arrays([*cols, *sums], names=[*by, "n", "moments"])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Moments] = {}
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.column(c).type for c in by]
            x = np.stack([b.column(f"__m{i}").to_numpy(zero_copy_only=False) for i in range(size)], axis=1).astype(float)
            ok = np.flatnonzero(~np.isnan(x).any(axis=1))
            if not by:
                if len(ok):
                    held.setdefault((), Moments(size)).add_rows(x[ok])
                continue
            places: dict[tuple, list[int]] = {}
            names = list(zip(*(b.column(c).to_pylist() for c in by)))
            for i in ok.tolist():
                places.setdefault(names[i], []).append(i)
            for name, at in places.items():
                held.setdefault(name, Moments(size)).add_rows(x[at])
            if len(held) * size * size * 8 > HELD_BYTES:
                yield batch(held, types)
                held = {}
        if held:
            yield batch(held, types)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: dict[tuple, Moments] = {}
        types: list[pa.DataType] = []
        for b in batches:
            types = [b.column(c).type for c in by]
            closed: dict[tuple, Moments] = {}
            names = zip(*(b.column(c).to_pylist() for c in by)) if by else [()] * b.num_rows
            for name, raw in zip(names, b.column("moments")):
                if name not in open_:  # rows are sorted: the one before is whole
                    closed.update(open_)
                    open_ = {name: Moments(size)}
                open_[name].add(*Moments.parts(raw.as_py(), size))
            if closed:
                yield batch(closed, types)
        if open_:
            yield batch(open_, types)

    spec = ", ".join([*keys, "n long", "moments binary"])
    met = src.mapInArrow(add_up, spec).withColumn("share", F.pmod(F.spark_partition_id(), F.lit(SHARES)))
    met = met.repartition(*by, "share").sortWithinPartitions(*by, "share").drop("share").mapInArrow(merge, spec)
    met = met.repartition(*by).sortWithinPartitions(*by) if by else met.repartition(1)
    return met.mapInArrow(merge, spec)


def ridge(m: Moments, alpha: float) -> tuple[float, np.ndarray]:
    """Intercept and coefficients; the last column is the label. Solved with one step of refinement; singular: least norm."""
    xx, xy = m.products[:-1, :-1] + alpha * np.eye(len(m.mean) - 1), m.products[:-1, -1]
    try:
        w = np.linalg.solve(xx, xy)
        w = w + np.linalg.solve(xx, xy - xx @ w)
    except np.linalg.LinAlgError:
        w = np.linalg.lstsq(xx, xy, rcond=None)[0]
    return float(m.mean[-1] - m.mean[:-1] @ w), w


def elastic_net(m: Moments, alpha: float, l1_ratio: float) -> tuple[float, np.ndarray]:
    """The same by coordinate descent; penalties on the scale of a mean of squared errors."""
    from foldline.operators.gram import _elastic_net

    n = np.array([[m.n]], float)
    w = _elastic_net(n[0], m.products[None, :-1, :-1], m.products[None, :-1, -1], alpha, l1_ratio)[0]
    return float(m.mean[-1] - m.mean[:-1] @ w), w


def total_moments(df: DataFrame, columns: Sequence[str]) -> Moments:
    """The moments of the whole table: one buffer, which passes to the driver."""
    row = moments(df, columns).first()
    return Moments.unpacked(bytes(row["moments"]), len(columns)) if row else Moments(len(columns))
