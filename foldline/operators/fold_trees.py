"""Trees of a stack's members for all its folds at once, from one table of cells.

Rows of equal bins are one cell: it has their number and label sum by fold, and
for forests with bootstrap the same of the rows drawn for every tree. Cells are
made in one shuffle of the rows. Every pass over the cells then grows one level
of all trees of all folds, where a fit for each fold would bin, draw and pass
the rows by itself. Cut points are statistics of all given rows, as the scaling
before a stack is; labels of a fold reach no model that predicts it.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressionModel, GBTRegressionModel, GBTRegressor, RandomForestRegressor
from pyspark.ml.wrapper import JavaWrapper
from pyspark.sql import DataFrame, SparkSession, functions as F

from foldline.functions.numeric import sql_name
from foldline.operators import learners
from foldline.session import drop_staged, stage_table

LARGEST_DEPTH = 10  # of trees that grow here
CODES = 1 << 62  # cells that a number tells apart
SHARE = 0.25  # cells of a row, at most: more would take more room than the rows
TREES_AT_ONCE = 20  # that a cell has draws of
HELD_BYTES = 1 << 26  # of sums in a task
LEAST_GAIN = 1e-12  # of a split, as a share of its node's squared sum around the mean label: below is rounding


@dataclass
class Tree:
    """Nodes in the order they were made; the right child follows the left one, a leaf has none."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    sums: list[tuple[float, float]] = field(default_factory=lambda: [(0.0, 0.0)])  # rows and label sum
    gain: list[float] = field(default_factory=lambda: [0.0])
    open: list[int] = field(default_factory=lambda: [0])  # nodes of the level that grows

    def value(self, node: int) -> float:
        n, s = self.sums[node]
        return s / n if n else 0.0

    def split(self, found: np.ndarray, last: bool) -> None:
        """Grow a level: a row for each open node of (rows, sum, gain, feature, cut, rows left, sum left)."""
        grown = []
        for node, (n, s, gain, f, cut, n_left, s_left) in zip(self.open, found):
            self.sums[node] = (n, s)
            if not gain > LEAST_GAIN * abs(s * s / n if n else 0.0):
                continue
            self.feature[node], self.cut[node], self.left[node], self.gain[node] = int(f), int(cut), len(self.left), float(gain / n)
            grown += [len(self.left), len(self.left) + 1]
            self.feature, self.cut, self.left, self.gain = self.feature + [0, 0], self.cut + [0, 0], self.left + [0, 0], self.gain + [0.0, 0.0]
            self.sums += [(n_left, s_left), (n - n_left, s - s_left)]
        self.open = [] if last else grown

    def arrays(self) -> tuple[np.ndarray, ...]:
        return np.array(self.feature, np.int32), np.array(self.cut, np.int32), np.array(self.left, np.int32), np.array([self.value(i) for i in range(len(self.left))])


@dataclass
class Job:
    """A tree that grows: on the rows outside ``fold``, drawn for tree ``draw`` or as they are, less what ``before`` predict."""

    fold: int
    draw: int | None
    tree: Tree = field(default_factory=Tree)
    before: list[tuple[float, Tree]] = field(default_factory=list)


def _nodes(codes: np.ndarray, tree: tuple[np.ndarray, ...]) -> np.ndarray:
    """The node that every cell has come to."""
    feature, cut, left, _ = tree
    size, at = codes.shape[1], np.zeros(codes.shape[1], np.int32)
    flat, rows = codes.ravel(), np.arange(codes.shape[1])
    while True:
        down = left[at]
        inner = down > 0
        if not inner.any():
            return at
        at = np.where(inner, down + (flat[feature[at] * size + rows] > cut[at]), at)


def _best(sums: np.ndarray, open_: int, bins: Sequence[int], least: float) -> np.ndarray:
    """The best split of every open node, the first of equal ones, as ``Tree.split`` takes it."""
    out, at = np.zeros((open_, 7)), 0
    for f, size in enumerate(bins):
        n, s = sums[at : at + 2 * open_ * size].reshape(2, open_, size)
        at += 2 * open_ * size
        if f == 0:
            out[:, 0], out[:, 1] = n.sum(1), s.sum(1)
        if size < 2:
            continue
        n_left, s_left = n.cumsum(1)[:, :-1], s.cumsum(1)[:, :-1]
        n_right, s_right = out[:, :1] - n_left, out[:, 1:2] - s_left
        ok = (n_left >= least) & (n_right >= least)
        with np.errstate(all="ignore"):
            gain = np.where(ok, s_left**2 / n_left + s_right**2 / n_right - out[:, 1:2] ** 2 / out[:, :1], -1.0)
        place = gain.argmax(1)
        rows = np.arange(open_)
        better = gain[rows, place] > out[:, 2]
        found = np.stack([gain[rows, place], np.full(open_, f), place, n_left[rows, place], s_left[rows, place]], axis=1)
        out[better, 2:] = found[better]
    return out


def _buffers(column: pa.Array, kind: type, shape: tuple[int, ...]) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, *shape)


class Cells:
    """The cells of some rows: ``bins`` pieces of every column, and the staged table of their sums."""

    def __init__(self, rows: DataFrame, x: Sequence[str], label: str, fold: str, k: int, n_rows: int, mean: float, edges: list[np.ndarray], drawn: int, seed: int, large: dict[int, int]):
        self.x, self.k, self.drawn, self.mean, self.edges = list(x), k, drawn, mean, edges
        self.bins = [len(e) + 1 for e in edges]
        self.radix = [math.prod(self.bins[:f]) for f in range(len(x))]
        self.table = self._made(rows, label, fold, n_rows, seed, large)

    def _made(self, rows: DataFrame, label: str, fold: str, n_rows: int, seed: int, large: dict[int, int]) -> DataFrame:
        x, k, trees, mean, edges, radix = self.x, self.k, self.drawn, self.mean, self.edges, self.radix
        names, width = [f"__x{i}" for i in range(len(x))], np.array(sorted(large), np.int64)
        pieces = np.array([large[int(c)] for c in width] or [1], np.uint64)

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cell = np.zeros(b.num_rows, np.int64)
                for name, e, r in zip(names, edges, radix):
                    cell += np.searchsorted(e, b.column(name).to_numpy(zero_copy_only=False), "right") * r
                y = b.column("__y").to_numpy(zero_copy_only=False) - mean
                piece = np.zeros(b.num_rows, np.int32)
                if len(width):
                    at = np.minimum(np.searchsorted(width, cell), len(width) - 1)
                    mixed = (np.ascontiguousarray(y).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                    piece = np.where(width[at] == cell, mixed % pieces[at], 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(cell), b.column("__f"), pa.array(y), pa.array(piece)], names=["cell", "f", "y", "piece"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
            for b in batches:
                if not b.num_rows:
                    continue
                cell, y = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "y"))
                first = np.concatenate([[True], cell[1:] != cell[:-1]])
                place, size = (first.cumsum() - 1) * k + b.column("f").to_numpy(zero_copy_only=False), int(first.sum())
                taken = [np.ones(len(y)), *(rng.poisson(1.0, (trees, len(y))) if trees else [])]
                n = np.stack([np.bincount(place, t, size * k) for t in taken]).reshape(-1, size, k).transpose(1, 0, 2).astype(np.int32)
                s = np.stack([np.bincount(place, t * y, size * k) for t in taken]).reshape(-1, size, k).transpose(1, 0, 2)
                parts = [n[:, :1], s[:, :1], n[:, 1:], s[:, 1:]]
                cols = [pa.array([r.tobytes() for r in np.ascontiguousarray(p)], pa.binary()) for p in parts]
                yield pa.RecordBatch.from_arrays([pa.array(cell[first]), *cols], names=["cell", "n", "s", "dn", "ds"])

        src = rows.select(*[F.col(sql_name(c)).alias(n) for c, n in zip(x, names)], F.col(sql_name(label)).cast("double").alias("__y"), F.col(fold).cast("int").alias("__f"))
        met = src.mapInArrow(code, "cell long, f int, y double, piece int").repartition(max(1, math.ceil(n_rows / learners.DRAWN_ROWS)), "cell", "piece")
        made = met.sortWithinPartitions("cell", "f", "y").mapInArrow(add, "cell long, n binary, s binary, dn binary, ds binary")
        return stage_table(made, "cells")

    def level(self, jobs: Sequence[Job], least: int, last: bool) -> None:
        """Grow one level of all jobs' trees, as many in a pass as tasks can hold sums of."""
        width = 2 * 8 * sum(self.bins)
        todo = [j for j in jobs if j.tree.open]
        while todo:
            size = part = 0
            while part < len(todo) and (not part or size + len(todo[part].tree.open) * width <= HELD_BYTES):
                size, part = size + len(todo[part].tree.open) * width, part + 1
            for job, found in zip(todo[:part], self._splits(todo[:part], least)):
                job.tree.split(found, last)
            todo = todo[part:]

    def _splits(self, jobs: Sequence[Job], least: int) -> list[np.ndarray]:
        bins, radix, k, drawn = self.bins, self.radix, self.k, self.drawn
        plans = []
        for j in jobs:
            slot = np.full(len(j.tree.left), -1, np.int32)
            slot[j.tree.open] = np.arange(len(j.tree.open))
            plans.append((j.fold, j.draw, j.tree.arrays(), slot, len(j.tree.open), [(w, t.arrays()) for w, t in j.before]))
        from_draws = jobs[0].draw is not None
        shape, columns = ((drawn, k), ("dn", "ds")) if from_draws else ((1, k), ("n", "s"))

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros(2 * p[4] * sum(bins)) for p in plans]
            for b in batches:
                if not b.num_rows:
                    continue
                cell = b.column("cell").to_numpy(zero_copy_only=False)
                codes = np.stack([cell // r % size for r, size in zip(radix, bins)]).astype(np.int32)
                n, s = _buffers(b.column(columns[0]), np.int32, shape).astype(float), _buffers(b.column(columns[1]), float, shape)
                all_n, all_s = n.sum(2), s.sum(2)
                for sums, (fold, draw, tree, slot, open_, before) in zip(held, plans):
                    t = draw or 0
                    w, y = (all_n[:, t], all_s[:, t]) if fold == k else (all_n[:, t] - n[:, t, fold], all_s[:, t] - s[:, t, fold])
                    if before:  # what is left of the labels is their gradient, twice the error
                        y = 2 * (y - w * sum(weight * done[3][_nodes(codes, done)] for weight, done in before))
                    place = slot[_nodes(codes, tree)]
                    here = place >= 0
                    whole = here.all()
                    w, y, place = (w, y, place) if whole else (w[here], y[here], place[here])
                    at = 0
                    for f, size in enumerate(bins):
                        i = place * size + (codes[f] if whole else codes[f][here])
                        for v in (w, y):
                            sums[at : at + open_ * size] += np.bincount(i, v, open_ * size)
                            at += open_ * size
            part = TaskContext.get().partitionId()
            for i, sums in enumerate(held):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["job", "part", "sums"])

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            job, sums = -1, None

            def done() -> pa.RecordBatch:
                best = _best(sums, plans[job][4], bins, least - 0.5)
                return pa.RecordBatch.from_arrays([pa.array([job], pa.int32()), pa.array([best.tobytes()], pa.binary())], names=["job", "best"])

            for b in batches:
                for i, raw in zip(b.column("job").to_pylist(), b.column("sums")):
                    if i != job:
                        if sums is not None:
                            yield done()
                        job, sums = i, np.zeros(2 * plans[i][4] * sum(bins))
                    sums += np.frombuffer(raw.as_py())
            if sums is not None:
                yield done()

        counted = self.table.select("cell", *columns).mapInArrow(count, "job int, part int, sums binary")
        tasks = min(len(plans), 2 * counted.sparkSession.sparkContext.defaultParallelism)
        met = counted.repartition(tasks, "job").sortWithinPartitions("job", "part").mapInArrow(choose, "job int, best binary")
        found = {r["job"]: np.frombuffer(bytes(r["best"])).reshape(-1, 7) for r in met.collect()}
        return [found[i] for i in range(len(jobs))]

    def grow(self, jobs: Sequence[Job], depth: int, least: int) -> None:
        for level in range(depth):
            self.level(jobs, least, False)
        for j in jobs:
            j.tree.open = []

    def thresholds(self) -> list[np.ndarray]:
        """For MLlib, which goes left up to a threshold: the largest numbers below the edges."""
        return [np.nextafter(e, -np.inf) for e in self.edges]


def _java_tree(tree: Tree, cells: Cells, thresholds: list[np.ndarray], shift: float) -> DecisionTreeRegressionModel:
    gateway, jvm = SparkSession.active().sparkContext._gateway, SparkSession.active().sparkContext._jvm
    nodes, impurity = jvm.org.apache.spark.ml.tree, jvm.org.apache.spark.mllib.tree.impurity
    made: dict[int, object] = {}
    for i in reversed(range(len(tree.left))):
        n, value = tree.sums[i][0], tree.value(i) + shift
        stats = gateway.new_array(jvm.double, 3)
        stats[0], stats[1], stats[2] = float(n), float(n * value), float(n * value * value)
        held = impurity.VarianceCalculator(stats, int(n))
        if tree.left[i]:
            at = nodes.ContinuousSplit(tree.feature[i], float(thresholds[tree.feature[i]][tree.cut[i]]))
            made[i] = nodes.InternalNode(value, 0.0, tree.gain[i], made[tree.left[i]], made[tree.left[i] + 1], at, held)
        else:
            made[i] = nodes.LeafNode(value, 0.0, held)
    name = "org.apache.spark.ml.regression.DecisionTreeRegressionModel"
    return DecisionTreeRegressionModel(JavaWrapper._new_java_obj(name, f"tree_{uuid.uuid4().hex}", made[0], len(cells.x)))


def _model(cells: Cells, trees: Sequence[Tree], weights: Sequence[float], shifts: Sequence[float], prediction: str) -> PipelineModel:
    """The weighted sum of the trees, as a stage that can be saved."""
    jvm, limits = SparkSession.active().sparkContext._jvm, cells.thresholds()
    made = [_java_tree(t, cells, limits, shift) for t, shift in zip(trees, shifts)]  # held until the model is
    name = "org.apache.spark.ml.regression"
    members = JavaWrapper._new_java_array([t._java_obj for t in made], jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel)
    held = JavaWrapper._new_java_array([float(w) for w in weights], jvm.double)
    model = GBTRegressionModel(JavaWrapper._new_java_obj(f"{name}.GBTRegressionModel", f"sum_{uuid.uuid4().hex}", members, held))
    join = VectorAssembler(inputCols=cells.x, outputCol="__x")
    return PipelineModel([join, model.setFeaturesCol("__x").setPredictionCol(prediction), SQLTransformer(statement="SELECT * EXCEPT (__x) FROM __THIS__")])


def _edges(rows: DataFrame, x: Sequence[str], bins: int, counts: Sequence[int], some: np.ndarray) -> list[np.ndarray]:
    """Where the pieces of every column begin but the first: between its values, or at quantiles of some rows if it has more than ``bins``."""
    few = [i for i in range(len(x)) if counts[i] <= 1.2 * bins]  # approximate counts; sets are exact
    sets = rows.agg(*[F.collect_set(sql_name(x[i])).alias(f"v{i}") for i in few]).first() if few else {}
    out = []
    for i in range(len(x)):
        values = np.unique(np.array(sets[f"v{i}"], float)) if i in few else None
        if values is not None and len(values) <= bins:
            out.append(np.maximum((values[1:] + values[:-1]) / 2, np.nextafter(values[:-1], np.inf)))
        else:
            found = np.quantile(some[:, i], [j / bins for j in range(1, bins)], method="inverted_cdf")
            out.append(np.setdiff1d(found, some[:, i].min()))
    return out


def grows_here(est) -> bool:
    """Whether a learner's trees can grow on cells of all folds."""
    return isinstance(est, (RandomForestRegressor, GBTRegressor)) and est.getSubsamplingRate() == 1.0 and est.getMaxDepth() <= LARGEST_DEPTH


def fit_by_fold(bases: Sequence, rows: DataFrame, x: Sequence[str], label: str, fold: str, k: int, seed: int = 42) -> list[PipelineModel] | None:
    """The members fitted on the rows outside every fold, and last on all rows; ``rows`` come from files.

    None where these are not trees over plain numbers, a value is missing (for MLlib to refuse) or cells are not far fewer
    than rows. Every row is drawn once for each tree of a forest with bootstrap, and counts so in all fits that see it.
    """
    kinds = dict(rows.dtypes)
    if not all(b.learner in learners.DEFAULTS and b.learner not in ("Ridge", "ElasticNet", "SVR", "ExtraTreesRegressor") for b in bases) or any(kinds[c] != "double" for c in x):
        return None
    ests = [learners.tree_estimator(b.learner, b.params, seed) for b in bases]
    if not all(map(grows_here, ests)) or len({e.getMaxBins() for e in ests}) > 1:
        return None
    gaps = [F.count_if(F.col(sql_name(c)).isNull() | F.isnan(sql_name(c))) for c in (*x, label)]
    counts = [F.approx_count_distinct(sql_name(c), 0.03).alias(f"n{i}") for i, c in enumerate(x)]
    row = rows.agg(F.count("*").alias("n"), F.avg(sql_name(label)).alias("mean"), sum(gaps[1:], gaps[0]).alias("gaps"), *counts).first()
    if not row["n"] or row["gaps"]:
        return None
    share = min(1.0, 2 * learners.SAMPLED_ROWS / row["n"])
    some = rows.select(*map(sql_name, x)).sample(share, seed).toPandas().to_numpy(float)
    if not len(some):
        return None
    edges = _edges(rows, x, ests[0].getMaxBins(), [row[f"n{i}"] for i in range(len(x))], some)
    radix = [math.prod(len(e) + 1 for e in edges[:f]) for f in range(len(x) + 1)]
    if radix[-1] > CODES:
        return None
    codes, seen = np.unique(sum(np.searchsorted(e, some[:, f], "right") * radix[f] for f, e in enumerate(edges)), return_counts=True)
    if radix[-1] > SHARE * row["n"]:  # or fewer cells are met
        if _count_cells(rows, x, edges, radix) > SHARE * row["n"]:
            return None
    per_row = row["n"] / len(some)
    large = {int(c): math.ceil(m * per_row / learners.DRAWN_ROWS) for c, m in zip(codes, seen) if m * per_row > learners.DRAWN_ROWS}
    models: list[list[PipelineModel]] = []
    forests = [e for e in ests if isinstance(e, RandomForestRegressor) and e.getBootstrap()]
    most = max((e.getNumTrees() for e in forests), default=0)
    grown: dict[int, list[list[Tree]]] = {i: [[] for _ in range(k + 1)] for i in range(len(ests))}
    for start in range(0, max(most, 1), TREES_AT_ONCE):
        size = min(TREES_AT_ONCE, most - start)
        cells = Cells(rows, x, label, fold, k, row["n"], row["mean"], edges, max(size, 0), seed + start, large)
        for i, est in enumerate(ests):
            least = est.getMinInstancesPerNode()
            if est in forests:
                jobs = [Job(f, t) for f in range(k + 1) for t in range(min(size, est.getNumTrees() - start))]
                cells.grow(jobs, est.getMaxDepth(), least)
                for j in jobs:
                    grown[i][j.fold].append(j.tree)
            elif start == 0:
                boosted = isinstance(est, GBTRegressor)
                for step in range(est.getMaxIter() if boosted else 1):
                    weights = [1.0] + [est.getStepSize()] * (step - 1) if boosted else []
                    jobs = [Job(f, None, before=list(zip(weights, grown[i][f]))) for f in range(k + 1)]
                    cells.grow(jobs, est.getMaxDepth(), least)
                    for j in jobs:
                        grown[i][j.fold].append(j.tree)
        drop_staged(cells.table)
    for f in range(k + 1):
        stages = []
        for i, (est, base) in enumerate(zip(ests, bases)):
            trees, boosted = grown[i][f], isinstance(est, GBTRegressor)
            weights = [1.0] + [est.getStepSize()] * (len(trees) - 1) if boosted else [1 / len(trees)] * len(trees)
            shifts = [row["mean"], *[0.0] * (len(trees) - 1)] if boosted else [row["mean"]] * len(trees)
            stages.append(_model(cells, trees, weights, shifts, base.column))
        models.append(PipelineModel(stages))
    return models


def _count_cells(rows: DataFrame, x: Sequence[str], edges: list[np.ndarray], radix: list[int]) -> int:
    names = [f"__x{i}" for i in range(len(x))]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = sum(np.searchsorted(e, b.column(n).to_numpy(zero_copy_only=False), "right") * r for n, e, r in zip(names, edges, radix))
            yield pa.RecordBatch.from_arrays([pa.array(np.asarray(cell, np.int64))], names=["cell"])

    src = rows.select(*[F.col(sql_name(c)).alias(n) for c, n in zip(x, names)])
    return src.mapInArrow(code, "cell long").agg(F.approx_count_distinct("cell", 0.02)).first()[0]
