"""Toxicity by a classifier chain over hashed word features."""

from __future__ import annotations

import math
import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from foldline.llm.common import rows

WORD = re.compile(r"[^\W\d_]+")
SPACE = 1 << 22  # hashed features
LEAST = 5  # documents of the sample that a feature must be in


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers: words, and the first four and five letters of longer ones."""
    found = set()
    digest = xxhash.xxh32_intdigest
    for w in set(WORD.findall(text.lower())):
        found.add(digest(w) & (SPACE - 1))
        if len(w) > 5:
            found.add(digest("^" + w[:4]) & (SPACE - 1))
            found.add(digest("^" + w[:5]) & (SPACE - 1))
    return np.array(sorted(found), np.int64)


@dataclass
class Linear:
    """Logistic regression over a few chosen features and dense columns."""

    chosen: np.ndarray  # feature numbers, ascending
    weight: np.ndarray  # of the chosen, then of the dense columns, then the constant

    def scores(self, flat: np.ndarray, doc: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.chosen, flat), max(0, len(self.chosen) - 1))
        hit = self.chosen[at] == flat if len(self.chosen) else np.zeros(len(flat), bool)
        z = np.bincount(doc[hit], self.weight[at[hit]], n)
        k = len(self.chosen)
        return 1 / (1 + np.exp(-np.clip(z + dense @ self.weight[k:-1] + self.weight[-1], -30, 30)))


def fit_linear(flat: np.ndarray, doc: np.ndarray, n: int, dense: np.ndarray, y: np.ndarray, keep: int = 4096, least: int = LEAST, l2: float = 1e-3, steps: int = 150) -> Linear:
    """Full-batch Adam on the ``keep`` features that differ most between the classes.

    Features of fewer than ``least`` documents are left out; the two classes
    weigh the same in total. One class alone: a constant.
    """
    pos = max(1, int(y.sum()))
    neg = max(1, n - pos)
    count = np.bincount(flat)
    with_pos = np.bincount(flat, y[doc], len(count))
    share, base = with_pos / np.maximum(count, 1), y.mean() if n else 0.0
    z = np.abs(share - base) * np.sqrt(count) / max(np.sqrt(base * (1 - base)), 1e-9)
    z[count < least] = 0
    order = np.argsort(-z, kind="stable")[:keep]
    order = np.sort(order[z[order] > 2])
    place = np.full(len(count), -1, np.int32)
    place[order] = np.arange(len(order))
    hit = place[flat] >= 0
    col, row = place[flat[hit]], doc[hit]
    k, d = len(order), dense.shape[1]
    w = np.zeros(k + d + 1)
    if not 0 < y.sum() < n:
        w[-1] = 30 if n and y.all() else -30
        return Linear(order, w)
    importance = np.where(y > 0, 0.5 / pos, 0.5 / neg)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        score = np.bincount(row, w[col], n) + dense @ w[k:-1] + w[-1]
        err = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) * importance
        g = np.r_[np.bincount(col, err[row], k), dense.T @ err, err.sum()]
        g[:-1] += l2 * w[:-1] / max(1, k) ** 0.5
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return Linear(order, w)


@dataclass
class Chain:
    """Models in sequence; each sees the probabilities of the earlier categories."""

    names: list[str]
    models: list[Linear]
    thresholds: list[float]

    def probabilities(self, flat: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        p = np.zeros((n, 0))
        for model in self.models:
            p = np.column_stack([p, model.scores(flat, doc, n, p)])
        return p


LEAST_PRECISION = 0.5  # under it a category's cut does more harm than good


def _best_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The cut with the best F1 among those of this precision or more, halfway between the probabilities around it.

    Where none is so precise, as with few labels or some wrong ones among the
    highest, the best of those that are right at least every other time. Where
    held-out labels cannot even tell that much, or none is positive, the
    category is never set: infinity, with a warning.
    """
    if y.any():
        order = np.argsort(-p, kind="stable")
        hits = np.cumsum(y[order])
        taken = np.arange(1, len(y) + 1)
        f1 = 2 * hits / (taken + y.sum())
        f1[:-1][p[order][:-1] == p[order][1:]] = 0  # ties fall on one side
        for least in (precision, min(precision, LEAST_PRECISION)):
            good = np.where(hits >= least * taken, f1, 0.0)
            if good.any():
                at = int(np.argmax(good))
                return float((p[order][at] + (p[order][at + 1] if at + 1 < len(y) else 0)) / 2)
        warnings.warn(f"{len(y)} held-out labels do not tell a category apart: it is never set", stacklevel=2)
    return math.inf


def fit_chain(flat: np.ndarray, doc: np.ndarray, labels: np.ndarray, names: list[str], fold: np.ndarray, folds: int = 3, precision: float = 0.9) -> Chain:
    """Later models are trained on out-of-fold probabilities of the earlier ones; cuts come from those of their own."""
    n = len(labels)
    held, models, cuts = np.zeros((n, 0)), [], []
    for j in range(len(names)):
        y = labels[:, j].astype(float)
        out = np.zeros(n)
        for f in range(folds):
            inside = fold != f
            part = inside[doc]
            number = (np.cumsum(inside) - 1).astype(np.int32)
            model = fit_linear(flat[part], number[doc[part]], int(inside.sum()), held[inside], y[inside])
            number = (np.cumsum(~inside) - 1).astype(np.int32)
            out[~inside] = model.scores(flat[~part], number[doc[~part]], int((~inside).sum()), held[~inside])
        models.append(fit_linear(flat, doc, n, held, y))
        cuts.append(_best_threshold(out, y, precision))
        held = np.column_stack([held, out])
    return Chain(names, models, cuts)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], max_rows: int = 10_000, precision: float = 0.9, key: str = "doc_id", text: str = "text") -> Chain:
    """Fits a chain on at most ``max_rows`` labelled documents, chosen by a hash of their ids.

    A category is set where held-out documents were right in a share of at least ``precision``.

    Rows without an id or with a null category are left out. The chosen labels,
    whose number is bounded by the parameter, are broadcast to the scan of
    docs; only feature numbers of the sample reach the driver.
    """
    names = list(categories)
    known = labels.select(F.col(key).alias("doc_id"), *(c.cast("int").alias(n) for n, c in categories.items())).dropna()
    known = known.dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(known), "doc_id")
    out = pa.schema([("doc_id", pa.int64()), ("y", pa.list_(pa.int64())), ("x", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = zip(*(b.column(c).to_pylist() for c in names))
            x = [features(t or "").astype(np.int32).tobytes() for t in b.column("text").to_pylist()]
            yield rows((b.column("doc_id").to_pylist(), [list(v) for v in y], x), out)

    got = sample.mapInArrow(run, "doc_id long, y array<long>, x binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.x)))
    xs = [np.frombuffer(r.x, np.int32) for r in got]
    flat = np.concatenate([np.zeros(0, np.int32), *xs])
    doc = np.repeat(np.arange(len(xs), dtype=np.int32), [len(x) for x in xs])
    # Features too rare for any model go at once, the others are numbered in order.
    enough = np.bincount(flat, minlength=1) >= LEAST
    flat, doc = flat[enough[flat]], doc[enough[flat]]
    flat = (np.cumsum(enough, dtype=np.int32) - 1)[flat]
    y = np.array([r.y for r in got], np.int64).reshape(-1, len(names))
    fold = np.array([xxhash.xxh32_intdigest(str(r.doc_id)) % 3 for r in got], np.int64)
    del got, xs
    chain = fit_chain(flat, doc, y, names, fold, precision=precision)
    known = np.flatnonzero(enough)
    for model in chain.models:
        model.chosen = known[model.chosen]
    return chain


class Scorer:
    """Probabilities of texts; keeps which features of a word any model uses."""

    def __init__(self, chain: Chain, limit: int = 300_000):
        self.chain, self.limit = chain, limit
        self.used = {int(c) for m in chain.models for c in m.chosen}
        self.known: dict[str, list[int]] = {}

    def _of(self, w: str) -> list[int]:
        if len(self.known) > self.limit:
            self.known.clear()
        digest = xxhash.xxh32_intdigest
        keys = [w, "^" + w[:4], "^" + w[:5]] if len(w) > 5 else [w]
        self.known[w] = hit = [k for k in (digest(x) & (SPACE - 1) for x in keys) if k in self.used]
        return hit

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        flat, size = [], []
        for t in texts:
            mine: set[int] = set()
            for w in set(WORD.findall((t or "").lower())):
                hit = self.known.get(w)
                if hit is None:
                    hit = self._of(w)
                if hit:
                    mine.update(hit)
            flat.extend(mine)
            size.append(len(mine))
        return self.chain.probabilities(np.array(flat, np.int64), np.repeat(np.arange(len(size)), size), len(size))


def score(docs: DataFrame, chain: Chain, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_<category>..., is_<category>...) for every row of docs, read once and not shuffled.

    Null and empty texts have no features: their probabilities are the models'
    constants. Null ids stay null; repeated rows give repeated rows.
    """
    names = chain.names
    fields = ["doc_id long", *(f"p_{n} double" for n in names), *(f"is_{n} boolean" for n in names)]
    out = pa.schema([("doc_id", pa.int64()), *((f"p_{n}", pa.float64()) for n in names), *((f"is_{n}", pa.bool_()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for b in batches:
            p = scorer(b.column("text").to_pylist())
            cut = p >= np.array(chain.thresholds)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(c) for c in p.T), *(pa.array(c) for c in cut.T)], schema=out)

    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ", ".join(fields))


def keep_clean(docs: DataFrame, chain: Chain, category: str = "toxic", text: str = "text") -> DataFrame:
    """Rows of docs, with all their columns, that the chain does not place in the category; null texts count as empty."""
    at = chain.names.index(category)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(chain)
        for b in batches:
            p = scorer(b.column(text).to_pylist())
            yield b.filter(pa.array(p[:, at] < chain.thresholds[at]))

    return docs.mapInArrow(run, docs.schema)
