"""Document quality by a factorisation machine.

A score is a constant, a weight for every feature, and for every pair of
features the product of their low-rank vectors. The pairs are never listed:
their sum is half of (the square of the summed vectors less the sum of their
squares), so a document is scored in time linear in its features.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from foldline.llm.common import rows, texts

SPACE = 1 << 22  # hashed words
LEAST = 5  # documents of the sample that a word must be in
BINS = 12  # steps of a structure statistic, and one for "no value"

#: Statistics of a text, each from 0 up; nan where it has no value.
STATISTICS = (
    "log_bytes log_words log_lines letters upper digits spaces beyond_ascii marks commas bars bangs stars hashes "
    "bytes_a_word distinct_words repeated_words distinct_lines capital_words words_with_marks longest_word short_words"
).split()

_SPACES = b" \t\n\x0b\x0c\r"
_MARKS = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_NO_MARKS = bytes(32 if b in _MARKS else b for b in range(256))


def statistics(raw: bytes, words: list[bytes], distinct: int) -> list[float]:
    """Values of STATISTICS from one count of the bytes and the list of words."""
    n, n_words = len(raw), len(words)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    lines = raw.split(b"\n")
    some, any_words = max(n, 1), max(n_words, 1)
    upper, lower = int(count[65:91].sum()), int(count[97:123].sum())
    marks = int(count[list(_MARKS)].sum())
    sizes = np.fromiter(map(len, words), np.int64, n_words)
    repeated = sum(map(bytes.__eq__, words, words[1:]))
    capital = sum(map(bytes.isupper, words))
    ends = sum(w[-1] in _MARKS for w in words)
    none = np.nan
    return [
        np.log1p(n),
        np.log1p(n_words),
        np.log1p(len(lines)),
        (upper + lower) / some if n else none,
        upper / max(1, upper + lower) if upper + lower else none,
        int(count[48:58].sum()) / some if n else none,
        int(count[list(_SPACES)].sum()) / some if n else none,
        int(count[128:].sum()) / some if n else none,
        marks / any_words if n_words else none,
        int(count[44] + count[46]) / any_words if n_words else none,
        int(count[124]) / any_words if n_words else none,
        int(count[33]) / any_words if n_words else none,
        int(count[42] + count[36] + count[37] + count[38]) / any_words if n_words else none,
        int(count[35]) / any_words if n_words else none,
        sizes.mean() if n_words else none,
        distinct / any_words if n_words else none,
        repeated / any_words if n_words else none,
        len(set(lines)) / len(lines),
        capital / any_words if n_words else none,
        ends / any_words if n_words else none,
        np.log1p(sizes.max()) if n_words else none,
        float((sizes < 3).mean()) if n_words else none,
    ]


@dataclass
class Machine:
    """A fitted factorisation machine over numbered features: bins of statistics and metadata first, then words."""

    edges: np.ndarray  # inner borders of the bins, one row for each statistic
    words: np.ndarray  # hashes of the words it knows, ascending
    constant: float
    weight: np.ndarray
    factor: np.ndarray  # features x rank

    @property
    def n_bins(self) -> int:
        return len(self.edges) * (BINS + 1)

    def binned(self, values: np.ndarray) -> np.ndarray:
        """Feature number of every statistic of every row."""
        at = np.stack([np.searchsorted(e, v, "right") for e, v in zip(self.edges, values.T)], axis=1).reshape(values.shape)
        return np.where(np.isnan(values), BINS, at) + np.arange(len(self.edges)) * (BINS + 1)

    def logits(self, feature: np.ndarray, value: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Every document has a feature; ``starts`` has the place of its first."""
        if not len(starts):
            return np.zeros(0)
        linear = np.add.reduceat(self.weight[feature] * value, starts)
        vx = self.factor[feature] * value[:, None]
        total, squares = np.add.reduceat(vx, starts), np.add.reduceat(vx * vx, starts)
        return self.constant + linear + 0.5 * (total * total - squares).sum(axis=1)


def _flat(machine: Machine, values: np.ndarray, words: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, their values and first places of documents: bins weigh one each, words together one in square."""
    bins = machine.binned(values)
    size = np.array([bins.shape[1] + len(w) for w in words], np.int64)
    feature = np.concatenate([np.zeros(0, np.int64), *(x for b, w in zip(bins, words) for x in (b, w + machine.n_bins))])
    value = np.concatenate([np.zeros(0), *(x for w in words for x in (np.ones(bins.shape[1]), np.full(len(w), 1 / max(1, len(w)) ** 0.5)))])
    return feature, value, np.r_[0, np.cumsum(size)[:-1]] if len(size) else np.zeros(0, np.int64)


def fit_machine(values: np.ndarray, words: list[np.ndarray], y: np.ndarray, rank: int = 8, keep: int = 8192, steps: int = 24, batch: int = 256, l2: float = 2e-5, seed: int = 3) -> Machine:
    """Mini-batch Adam on the logistic loss; both classes weigh the same.

    The bins are the sample's quantiles. Of the words that at least ``LEAST``
    documents have, the ``keep`` that differ most between the classes are used.
    One class alone: a constant.
    """
    n, pos = len(y), int(y.sum())
    cuts = np.linspace(0, 1, BINS + 1)[1:-1]
    # A statistic without any value has no border.
    edges = np.stack([np.quantile(v[~np.isnan(v)], cuts) if (~np.isnan(v)).any() else np.full(len(cuts), np.inf) for v in values.T]) if n else np.full((values.shape[1], len(cuts)), np.inf)
    flat = np.concatenate([np.zeros(0, np.int32), *words])
    doc = np.repeat(np.arange(n), [len(w) for w in words])
    count, with_pos = np.bincount(flat, minlength=1), np.bincount(flat, y[doc], minlength=1)
    base = y.mean() if n else 0.0
    z = np.abs(with_pos - base * count) / np.sqrt(np.maximum(count, 1))
    z[count < LEAST] = 0
    chosen = np.argsort(-z, kind="stable")[:keep]
    chosen = np.sort(chosen[z[chosen] > 0])
    machine = Machine(edges, chosen, 0.0, np.zeros(0), np.zeros((0, rank)))
    n_features = machine.n_bins + len(chosen)
    machine.weight = np.zeros(n_features)
    machine.factor = np.random.default_rng(seed).normal(0, 0.05, (n_features, rank))
    if not 0 < pos < n:
        machine.factor[:] = 0
        machine.constant = 8.0 if n and pos else -8.0 if n else 0.0
        return machine
    known = [_numbers(chosen, w) for w in words]
    feature, value, starts = _flat(machine, values, known)
    ends = np.r_[starts[1:], len(feature)]
    importance = np.where(y > 0, 0.5 / pos, 0.5 / (n - pos)) * n
    means = [np.zeros(1), np.zeros_like(machine.weight), np.zeros_like(machine.factor)]
    squares = [np.zeros_like(m) for m in means]
    rng, t = np.random.default_rng(seed), 0
    for step in range(steps):
        rate = 0.02 * (1 - step / steps)
        for part in np.array_split(rng.permutation(n), max(1, n // batch)):
            t += 1
            size = ends[part] - starts[part]
            at = np.repeat(starts[part] - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
            f, x, row = feature[at], value[at][:, None], np.repeat(np.arange(len(part)), size)
            vx = machine.factor[f] * x
            first = np.r_[0, np.cumsum(size)[:-1]]
            total = np.add.reduceat(vx, first)
            logit = machine.constant + np.add.reduceat(machine.weight[f] * x[:, 0], first) + 0.5 * (total**2 - np.add.reduceat(vx**2, first)).sum(axis=1)
            err = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[part]) * importance[part] / len(part)
            used, place = np.unique(f, return_inverse=True)
            pull = err[row][:, None] * x
            g_w = np.bincount(place, pull[:, 0], len(used)) + l2 * machine.weight[used]
            g_v = np.stack([np.bincount(place, pull[:, 0] * (total[row, k] - vx[:, k]), len(used)) for k in range(rank)], axis=1) + l2 * machine.factor[used]
            for k, (target, of, g) in enumerate(((None, slice(None), err.sum(keepdims=True)), (machine.weight, used, g_w), (machine.factor, used, g_v))):
                means[k][of] = 0.9 * means[k][of] + 0.1 * g
                squares[k][of] = 0.999 * squares[k][of] + 0.001 * g * g
                move = rate * (means[k][of] / (1 - 0.9**t)) / (np.sqrt(squares[k][of] / (1 - 0.999**t)) + 1e-8)
                if target is None:
                    machine.constant -= float(move[0])
                else:
                    target[of] -= move
    return machine


def _numbers(known: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Places among the known word hashes of those that are known."""
    if not len(known):
        return np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return at[known[at] == words]


def word_hashes(distinct: set[bytes]) -> np.ndarray:
    digest = xxhash.xxh32_intdigest
    return np.array(sorted({digest(w) & (SPACE - 1) for w in distinct}), np.int64)


def _source(docs: DataFrame, key: str, text: str, metadata: Sequence[str]) -> DataFrame:
    """doc_id, text and one numeric column for each metadata name; a missing column has no value."""
    kinds = dict(docs.dtypes)
    found = [F.col(c).cast("double") if c in kinds else F.lit(None).cast("double") for c in metadata]
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"), *(c.alias(f"meta{i}") for i, c in enumerate(found)))


def _meta(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """log(1 + value) of the metadata columns, nan for null or negative values."""
    cols = [batch.column(f"meta{i}").cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False) for i in range(n)]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(np.stack(cols, axis=1) >= 0, np.log1p(np.stack(cols, axis=1)), np.nan) if cols else np.zeros((batch.num_rows, 0))


def held_out(key: Column) -> Column:
    """Rows that no model learns from: crc32 of the id as text leaves 1 when divided by 3; no id: false."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", metadata: Sequence[str] = ("n_chars",), max_rows: int = 10_000, key: str = "doc_id", text: str = "text") -> Machine:
    """Fits a machine on at most ``max_rows`` labelled documents outside the held-out third, chosen by a hash of their ids.

    Label rows without an id or a label are left out, and one of several for an
    id counts. The chosen labels, bounded by the parameter, are broadcast to
    the scan of docs; word hashes and statistics of the sample reach the driver.
    """
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna().where(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    sample = _source(docs, key, text, metadata).join(F.broadcast(known), "doc_id")
    out = pa.schema([("doc_id", pa.int64()), ("y", pa.int64()), ("stats", pa.list_(pa.float64())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stats, hashes = [], []
            for raw, meta in zip(texts(b), _meta(b, len(metadata))):
                words = raw.split()
                distinct = set(words)
                stats.append([*statistics(raw, words, len(distinct)), *meta])
                hashes.append(word_hashes({x for w in distinct for x in _bare(w)}).astype(np.int32).tobytes())
            yield rows((b.column("doc_id").to_pylist(), b.column("y").to_pylist(), stats, hashes), out)

    got = sample.mapInArrow(run, "doc_id long, y long, stats array<double>, words binary").collect()
    got.sort(key=lambda r: (r.doc_id, bytes(r.words)))
    values = np.array([r.stats for r in got], float).reshape(len(got), len(STATISTICS) + len(metadata))
    words = [np.frombuffer(r.words, np.int32) for r in got]
    return fit_machine(values, words, np.array([r.y > 0 for r in got], float))


def _bare(w: bytes) -> list[bytes]:
    """A word without marks, A-Z lower-cased; marks inside cut it."""
    return w.lower().translate(_NO_MARKS).split()


class Scorer:
    """Logits of texts; remembers which known features a word has."""

    def __init__(self, machine: Machine, limit: int = 300_000):
        self.machine, self.limit = machine, limit
        self.place = {int(h): i for i, h in enumerate(machine.words)}
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _of(self, w: bytes) -> tuple[int, ...]:
        if len(self.known) > self.limit:
            self.known.clear()
        digest, place = xxhash.xxh32_intdigest, self.place
        hit = tuple(place[h] for h in (digest(x) & (SPACE - 1) for x in _bare(w)) if h in place)
        self.known[w] = hit
        return hit

    def __call__(self, raws: list[bytes], meta: np.ndarray) -> np.ndarray:
        stats, found = [], []
        known = self.known
        for raw in raws:
            words = raw.split()
            distinct = set(words)
            mine: set[int] = set()
            for w in distinct:
                hit = known.get(w)
                if hit is None:
                    hit = self._of(w)
                if hit:
                    mine.update(hit)
            stats.append(statistics(raw, words, len(distinct)))
            found.append(np.array(sorted(mine), np.int64))
        values = np.concatenate([np.array(stats, float).reshape(len(raws), len(STATISTICS)), meta], axis=1)
        return self.machine.logits(*_flat(self.machine, values, found))


def score(docs: DataFrame, machine: Machine, metadata: Sequence[str] = ("n_chars",), key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs, read once and not shuffled.

    score is the probability of label 1, above 0.5 for predicted 1. Null texts
    count as empty: no words, and statistics without a value have a bin of
    their own, as null metadata have. Null ids stay null; repeated rows give
    repeated rows; columns of docs beside key, text and metadata are not read.
    """
    out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
    n_meta = len(metadata)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(machine)
        for b in batches:
            z = scorer(texts(b), _meta(b, n_meta))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], schema=out)

    scored = _source(docs, key, text, metadata).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
