"""Language-model scores by stupid backoff over n-gram count tables."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from foldline.llm.anchors import gram_hashes
from foldline.llm.common import n_parts, rows, stage
from foldline.llm.passages import documents

CHUNK_CHARS = 2_500_000  # text whose n-grams are counted together before the shuffle
BUCKET_GRAMS = 1 << 21  # n-grams that one bucket of a count table is meant to hold
KEPT = 5  # bytes of a hash beside those that name its bucket
TABLE_SCHEMA = pa.schema([("bucket", pa.int64()), ("chunk", pa.int64()), ("n", pa.int32()), ("fold", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
TOTAL_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int32()), ("fold", pa.int32()), ("counts", pa.binary()), ("even", pa.int64()), ("odd", pa.int64())])
SCORE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("log_score", pa.float64())])


def word_hashes(raw: bytes) -> np.ndarray:
    w = raw.split()
    return np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w))


def _packed(h: np.ndarray) -> bytes:
    """The KEPT bytes below the two highest bytes' bucket bits; see ``_shift``."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def _unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(b, np.uint8).reshape(-1, KEPT)
    return out.view("<u8").ravel()


class Grams:
    """The n-grams of some documents, for the given numbers n, which are the keys of all tables."""

    def __init__(self, texts: list[bytes], orders: Iterable[int], bits: int):
        per_doc = [word_hashes(t) for t in texts]
        self.sizes = np.array([len(x) for x in per_doc], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *per_doc])
        doc = np.repeat(np.arange(len(texts)), self.sizes)
        self.doc = doc
        self.ends: dict[int, np.ndarray] = {}  # last word of each n-gram
        self.unique: dict[int, np.ndarray] = {}
        self.inverse: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        mask = np.uint64((1 << (8 * KEPT)) - 1)
        for n in orders:
            h = gram_hashes(flat, n)
            at = np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(h) else np.zeros(0, np.int64)
            # Bucket in front, then the bytes that are kept.
            key = ((h[at] >> np.uint64(64 - bits)) << np.uint64(8 * KEPT)) | ((h[at] >> np.uint64(1)) & mask)
            unique, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
            self.ends[n], self.unique[n], self.inverse[n], self.counts[n] = at + n - 1, unique, inverse, counts

    def buckets(self, n: int) -> Iterator[tuple[int, slice]]:
        b = (self.unique[n] >> np.uint64(8 * KEPT)).astype(np.int64)
        cut = np.flatnonzero(np.diff(b)) + 1
        for s, e in zip(np.r_[0, cut], np.r_[cut, len(b)]):
            if e > s:
                yield int(b[s]), slice(int(s), int(e))


def _chunks(batches: Iterator[pa.RecordBatch], names: tuple[str, ...]) -> Iterator[tuple[int, int, list[tuple]]]:
    """Rows of sorted batches by (chunk, fold)."""
    now, held = None, []
    for b in batches:
        for chunk, fold, *row in zip(*(b.column(c).to_pylist() for c in ("chunk", "fold", *names))):
            if now != (chunk, fold):
                if held:
                    yield *now, held
                now, held = (chunk, fold), []
            held.append(tuple(row))
    if held:
        yield *now, held


def score(docs: DataFrame, order: int = 3, backoff: float = 0.4, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score): sum of log stupid-backoff scores of a document's words.

    Documents of even and odd ids (null: even) are two halves, and each half
    is scored with the counts of the other, so that no text vouches for itself.
    A word's score is the count of the longest n-gram that ends in it and is
    known, over the count of its context, times ``backoff`` for every order
    below the highest possible; a word that is not known counts as one among
    all words of the other half.

    Documents are dealt into chunks by a hash of their ids. A chunk counts its
    n-grams and sends each once to the table bucket of its hash; buckets add up
    and send the other half's counts back to the chunks that asked; a chunk
    looks its n-grams up and sums per document. A frequent n-gram is thus one
    row of each chunk at most. Null and empty texts: no words, score 0; null
    ids stay null; repeated rows are documents of their own.
    """
    total = docs.agg(F.sum(F.length(text))).first()[0] or 0
    n_chunks = max(1, -(-total // CHUNK_CHARS))
    bits = max(1, math.ceil(math.log2(max(2, total // 6 * order / BUCKET_GRAMS))))
    src = documents(docs, key, text)
    fold = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(2)).cast("int")
    src = src.select(F.pmod(F.xxhash64("doc_id", "digest"), F.lit(n_chunks)).alias("chunk"), fold.alias("fold"), "doc_id", "text")

    def count(orders: list[int]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for chunk, half, held in _chunks(batches, ("text",)):
                grams = Grams([t.encode() for (t,) in held], orders, bits)
                for n in orders:
                    done = [(b, chunk, n, half, _packed(grams.unique[n][s]), grams.counts[n][s].astype("<u4").tobytes()) for b, s in grams.buckets(n)]
                    if done:
                        yield rows(list(zip(*done)), TABLE_SCHEMA)

        return run

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def close() -> pa.RecordBatch:
            bucket, n = now
            asked = [_unpacked(g) for _, _, g, _ in held]
            unique, inverse = np.unique(np.concatenate(asked), return_inverse=True)
            half = np.repeat([f for _, f, _, _ in held], [len(a) for a in asked])
            weight = np.concatenate([np.frombuffer(c, "<u4") for _, _, _, c in held])
            sums = np.stack([np.bincount(inverse[half == f], weight[half == f], len(unique)) for f in (0, 1)])
            done, at = [], 0
            for (chunk, f, _, _), a in zip(held, asked):
                back = sums[1 - f][inverse[at : at + len(a)]]
                done.append((chunk, bucket, n, f, np.minimum(back, 0xFFFFFFFF).astype("<u4").tobytes(), int(sums[0].sum()), int(sums[1].sum())))
                at += len(a)
            return rows(list(zip(*done)), TOTAL_SCHEMA)

        for b in batches:
            for bucket, n, *row in zip(*(b.column(c).to_pylist() for c in ("bucket", "n", "chunk", "fold", "grams", "counts"))):
                if now != (bucket, n):
                    if held:
                        yield close()
                    now, held = (bucket, n), []
                held.append(tuple(row))
        if held:
            yield close()

    parts = n_parts(docs)

    def count_tables(orders: list[int]) -> DataFrame:
        """The longest n-grams have a pass of their own, so that a pass's shuffle files are gone before the next."""
        dealt = src.repartition(parts, "chunk").sortWithinPartitions("chunk", "fold")
        tables = dealt.mapInArrow(count(orders), "bucket long, chunk long, n int, fold int, grams binary, counts binary")
        dealt = tables.repartition(parts, "bucket").sortWithinPartitions("bucket", "n")
        return stage(dealt.mapInArrow(add_up, "chunk long, bucket long, n int, fold int, counts binary, even long, odd long"), "totals")

    passes = [list(range(1, max(2, order))), *([[order]] if order > 1 else [])]
    totals = reduce(DataFrame.unionByName, [count_tables(p) for p in passes])
    # Every row of a bucket has the bucket's sums; the sums over buckets are all words of a half.
    per_bucket = totals.where("n = 1").groupBy("bucket").agg(F.max("even").alias("even"), F.max("odd").alias("odd"))
    halves = per_bucket.agg(F.sum("even"), F.sum("odd")).first()
    size = [max(1, x or 0) for x in halves]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, half, held in _chunks(batches, ("doc_id", "text", "n", "bucket", "counts")):
            texts = [(d, t.encode()) for d, t, n, _, _ in held if n == 0]
            grams = Grams([t for _, t in texts], range(1, order + 1), bits)
            known: list[np.ndarray] = []
            for n in range(1, order + 1):
                mine = sorted((b, c) for _, _, k, b, c in held if k == n)
                counts = np.frombuffer(b"".join(c for _, c in mine), "<u4").astype(np.float64)
                if len(counts) != len(grams.unique[n]):
                    raise RuntimeError("the documents changed between two reads")
                at = np.zeros(len(grams.doc))
                at[grams.ends[n]] = counts[grams.inverse[n]]
                known.append(at)
            words = len(grams.doc)
            room = np.arange(words) - np.repeat(np.cumsum(grams.sizes) - grams.sizes, grams.sizes)  # words before it
            scores = np.log(np.maximum(known[0], 1) / size[1 - half])
            factor = math.log(backoff)
            for n in range(2, order + 1):
                possible = room >= n - 1
                context = np.r_[0.0, known[n - 2][:-1]] if words else known[0]
                seen = possible & (known[n - 1] > 0)
                scores = np.where(seen, np.log(np.where(seen, known[n - 1], 1) / np.where(seen, context, 1)), scores + possible * factor)
            sums = np.bincount(grams.doc, scores, len(texts))
            yield rows(([d for d, _ in texts], grams.sizes, sums), SCORE_SCHEMA)

    blank = lambda t: F.lit(None).cast(t)
    asked = totals.select("chunk", "fold", blank("long").alias("doc_id"), blank("string").alias("text"), "n", "bucket", "counts")
    read = src.select("chunk", "fold", "doc_id", "text", F.lit(0).alias("n"), blank("long").alias("bucket"), blank("binary").alias("counts"))
    both = asked.unionByName(read).repartition(parts, "chunk").sortWithinPartitions("chunk", "fold")
    return both.mapInArrow(look_up, "doc_id long, n_words long, log_score double")
