"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldline.llm.common import n_parts, row_digest, rows

PRIME = (1 << 31) - 1
BASES = (911382323, 972663749)
INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)


STEP = 1 << 16


def _ladder(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1)."""
    out, done = np.ones(n, np.uint64), 1
    while done < n:  # the next stretch is the first one times base ** done
        step = min(done, n - done)
        out[done : done + step] = out[:step] * np.uint64(pow(base, done, PRIME)) % np.uint64(PRIME)
        done += step
    return out


@lru_cache(maxsize=None)
def _low(base: int) -> np.ndarray:
    return _ladder(base, STEP)


def _powers(base: int, at: np.ndarray | int) -> np.ndarray:
    """base ** at, or of 0 .. at - 1 for a number; two short tables serve texts of any length."""
    low = _low(base)
    if isinstance(at, int):
        if at <= STEP:
            return low[:at]
        at = np.arange(at)
    high = _ladder(pow(base, STEP, PRIME), (int(at.max(initial=0)) >> 16) + 1)
    return low[at & (STEP - 1)] * high[at >> 16] % np.uint64(PRIME)


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo the Mersenne prime, for x below 2 ** 63, by folding its upper bits down."""
    prime, shift = np.uint64(PRIME), np.uint64(31)
    y = x >> shift
    y += x & prime
    z = y >> shift
    y &= prime
    y += z
    y[y >= prime] -= prime
    return y


class PrefixHash:
    """Modular prefix arrays of one text: any span's hash in constant time.

    Two polynomials modulo a prime of 31 bits; spans of equal code points have
    equal hashes wherever they stand, in this text or another.
    """

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        c = codes.astype(np.uint64) + np.uint64(1)
        self.sums = np.zeros((len(BASES), self.n + 1), np.uint64)
        for row, base in zip(self.sums, BASES):
            np.cumsum(_mod(c * _powers(base, self.n)), out=row[1:])
            row[1:] = _mod(row[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hashes of the spans [start, end)."""
        out = np.zeros(len(starts), np.uint64)
        for row, base in zip(self.sums, INVERSES):
            h = _mod((row[ends] + np.uint64(PRIME) - row[starts]) * _powers(base, starts))
            out = (out << np.uint64(31)) | h
        return out

    def windows(self, k: int) -> np.ndarray:
        """Hashes of all spans of k code points."""
        m = self.n - k + 1
        out = np.zeros(m, np.uint64)
        for row, base in zip(self.sums, INVERSES):
            out = (out << np.uint64(31)) | _mod((row[k:] + np.uint64(PRIME) - row[:m]) * _powers(base, m))
        return out


def common_extension(a: PrefixHash, i: np.ndarray, b: PrefixHash, j: np.ndarray) -> np.ndarray:
    """Length of the longest common extension of a from i and b from j, for arrays of places, by binary search.

    The search doubles its reach first, so short extensions take few steps.
    """
    i, j = np.asarray(i), np.asarray(j)
    low, reach = np.zeros(len(i), np.int64), np.ones(len(i), np.int64)
    high = np.minimum(a.n - i, b.n - j)
    growing = low < high
    while (open_ := low < high).any():
        mid = np.where(growing, np.minimum(low + reach, high), (low + high + 1) // 2)
        same = a.spans(i, i + mid) == b.spans(j, j + mid)
        low, high = np.where(open_ & same, mid, low), np.where(open_ & ~same, mid - 1, high)
        reach, growing = reach * 2, growing & same
    return low


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(prefix: PrefixHash, span: int) -> np.ndarray:
    """Mixed hashes (32 bits) of all spans, by start; a shorter text is one span, an empty one none."""
    if not prefix.n:
        return np.zeros(0, np.uint32)
    return (_mix(prefix.windows(min(span, prefix.n))) >> np.uint64(32)).astype(np.uint32)


def edited_hashes(old: PrefixHash, old_codes: np.ndarray, old_hashes: np.ndarray, new_codes: np.ndarray, new_hashes: np.ndarray, span: int) -> np.ndarray:
    """Span hashes of the old text with its last quarter replaced by the new one's head.

    A span's hash does not depend on where it stands: those left of the seam
    are the old text's, those right of it the new one's, and only spans across
    it are hashed.
    """
    kept = old.n - old.n // 4
    head = min(old.n // 4, len(new_codes))
    if kept + head < 2 * span:
        return span_hashes(PrefixHash(np.concatenate([old_codes[:kept], new_codes[:head]])), span)
    seam = np.concatenate([old_codes[max(0, kept - span + 1) : kept], new_codes[: min(head, span - 1)]])
    across = span_hashes(PrefixHash(seam), span) if len(seam) >= span else old_hashes[:0]
    return np.concatenate([old_hashes[: max(0, kept - span + 1)], across, new_hashes[: max(0, head - span + 1)]])


def sketch(h: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` smallest distinct hashes, ascending."""
    bound = 3 * size
    while bound < len(h):  # among those below so much of the range are likely enough
        low = np.unique(h[h < np.uint32(bound * 0xFFFFFFFF // len(h))])
        if len(low) >= size:
            return low[:size]
        bound *= 4  # repeats: look further
    return np.unique(h)[:size]


def likeness(a: np.ndarray, b: np.ndarray, size: int) -> float:
    """Estimated Dice coefficient of two texts' span sets from their sketches, 0 to 1; two empty texts are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    again = both[1:] == both[:-1]  # values that both have
    distinct = both[np.r_[True, ~again]][:size]
    share = np.count_nonzero(both[1:][again] <= distinct[-1]) / len(distinct)
    return float(2 * share / (1 + share))


def as_text(s: np.ndarray) -> str:
    return s.astype(">u4").tobytes().hex()


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"
SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("common_prefix", pa.int64())]
)


def _ordinals(o: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Pairs as byte strings in the order of the pairs."""
    flip = np.uint64(1 << 63)
    both = np.stack([o.astype(np.int64).view(np.uint64) ^ flip, digest.astype(np.int64).view(np.uint64) ^ flip], axis=1)
    return np.ascontiguousarray(both.astype(">u8")).view("S16").ravel()


def consecutive(docs: DataFrame, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(part, tail, doc_id, text): parts of consecutive documents in order of (doc_id, text digest), null ids first.

    A part lies in one partition, in order; its last row (tail 1) is the first
    row of the next part once more, and of the first part after the last. Texts
    are shuffled once. Rows of one id are split by their texts. The parts' first
    rows, one for each of a number of parts that the session's partitions fix,
    are all that passes the driver.
    """
    parts = parts or 4 * n_parts(docs)
    order = F.coalesce(F.col(key).cast("long"), F.lit(-(1 << 63)))
    ranged = docs.select(order.alias("o"), row_digest(text).alias("digest")).repartitionByRange(parts, "o", "digest")
    firsts = ranged.groupBy(F.spark_partition_id()).agg(F.min(F.struct("o", "digest")).alias("first")).collect()
    cuts = np.sort(_ordinals(np.array([r.first.o for r in firsts], np.int64), np.array([r.first.digest for r in firsts], np.int64)))

    @F.pandas_udf("array<int>")
    def places(o: pd.Series, digest: pd.Series) -> pd.Series:
        mine = _ordinals(o.to_numpy(), digest.to_numpy())
        at = np.searchsorted(cuts, mine, "right") - 1
        first = cuts[at] == mine
        return pd.Series([[p, -((p - 1) % len(cuts)) - 1] if f else [p] for p, f in zip(at.tolist(), first.tolist())])

    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), order.alias("o"), row_digest(text).alias("digest"))
    dealt = src.withColumn("place", F.explode(places("o", "digest")))
    dealt = dealt.select(F.expr("if(place < 0, -place - 1, place)").alias("part"), (F.col("place") < 0).alias("tail"), "o", "digest", "doc_id", "text")
    return dealt.repartition(n_parts(docs), "part").sortWithinPartitions("part", "tail", "o", "digest").select("part", "tail", "doc_id", "text")


def neighbour_fingerprints(docs: DataFrame, span: int = 16, size: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next text are.

    The edited text has its last quarter of code points replaced by the first
    as many of the next document (by id; rows of one id by text digest). The
    fingerprint is the ``size`` smallest span hashes in hex; likeness is the
    Dice coefficient of span sets as the fingerprints estimate it.
    common_prefix is the longest common extension of text and edited text from
    their starts. Null texts are empty and have an empty fingerprint; null ids
    come first; a single document is its own next; no rows: no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None  # part, id, text, codes, prefix, sketch
        for b in batches:
            done = []
            for part, tail, doc, t in zip(*(b.column(c).to_pylist() for c in ("part", "tail", "doc_id", "text"))):
                if tail and before is None:
                    continue
                codes = codes_of(t)
                prefix = PrefixHash(codes)
                hashes = span_hashes(prefix, span)
                own = sketch(hashes, size)
                if before and before[0] == part:
                    _, old_doc, old_text, old_codes, old_prefix, old_hashes, old = before
                    n = len(old_codes)
                    kept = n - n // 4
                    edited = sketch(edited_hashes(old_prefix, old_codes, old_hashes, codes, hashes, span), size)
                    sha = hashlib.sha256((old_text[:kept] + t[: n // 4]).encode()).hexdigest()
                    # Up to the seam the two are one text.
                    same = kept + int(common_extension(old_prefix, np.array([kept]), prefix, np.zeros(1, np.int64))[0])
                    done.append((old_doc, n, sha, as_text(old), as_text(edited), likeness(old, edited, size), likeness(old, own, size), same))
                before = None if tail else (part, doc, t, codes, prefix, hashes, own)
            if done:
                yield rows(list(zip(*done)), SCHEMA)

    return consecutive(docs, key, text).mapInArrow(run, FIELDS)
