"""Places where texts may repeat: windows gathered by the anchor they share.

A document falls into stretches of windows with one anchor each. Windows can
only be equal if their anchors are, so stretches whose anchor occurs once are
settled, and stretches that are equal as a whole need no closer look.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from foldline.llm.anchors import anchored, gram_hashes
from foldline.llm.common import row_digest, stage, texts

FIELDS = ("doc_id", "digest", "lo", "hi", "anchor", "seg")


def documents(docs: DataFrame, key: str, text: str, rest: bool = False) -> DataFrame:
    """(doc_id, digest, text): digest tells documents of one id apart, null texts are empty; rest holds all other columns."""
    cols = [F.col(key).cast("long").alias("doc_id"), row_digest(text).alias("digest"), F.coalesce(F.col(text), F.lit("")).alias("text")]
    return docs.select(*cols, *([F.struct(*(docs[c] for c in docs.columns if c != text)).alias("rest")] if rest else []))


class Words:
    """A text as words, with the bytes of any span of words joined by one space."""

    def __init__(self, raw: bytes):
        self.units = raw.split()
        self.flat = b" ".join(self.units)
        self.n = len(self.units)

    def values(self) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh64_intdigest, self.units), np.uint64, self.n)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        ends = np.cumsum(np.fromiter(map(len, self.units), np.int64, self.n) + 1)
        return np.r_[0, ends[:-1]], ends - 1


class Bytes:
    """A text as bytes."""

    def __init__(self, raw: bytes):
        self.flat, self.n = raw, len(raw)

    def values(self) -> np.ndarray:
        return np.frombuffer(self.flat, np.uint8)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(self.n)
        return at, at + 1


def stretches(source: DataFrame, unit: type, window: int, gram: int) -> DataFrame:
    """(doc_id, digest, lo, hi, anchor, seg): windows lo..hi of a document, their anchor and a hash of all they cover."""
    out = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("anchor", pa.int64()), ("seg", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            size, lo, hi, anchor, seg = [], [], [], [], []
            for raw in texts(b):
                t = unit(raw)
                if t.n < window:
                    size.append(0)
                    continue
                h = gram_hashes(t.values(), gram)
                first, last, place = anchored(h, window - gram + 1)
                starts, ends = (first, last + window) if unit is Bytes else (lambda s, e: (s[first], e[last + window - 1]))(*t.edges())
                flat = t.flat
                size.append(len(first))
                lo.append(first)
                hi.append(last)
                anchor.append(h[place])
                seg.append(np.fromiter((digest(flat[s:e]) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(first)))
            row = pa.array(np.repeat(np.arange(len(size)), size))
            if len(row):
                cat = np.concatenate
                cols = [b.column("doc_id").take(row), b.column("digest").take(row), cat(lo).astype(np.int32), cat(hi).astype(np.int32), cat(anchor).view(np.int64), cat(seg).view(np.int64)]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], schema=out)

    return source.mapInArrow(run, "doc_id long, digest long, lo int, hi int, anchor long, seg long")


def candidates(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stretches with an anchor that occurs again, their distinct contents, and those of anchors with several.

    (1) doc_id, digest, lo, hi, anchor, seg. (2) anchor, seg, n, first (the
    earliest by doc_id, digest, lo). (3) as (2), with the number of variants
    of the anchor. Counts combine before the shuffle; the join with the
    recurring anchors splits hot ones.
    """
    found = stage(found, "stretches")
    # Written first: a join side that is shuffled for the join alone can be split where an anchor is hot.
    twice = stage(found.groupBy("anchor").count().where("count > 1").select("anchor"), "twice")
    again = stage(found.join(twice, "anchor"), "again")
    first = F.min(F.struct("doc_id", "digest", "lo", "hi")).alias("first")
    distinct = stage(again.groupBy("anchor", "seg").agg(F.count("*").alias("n"), first), "distinct")
    varied = stage(distinct.groupBy("anchor").agg(F.count("*").alias("variants")).where("variants > 1"), "varied")
    return again, distinct, distinct.join(varied, "anchor")


def with_lists(source: DataFrame, parts: DataFrame, how: str) -> DataFrame:
    """Documents with the list ``parts`` of their rows of a table by (doc_id, digest); a list is never longer than its document."""
    cols = [c for c in parts.columns if c not in ("doc_id", "digest")]
    lists = parts.groupBy("doc_id", "digest").agg(F.collect_list(F.struct(*cols)).alias("parts"))
    lists = lists.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "parts")
    return source.join(lists, source["doc_id"].eqNullSafe(F.col("d")) & (source["digest"] == F.col("g")), how).select(*source.columns, "parts")
