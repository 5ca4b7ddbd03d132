"""Packing documents into fixed token windows by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from foldline.llm.common import rows
from foldline.llm.tokens import byte_pairs

Piece = tuple[int | None, int, bytes, int]  # document, ids before it, ids, ids of the document
SCHEMA = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class SumOfSquares:
    """Online packing: the level array holds how many open windows are filled to each level.

    An item goes to the fill level that leaves the smallest sum of squared
    counts over the partially filled windows (ties: the fullest window), or
    into a new window.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.level = np.zeros(capacity + 1, np.int64)
        self.windows: list[list[list[Piece]]] = [[] for _ in range(capacity)]

    def place(self, piece: Piece) -> list[Piece] | None:
        """Adds an item no longer than a window; returns the window if that fills it."""
        n, size, top = self.level, len(piece[2]) // 4, self.capacity
        change = 2 * (n[size:] - n[: top - size + 1]) + 2
        change[0] -= 1  # a new window leaves no level
        change[-1] -= 1  # a full one reaches none
        usable = n[: top - size + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        at = len(change) - 1 - int(np.argmin(change[::-1]))
        window = self.windows[at].pop() if at else []
        if at:
            n[at] -= 1
        window.append(piece)
        if at + size == top:
            return window
        n[at + size] += 1
        self.windows[at + size].append(window)
        return None

    def finish(self) -> Iterator[list[Piece]]:
        """Fills the open windows, fullest first, with cut pieces of the emptiest; the last falls into powers of two."""
        left = [(at, w) for at in range(1, self.capacity) for w in self.windows[at]]
        low, high = 0, len(left) - 1
        while low < high:
            fill, window = left[high]
            while fill < self.capacity and low < high:
                doc, start, ids, total = left[low][1].pop()
                take = min(len(ids) // 4, self.capacity - fill)
                window.append((doc, start, ids[: 4 * take], total))
                fill += take
                if 4 * take < len(ids):
                    left[low][1].append((doc, start + take, ids[4 * take :], total))
                if not left[low][1]:
                    low += 1
            if fill < self.capacity:
                left[high] = (fill, window)
                break
            yield window
            high -= 1
        if low <= high:
            pieces = left[high][1][::-1]
            rest = sum(len(p[2]) // 4 for p in pieces)
            while rest:
                size = 1 << (rest.bit_length() - 1)
                rest -= size
                window = []
                while size:
                    doc, start, ids, total = pieces.pop()
                    take = min(len(ids) // 4, size)
                    window.append((doc, start, ids[: 4 * take], total))
                    size -= take
                    if 4 * take < len(ids):
                        pieces.append((doc, start + take, ids[4 * take :], total))
                yield window


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every partition packs its own documents, without a shuffle: what is longer
    than a window gives whole windows, the rest is placed by ``SumOfSquares``.
    Windows still open at the end of a partition fill each other with cut
    pieces; what is left at the very end is cut into sequences whose lengths
    are powers of two, so that nothing is padded. sequence_id is the
    partition's number and a count. Null text is empty: the end id alone. A
    null id stays null; rows that repeat are documents of their own; no rows:
    no pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = byte_pairs(tokenizer).encode, int(end_id).to_bytes(4, "little")
        packer, number = SumOfSquares(capacity), TaskContext.get().partitionId() << 40
        done: list[tuple] = []

        def emit(window: list[Piece]) -> None:
            nonlocal number
            offset = 0
            for doc, start, ids, total in window:
                done.append((doc, start, len(ids) // 4, zlib.crc32(ids), total, number, offset))
                offset += len(ids) // 4
            number += 1

        for b in batches:
            for doc, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = encode(t or "") + end
                total = len(ids) // 4
                whole = total - total % capacity
                for at in range(0, whole, capacity):
                    emit([(doc, at, ids[4 * at : 4 * (at + capacity)], total)])
                if whole < total and (full := packer.place((doc, whole, ids[4 * whole :], total))):
                    emit(full)
            if done:
                yield rows(list(zip(*done)), SCHEMA)
                done.clear()
        for window in packer.finish():
            emit(window)
        if done:
            yield rows(list(zip(*done)), SCHEMA)

    names = [f"{f.name} long" for f in SCHEMA]
    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, ", ".join(names))
