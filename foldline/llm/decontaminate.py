"""Benchmark decontamination by pigeonhole edit matching."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldline.llm.common import row_digest, rows, stage

OUT = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int64()), ("end", pa.int64())])


def normal(text: str | None) -> str:
    """Lower case, every run of white space one space."""
    return " ".join((text or "").lower().split())


def budget(n: int, rate: float) -> int:
    """Edits allowed in an item of n characters."""
    return int(n * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that make up the item, with their offsets: that many edits leave one of them whole."""
    edges = [i * len(item) // (errors + 1) for i in range(errors + 2)]
    return [(s, item[s:e]) for s, e in zip(edges, edges[1:])]


def pattern_masks(item: str) -> dict[str, int]:
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    return masks


def myers(masks: dict[str, int], size: int, text: str, limit: int) -> tuple[int, int]:
    """(smallest edit distance of the pattern to any substring, its end); (limit + 1, -1) if above the limit.

    One column of the distance matrix is held as bits of two integers, one bit
    for each character of the pattern.
    """
    full, top = (1 << size) - 1, 1 << (size - 1)
    up, down, score = full, 0, size
    best, end = (size, 0) if size <= limit else (limit + 1, -1)
    for at, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        plus, minus = down | (~(d | up) & full), up & d
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (~(d | plus) & full), plus & d
        if score < best:
            best, end = score, at
            if not best:
                break
    return best, end


class Matcher:
    """All items of a block: an automaton of their pieces and what verification needs."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items = [(i, t, budget(len(t), rate)) for i, t in items if t]
        self.masks = [pattern_masks(t) for _, t, _ in self.items]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, t, errors) in enumerate(self.items):
            for offset, piece in pieces(t, errors):
                found[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in found.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if found:
            self.automaton.make_automaton()

    def search(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of the best occurrence of every item within its budget."""
        if not self.items:
            return []
        places: dict[int, list[int]] = defaultdict(list)
        for end, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                places[n].append(end - size + 1 - offset)
        out = []
        for n, starts in places.items():
            item, t, errors = self.items[n]
            best, reach = (errors + 1, -1), -1
            for at in sorted(set(starts)):
                if at >= 0 and text.startswith(t, at):
                    best = (0, at + len(t))
                    break
            starts = [] if not best[0] else sorted(set(starts))
            k = 0
            while k < len(starts):  # regions that overlap are searched as one
                low = max(0, starts[k] - errors)
                reach = starts[k] + len(t) + errors
                while k + 1 < len(starts) and starts[k + 1] - errors <= reach:
                    k += 1
                    reach = starts[k] + len(t) + errors
                distance, end = myers(self.masks[n], len(t), text[low:reach], errors)
                best = min(best, (distance, low + end))
                k += 1
            if best[0] <= errors:
                out.append((item, *best))
        return out


def leaks(docs: DataFrame, items: DataFrame, rate: float = 0.05, block_chars: int = 8_000_000, key: str = "doc_id", item_key: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, item_id, distance, end): items that occur in a document within their edit budget.

    Texts are lower-cased and their white space is evened out; an item of n
    characters may differ in ``rate`` * n edits. end is where the best
    occurrence ends in the normalised text (ties: the first). Items are taken
    in blocks of a bounded size, each block by a scan of all documents, which
    are not shuffled. Null and empty items match nothing, null texts are empty;
    null ids stay null; repeated rows give repeated rows, repeated items count
    once. digest tells documents of one id apart.
    """
    items = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(text).alias("text")).dropna(subset=["text"]).distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_chars) or 1
    src = docs.select(F.col(key).cast("long").alias("doc_id"), row_digest(text).alias("digest"), F.col(text).alias("text"))

    def scan(block: int) -> DataFrame:
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        mine = sorted({(r.item_id, normal(r.text)) for r in mine}, key=repr)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(mine, rate)
            for b in batches:
                done = []
                for doc, digest, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "text"))):
                    done += [(doc, digest, *m) for m in matcher.search(normal(t))]
                if done:
                    yield rows(list(zip(*done)), OUT)

        return src.mapInArrow(run, "doc_id long, digest long, item_id long, distance long, end long")

    return reduce(DataFrame.unionByName, [scan(b) for b in range(blocks)])


def clean(docs: DataFrame, items: DataFrame, rate: float = 0.05, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of docs that hold no item within its budget; all columns are returned."""
    found = stage(leaks(docs, items, rate, key=key, text=text).select("doc_id", "digest").distinct(), "leaks")
    same = docs[key].cast("long").eqNullSafe(found["doc_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == found["digest"])
    return docs.join(found, same, "left_anti")
