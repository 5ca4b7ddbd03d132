"""Substring dedup by suffix arrays over bytes, built by linear grouping."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldline.llm.anchors import gram_hashes
from foldline.llm.common import n_parts, rows, stage
from foldline.llm.passages import Bytes, candidates, documents, stretches, with_lists
from foldline.llm.phrases import SPAN, covered

BLOCK = 1 << 18  # bytes of passages that are sorted together
SEGMENT = "anchor long, variants long, doc_id long, digest long, lo long, bytes binary"
SEGMENT_SCHEMA = pa.schema([("anchor", pa.int64()), ("variants", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("lo", pa.int64()), ("bytes", pa.binary())])
RANGE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
OUT = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(SPAN)), ("kept", pa.binary())])


def suffix_array(s: Sequence[int]) -> list[int]:
    """Suffix array of a sequence whose last value is smaller than all others.

    Suffixes start grouped by their first value. Groups are taken from the
    highest to the lowest; every suffix of a group points at the last one
    before it that lies in a lower group, and suffixes pointed at move to new
    groups just above their old ones, further up the more pointers they got. In
    the end a group holds the suffixes with one Lyndon prefix. The array then
    fills up from the front: whatever precedes the next suffix in order, along
    the pointers, takes the first free place of its group.
    """
    n = len(s)
    group = [0] * n
    members: list[list[int]] = []
    number: dict[int, int] = {}
    for c in sorted(set(s)):
        number[c] = len(members)
        members.append([])
    for i, c in enumerate(s):
        group[i] = g = number[c]
        members[g].append(i)
    count = len(members)
    above = [*range(1, count), -1]
    below = [-1, *range(count - 1)]
    higher = bytearray(n)  # in a group already taken
    before = [-1] * n
    g = count - 1
    while g >= 0:
        here = [i for i in members[g] if group[i] == g]
        for i in here:
            higher[i] = 1
        pointers: dict[int, int] = {}
        for i in here:
            j = i - 1
            while j >= 0 and higher[j]:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointers[j] = pointers.get(j, 0) + 1
        if pointers:
            moves: dict[tuple[int, int], list[int]] = defaultdict(list)
            for j in sorted(pointers):
                moves[pointers[j], group[j]].append(j)
            for number_of, old in sorted(moves, reverse=True):
                moved = moves[number_of, old]
                new = len(members)
                members.append(moved)
                for j in moved:
                    group[j] = new
                up = above[old]
                above.append(up)
                below.append(old)
                above[old] = new
                if up >= 0:
                    below[up] = new
        g = below[g]
    free = [0] * len(members)
    sizes = [0] * len(members)
    for i in group:
        sizes[i] += 1
    g, at = 0, 0  # the lowest group stays first: it is the end's
    while g >= 0:
        free[g] = at
        at += sizes[g]
        g = above[g]
    order = [-1] * n
    placed = bytearray(n)
    order[0] = n - 1
    placed[n - 1] = 1
    for k in range(n):
        j = order[k] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            order[free[g]] = j
            free[g] += 1
            placed[j] = 1
            j = before[j]
    return order


def _order(doc: int | None, digest: int, start: int) -> tuple:
    return (doc is not None, doc or 0, digest, start)


def _ranges(starts: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.diff(starts) > 1)
    for a, b in zip(np.r_[0, cut + 1], np.r_[cut, len(starts) - 1]):
        yield int(starts[a]), int(starts[b])


Passage = tuple[int | None, int, int, bytes]  # doc_id, digest, start, bytes


def _recurring_runs(passages: list[Passage], window: int) -> tuple[list[Passage], list[tuple]]:
    """(the passages' runs of windows that occur more than once, each content at its earliest place; its other places as ranges)."""
    flat = np.frombuffer(b"".join(p[3] for p in passages), np.uint8)
    sizes = np.array([len(p[3]) for p in passages])
    begin = np.cumsum(sizes) - sizes
    h = gram_hashes(flat, window)
    inside = np.zeros(len(h), bool)
    for b, n in zip(begin.tolist(), sizes.tolist()):
        inside[b : b + n - window + 1] = True
    _, index, count = np.unique(h[inside], return_inverse=True, return_counts=True)
    repeats = np.zeros(len(h) + 2, bool)
    repeats[1:-1][inside] = count[index] > 1
    edge = np.flatnonzero(np.diff(repeats.astype(np.int8)))
    text = flat.tobytes()
    later: list[tuple] = []
    best: dict[bytes, tuple] = {}
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):  # windows s..e-1
        k = int(np.searchsorted(begin, s, "right")) - 1
        doc, digest, start, _ = passages[k]
        place = (_order(doc, digest, start + s - int(begin[k])), doc, digest)
        content = text[s : e - 1 + window]
        first = best.setdefault(content, place)
        if first is not place:
            if place[0] < first[0]:
                best[content], place = place, first
            at = place[0][3]
            later.append((place[1], place[2], at, at + e - s - 1))
    return [(doc, digest, order[3], content) for content, (order, doc, digest) in best.items()], later


def later_windows(passages: list[Passage], window: int) -> list[tuple]:
    """(doc_id, digest, lo, hi): windows of the passages that start earlier in another place.

    Windows that occur once are cut off first, by hash, and runs that are equal
    as a whole stand for their earliest, until nothing more goes: most
    passages share one run, which is then alone. The rest is one sequence,
    separated by values of their own, whose suffix array brings equal windows
    together. A passage that is given more than once, as by repeated rows,
    counts once.
    """
    passages = list({p[:3]: p for p in passages}.values())
    out: list[tuple] = []
    while passages:
        left, later = _recurring_runs(passages, window)
        out += later
        done = sum(len(p[3]) - window + 1 for p in left) == sum(len(p[3]) - window + 1 for p in passages)
        passages = left
        if done:
            break
    if not passages:
        return out
    runs = sorted(((_order(*p[:3]), p[0], p[1], p[3]) for p in passages), key=lambda r: r[0])
    sequence: list[int] = []
    for k, (*_, content) in enumerate(runs):
        sequence += [c + len(runs) for c in content]
        sequence.append(len(runs) - 1 - k)
    lengths = np.array([len(r[3]) + 1 for r in runs])
    heads = np.cumsum(lengths) - lengths
    order = np.array(suffix_array(sequence))
    owner = np.repeat(np.arange(len(runs)), lengths)
    order = order[heads[owner[order]] + lengths[owner[order]] - 1 - order >= window]  # a whole window is left
    h = gram_hashes(np.array(sequence, np.uint64), window)[order]
    whole = np.array(sequence, np.int32)
    same = np.r_[False, h[1:] == h[:-1]]
    at = np.flatnonzero(same)
    if len(at):
        apart = (whole[order[at][:, None] + np.arange(window)] != whole[order[at - 1][:, None] + np.arange(window)]).any(axis=1)
        same[at[apart]] = False
    kind = np.cumsum(~same)
    # Runs are in order of place, so the smallest position of a class is its earliest.
    by = np.lexsort((order, kind))
    first = np.r_[True, np.diff(kind[by]) > 0]
    gone = np.sort(order[by][~first])
    for k in np.unique(owner[gone]).tolist():
        mine = gone[owner[gone] == k] - heads[k]
        (_, _, _, start), doc, digest, _ = runs[k]
        out += [(doc, digest, start + lo, start + hi) for lo, hi in _ranges(mine)]
    return out


def _segments(source: DataFrame, window: int) -> DataFrame:
    """The bytes of the stretches that the lists name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for doc, g, t, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "text", "parts"))):
                raw = t.encode()
                done += [(p["anchor"], p["variants"], doc, g, p["lo"], raw[p["lo"] : p["hi"] + window]) for p in parts]
            if done:
                yield rows(list(zip(*done)), SEGMENT_SCHEMA)

    return source.mapInArrow(run, SEGMENT)


def _cut_to_recurring(segments: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """For anchors with very many stretches: (segments cut to their recurring windows, later copies of these).

    Windows are counted one by one with combining before the shuffle, and equal
    cuts come down to their earliest, so that what is left of a passage does
    not grow with the number of its copies.
    """
    out = pa.schema([("anchor", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("lo", pa.int64()), ("h", pa.list_(pa.int64())), ("bytes", pa.binary())])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = [gram_hashes(np.frombuffer(x, np.uint8), window).view(np.int64).tolist() for x in b.column("bytes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("anchor", "doc_id", "digest", "lo")), pa.array(h, pa.list_(pa.int64())), b.column("bytes")], schema=out)

    hashed = stage(segments.mapInArrow(hashes, "anchor long, doc_id long, digest long, lo long, h array<long>, bytes binary"), "hashed")
    single = hashed.select("anchor", "doc_id", "digest", "lo", F.posexplode("h").alias("i", "h"))
    twice = stage(single.groupBy("anchor", "h").count().where("count > 1").select("anchor", "h"), "twice")
    hits = single.join(twice, ["anchor", "h"]).groupBy("anchor", "doc_id", "digest", "lo").agg(F.sort_array(F.collect_list("i")).alias("hits"))
    hits = hits.withColumnRenamed("doc_id", "d")
    cut = hashed.join(hits, ["anchor", "digest", "lo"]).where(F.col("doc_id").eqNullSafe(F.col("d")))
    # A run starts where the window before it is no hit.
    heads = F.expr("filter(hits, x -> not array_contains(hits, x - 1))")
    tails = F.expr("filter(hits, x -> not array_contains(hits, x + 1))")
    run = F.explode(F.arrays_zip(heads.alias("s"), tails.alias("e"))).alias("r")
    runs = cut.select("anchor", "doc_id", "digest", "lo", "bytes", run).select(
        "anchor", "doc_id", "digest", (F.col("lo") + F.col("r.s")).alias("lo"), F.expr(f"substring(bytes, r.s + 1, r.e - r.s + {window})").alias("bytes")
    )
    runs = stage(runs, "runs")
    first = runs.groupBy("anchor", "bytes").agg(F.min(F.struct("doc_id", "digest", "lo")).alias("first"))
    first = stage(first, "first")
    later = runs.join(first, ["anchor", "bytes"]).where(~F.struct("doc_id", "digest", "lo").eqNullSafe(F.col("first")))
    later = later.select("doc_id", "digest", F.col("lo").cast("int").alias("lo"), (F.col("lo") + F.length("bytes") - window).cast("int").alias("hi"))
    return first.select("anchor", "first.doc_id", "first.digest", "first.lo", "bytes"), later


def repeats(source: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(doc_id, digest, lo, hi): windows lo..hi that also start earlier."""
    again, distinct, several = candidates(stretches(source, Bytes, window, gram))
    firsts = distinct.where("n > 1").select("anchor", "seg", "first")
    mine = F.struct("doc_id", "digest", "lo", "hi")
    copies = again.join(firsts, ["anchor", "seg"]).where(~mine.eqNullSafe(F.col("first"))).select("doc_id", "digest", "lo", "hi")
    segments = stage(_segments(with_lists(source, several.select("first.*", "anchor", "variants"), "inner"), window), "segments")
    cut, later = _cut_to_recurring(segments.where(F.col("variants") > hot).drop("variants"), window)
    dealt = segments.where(F.col("variants") <= hot).drop("variants").unionByName(cut)
    dealt = dealt.repartition(n_parts(source), "anchor").sortWithinPartitions("anchor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, last = 0, None
        for b in batches:
            for anchor, *passage in zip(*(b.column(c).to_pylist() for c in ("anchor", "doc_id", "digest", "lo", "bytes"))):
                if anchor != last and size >= BLOCK:
                    if found := later_windows(held, window):
                        yield rows(list(zip(*found)), RANGE_SCHEMA)
                    held, size = [], 0
                held.append(tuple(passage))
                size, last = size + len(passage[3]), anchor
        if held and (found := later_windows(held, window)):
            yield rows(list(zip(*found)), RANGE_SCHEMA)

    sorted_out = dealt.mapInArrow(run, "doc_id long, digest long, lo int, hi int")
    return stage(copies.unionByName(later).unionByName(sorted_out), "repeats")


def remove_repeats(docs: DataFrame, window: int = 100, gram: int = 24, hot: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_bytes, n_removed, spans, kept): texts without the strings that start earlier.

    A byte goes if a string of ``window`` bytes that covers it also starts
    earlier: in a smaller doc_id (null first; rows of one id by text digest) or
    before it in the same document. Stretches that are equal to an earlier one
    go as they are; different stretches with one anchor are compared in suffix
    arrays of bounded blocks. Anchors with more than ``hot`` stretches are
    first cut to what recurs in them. kept holds the other bytes, spans the
    removed ones. Null texts are empty, texts shorter than a window lose
    nothing; rows that repeat both id and text are one document and get its
    result each.
    """
    source = documents(docs, key, text)
    given = with_lists(source, repeats(source, window, gram, hot), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = []
            for doc, g, t, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "text", "parts"))):
                raw = t.encode()
                if not parts:
                    done.append((doc, g, len(raw), 0, [], raw))
                    continue
                mask, spans = covered(len(raw), ((p["lo"], p["hi"] + window) for p in parts))
                done.append((doc, g, len(raw), int(mask.sum()), spans, np.frombuffer(raw, np.uint8)[~mask].tobytes()))
            yield rows(list(zip(*done)), OUT)

    fields = "doc_id long, digest long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    return given.mapInArrow(run, fields)
