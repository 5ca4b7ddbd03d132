"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are compared inside buckets of equal key bits. A bucket stores its
fingerprints as bit planes, 64 of them to a machine word; the distances of one
fingerprint to 64 others grow plane by plane in carry-save counters, and a
block of 64 is abandoned once every distance in it exceeds the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from foldline.llm.common import n_parts, rows, stage, texts
from foldline.llm.components import components

CHUNK = 4096  # fingerprints of one bucket that are compared in one piece
SLICE = 1 << 15  # hashes or blocks held at a time
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(raw: bytes, words: int) -> np.ndarray:
    """XXH64 (seed 42) of every shingle of the text, A-Z lower-cased, repeats included."""
    w = raw.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    flat, ends = b" ".join(w), np.cumsum([len(x) + 1 for x in w])
    starts, ends, digest = [0, *ends[:-1].tolist()], (ends - 1).tolist(), xxhash.xxh64_intdigest
    k = min(words, len(w))
    return np.fromiter((digest(flat[s:e], 42) for s, e in zip(starts, ends[k - 1 :])), np.uint64, len(w) - k + 1)


def _mixed(h: np.ndarray, word: int) -> np.ndarray:
    """The word-th 64 bits of a shingle; the first are the hash itself."""
    if not word:
        return h
    x = h + np.uint64(word * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(raw: bytes, words: int = 4, bits: int = 64) -> list[int]:
    """bits/64 unsigned words; a bit is set if it is in over half the hashes; no words: zero."""
    return majority(shingle_hashes(raw, words), bits)


def majority(h: np.ndarray, bits: int) -> list[int]:
    """bits/64 unsigned words of what most hashes have."""
    out = []
    for word in range(bits // 64):
        ones = np.zeros(64, np.int64)
        for at in range(0, len(h), SLICE):
            part = _mixed(h[at : at + SLICE], word)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
        out.append(int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0]))
    return out


def fingerprints(docs: DataFrame, words: int = 4, bits: int = 64, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, f0, f1, ...): one row per row of docs, fingerprint words as signed 64-bit integers."""
    names = [f"f{i}" for i in range(bits // 64)]
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.array([fingerprint(x, words, bits) for x in texts(b)], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *(pa.array(prints[:, i]) for i in range(len(names)))], schema=out)

    return src.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def pigeonhole_masks(radius: int, bands: int | None = None) -> list[tuple[int, int]]:
    """(word, mask) keys such that any two fingerprints of 64 bits within the radius agree on one of them.

    The 64 bits fall into ``bands`` runs; at most ``radius`` of them differ, so
    ``bands - radius`` runs are equal. More bands: more keys, smaller buckets.
    """
    bands = bands or radius + 2
    edges = [round(i * 64 / bands) for i in range(bands + 1)]
    runs = [((1 << e) - 1) ^ ((1 << s) - 1) for s, e in zip(edges, edges[1:])]
    return [(0, sum(c)) for c in combinations(runs, bands - radius)]


def close_blocks(planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, flips: np.ndarray, radius: int, every: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Blocks with a distance within the radius: (block number, lanes that are).

    planes[b, w]: bit b of the 64 fingerprints of word w. Block i compares
    fingerprint query[i] (flips[b, query]: all ones if its bit b is set) with
    the lanes of planes[:, word[i]]. ``over`` has the lanes known to exceed.
    """
    size = radius.bit_length()
    block = np.arange(len(query))
    over = ~lanes
    count = [np.zeros(len(query), np.uint64) for _ in range(size)]
    for b in range(len(planes)):
        carry = planes[b][word] ^ flips[b][query]
        for c in count:
            c ^= carry
            carry &= ~c
        over |= carry  # past what the counters hold
        if b % every == every - 1 or b == len(planes) - 1:
            above, equal = np.zeros_like(over), np.full_like(over, ALL)
            for k in range(size - 1, -1, -1):
                if radius >> k & 1:
                    equal &= count[k]
                else:
                    above |= equal & count[k]
                    equal &= ~count[k]
            over |= above
            live = over != ALL
            if not live.all():
                block, query, word, over = block[live], query[live], word[live], over[live]
                count = [c[live] for c in count]
            if not len(block):
                break
    return block, ~over


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest number reachable from each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while not np.array_equal(new, (jump := new[new])):
            new = jump
        if np.array_equal(new, root):
            return root
        root = new


def bucket_pairs(group: np.ndarray, prints: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group within the radius, the earlier row first, in pieces."""
    n = len(group)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))
    here = np.flatnonzero(end - np.arange(n) > 1)  # rows with later rows in their group
    if not len(here):
        return
    bits = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
    wide = np.zeros((-(-n // 64) * 64, bits.shape[1]), np.uint8)
    wide[:n] = bits
    planes = np.ascontiguousarray(np.packbits(wide.T, axis=1, bitorder="little")).view(np.uint64)
    flips = np.where(bits.T.astype(bool), ALL, np.uint64(0))
    first, last = (here + 1) // 64, (end[here] - 1) // 64
    at = 0
    width = last - first + 1
    cum = np.r_[0, np.cumsum(width)]
    while at < len(here):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + SLICE * 4, "right")) - 1)
        w = width[at:to]
        query = np.repeat(here[at:to], w)
        word = np.arange(len(query)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[at:to], w)
        low, high = np.maximum(query + 1 - word * 64, 0), np.minimum(end[query] - word * 64, 64)
        lanes = (ALL >> (64 - high).astype(np.uint64)) & (ALL << low.astype(np.uint64))
        block, hit = close_blocks(planes, query, word, lanes, flips, radius)
        if len(block):
            for part in range(0, len(block), 4096):
                k, lane = np.nonzero(np.unpackbits(hit[part : part + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
                k = block[part : part + 4096][k]
                yield query[k], word[k] * 64 + lane
        at = to


def bucket_links(group: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows that are linked inside their group, as a forest: every row with a link points at its part's first row."""
    n = len(group)
    root = np.arange(n)
    for i, j in bucket_pairs(group, prints, radius):
        a, b = root[i], root[j]
        if (differ := a != b).any():
            root = _roots(n, np.r_[np.arange(n), a[differ]], np.r_[root, b[differ]])
    own = np.flatnonzero(root != np.arange(n))
    return own, root[own]


def _link_rows(radius: int, names: list[str]):
    """Links inside each group as a forest."""
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def close(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, size
            t = pa.Table.from_batches(held)
            group = t["gid"].to_numpy()
            cut = len(group) if final else int(np.searchsorted(group, group[-1], "left"))
            if cut:
                part = t.slice(0, cut)
                prints = np.stack([part[n].to_numpy() for n in names], axis=1)
                own, root = bucket_links(group[:cut], prints, radius)
                ids = part["nid"].to_numpy()
                yield rows((ids[own], ids[root]), out)
            held, size = t.slice(cut).combine_chunks().to_batches(), len(group) - cut

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= SLICE:
                yield from close(False)
        if size:
            yield from close(True)

    return run


def _dealt(nodes: DataFrame, names: list[str], masks: list[tuple[int, int]], chunk: int) -> DataFrame:
    """(gid, nid, *names): nodes once for every key, and once more for every other piece of a large bucket."""

    def key(word: int, mask: int) -> Column:
        return F.col(names[word]).bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))

    cols = ["nid", *names]
    keyed = nodes.select(*cols, F.posexplode(F.array(*(key(w, m) for w, m in masks))).alias("t", "k"))
    full = keyed.groupBy("t", "k").count().where(F.col("count") > chunk)
    full = stage(full.select("t", "k", F.ceil(F.col("count") / chunk).cast("int").alias("n")), "full")
    keyed = keyed.join(full, ["t", "k"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
    own = F.pmod(F.xxhash64("nid"), F.col("n"))
    other = F.expr("explode(if(n = 1, array(0), filter(sequence(0, n - 1), x -> x != c)))")
    dealt = keyed.withColumn("c", own.cast("int")).select(*cols, "t", "k", "c", other.alias("o"))
    return dealt.select(F.xxhash64("t", "k", F.least("c", "o"), F.greatest("c", "o")).alias("gid"), *cols)


def near_duplicates(prints: DataFrame, radius: int, masks: list[tuple[int, int]], chunk: int = CHUNK) -> DataFrame:
    """(doc_id, f0, ..., component_id) for every row of ``fingerprints()``.

    Fingerprints within the radius that share a key are linked; component_id is
    the smallest doc_id reachable. With ``pigeonhole_masks`` no link is lost.
    Equal fingerprints count once. A bucket of more than ``chunk`` is dealt out
    in pieces, and every two pieces meet in a task of their own. Null ids stay
    null and never name a component that has another id; no rows: no rows.
    """
    names = [c for c in prints.columns if c != "doc_id"]
    nid = F.col(names[0]) if len(names) == 1 else F.xxhash64(*names)
    prints = stage(prints, "prints")
    nodes = stage(prints.groupBy(*names).agg(F.min("doc_id").alias("rep")).withColumn("nid", nid), "nodes")

    dealt = _dealt(nodes, names, masks, chunk)
    links = dealt.repartition(n_parts(prints), "gid").sortWithinPartitions("gid").mapInArrow(_link_rows(radius, names), "a long, b long")
    roots = components(links)
    found = nodes.join(roots, nodes.nid == roots.node).select("root", "rep", "nid")
    least = found.groupBy("root").agg(F.min("rep").alias("least"))
    named = stage(found.join(least, "root").select("nid", "least"), "named")
    whole = nodes.join(named, "nid", "left").select(*names, F.coalesce("least", "rep").alias("component_id"))
    return prints.join(whole, names)


def simhash_dedup(docs: DataFrame, words: int = 4, radius: int = 4, order: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """Rows of docs without near copies: of each group the row with the smallest doc_id stays.

    Groups are the components of ``near_duplicates``: fingerprints of shingles
    of that many words that differ in ``radius`` bits or fewer. Null text
    counts as empty; texts without words have fingerprint zero and link like
    any other. Rows that repeat an id and a text are copies too: one stays.
    Rows of one id with different texts stay or go together. Rows whose id is
    null stay only if their group has no other id. All columns of docs are
    returned.
    """
    prints = fingerprints(docs, words, key=order, text=text)
    groups = stage(near_duplicates(prints, radius, pigeonhole_masks(radius), chunk).select("doc_id", "component_id"), "groups")
    keep = stage(groups.select(F.col("component_id").alias("kept_id")).distinct(), "keep")
    kept = docs.join(keep, docs[order].eqNullSafe(keep["kept_id"]), "left_semi")
    repeated = groups.groupBy("doc_id").count().where("count > 1").limit(1).count()
    return kept.dropDuplicates([order, text]) if repeated else kept
