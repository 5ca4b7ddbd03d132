"""Spelling variants: words one letter apart, by a bit-sliced position index.

The words of a bucket are stored as bitsets: one for every (position, letter),
with a bit for each word that has the letter there. A query runs along its own
letters and keeps two sets of words, 64 to a machine word: those equal to it so
far, and those one error behind, either with one letter replaced or with one
letter more, whose positions are then shifted by one. Words with one letter
less find the query when they ask.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldline.llm.common import n_parts, rows, stage, texts

PIECES = 3  # a pair agrees on all but one piece of the shorter word
CHUNK = 1 << 15  # words of a bucket that are compared in one piece; a larger bucket gets longer keys
LETTERS = 1 << 20  # letters held at a time
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def word_counts(docs: DataFrame, least_length: int = 7, every: int = 31, key: str = "doc_id", text: str = "text", held: int = 200_000) -> DataFrame:
    """(word, n): maximal runs of Latin letters, A-Z lower-cased, of ``least_length`` code points or more, with their occurrences.

    Where ``every`` divides the CRC-32 h of "<doc_id>:<run>", the run loses its
    code point h % length first. Null texts have no runs; a null id counts as
    an empty one. Counts combine in the task, then before the shuffle.
    """
    src = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text"))
    run_of = re.compile(f"[A-Za-zÀ-ÿ]{{{least_length},}}")
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for b in batches:
            for doc, raw in zip(b.column("doc_id").to_pylist(), texts(b)):
                seed = zlib.crc32(f"{doc}:".encode())
                for w, n in Counter(run_of.findall(raw.lower().decode())).items():
                    h = zlib.crc32(w.encode(), seed)
                    if h % every == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                        if len(w) < least_length:
                            continue
                    total[w] += n
                if len(total) > held:
                    yield rows((list(total), list(total.values())), out)
                    total.clear()
        if total:
            yield rows((list(total), list(total.values())), out)

    return src.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def one_error(codes: np.ndarray, length: np.ndarray, group: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i before j in one group, where j is i with one letter replaced or inserted.

    codes[p, i]: letter number at position p of word i, words of ``size`` or
    ``size + 1`` letters, the shorter ones first in their group; length[i];
    group ascending. Blocks of 64 words are left once neither set has a word.
    """
    n = len(length)
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    end = np.repeat(np.r_[start[1:], n], np.diff(np.r_[start, n]))
    asking = np.flatnonzero((length == size) & (end - np.arange(n) > 1))
    if not len(asking):
        return
    wide = -(-n // 64) * 64
    n_letters = int(codes.max()) + 1
    index = np.zeros((size + 1, n_letters, wide // 64), np.uint64)  # bitsets by position and letter
    for p in range(size + 1):
        bits = np.zeros((n_letters, wide), np.uint8)
        has = np.flatnonzero(length > p)
        bits[codes[p, has], has] = 1
        index[p] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    bits = np.zeros(wide, np.uint8)
    bits[:n] = length == size
    same_size = np.packbits(bits, bitorder="little").view(np.uint64)

    first, last = (asking + 1) // 64, (end[asking] - 1) // 64
    width = last - first + 1
    cum = np.r_[0, np.cumsum(width)]
    at = 0
    while at < len(asking):
        to = max(at + 1, int(np.searchsorted(cum, cum[at] + CHUNK, "right")) - 1)
        w = width[at:to]
        query = np.repeat(asking[at:to], w)
        word = np.arange(len(query)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(first[at:to], w)
        low, high = np.maximum(query + 1 - word * 64, 0), np.minimum(end[query] - word * 64, 64)
        lanes = (FULL >> (64 - high).astype(np.uint64)) & (FULL << low.astype(np.uint64))
        equal, replaced, longer = lanes, np.zeros_like(lanes), np.zeros_like(lanes)
        for p in range(size):
            letter = codes[p, query]
            here, shifted = index[p, letter, word], index[p + 1, letter, word]
            longer = (longer | equal) & shifted
            replaced = (replaced & here) | (equal & ~here)
            equal = equal & here
            if p % 4 == 3:
                live = (equal | replaced | longer) != 0
                if not live.all():
                    query, word, equal, replaced, longer = (x[live] for x in (query, word, equal, replaced, longer))
                    if not len(query):
                        break
        if len(query):
            even = same_size[word]
            hit = (replaced & even) | ((longer | equal) & ~even)
            k, lane = np.nonzero(np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            yield query[k], word[k] * 64 + lane
        at = to


def _errors_at(a: str, b: str) -> int:
    """First place of the one letter of b, as long as a or one longer, that a does not have there."""
    n = len(a)
    if len(a) == len(b):
        return next(i for i in range(n) if a[i] != b[i])
    return n - next((i for i in range(n) if a[-1 - i] != b[-1 - i]), n)


def _bucket_pairs(t: pa.Table) -> tuple[list, list, list]:
    """(word, other, n of other) for all near pairs of whole buckets, both ways.

    A pair can meet in several pieces; it counts in the piece its first error is in.
    """
    words, ns = t["word"].to_pylist(), t["n"].to_pylist()
    gid, size, lo, hi = (t[c].to_numpy() for c in ("gid", "size", "lo", "hi"))
    out: tuple[list, list, list] = ([], [], [])
    cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(size)]
    for x, y in zip(cuts, cuts[1:]):
        s = int(size[x])
        flat = np.frombuffer("".join([w.ljust(s + 1, "\0") for w in words[x:y]]).encode("utf-32-le"), np.uint32).reshape(y - x, s + 1)
        codes = np.ascontiguousarray(np.unique(flat, return_inverse=True)[1].reshape(flat.shape).T)
        length = np.array([len(w) for w in words[x:y]])
        for i, j in one_error(codes, length, gid[x:y], s):
            for a, b in zip((i + x).tolist(), (j + x).tolist()):
                at = _errors_at(words[a], words[b])
                if lo[a] <= at < hi[a] or at == s == hi[a]:
                    out[0].extend((words[a], words[b]))
                    out[1].extend((words[b], words[a]))
                    out[2].extend((ns[b], ns[a]))
    return out


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near pairs of rows sorted by (size, gid, length); some buckets are held at a time."""
    out = pa.schema([("word", pa.string()), ("other", pa.string()), ("m", pa.int64())])
    held: list[pa.RecordBatch] = []
    letters = 0
    for b in batches:
        held.append(b)
        letters += int(b.column("size").to_numpy().sum()) + b.num_rows
        if letters >= LETTERS:
            t = pa.Table.from_batches(held)
            gid, size = t["gid"].to_numpy(), t["size"].to_numpy()
            open_ = (gid == gid[-1]) & (size == size[-1])
            cut = int(np.argmax(open_))
            if cut:
                yield rows(_bucket_pairs(t.slice(0, cut)), out)
            held = t.slice(cut).combine_chunks().to_batches()
            letters = int(size[cut:].sum()) + len(size) - cut
    if held:
        yield rows(_bucket_pairs(pa.Table.from_batches(held)), out)


def _keyed(df: DataFrame, piece: Column) -> DataFrame:
    """One row for each piece: words of one bucket have the same letters before and after it."""
    pieces = df.select("word", "n", F.explode(piece).alias("p")).select("word", "n", "p.*").where("lo < hi")
    return pieces.withColumn("gid", F.expr("xxhash64(size, lo, hi, substring(word, 1, lo), right(word, size - hi))"))


def _hot(keyed: DataFrame, n_rows: int, chunk: int) -> DataFrame:
    """Buckets of over ``chunk`` rows whose piece can be divided.

    Rows are counted by slot first, some hundred to a slot, which combines
    before the shuffle; only rows of slots that are large enough are counted by bucket.
    """
    slots = n_rows // 512 + 1
    keyed = keyed.where("hi - lo > 1").withColumn("slot", F.pmod("gid", F.lit(slots)))
    full = stage(keyed.groupBy("slot").count().where(F.col("count") > chunk).select("slot"), "slots")
    count = keyed.join(full, "slot", "left_semi").groupBy("gid").count()
    return stage(count.where(F.col("count") > chunk).select("gid"), "hot")


def near_pairs(counts: DataFrame, least_length: int = 1, chunk: int = CHUNK) -> DataFrame:
    """(word, other, m): every ordered pair of words of (word, n) that differ by one inserted, deleted or replaced code point; m is the other's n.

    counts: distinct words, written already. The shorter word of a pair is cut
    into pieces and the error lies in one of them, so the words meet under the
    letters before and after that piece. The piece of a bucket of over
    ``chunk`` words is divided, which makes its key longer, until it is one
    letter: such a bucket is bounded by the alphabet. No bucket is cut off.
    """
    n_rows = 2 * PIECES * counts.count() + 1
    first = f"""flatten(transform(filter(array(length(word), length(word) - 1), s -> s >= {least_length} and s > 0), s -> transform(
        sequence(0, {PIECES - 1}), i -> named_struct('size', s, 'lo', cast(s * i div {PIECES} as int), 'hi', cast(s * (i + 1) div {PIECES} as int)))))"""
    halves = """transform(array(0, 1), i -> named_struct(
        'size', size, 'lo', cast(if(i = 0, lo, (lo + hi) div 2) as int), 'hi', cast(if(i = 0, (lo + hi) div 2, hi) as int)))"""
    keyed = _keyed(counts, F.expr(first))
    dealt = None
    while True:
        hot = _hot(keyed, n_rows, chunk)
        none = hot.isEmpty()
        cold = keyed if none else keyed.join(hot, "gid", "left_anti")
        dealt = cold if dealt is None else dealt.unionByName(cold)
        if none:
            break
        full = stage(keyed.join(hot, "gid", "left_semi"), "full")
        keyed = stage(_keyed(full, F.expr(halves)), "keyed")
    parts = max(n_parts(counts), n_rows // 2_000_000)
    dealt = dealt.select("gid", "size", "lo", "hi", "word", "n").repartition(parts, "gid")
    return dealt.sortWithinPartitions("size", "gid", F.length("word")).mapInArrow(_pair_rows, "word string, other string, m long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words that are a form and have a form: the last word of their chain. A chain's counts grow tenfold, so it is short."""
    hops = stage(forms.join(forms.select(F.col("form").alias("word")).distinct(), "word").select("word", F.col("form").alias("root")), "hops")
    while True:
        ahead = hops.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        moved = stage(hops.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("on")), "hops")
        hops = moved.select("word", "root")
        if moved.where("on").isEmpty():
            return hops


def variant_groups(docs: DataFrame, least_length: int = 7, least_count: int = 2, ratio: int = 10, every: int = 31, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for every word of ``word_counts`` that occurs ``least_count`` times or more.

    n_near counts the words one inserted, deleted or replaced code point away;
    form is the most frequent of them (ties: the first in code-point order) if
    it occurs ``ratio`` times as often or more, else null; root is the last
    word along the forms, the word itself if it has none. Every row of docs
    counts, repeated rows too. Null and empty texts add nothing; no words: no rows.
    """
    counts = stage(word_counts(docs, least_length, every, key, text).where(F.col("n") >= least_count), "words")
    near = near_pairs(counts, least_length, chunk).groupBy("word")
    near = near.agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("other"))).alias("best"))
    most = -F.col("best.m")
    is_form = most >= F.col("n") * ratio
    found = counts.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, most).alias("form_n")
    )
    found = stage(found, "forms")
    roots = _roots(found.where("form is not null").select("word", "form")).toDF("form", "last")
    formed = found.where("form is not null").join(roots, "form", "left").withColumn("root", F.coalesce("last", "form")).drop("last")
    return formed.unionByName(found.where("form is null").withColumn("root", F.col("word"))).select("word", "n", "n_near", "form", "form_n", "root")
