"""Substring dedup by repeated-phrase automata over words."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from foldline.llm.common import rows, stage
from foldline.llm.passages import Words, candidates, documents, stretches, with_lists

SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
OUT = pa.schema([("doc_id", pa.int64()), ("digest", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(SPAN)), ("kept", pa.string())])


def window_hashes(source: DataFrame, window: int) -> DataFrame:
    """(anchor, n, doc_id, digest, start, h): hashes of the windows lo..hi that the lists name."""
    out = pa.schema([("anchor", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("lo", pa.int64()), ("h", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh64_intdigest
        for b in batches:
            done = []
            for doc, g, t, parts in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "text", "parts"))):
                w = Words(t.encode())
                starts, ends = (x.tolist() for x in w.edges())
                for p in parts:
                    h = np.array([digest(w.flat[starts[i] : ends[i + window - 1]]) for i in range(p["lo"], p["hi"] + 1)], np.uint64)
                    done.append((p["anchor"], p["n"], doc, g, p["lo"], h.view(np.int64).tolist()))
            if done:
                yield rows(list(zip(*done)), out)

    fields = "anchor long, n long, doc_id long, digest long, lo long, h array<long>"
    spread = source.mapInArrow(run, fields).select("anchor", "n", "doc_id", "digest", "lo", F.posexplode("h").alias("i", "h"))
    return spread.select("anchor", "n", "doc_id", "digest", (F.col("lo") + F.col("i")).alias("start"), "h")


def recurring(source: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, digest, lo, hi): windows lo..hi whose word sequences start elsewhere too.

    Stretches that recur as a whole are counted as such. Those that occur once
    beside others with their anchor are counted window by window.
    """
    again, distinct, several = candidates(stretches(source, Words, window, gram))
    whole = again.join(distinct.where("n > 1").select("anchor", "seg"), ["anchor", "seg"]).select("doc_id", "digest", "lo", "hi")
    mixed = several.select("first.*", "anchor", "n")
    single = stage(window_hashes(with_lists(source, mixed, "inner"), window), "windows")
    twice = stage(single.groupBy("anchor", "h").agg(F.sum("n").alias("total")).where("total > 1").select("anchor", "h"), "twice")
    lone = single.where("n = 1").join(twice, ["anchor", "h"]).select("doc_id", "digest", F.col("start").cast("int").alias("lo"), F.col("start").cast("int").alias("hi"))
    return stage(whole.unionByName(lone), "recurring")


class PhraseAutomaton:
    """Passages as strings with one character for each distinct word (two beyond a million words)."""

    def __init__(self, passages: list[list[bytes]]):
        words = {w for p in passages for w in p}
        wide = len(words) > 1_000_000
        self.width = 2 if wide else 1
        if wide:  # first and second characters come from ranges of their own, so matches keep step
            code = lambda i: chr(0x10000 + i // 50_000) + chr(0x80000 + i % 50_000)
        else:
            code = lambda i: chr(i + 1 if i < 0xD7FF else i + 0x801)  # noqa: E731  past the surrogates
        self.code = {w: code(i) for i, w in enumerate(sorted(words))}
        self.other = "\0" * self.width
        self.automaton = ahocorasick.Automaton()
        for p in passages:
            self.automaton.add_word("".join(map(self.code.__getitem__, p)), len(p))
        if passages:
            self.automaton.make_automaton()

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, end) of every occurrence of every passage."""
        if self.code:
            get, other = self.code.get, self.other
            for last, size in self.automaton.iter("".join([get(w, other) for w in words])):
                end = last // self.width + 1
                yield end - size, end


def _runs(parts: list[dict], window: int, longest: int = 512) -> list[tuple[int, int]]:
    """Word spans of maximal runs of consecutive windows, cut after ``longest`` windows: an automaton is as deep as its longest passage."""
    out: list[list[int]] = []
    for lo, hi in sorted((p["lo"], p["hi"]) for p in parts):
        if out and lo <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(at, min(at + longest - 1, hi) + window) for lo, hi in out for at in range(lo, hi + 1, longest)]


def covered(n: int, spans: Iterator[tuple[int, int]]) -> tuple[np.ndarray, list[dict]]:
    """Which of n units are covered, and the maximal spans."""
    step = np.zeros(n + 1, np.int64)
    for start, end in spans:
        step[start] += 1
        step[end] -= 1
    mask = np.cumsum(step[:-1]) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, mask, False].astype(np.int8))).tolist()
    return mask, [{"start": s, "end": e} for s, e in zip(edge[::2], edge[1::2])]


def remove_phrases(docs: DataFrame, window: int = 35, gram: int = 8, block_words: int = 300_000, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, n_words, n_removed, spans, kept): texts without the passages that recur.

    A window of ``window`` words is removed where its word sequence starts
    anywhere else, in the same document or another; kept has the other words
    joined by one space, spans the removed runs of words. First the recurring
    passages are confirmed over the whole corpus; then each shard of about
    ``block_words`` words of documents compiles the passages confirmed in it
    into one automaton and streams its documents through it. Null texts are
    empty; texts shorter than a window lose nothing; rows that repeat are
    documents of their own and lose what they share; null ids stay null.
    """
    source = documents(docs, key, text)
    return _stream(with_lists(source, recurring(source, window, gram), "left"), window, block_words)


def _stream(given: DataFrame, window: int, block_words: int) -> DataFrame:
    """Compiles and runs the automata; a column ``rest`` is handed on, and then unchanged texts keep their white space."""
    rest = "rest" in given.columns
    fields = T.StructType.fromDDL("doc_id long, digest long, n_words long, n_removed long, spans array<struct<start: long, end: long>>, kept string")
    if rest:
        fields = fields.add(given.schema["rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size, out = 0, OUT

        def shard() -> pa.RecordBatch:
            passages = {tuple(w[s:e]) for _, _, w, parts, *_ in held for s, e in _runs(parts, window)}
            automaton = PhraseAutomaton([list(p) for p in passages])
            done = []
            for doc, g, w, _, *more in held:
                mask, spans = covered(len(w), automaton.occurrences(w))
                kept = w if not spans else [x for x, gone in zip(w, mask.tolist()) if not gone]
                left = more[0] if rest and not spans else b" ".join(kept).decode()
                done.append((doc, g, len(w), len(w) - len(kept), spans, left, *more[1:]))
            return rows(list(zip(*done)), out)

        for b in batches:
            out = OUT.append(b.schema.field("rest")) if rest else OUT
            for doc, g, t, parts, *more in zip(*(b.column(c).to_pylist() for c in ("doc_id", "digest", "text", "parts", *["rest"] * rest))):
                held.append((doc, g, t.encode().split(), parts or [], *([t, *more] if rest else [])))
                size += len(held[-1][2])
                if size >= block_words:
                    yield shard()
                    held, size = [], 0
        if held:
            yield shard()

    return given.mapInArrow(run, fields)


def without_phrases(docs: DataFrame, window: int = 50, gram: int = 8, block_words: int = 300_000, key: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with their passages removed from the text column, and its length, where there is a column for it.

    As ``remove_phrases``; every row stays, texts that lose nothing stay as
    they are (null: empty), the others have the words left joined by one space.
    """
    source = documents(docs, key, text, rest=True)
    given = with_lists(source, recurring(source.drop("rest"), window, gram), "left")
    back = _stream(given, window, block_words)
    cols = {text: F.col("kept"), n_chars: F.length("kept").cast("long")}
    return back.select(*(cols.get(c, F.col(f"rest.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
