"""Ranked lexical search by the Best Position Algorithm.

Documents are cut into blocks. In a block every term of the queries has an
impact list: the documents that hold the term, the highest impact first. A
query reads its lists side by side from the top. A document met for the first
time is looked up in all lists (direct access), which gives its whole score and
marks its position in each of them as seen. The best position of a list is the
end of its unbroken run of seen positions; no unseen document can score above
the sum of the impacts there. Reading stops once that sum is strictly below the
k-th score: an equal score could still win by its smaller id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foldline.llm.common import n_parts, rows, stage, texts

# Bytes of terms: letters (A-Z lower-cased), digits and all of any character beyond ASCII; the others separate.
_SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
NO_ID = (1 << 63) - 1  # rows without an id rank behind all others of their score
BLOCK = 1 << 21  # postings of a block
STEP = 32  # positions of every list that are read before the next look at the threshold


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_SPLIT).split()


def postings(docs: DataFrame, number: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n, term, tf): for every row its number of terms, and the queries' terms in it with their occurrences."""
    src = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("term", pa.list_(pa.int32())), ("tf", pa.list_(pa.int32()))])
    shared = docs.sparkSession.sparkContext.broadcast(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            sizes, ids, counts = [], [], []
            for raw in texts(b):
                found = terms(raw)
                sizes.append(len(found))
                t, c = np.unique(np.array([known[w] for w in found if w in known], np.int32), return_counts=True)
                ids.append(t)
                counts.append(c.astype(np.int32))
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
            flat = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x) if x else np.zeros(0, np.int32))) for x in (ids, counts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), *flat], schema=out)

    return src.mapInArrow(run, "doc_id long, n long, term array<int>, tf array<int>")


class Block:
    """Impact lists of one block of documents, and direct access to them."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, n_docs: int, n_terms: int):
        """One posting each: document (0.., ascending id), term number, impact above 0; in any order."""
        by_impact = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[by_impact], impact[by_impact]
        self.start = np.searchsorted(term[by_impact], np.arange(n_terms + 1))
        key = term[by_impact].astype(np.int64) * n_docs + self.doc
        self.at = np.argsort(key)  # where the posting of a (term, document) lies
        self.key = key[self.at]
        self.n_docs = n_docs
        self.seen = np.zeros(len(doc), bool)

    def direct(self, term: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of documents by these terms' lists, and the places of their postings there."""
        if not len(self.key):
            return np.zeros(len(doc), np.int64), np.zeros(0, np.int64)
        want = (term[:, None].astype(np.int64) * self.n_docs + doc).ravel()
        near = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        hit = self.key[near] == want
        place = self.at[near]
        score = np.where(hit, self.impact[place], 0).reshape(len(term), len(doc)).sum(axis=0)
        return score, place[hit]

    def best(self, term: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k highest-scoring documents of a query with scores above 0, by score and then document; fewer if there are no more."""
        lo, hi = self.start[term], self.start[term + 1]
        term, lo, hi = term[hi > lo], lo[hi > lo], hi[hi > lo]
        best = lo.copy()  # first position that is not seen
        met = np.zeros(self.n_docs, bool)
        docs, scores, touched = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
        read, step, kth = 0, STEP, 0
        while True:
            part = [self.doc[a:b] for a, b in zip(np.minimum(lo + read, hi), np.minimum(lo + read + step, hi))]
            new = np.unique(np.concatenate([np.zeros(0, np.int64), *part]))
            new = new[~met[new]]
            met[new] = True
            read += step
            score, place = self.direct(term, new)
            self.seen[place] = True
            touched.append(place)
            docs.append(new)
            scores.append(score)
            all_scores = np.concatenate(scores)
            if len(all_scores) > 4 * k + 1024:  # only those that can still be among the k
                high = all_scores >= kth
                docs, scores = [np.concatenate(docs)[high]], [all_scores[high]]
                all_scores = scores[0]
            if len(all_scores) >= k:
                kth = int(np.partition(all_scores, len(all_scores) - k)[len(all_scores) - k])
            limit = 0
            for i in range(len(term)):
                while best[i] < hi[i]:
                    ahead = self.seen[best[i] : min(best[i] + 2 * step, hi[i])]
                    run = int(np.argmin(ahead)) if not ahead.all() else len(ahead)
                    best[i] += run
                    if run < len(ahead):
                        limit += int(self.impact[best[i]])  # the next document of this list may have this much
                        break
            if limit == 0 or (len(all_scores) >= k and limit < kth):
                break
            step = min(2 * step, 1 << 12)
        for place in touched:
            self.seen[place] = False
        doc, score = np.concatenate(docs), np.concatenate(scores)
        order = np.lexsort((doc, -score))[:k]
        return doc[order], score[order]


def impacts(weight: np.ndarray, tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term adds to a document's score, in 64-bit integers; length: the document's, 100 on average."""
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * length))


def _block_of_items(items: DataFrame, docs: DataFrame, k: int, key: str, text: str) -> DataFrame:
    """The k best documents of every item of a bounded block of items, from each block of documents."""
    found = {r.item_id: sorted(set(terms((r.text or "").encode()))) for r in items.collect()}
    number = {w: i for i, w in enumerate(sorted({w for ws in found.values() for w in ws}))}
    listed = stage(postings(docs, number, key, text), "postings")
    total = listed.agg(F.count(F.when(F.col("n") > 0, 1)).alias("with_terms"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_terms")).first()
    df = np.zeros(len(number), np.int64)
    for r in listed.select(F.explode("term").alias("t")).groupBy("t").count().collect():  # one row for each term of the block
        df[r.t] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * total.with_terms + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    asked = {i: np.array([number[w] for w in ws], np.int64) for i, ws in found.items()}
    shared = docs.sparkSession.sparkContext.broadcast((weight, asked))
    n_docs, n_words = int(total.with_terms), max(1, int(total.all_terms))
    out = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, asked = shared.value
        t = pa.Table.from_batches(held)
        ids = t["doc_id"].fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        size = t["term"].combine_chunks().value_lengths().to_numpy()
        doc = np.repeat(place, size)
        length = np.repeat(50 + (50 * t["n"].to_numpy() * n_docs) // n_words, size)
        term = t["term"].combine_chunks().flatten().to_numpy().astype(np.int64)
        impact = impacts(weight[term], t["tf"].combine_chunks().flatten().to_numpy().astype(np.int64), length)
        block = Block(doc[impact > 0], term[impact > 0], impact[impact > 0], len(ids), len(weight))
        ids = ids[order]
        for item, of in asked.items():
            docs, score = block.best(of, k)
            if len(docs):
                yield rows(([item] * len(docs), [None if i == NO_ID else i for i in ids[docs].tolist()], score.tolist()), out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += len(b.column("term").flatten()) + b.num_rows
            if size >= BLOCK:
                yield from search(held)
                held, size = [], 0
        if held:
            yield from search(held)

    return listed.mapInArrow(run, "item_id long, doc_id long, score long")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, block_chars: int = 4_000_000, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of every item with scores above 0.

    A document's score sums, over the item's distinct terms, the term's weight
    times its saturated occurrences; see ``impacts``. Every row of docs is a
    document: repeated rows count in the statistics and rank one behind the
    other. Equal scores rank by id, null ids last. Null and empty texts have no
    terms and are never found; items without terms and items without an id give
    no rows; of items with one id the one that comes last in text order counts.
    No documents or no items: no rows.

    Items are asked in blocks of about ``block_chars`` characters, which pass
    through the driver; documents are read once for each block of items and not
    shuffled. Best documents of the blocks meet in two steps, so no task gets
    more than a share of them.
    """
    asked = items.select(F.col(item_key).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null")
    asked = stage(asked.groupBy("item_id").agg(F.max("text").alias("text")), "items")
    n_blocks = 1 + int(asked.agg(F.sum(F.length("text") + 16)).first()[0] or 0) // block_chars
    of_block = F.pmod(F.xxhash64("item_id"), F.lit(n_blocks))
    found = None
    for i in range(n_blocks):
        part = stage(_block_of_items(asked.where(of_block == i), docs, k, key, text).withColumn("part", F.spark_partition_id()), "found")
        found = part if found is None else found.unionByName(part)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = Window.partitionBy("item_id", F.pmod("part", F.lit(n_parts(docs)))).orderBy(*order)
    first = found.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
