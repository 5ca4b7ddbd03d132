"""Ranked search, spelling variants and the quality machine against brute force, and on the awkward rows of any table."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldline.llm import quality, ranked, variants
from foldline.llm.common import table

SCHEMA = "doc_id long, text string, n_chars long, n long, word string, term string, score double, size int"


def frame(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, None if t is None else len(t), 5, "clash", "clash", 0.1, 3) for i, t in texts], SCHEMA).repartition(3)


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# -- ranked search --------------------------------------------------------------


def brute_ranked(docs, items, k):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = [(i, collections.Counter(term.findall((t or "").translate(low)))) for i, t in docs]
    n_docs = sum(bool(c) for _, c in counts)
    n_terms = sum(c.total() for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            m = 50 + (50 * c.total() * n_docs) // n_terms if n_terms else 0
            score = 0
            for t in set(term.findall((text or "").translate(low))):
                if c[t]:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(found[:k])]
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def ranked_case():
    r = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "éa", "x9", "İ"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(i, r.choice([" ", "-", "\n", "."]).join(r.choices(vocabulary, weights, k=r.randint(1, 80))).title()) for i in range(300)]
    docs += [(500 + i, docs[7][1]) for i in range(90)]  # copies: ties at the k-th score
    docs += [(600, None), (601, ""), (602, " .,!"), (None, docs[9][1]), (603, docs[9][1]), (603, docs[9][1]), (604, "w0 " * 30000)]
    items = [(i, " ".join(r.choices(vocabulary, k=r.randint(1, 12)))) for i in range(25)] + [(90, docs[7][1]), (91, None), (92, ""), (93, "unknown word"), (94, "w0 W0 w0")]
    return docs, items


@pytest.mark.parametrize("block, block_chars, step", [(1 << 21, 4_000_000, 32), (200, 300, 1)])
def test_ranked_search_is_brute_force(spark, ranked_case, monkeypatch, block, block_chars, step):
    docs, items = ranked_case
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "STEP", step)
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id long")
    got = ranked.ranked_search(frame(spark, docs), asked, k=50, block_chars=block_chars)
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == brute_ranked(docs, items, 50)


def test_reading_stops_before_the_lists_end():
    rng = np.random.default_rng(4)
    n = 20_000
    doc = np.concatenate([np.arange(n), np.arange(n)])
    term = np.repeat([0, 1], n)
    block = ranked.Block(doc, term, rng.integers(1, 10**9, 2 * n), n, 2)
    asked = []
    direct = block.direct
    block.direct = lambda t, d: (asked.append(len(d)), direct(t, d))[1]
    docs, score = block.best(np.array([0, 1]), 10)
    whole = np.bincount(block.doc, block.impact, n)
    order = np.lexsort((np.arange(n), -whole))[:10]
    assert docs.tolist() == order.tolist() and score.tolist() == whole[order].astype(int).tolist()
    assert sum(asked) < n / 2 and not block.seen.any()


def test_ranked_search_of_empty_tables(spark, ranked_case):
    docs, items = ranked_case
    none = frame(spark, docs).where("false")
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked.ranked_search(none, asked).count() == 0
    assert ranked.ranked_search(frame(spark, docs), asked.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
    assert ranked.ranked_search(frame(spark, docs), asked.where("false")).count() == 0


# -- spelling variants -----------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs, least_length=7, every=31, ratio=10):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    count = collections.Counter()
    for i, t in docs:
        for w in re.findall("[A-Za-zÀ-ÿ]+", (t or "").translate(low)):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= least_length:
                count[w] += 1
    count = {w: n for w, n in count.items() if n >= 2}
    form, out = {}, []
    neighbours = {w: [x for x in count if near(w, x)] for w in count}
    for w, n in count.items():
        best = min(neighbours[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= ratio * n else None
    for w, n in count.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n, len(neighbours[w]), form[w], count[form[w]] if form[w] else None, root))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def misspelt():
    r = random.Random(3)
    letters = "abcdéÿ"
    words = ["".join(r.choice(letters) for _ in range(r.randint(5, 12))) for _ in range(25)] + ["aaaaaaaa", "bbbbbbb", "longest" * 9]
    weights = [3.0 ** -(i % 9) for i in range(len(words))]

    def spelt(w):
        at, kind = r.randrange(len(w)), r.randrange(8)
        return [w[:at] + w[at + 1 :], w[:at] + r.choice(letters) + w[at:], w[:at] + r.choice(letters) + w[at + 1 :]][kind] if kind < 3 else w

    docs = [(i, r.choice(" ,7_\n").join(spelt(w).title() if r.random() < 0.2 else spelt(w) for w in r.choices(words, weights, k=120))) for i in range(60)]
    chain = "chainedx " * 400 + "chainedxy " * 30 + "chainedxyz " * 2
    return [*docs, (70, chain), (71, None), (72, ""), (73, "Éclairage éclairage ÉCLAIRAGE ××××××× Ωmegatron"), (None, docs[0][1]), (74, docs[3][1]), (74, docs[3][1]), (75, "z" * 9000 + " " + "z" * 9001)]


@pytest.mark.parametrize("chunk, letters", [(variants.CHUNK, variants.LETTERS), (3, 60)])
def test_variants_are_brute_force(spark, misspelt, monkeypatch, chunk, letters):
    monkeypatch.setattr(variants, "LETTERS", letters)
    got = variants.variant_groups(frame(spark, misspelt), every=5, chunk=chunk)
    want = brute_variants(misspelt, every=5)
    assert rows_of(got, "word", "n", "n_near", "form", "form_n", "root") == want
    assert any(w[3] for w in want) and any(w[5] not in (w[0], w[3]) for w in want)


def test_variants_of_the_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    got = variants.variant_groups(docs)
    assert rows_of(got, "word", "n", "n_near", "form", "form_n", "root") == brute_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert variants.variant_groups(docs.where("false")).count() == 0


def test_buckets_are_divided_until_small(spark):
    words = ["ab" + x + y + z + "cdef" for x in "abcdefgh" for y in "abcdefgh" for z in "abcdefgh"]
    counts = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    pairs = variants.near_pairs(counts, chunk=20)
    assert pairs.count() == 512 * 21 == pairs.distinct().count()


# -- factorisation machine -----------------------------------------------------------


def small_machine(rank=4):
    rng = np.random.default_rng(1)
    edges = np.sort(rng.normal(size=(3, quality.BINS - 1)), axis=1)
    m = quality.Machine(edges, np.arange(50), 0.3, np.zeros(0), np.zeros((0, rank)))
    m.weight, m.factor = rng.normal(size=m.n_bins + 50), rng.normal(size=(m.n_bins + 50, rank))
    return m


def test_sum_of_squares_identity_is_the_sum_over_pairs():
    m, rng = small_machine(), np.random.default_rng(2)
    values = rng.normal(size=(6, 3))
    values[2, 1] = np.nan
    words = [np.sort(rng.choice(50, k, replace=False)) for k in (0, 1, 2, 7, 20, 0)]
    feature, value, starts = quality._flat(m, values, words)
    ends = np.r_[starts[1:], len(feature)]
    for got, s, e in zip(m.logits(feature, value, starts), starts, ends):
        f, x = feature[s:e], value[s:e]
        want = m.constant + (m.weight[f] * x).sum()
        want += sum(m.factor[f[i]] @ m.factor[f[j]] * x[i] * x[j] for i in range(len(f)) for j in range(i))
        assert math.isclose(got, want, rel_tol=1e-9)


def test_pairs_of_features_are_learnt():
    rng = np.random.default_rng(5)
    values = rng.random((3000, 2))
    y = ((values[:, 0] > 0.5) != (values[:, 1] > 0.5)).astype(float)  # neither statistic tells alone
    m = quality.fit_machine(values[:2000], [np.zeros(0, np.int32)] * 2000, y[:2000], steps=40)
    got = m.logits(*quality._flat(m, values[2000:], [np.zeros(0, np.int64)] * 1000))
    assert ((got > 0) == (y[2000:] > 0)).mean() > 0.9


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in quality.score(docs, quality.train(docs, labels)).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(a == b for a, b in held) / len(held) > 0.95 and sum(a == b for a, b in held if a == 0) / sum(a == 0 for a, _ in held) > 0.8
    # Labels of the held-out third, language and source change nothing.
    other = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = quality.score(docs, quality.train(docs.withColumn("lang", F.lit("xx")).drop("source"), other)).collect()
    assert all(r.score == got[r.doc_id].score for r in again)


def test_quality_of_awkward_rows(spark):
    texts = [(i, t) for i, t in enumerate([None, "", " \n", "word " * 40000, "é ÿ", "a", "!!", "|" * 500])] + [(3, "word"), (3, "word"), (None, "No id at all.")]
    docs = frame(spark, texts)
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, None), (None, 1), (5, 1), (5, 0), (77, 1)], "doc_id long, quality int")
    for learnt, cols in ((labels, ("n_chars",)), (labels.where("false"), ()), (labels.where("quality = 1"), ("missing", "n_chars"))):
        machine = quality.train(docs, learnt, metadata=cols)
        got = quality.score(docs, machine, metadata=cols).collect()
        assert len(got) == len(texts) and all(0 <= r.score <= 1 for r in got) and sum(r.doc_id is None for r in got) == 1
        assert quality.score(docs.where("false"), machine, metadata=cols).count() == 0
    assert quality.train(docs.where("false"), labels).constant == 0
    batch = pa.RecordBatch.from_arrays([pa.array([3, None, -1])], ["meta0"])
    assert np.isnan(quality._meta(batch, 1)[1:]).all()
