"""Operators on whole documents against brute force, and on the awkward rows of any table."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foldline.llm import decontaminate, fingerprints, html_text, licences, lm, packing, phrases, simhash, suffixes, toxicity
from foldline.llm.anchors import anchored, gram_hashes, mixed
from foldline.llm.common import table
from foldline.llm.components import components
from foldline.llm.tokens import byte_pairs

SCHEMA = "doc_id long, text string, lang string, n_chars long, digest string, rest int"


def frame(spark, texts):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(i, t, "xx", None if t is None else len(t), "clash", 7) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared and periodic passages, empty, null and long texts, repeated rows, a null id."""
    r = random.Random(5)
    words = ["a", "b", "ab", "ç", "éa"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(1, 250))) for _ in range(10)]
    out = []
    for i in range(36):
        x, y = r.choice(base), r.choice(base)
        k = r.randint(0, len(x))
        out.append((i, x[:k] + y[k // 2 :]))
    return [*out, (40, "a " * 300), (41, "ab" * 250), (42, ""), (43, None), (44, out[3][1]), (44, out[3][1]), (None, out[5][1]), (46, "Word, " * 5000), (47, " \n\t ")]


def text_of(t):
    return t or ""


# -- SimHash ------------------------------------------------------------------


def brute_print(t, k=4):
    w = text_of(t).encode().lower().split()
    n = min(k, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + n]), 42) for i in range(len(w) - n + 1)] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


@pytest.mark.parametrize("chunk", [4096, 3])
def test_simhash_components(spark, corpus, chunk):
    got = simhash.near_duplicates(simhash.fingerprints(frame(spark, corpus)), 4, simhash.pigeonhole_masks(4), chunk).collect()
    prints = [(i, brute_print(t)) for i, t in corpus]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(prints):
        least[find(k)] += [i] if i is not None else []
    want = sorted((repr(i), f, min(least[find(k)])) for k, (i, f) in enumerate(prints))
    assert sorted((repr(r.doc_id), r.f0 % (1 << 64), r.component_id) for r in got) == want


def test_bit_sliced_distances_and_hot_buckets():
    rng = np.random.default_rng(2)
    for words, radius in ((1, 4), (1, 0), (4, 39)):
        p = rng.integers(0, 1 << 63, (300, words), dtype=np.uint64)
        near = p[rng.integers(0, 300, 500)] ^ (np.uint64(1) << rng.integers(0, 64, (500, words), dtype=np.uint64))
        p = np.concatenate([p, near])
        group = np.sort(rng.integers(0, 5, len(p)))
        own, root = simhash.bucket_links(group, p, radius)
        label = np.arange(len(p))
        label[own] = root
        d = np.bitwise_count(p[:, None, :] ^ p[None]).sum(axis=2)
        link = (d <= radius) & (group[:, None] == group[None])
        want = np.arange(len(p))
        while True:
            new = np.array([want[link[i]].min() for i in range(len(p))])
            if (new == want).all():
                break
            want = new
        assert (label == want).all()


def test_components_of_a_chain_and_of_nothing(spark):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 100), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def groups_of(texts, radius=4):
    """The first of each text's group, by links of all pairs of fingerprints."""
    prints = [brute_print(t) for t in texts]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("chunk", [4096, 3])
def test_near_copies_leave_one(spark, chunk):
    """Copies with more and more words replaced, chains of them, short texts, and one phrase repeated often."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(7))
    texts = ["", None, " \n"]
    for k in range(60):
        base = [word() for _ in range(r.choice([12, 40, 150, 600]))]
        texts.append(" ".join(base))
        for at in r.sample(range(len(base)), k % 5):
            base[at] = word()
        texts.append(" ".join(base))
    chain = [word() for _ in range(900)]
    texts += [" ".join(chain[3 * i : 3 * i + 800]) for i in range(6)]
    texts += [" ".join(["one and the same phrase again"] * 200 + [word() for _ in range(60)]) for _ in range(3)]
    docs = frame(spark, list(enumerate(texts)))
    want = groups_of(texts)
    kept = simhash.simhash_dedup(docs, chunk=chunk)
    assert sorted(x.doc_id for x in kept.collect()) == sorted(set(want)) and kept.columns == docs.columns
    assert 60 < len(set(want)) < len(texts) - 20


def test_repeated_rows_and_null_ids_leave_one(spark):
    assert simhash.simhash_dedup(frame(spark, [(20, "x"), (20, "x")])).count() == 1
    assert [x.doc_id for x in simhash.simhash_dedup(frame(spark, [(None, "x y z w v"), (3, "x y z w v"), (9, "x y z w v")])).collect()] == [3]
    assert [x.doc_id for x in simhash.simhash_dedup(frame(spark, [(None, "x y z w v"), (None, "x y z w v")])).collect()] == [None]


# -- Licences -----------------------------------------------------------------


def brute_licences(docs, templates, least=0.8):
    found = []
    for i, t in docs:
        w = licences.words_of(t or "")
        bg = list(zip(w, w[1:]))
        for name, text in templates.items():
            k = licences.words_of(text)
            grams = set(zip(k, k[1:]))
            hits = []
            for p in range(len(bg)):
                for size in licences.window_sizes(text, least):
                    x = set(bg[p : p + size])
                    if bg[p] in grams and 2 * len(x & grams) / (len(x) + len(grams)) >= least - 1e-12:
                        hits.append((2 * len(x & grams) / (len(x) + len(grams)), p))
            if hits:
                starts = sorted({p for _, p in hits})
                places = sum(j == 0 or p - starts[j - 1] >= len(k) - 1 for j, p in enumerate(starts))
                best = max(d for d, _ in hits)
                found.append((repr(i), name, places, round(best, 9), min(p for d, p in hits if d == best)))
    return sorted(found)


def test_licences(spark):
    mit, apache = licences.TEMPLATES["mit-grant"], licences.TEMPLATES["apache-2.0-header"]
    docs = [(1, "Some words to begin with.\nReleased under THE mit license\nand some more"), (2, mit.replace(" ", "\n", 3)), (3, "Released under"), (4, None), (5, ""), (6, mit.replace("charge", "cost"))]
    docs += [(7, "a b"), (None, "licensed under cc by nc 4 0"), (1, "Some words to begin with.\nReleased under THE mit license\nand some more")]
    docs += [
        (10, "Copyright 2024 Jane Doe. Released under the MIT License."),
        (11, "This project is released under the MIT License, see LICENSE."),
        (12, "A long paragraph that ends with the notice, released\nunder the MIT\nLicense. And then it goes on for a while."),
        (13, apache.replace(" http", "\n\n    http").replace("2.0 Unless", "2.0\n\nUnless")),
        (14, "Copyright (c) 2020 X\n\n" + licences.TEMPLATES["mit-text"].replace("conditions: ", "conditions:\n\n").replace(". IN NO", ".\nIN NO")),
        (15, ("Released under the MIT License. " + "other words entirely and more of them " * 3) * 4),
        (16, "of the software and the use of the license " * 2000 + "Licensed under CC BY 4.0."),
        (17, "word " * 60_000),
    ]
    got = licences.scan(frame(spark, docs).withColumn("licence", F.lit("clash")).withColumn("w", F.lit("clash"))).collect()
    assert sorted((repr(r.doc_id), r.licence, r.n_places, round(r.dice, 9), r.start) for r in got) == brute_licences(docs, licences.TEMPLATES)
    found = collections.Counter((r.doc_id, r.licence) for r in got)
    assert found[1, "mit"] == 2 and all(found[i, "mit"] == 1 for i in (10, 11, 12, 15)) and found[13, "apache-2.0-header"] == 1 and found[14, "mit-text"] == 1
    assert next(r.n_places for r in got if r.doc_id == 15) == 4 and all(r.dice == 1 for r in got if r.licence == "mit")
    assert not {3, 4, 5, 7, 17} & {r.doc_id for r in got}


def test_licence_templates_that_tie_or_say_nothing(spark):
    docs = frame(spark, [(1, "one two three four five six")])
    templates = {"b": "two three four", "a's": "Two, three: four!", "short": "one", "none": "..."}
    got = licences.scan(docs, templates).collect()
    assert sorted((r.licence, r.dice, r.start) for r in got) == [("a's", 1.0, 1), ("b", 1.0, 1)]
    assert licences.scan(docs, {"none": "..."}).count() == 0


def test_needed_words_lose_no_match():
    r = random.Random(3)
    grams = lambda w: set(zip(w, w[1:]))
    for text in licences.TEMPLATES.values():
        words = licences.re.sub("[^a-z0-9]+", " ", text.lower()).split()
        need = licences.needed_words(text, 0.8)
        for _ in range(30):
            w = [x for x in words if r.random() > 0.1]
            if len(w) > 1 and 2 * len(grams(w) & grams(words)) / (len(grams(w)) + len(grams(words))) >= 0.8:
                assert need & set(w)


# -- Packing ------------------------------------------------------------------


def test_packing_round_trip(spark, corpus):
    capacity = 64
    got = collections.defaultdict(list)
    rows = packing.pack(frame(spark, corpus), capacity).collect()
    for r in rows:
        got[r.doc_id, r.doc_tokens].append(r)
    ids = {}
    for i, t in corpus:
        ids.setdefault((i, zlib.crc32(x := byte_pairs().encode(text_of(t)) + (1).to_bytes(4, "little"))), []).append(x)
    want = collections.Counter((i, len(x) // 4) for (i, _), xs in ids.items() for x in xs)
    for (i, n), pieces in got.items():
        assert sum(p.length for p in pieces) == n * want[i, n]
        for p in pieces:
            whole = next(x for (d, _), xs in ids.items() for x in xs if d == i and len(x) // 4 == n)
            assert zlib.crc32(whole[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32
    assert set(got) == set(want)
    by = collections.defaultdict(list)
    for r in rows:
        by[r.sequence_id].append(r)
    for pieces in by.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at == capacity or at & (at - 1) == 0


def test_sum_of_squares_chooses_the_smallest_sum():
    r = random.Random(4)
    packer = packing.SumOfSquares(20)
    for _ in range(300):
        size = r.randint(1, 20)
        before = packer.level[1:20].copy()
        sums = {}
        for at in [0, *np.flatnonzero(before) + 1]:
            if at + size <= 20:
                after = before.copy()
                if at:
                    after[at - 1] -= 1
                if at + size < 20:
                    after[at + size - 1] += 1
                sums[at] = (after**2).sum()
        packer.place((0, 0, b"\0\0\0\0" * size, size))
        assert (packer.level[1:20] ** 2).sum() == min(sums.values())


def test_token_ids_equal_the_tokenizers_library():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ["", " ", "a  b", " a\n\n b\t\tc ", "it's 12,5 €! x", "x<|endoftext|> y", "\x1c a\x85b", "日本 語\r\n", "a" * 500, "  \n  x's 's"]:
        assert np.frombuffer(byte_pairs().encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


# -- LM scores ----------------------------------------------------------------


def test_lm_scores(spark, corpus):
    half = [collections.Counter(), collections.Counter()]
    for i, t in corpus:
        w = text_of(t).encode().split()
        for n in (1, 2, 3):
            half[(i or 0) % 2].update(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    want = []
    for i, t in corpus:
        c = half[1 - (i or 0) % 2]
        total = max(1, sum(v for k, v in c.items() if len(k) == 1))
        w, s = text_of(t).encode().split(), 0.0
        for k in range(len(w)):
            for n in range(min(3, k + 1), 0, -1):
                gram = tuple(w[k - n + 1 : k + 1])
                if n == 1:
                    s += np.log(max(c[gram], 1) / total)
                elif c[gram]:
                    s += np.log(c[gram] / c[gram[:-1]])
                    break
                else:
                    s += np.log(0.4)
        want.append((repr(i), len(w), round(s, 3)))
    got = [(repr(r.doc_id), r.n_words, round(r.log_score, 3)) for r in lm.score(frame(spark, corpus)).collect()]
    assert [g[:2] for g in sorted(got)] == [w[:2] for w in sorted(want)]
    assert np.allclose([g[2] for g in sorted(got)], [w[2] for w in sorted(want)], atol=0.002)


# -- Fingerprints -------------------------------------------------------------


def test_prefix_hashes_and_common_extensions():
    rng = np.random.default_rng(3)
    codes = rng.integers(0, 2, 70_000).astype(np.uint32)  # beyond one table of powers
    a = fingerprints.PrefixHash(codes)
    text = codes.tobytes()
    i, j = rng.integers(0, 69_900, 400), rng.integers(0, 69_900, 400)
    same = np.array([text[4 * x : 4 * x + 24] == text[4 * y : 4 * y + 24] for x, y in zip(i, j)])
    assert ((a.spans(i, i + 6) == a.spans(j, j + 6)) == same).all()
    assert (a.windows(6)[i] == a.spans(i, i + 6)).all()
    got = fingerprints.common_extension(a, i, a, j)
    for x, y, n in zip(i.tolist(), j.tolist(), got.tolist()):
        assert (codes[x : x + n] == codes[y : y + n]).all()
        assert max(x, y) + n == len(codes) or codes[x + n] != codes[y + n]


def test_edited_hashes_and_likeness():
    rng = np.random.default_rng(6)
    big = np.array([0, fingerprints.PRIME, 2 * fingerprints.PRIME, (1 << 63) - 1, *rng.integers(0, 1 << 63, 500)], np.uint64)
    assert (fingerprints._mod(big) == big % np.uint64(fingerprints.PRIME)).all()
    for n, m in [(0, 0), (0, 9), (3, 40), (16, 16), (17, 2), (40, 0), (61, 200), (64, 3), (500, 7), (500, 90), (2000, 2000), (3000, 15), (3000, 16)]:
        old, new = (rng.integers(97, 97 + k, size).astype(np.uint32) for size, k in ((n, 3), (m, 4)))
        edited = np.concatenate([old[: n - n // 4], new[: n // 4]])
        a, b = fingerprints.PrefixHash(old), fingerprints.PrefixHash(new)
        got = fingerprints.edited_hashes(a, old, fingerprints.span_hashes(a, 16), new, fingerprints.span_hashes(b, 16), 16)
        assert sorted(got) == sorted(fingerprints.span_hashes(fingerprints.PrefixHash(edited), 16))
    for n in (20, 40, 5000):
        x = rng.integers(97, 123, n).astype(np.uint32)
        for keep in (0.0, 0.3, 0.7, 1.0):
            y = np.concatenate([x[: int(keep * n)], rng.integers(97, 123, n - int(keep * n)).astype(np.uint32)])
            spans = [{c[i : i + 16].tobytes() for i in range(n - 15)} for c in (x, y)]
            dice = 2 * len(spans[0] & spans[1]) / (len(spans[0]) + len(spans[1]))
            sketches = [fingerprints.sketch(fingerprints.span_hashes(fingerprints.PrefixHash(c), 16), 64) for c in (x, y)]
            got = fingerprints.likeness(*sketches, 64)
            assert abs(got - dice) < (1e-9 if n < 45 else 0.2)  # small sets are held whole
    repeats = np.repeat(np.arange(70, dtype=np.uint32), 500)
    assert (fingerprints.sketch(repeats, 64) == np.arange(64)).all() and (fingerprints.sketch(np.zeros(900, np.uint32), 64) == [0]).all()


def test_neighbour_fingerprints(spark, corpus):
    docs = [(i, t) for i, t in corpus if i != 44] + [(44, corpus[3][1])]
    got = {r.doc_id: r for r in fingerprints.neighbour_fingerprints(frame(spark, docs)).collect()}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0))
    assert len(got) == len(docs)
    prints = collections.defaultdict(set)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1]):
        t, u = text_of(t), text_of(u)
        n = len(t)
        edited = t[: n - n // 4] + u[: n // 4]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and got[i].n_chars == n
        assert 0 <= got[i].near_edited <= 1 and (edited != t or got[i].near_edited == 1)
        prints[t].add(got[i].fingerprint)
        prints[edited].add(got[i].edited_fingerprint)
    assert all(len(v) == 1 for v in prints.values())
    many = [(None, f"text {i} " * 9) for i in range(50)] + [(7, f"other {i} " * 9) for i in range(50)]
    assert fingerprints.neighbour_fingerprints(frame(spark, many)).count() == 100
    one = fingerprints.neighbour_fingerprints(frame(spark, [(5, "abcdefgh" * 9)])).collect()
    assert len(one) == 1 and one[0].near_next == 1


# -- Substrings ---------------------------------------------------------------


def test_anchors_are_leftmost_minima():
    rng = np.random.default_rng(1)
    for _ in range(200):
        h = rng.integers(1, rng.integers(3, 50), rng.integers(1, 80)).astype(np.uint64)
        width = int(rng.integers(1, 12))
        got = [c for a, b, c in zip(*anchored(h, width)) for _ in range(b - a + 1)]
        assert got == [i + int(np.argmin(h[i : i + width])) for i in range(len(h) - width + 1)]
    v = rng.integers(0, 255, 50).astype(np.uint64)
    for k in (1, 2, 5, 24, 35):
        plain = [0] * (len(v) - k + 1)
        for i in range(len(plain)):
            for c in v[i : i + k].tolist():
                plain[i] = (plain[i] * 0x9E3779B97F4A7C15 + c) % (1 << 64)
        assert (gram_hashes(v, k) == (mixed(np.array(plain, np.uint64)) | np.uint64(1))).all()


def test_suffix_arrays():
    r = random.Random(1)
    for _ in range(300):
        s = [r.randint(1, r.choice([1, 2, 3, 30])) for _ in range(r.randint(0, 60))] + [0]
        assert suffixes.suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


@pytest.mark.parametrize("hot", [2000, 2])
def test_earlier_strings_go(spark, corpus, hot):
    docs = [(i, t) for i, t in corpus if i != 44] + [(44, corpus[3][1])]
    seen, want = set(), {}
    for i, t in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        raw = text_of(t).encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        want[i] = (len(raw), sum(gone), bytes(c for c, g in zip(raw, gone) if not g))
    got = suffixes.remove_repeats(frame(spark, docs), hot=hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, bytes(r.kept)) for r in got} == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    twice = suffixes.remove_repeats(frame(spark, [(1, "xyz" * 70 + "q" * 3)] * 2)).collect()
    assert len(twice) == 2 and twice[0].n_removed == twice[1].n_removed


@pytest.mark.parametrize("hot", [2000, 2])
def test_repeated_rows_that_share_anchors_keep_what_starts_in_them(spark, hot):
    r = random.Random(8)
    word = lambda n: "".join(r.choice("abcdefghij") for _ in range(n))
    shared = word(220)
    docs = [(3, word(60) + shared + word(60)), (3, None), (5, word(80) + shared + word(30)), (6, shared[:150] + word(90)), (7, word(40) + shared[20:] + word(150))]
    docs[1] = docs[0]
    seen, want = set(), {}
    for i, t in dict(docs).items():
        raw = t.encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            seen.add(raw[k : k + 100])
        want[i] = (sum(gone), bytes(c for c, g in zip(raw, gone) if not g))
    assert want[3][0] == 0 and all(want[i][0] for i in (5, 6, 7))
    got = [(x.doc_id, (x.n_removed, bytes(x.kept))) for x in suffixes.remove_repeats(frame(spark, docs), hot=hot).collect()]
    assert sorted(got) == sorted((i, want[i]) for i, _ in docs)


def brute_phrases(docs, window):
    count = collections.Counter()
    for _, t in docs:
        w = text_of(t).encode().split()
        count.update(tuple(w[k : k + window]) for k in range(len(w) - window + 1))
    for i, t in docs:
        w = text_of(t).encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if count[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        yield repr(i), len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()


def test_recurring_phrases_go(spark, corpus):
    got = phrases.remove_phrases(frame(spark, corpus), block_words=3000).collect()
    assert sorted((repr(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got) == sorted(brute_phrases(corpus, 35))
    left = phrases.without_phrases(docs := frame(spark, corpus), window=50)
    assert left.columns == docs.columns and left.schema["rest"].dataType == docs.schema["rest"].dataType
    want = sorted((i, kept if gone else None) for i, _, gone, kept in brute_phrases(corpus, 50))
    plain = {repr(i): text_of(t) for i, t in corpus}
    assert sorted((repr(r.doc_id), r.text) for r in left.collect()) == sorted((i, plain[i] if k is None else k) for i, k in want)


def test_automaton_with_wide_characters():
    a = phrases.PhraseAutomaton([[b"x", b"y"], [b"y", b"z", b"x"]])
    assert sorted(a.occurrences([b"x", b"y", b"z", b"x", b"q", b"x", b"y"])) == [(0, 2), (1, 4), (5, 7)]
    words = [str(i).encode() for i in range(1_000_100)]
    wide = phrases.PhraseAutomaton([words[i : i + 100] for i in range(0, len(words), 100)])
    assert wide.width == 2 and list(wide.occurrences([b"q", *words[100:300], b"1"])) == [(1, 101), (101, 201)]


def test_runs_are_cut_without_losing_windows():
    parts = [{"lo": 0, "hi": 9}, {"lo": 10, "hi": 12}, {"lo": 20, "hi": 20}]
    assert phrases._runs(parts, 5, 4) == [(0, 8), (4, 12), (8, 16), (12, 17), (20, 25)]


# -- Decontamination ----------------------------------------------------------


def edit_distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        row, last = [i] + [0] * len(t), row
        for j, d in enumerate(t, 1):
            row[j] = min(last[j - 1] + (c != d), last[j] + 1, row[j - 1] + 1)
    return min(row)


def test_edit_matches_against_the_full_matrix():
    r = random.Random(3)
    for _ in range(150):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 90)))
        q = "".join(c if r.random() > 0.04 else r.choice(["", "x", c + "b"]) for c in p)
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 60))) + (q if r.random() < 0.6 else "")
        want, limit = edit_distance(p, t), decontaminate.budget(len(p), 0.1)
        got = decontaminate.Matcher([(1, p)], 0.1).search(t)
        assert [m[1] for m in got] == ([want] if want <= limit else [])


def test_leaks(spark):
    item = "The quick brown fox jumps over the lazy dog while nine wizards mix a jug of poison tonight"
    docs = [(1, "x " + item.upper().replace(" ", "\n ") + " y"), (2, item[:40] + "#" + item[41:]), (3, item[:45]), (4, None), (5, ""), (None, item), (1, "clean"), (6, item), (6, item)]
    items = spark.createDataFrame([(1, item), (1, item), (2, None), (3, ""), (4, "zzz")], "item_id long, text string")
    for block in (8_000_000, 50):
        got = decontaminate.leaks(frame(spark, docs), items, block_chars=block).collect()
        assert sorted((repr(r.doc_id), r.item_id, r.distance) for r in got) == [("1", 1, 0), ("2", 1, 1), ("6", 1, 0), ("6", 1, 0), ("None", 1, 0)]
    left = decontaminate.clean(given := frame(spark, docs), items)
    assert sorted((r.doc_id, r.text) for r in left.where("text is not null").collect()) == [(1, "clean"), (3, item[:45]), (5, "")] and left.columns == given.columns


# -- Toxicity -----------------------------------------------------------------


def test_toxicity_on_held_out_documents(spark):
    r = random.Random(6)
    plain = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        w = [r.choice(plain) for _ in range(60)]
        toxic, low = i % 6 == 0, i % 5 == 0
        if toxic:
            w[r.randrange(60)] = r.choice(["moron", "scum", "idiot"])
        if low:
            w = [x + "###" for x in w] + ["buy"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(not low), int(toxic)))
    known = spark.createDataFrame(labels[:400] + [(None, 1, 1), (401, None, 1)], "doc_id long, quality int, toxic int")
    docs = frame(spark, [*rows, (700, None), (701, ""), (None, "moron scum idiot")])
    chain = toxicity.train(docs, known, {"low": 1 - F.col("quality"), "toxic": F.col("toxic")})
    assert len(chain.models[1].weight) == len(chain.models[1].chosen) + 2  # the earlier category is a column
    got = {x.doc_id: x for x in toxicity.score(docs, chain).collect()}
    assert len(got) == 603 and all(0 <= x.p_toxic <= 1 for x in got.values())
    held = range(402, 600)
    assert sum(got[i].is_toxic == bool(labels[i][2]) for i in held) >= 0.97 * len(held)
    kept = toxicity.keep_clean(docs, chain)
    assert kept.columns == docs.columns and {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if not x.is_toxic}


def test_threshold_without_a_precise_cut():
    p, y = np.array([0.9, 0.8, 0.7, 0.6, 0.2, 0.1]), np.array([0.0, 1, 1, 0, 0, 0])
    assert toxicity._best_threshold(p, y, 0.9) == pytest.approx(0.65)  # two of three: the best F1 there is
    assert toxicity._best_threshold(p, np.array([1.0, 1, 0, 1, 0, 0]), 0.9) == pytest.approx(0.75)
    with pytest.warns(UserWarning, match="never set"):
        assert toxicity._best_threshold(p, y[::-1], 0.9) == np.inf  # the two are the fourth and fifth of six
    assert toxicity._best_threshold(p, np.zeros(6), 0.9) == np.inf and toxicity._best_threshold(np.zeros(0), np.zeros(0), 0.9) == np.inf


def test_recall_on_given_labels(spark):
    """At 399 labels most toxic documents are found, and nearly all that are found are toxic."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels, {"low_quality": 1 - F.col("quality"), "toxic": F.col("toxic")}))
    found = labels.join(scored, "doc_id").agg(F.count_if("is_toxic"), F.sum("toxic"), F.count_if(F.col("is_toxic") & (F.col("toxic") == 1))).first()
    assert found[2] >= 0.7 * found[1] and found[2] >= 0.9 * found[0]


def test_toxicity_without_documents_or_labels(spark):
    none = frame(spark, [(1, "a b")]).where("false")
    chain = toxicity.train(none, spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int"), {"toxic": F.col("toxic")})
    assert toxicity.score(none, chain).count() == 0 and toxicity.keep_clean(none, chain).columns == none.columns and toxicity.keep_clean(none, chain).count() == 0


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    chain = toxicity.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), {"toxic": F.col("toxic")})
    assert [r.is_toxic for r in toxicity.score(docs, chain).collect()] == [False, False]


# -- Pages --------------------------------------------------------------------


def test_page_text(spark):
    page = """<html><head><title>T</title><style>p{}</style></head><body><header>Site</header><nav><a href=/>Home</a></nav>
    <div id="cookie-banner">We use cookies, a lot of them, as everyone does now.</div><article class="post"><h1>A &amp; B</h1><p>One
    two<br>three &lt;x&gt;</p><p>Of.<div class="ad">Buy this thing now</div><p>Last <a href=x>one</a></p><form><label>Mail</label></form></article>
    <section id="comments"><p>Nice, I like this a lot, thank you all for it.</p></section><aside>More</aside><footer>&copy; me</footer><p"""
    rows = [(1, "u", page), (2, None, None), (3, "v", ""), (None, "w", "<p>"), (1, "u", page), (4, "x", "<div"), (5, "y", "plain & simple")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    want = "A & B\nOne two three <x>\nOf.\nLast one"
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in got if r.page_id == 1] == [(1, "u", want, len(want))] * 2
    assert len(got) == 7 and all(r.text == "" for r in got if r.page_id in (2, 3, 4) or r.page_id is None)


ARTICLE = "".join(f"<p>Paragraph {i} {'of words ' * 12}</p>" for i in range(4))
TALK = f"<p>{'reply ' * 30}</p>"
LAYOUTS = [
    f"<nav><a href=#>Home</a></nav><div class='layout has-sidebar'><article><h1>Head</h1>{ARTICLE}</article></div>",
    f"<div class='overflow-hidden'><article><h1>Head</h1>{ARTICLE}</article></div><div hidden>{TALK}</div><p style='display: none'>reply</p>",
    f"<article class='post category-social tag-comments'><h1>Head</h1>{ARTICLE}</article><aside>{TALK}</aside>",
    f"<div aria-hidden='false'><article><h1>Head</h1>{ARTICLE}</article></div><div aria-hidden=true>{TALK}</div>",
    f"<form id='aspnetForm'><nav><a href=#>Home</a></nav><div class='page-sidebar'>{TALK}</div><div id='main-content'><h1>Head</h1>{ARTICLE}</div></form>",
    f"<article><svg/><h1>Head</h1><svg class=a><text>reply</text></svg><math/>{ARTICLE}</article>",
    f"<article><header class='entry-header'><h1>Head</h1></header>{ARTICLE}</article>",
    f"<main class='with-banner'><h1>Head</h1>{ARTICLE}</main><div class='comments'><article class='comment'>{TALK}</article></div>",
    f"<header id='masthead' class='site-header'>reply</header><div class='content-area'><main id='main' class='site-main'><article id='post-1' class='post'><h1 class='entry-title'>Head</h1>"
    f"<div class='entry-content'>{ARTICLE}</div></article><div id='comments' class='comments-area'><ol class='comment-list'><li><article class='comment-body'>{TALK}</article></li></ol></div></main></div>",
    f"<div class='cookie-consent'>{TALK}</div><div class='post-content'><h1>Head</h1>{ARTICLE}</div><div class='site-footer'>reply</div>",
    f"<div class='story'><h1>Head</h1>{ARTICLE}</div><section class='comments'>{TALK * 9}</section>",
    f"<article><iframe src=x><canvas><object><h1>Head</h1>{ARTICLE}</article><script>reply</script",
]


@pytest.mark.parametrize("page", LAYOUTS)
def test_layouts_lose_no_article(page):
    """A plain reader of the marked article: its head and paragraphs, whole, and nothing of what stands beside it."""
    got = html_text.main_text(f"<html><body>{page}</body></html>", html_text.grow(*html_text.labelled()))
    assert got == "\n".join(["Head", *(f"Paragraph {i} {'of words ' * 12}".strip() for i in range(4))])


def test_given_pages_keep_their_articles(spark, sf):
    """A reader of the one layout the given pages have."""
    import html as entities
    import re

    def plain(page):
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        found = [" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub(r"<br\s*/?>", " ", part))).split()) for part in re.split(r"</?(?:p|h1|h2|ul|li|div|blockquote|pre|table|tr|td)\b[^>]*>", inner)]
        return "\n".join(x for x in found if x)

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages.withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))).collect()}
    assert got == {r.page_id: plain(r.html) for r in pages.collect()}


def test_very_long_pages(spark):
    page = "<body><article>" + "<p>many words here</p><svg>" * 30_000 + "</article></body>"
    got = html_text.extract(spark.createDataFrame([(1, "u", page), (2, "u", "<div" * 200_000)], "page_id long, url string, html string")).collect()
    assert [r.text.count("\n") for r in got if r.page_id == 1] == [29_999] and [r.text for r in got if r.page_id == 2] == [""]


def test_tree_fits_its_table_and_held_out_layouts():
    x, y = html_text.labelled()
    tree = html_text.grow(x, y)
    assert (html_text.judge(tree, x) == y).all()
    hits = total = 0
    for k in range(0, len(y), 3):  # every third block held out
        keep = np.arange(len(y)) % 3 != k % 3
        hits += (html_text.judge(html_text.grow(x[keep], y[keep]), x[~keep]) == y[~keep]).sum()
        total += (~keep).sum()
    assert hits / total > 0.9


# -- Empty tables -------------------------------------------------------------


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([], "item_id long, text string")
    results = [
        simhash.near_duplicates(simhash.fingerprints(none), 4, simhash.pigeonhole_masks(4)), simhash.simhash_dedup(none), licences.scan(none), packing.pack(none), lm.score(none),
        fingerprints.neighbour_fingerprints(none), suffixes.remove_repeats(none), phrases.remove_phrases(none), phrases.without_phrases(none), decontaminate.leaks(none, items),
        decontaminate.clean(none, items), html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")),
    ]
    assert [r.count() for r in results] == [0] * len(results)
    some = frame(spark, [(1, "a")])
    assert decontaminate.leaks(some, items).count() == 0 and decontaminate.clean(some, items).count() == 1
