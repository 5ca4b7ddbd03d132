"""The pipeline stage by stage against plain versions, and the registered queries beside their SQL and contracts."""

import collections
import inspect

import duckdb
import pytest
from compare import TABLES, compare
from test_documents import groups_of

import __spark_entry__ as entry
import corpus_pipeline
from foldline.llm import queries
from foldline.llm.common import stage, table
from foldline.llm.decontaminate import budget, normal
from foldline.llm.tokens import byte_pairs

COLUMNS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op3_packing": ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
    "op5_fingerprints": ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    "op6_suffixes": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op7_html_text": ["page_id", "url", "text", "n_chars"],
    "op10_phrases": ["doc_id", "n_words", "n_removed", "kept_sha256"],
    "op11_quality": ["doc_id", "held_out", "score", "predicted"],
    "op12_variants": ["word", "n", "n_near", "form", "form_n", "root"],
    "op13_ranked": ["item_id", "rank", "doc_id", "score"],
}
OTHER_ROWS = {"op3_packing", "op12_variants", "op13_ranked"}


def test_every_operator_has_a_query():
    found = entry.queries()
    assert all(any(name.startswith(f"op{n}_") for name in found) for n in range(1, 14)) and "pipeline" in found
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "packing"]
    assert all(list(inspect.signature(f).parameters) == ["spark", "docs", "sf_dir"] for _, f in corpus_pipeline.STAGES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_beside_its_sql(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    text, _, ok = compare(spark, con, name, queries.QUERIES[name], queries.ORACLES[name], sf)
    assert ok, text


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_one_row_per_document(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    assert got.columns[: len(COLUMNS[name])] == COLUMNS[name]
    if name not in OTHER_ROWS:
        assert got.count() == table(spark, sf, "pages" if "html" in name else "documents").count()


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    kept = []
    for name, step in corpus_pipeline.STAGES:
        kept.append(docs)
        docs = stage(step(spark, docs, sf), name)
        if name != "packing":
            assert docs.columns == kept[0].columns and docs.schema["n_chars"].dataType == kept[0].schema["n_chars"].dataType
    raw, clean, single, cut, free = [{r.doc_id: r for r in d.collect()} for d in kept]
    known = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    gone = [known[i] for i in raw.keys() - clean.keys() if i in known]
    assert sum(gone) >= 0.8 * len(gone)

    ids = sorted(clean)
    assert set(single) == {ids[k] for k in groups_of([clean[i].text for i in ids])} and len(single) < len(clean)

    windows = collections.Counter()
    for r in single.values():
        w = r.text.split()
        windows.update(tuple(w[k : k + 50]) for k in range(len(w) - 49))
    for i, r in single.items():
        w = r.text.split()
        hit = [False] * len(w)
        for k in range(len(w) - 49):
            if windows[tuple(w[k : k + 50])] > 1:
                hit[k : k + 50] = [True] * 50
        assert cut[i].text == (" ".join(x for x, h in zip(w, hit) if not h) if any(hit) else r.text)
        assert cut[i].n_chars == len(cut[i].text) and cut[i].lang == r.lang
    assert set(cut) == set(single)

    items = [normal(r.text) for r in table(spark, sf, "benchmark").collect()]
    for i, r in cut.items():
        exact = any(t and t in normal(r.text) for t in items)
        assert not exact or i not in free
    assert all(budget(len(t), 0.05) < len(t) for t in items if t)
    packed = collections.defaultdict(int)
    for r in docs.collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(byte_pairs().encode(r.text)) // 4 + 1 for i, r in free.items()}
