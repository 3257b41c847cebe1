"""The registered queries on the smallest tables, and the pipeline stage by stage."""

import hashlib

import numpy as np
import pytest
from compare import connect, differences

import __spark_entry__ as driver
import corpus_pipeline
from rankmill.llm import queries, simhash
from rankmill.session import cut_lineage

NAMES = [n for n in driver.queries() if n.startswith("op")]


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14))
    assert "pipeline" in driver.queries() and set(queries.SQL) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", sorted(NAMES))
def test_query(spark, sf_dir, name):
    if name in queries.SQL:
        assert differences(spark, connect(sf_dir), queries.QUERIES[name], queries.SQL[name], sf_dir)[0] == ""
    else:
        assert queries.QUERIES[name](spark, sf_dir).count() > 0


def test_simhash_query_against_brute_force(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    ids = sorted(texts)
    prints = np.array([simhash.fingerprint(texts[i]) for i in ids], dtype=np.uint64)
    close = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    label = np.array(ids)
    for _ in ids:
        label = np.where(close, label[None, :], max(ids) + 1).min(axis=1)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.QUERIES["op9_simhash_groups"](spark, sf_dir).collect()}
    assert got == {i: (f"{int(p):016x}", int(c)) for i, p, c in zip(ids, prints, label, strict=True)}


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact dedup", "near dedup", "mix", "pack"]
    kept = [docs.cache()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stage(spark, kept[-1], sf_dir).cache())
        assert kept[-1].columns == columns
    ids = [[r.doc_id for r in k.collect()] for k in kept]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = {i for i in ids[0] if labels.get(i) == 0}
    assert len(clean & set(ids[1])) >= 0.97 * len(clean) and set(ids[1]) <= set(ids[0])
    lower = [hashlib.sha256((r.text or "").encode().lower()).digest() for r in kept[2].collect()]
    assert len(set(lower)) == len(lower)
    assert set(lower) == {hashlib.sha256((r.text or "").encode().lower()).digest() for r in kept[1].collect()}
    assert set(ids[4]) <= set(ids[3]) <= set(ids[2]) and max(map(ids[4].count, set(ids[4]))) <= 2
    packed = corpus_pipeline.STAGES[-1][1](spark, kept[4], sf_dir).collect()
    assert sorted(r.doc_id for r in packed if r.piece == 0) == sorted(ids[4])
    for k in kept:
        k.unpersist()


EDGE_ROWS = [
    (1, "A small text of its own that says nothing bad at all", "en", "web", 52), (2, None, None, None, None), (3, "", "en", "web", 0),
    (4, " \t\n", "de", "", 3), (None, "A row without an id", "en", "web", 19), (5, "same words here and there and everywhere", "en", "web", 40),
    (6, "SAME words here and there and everywhere", "en", None, 40), (7, "same words here and there and everywhere", "fr", "web", 40),
    (7, "same words here and there and everywhere", "fr", "web", 40), (8, "long " * 60_000, "en", "book", 300_000),
    (9, " ".join(f"w{i % 977}" for i in range(40_000)), "en", "book", 1), (10, "🙂 é İ ß \u0000 end", "xx", "web", 9),
]


@pytest.mark.parametrize("rows", [EDGE_ROWS, []])
def test_pipeline_stages_take_nulls_empty_tables_and_repeated_rows(spark, sf_dir, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    columns = docs.columns
    seen = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
        assert docs.columns == columns, name
        seen.append(docs.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    if not rows:
        assert all(s == [] for s in seen) and packed == []
        return
    toxic, exact_, near, mixed = seen
    assert len(toxic) == len(rows)  # none of these is toxic, however long
    texts = {(t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for _, t, *_ in rows}
    assert sorted((r.text or "").lower() for r in exact_) == sorted(t.lower() for t in texts)
    assert {7, 8, 9, 10, None} <= {r.doc_id for r in exact_} and {8, 9, 10, None} <= {r.doc_id for r in near}
    assert {r.doc_id for r in mixed} <= {r.doc_id for r in near}
    assert sum(r.piece == 0 for r in packed) == len(mixed)
