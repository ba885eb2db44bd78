"""Each stage of the pipeline on its predecessor's result, against brute force."""

import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from plumbline.llm.store import keep
from tests.llm.test_brute import plain_components, plain_fingerprint, plain_secrets

ROOT = os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{ROOT}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(keep(stage(spark, out[-1], ROOT), name))
    return out


def texts(df):
    return {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def test_registered():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    assert entry.queries()["pipeline"] is corpus_pipeline.run


def test_columns(steps):
    assert all(df.columns == COLUMNS for df in steps[:-1])


def test_toxicity_drops_labelled_toxic_documents_only(spark, steps):
    before, after = texts(steps[0]), texts(steps[1])
    assert after.keys() <= before.keys() and len(after) > 0.8 * len(before)
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{ROOT}/labels.parquet").collect()}
    gone = before.keys() - after.keys()
    assert sum(toxic.get(k, 1) == 0 for k in gone) <= 0.02 * len(before)


def test_one_document_of_each_group_stays(steps):
    before, after = texts(steps[1]), texts(steps[2])
    ids = sorted(before)
    prints = np.array([plain_fingerprint(before[k]) for k in ids], dtype=np.uint64)
    x, y = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    roots = plain_components(len(ids), zip(x.tolist(), y.tolist(), strict=True))
    assert sorted(after) == sorted({ids[r] for r in roots})


def test_documents_with_benchmark_items_go(spark, steps):
    def shingles(text):
        words = re.findall(r"[^\W_]+", text.lower())
        return {" ".join(words[k : k + 5]) for k in range(len(words) - 4)} or ({" ".join(words)} if words else set())

    items = [shingles(r.text) for r in spark.read.parquet(f"{ROOT}/benchmark.parquet").collect()]
    before = texts(steps[2])
    held = {k: shingles(t) for k, t in before.items()}
    want = {k for k, s in held.items() if not any(i and len(i & s) >= 0.8 * len(i) for i in items)}
    assert set(texts(steps[3])) == want


def test_secrets_are_replaced(steps):
    before, after = texts(steps[3]), texts(steps[4])
    assert before.keys() == after.keys()
    for k, text in before.items():
        spans = sorted((a, b) for _, a, b in plain_secrets(text))
        if not spans:
            assert after[k] == text
        else:
            assert "[secret]" in after[k] and not plain_secrets(after[k])
    assert steps[4].where(F.col("n_chars") != F.length("text")).count() == 0


def test_everything_left_is_packed(steps):
    assert {r.doc_id for r in steps[5].select("doc_id").collect()} == set(texts(steps[4]))


def test_stages_on_odd_documents(spark, edge_docs, no_docs):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, ROOT).columns == docs.columns
            docs = stage(spark, docs, ROOT)
        rows = docs.collect()
        assert len({(r.doc_id, r.text) for r in rows}) == len(rows)


def test_no_group_is_lost_to_null_or_repeated_ids(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcd")

    def kept(*rows):
        docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
        return sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, ROOT).collect()), key=str)

    assert kept((None, a), (None, b), (None, b), (None, c), (5, c)) == sorted([(None, a), (None, b), (5, c)], key=str)
    assert kept((None, a), (None, b), (None, c), (4, d), (4, d)) == sorted([(None, a), (None, b), (None, c), (4, d)], key=str)
    assert kept((7, a), (7, b), (8, b)) == [(7, a), (7, b)]
    assert kept((3, a), (7, a), (7, b)) == [(3, a), (7, b)]
    assert len(kept((None, None), (None, ""), (None, " "), (9, a))) == 2
