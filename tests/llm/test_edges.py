"""Every operator on nulls, empty and very long texts, repeated rows, an empty table and clashing column names."""

import public_tokenizers
import pytest

from plumbline.llm.decontamination import drop_contaminated, find_contaminated
from plumbline.llm.embeddings import near_vectors
from plumbline.llm.language import fit_language, predict_language
from plumbline.llm.packing import pack_documents
from plumbline.llm.pii import find_pii, pii_digests
from plumbline.llm.repeats import find_repeats, remove_repeats
from plumbline.llm.secrets import redact, scan_secrets, secret_digests
from plumbline.llm.simhash import near_duplicates
from plumbline.llm.tokens import token_counts
from plumbline.llm.toxicity import fit_toxicity, score_toxicity

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


def items(docs):
    return docs.sparkSession.createDataFrame([(1, "over the lazy dog by the river"), (2, None), (3, ""), (4, "quick fox")], "item_id long, text string")


OPERATORS = {
    "toxicity": lambda d: score_toxicity(d, fit_toxicity(d.selectExpr("text", "n_chars % 2 AS toxic"))),
    "tokens": lambda d: token_counts(d, BYTES),
    "pii": lambda d: pii_digests(find_pii(d)),
    "language": lambda d: predict_language(d, fit_language(d)),
    "secrets": lambda d: secret_digests(scan_secrets(d)),
    "redact": redact,
    "simhash": near_duplicates,
    "repeats": lambda d: remove_repeats(find_repeats(d)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each(edge_docs, name):
    assert OPERATORS[name](edge_docs).count() == edge_docs.count()


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(no_docs, name):
    assert OPERATORS[name](no_docs).collect() == []


def test_tokens_values(edge_docs):
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts(edge_docs, BYTES).collect()}
    assert got[2] == (0, 0) and got[3] == (0, 0) and got[5][1] > 30_000


def test_language_values(edge_docs):
    got = {r.doc_id: r.lang_pred for r in predict_language(edge_docs, fit_language(edge_docs)).collect()}
    assert got[2] == got[3] == got[4] == got[7] == "und" and got[1] != "und" and got[6] != "und"


def test_simhash_values(edge_docs):
    got = {(r.doc_id, r.fp): r.component_id for r in near_duplicates(edge_docs).collect()}
    assert got[(2, 0)] == got[(3, 0)] == got[(4, 0)] == 2


def test_repeats_values(edge_docs):
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in remove_repeats(find_repeats(edge_docs, length=40, gram=16)).collect()}
    assert got[1] == (57, 57) and got[2] == (0, 0)


def test_redact_keeps_columns(edge_docs):
    got = redact(edge_docs)
    assert got.columns == edge_docs.columns
    assert [r.text for r in got.where("doc_id = 2").collect()] == [None]


def test_packing(edge_docs, no_docs):
    rows = pack_documents(edge_docs, WORDS).collect()
    assert {r.doc_id for r in rows} == {1, 2, 3, 4, None, 5, 6, 7}
    assert sum(r.doc_id == 1 for r in rows) == 2
    assert [r.length for r in rows if r.doc_id == 2] == [1]
    assert pack_documents(no_docs, WORDS).collect() == []


def test_decontamination(edge_docs, no_docs):
    found = find_contaminated(edge_docs.select("doc_id", "text"), items(edge_docs)).collect()
    assert sorted((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in found) == [(1, 1, 3, 3), (1, 1, 3, 3)]
    assert drop_contaminated(edge_docs, items(edge_docs)).count() == edge_docs.count() - 2
    assert find_contaminated(no_docs, items(no_docs)).collect() == []
    assert drop_contaminated(edge_docs, items(edge_docs).limit(0)).count() == edge_docs.count()


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2),
        (5, [1.0, 0.0, 0.0], None), (6, None, 1), (7, [], 1), (8, [0.0, 0.0, 0.0], 1), (9, [nan, 1.0, 0.0], 1), (10, [inf, 1.0, 0.0], 1),
        (11, [None, 1.0, 0.0], 1), (12, [1.0, 0.0], 1), (None, [0.0, 1.0, 0.0], 1), (13, [1e300, 0.0, 0.0], 1), (14, [1e-300, 0.0, 0.0], 1),
    ]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "'x' AS digest", "'x' AS node", "'x' AS place")
    got = sorted((r.vec_id if r.vec_id is not None else -1, r.n_links, r.component_id, r.kept) for r in near_vectors(df).collect())
    alone = [(k, 0, k, True) for k in (4, 5, 6, 7, 8, 9, 10, 11, 12)]
    assert got == sorted([(1, 5, 1, True), (2, 5, 1, False), (3, 5, 1, False), (3, 5, 1, False), (13, 5, 1, False), (14, 5, 1, False), (-1, 0, None, True), *alone])
    assert near_vectors(df.limit(0)).collect() == []
