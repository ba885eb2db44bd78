"""Inputs that cost too much or came out wrong once: megabytes of matches, very long texts, hot rows, clashing names."""

import random
import time
import tracemalloc

import numpy as np
import pytest

import corpus_pipeline
from plumbline.llm.language import fit_language, gram_buckets, gram_counts, has_letter, predict_language
from plumbline.llm.packing import pack
from plumbline.llm.pii import candidates
from plumbline.llm.repeats import find_repeats, remove_repeats
from plumbline.llm.secrets import confirmed
from plumbline.llm.simhash import one_of_each
from plumbline.llm.toxicity import fit_toxicity, labelled_texts

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def seconds(run):
    start = time.process_time()
    run()
    return time.process_time() - start


def overlap_free(text, found):
    """The quadratic rule that the scanners replaced."""
    taken, out = [], []
    for kind, a, b in found:
        if not any(x < b and a < y for x, y in taken):
            out.append((kind, a, b))
            taken.append((a, b))
    return out


def test_a_megabyte_of_addresses_and_keys():
    many = " ".join(f"a{k}@host{k}.com 10.0.{k % 256}.{k % 99} 4{k % 10}11 1111 1111 11{k % 90 + 10}" for k in range(20_000))
    assert len(many) > 900_000 and seconds(lambda: candidates(many)) < 12
    tokens = " ".join(f"eyJhbGciOiJIUzI1NiJ9.e{k:08}eyJzdWIiOiIx.sig{k:012} {'Q' * 20}{k:020}" for k in range(8_000))
    assert seconds(lambda: confirmed(tokens)) < 12
    heads = "-----BEGIN RSA PRIVATE KEY-----\nabc\n" * 20_000
    assert seconds(lambda: confirmed(heads)) < 6
    assert seconds(lambda: confirmed(heads + "-----END RSA PRIVATE KEY-----")) < 6


def test_candidates_do_not_overlap():
    rng = random.Random(4)
    parts = ["a@b.co", "1.2.3.4", "300.1.2.3", "4111 1111 1111 1111", "(555) 123-4567", "x (at) y.com", " ", ",", "12", "\n"]
    for _ in range(300):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(20)))
        found = candidates(text)
        base = [s[:3] for s in found if s[3]]
        rest = [s[:3] for s in found if not s[3]]
        assert all(not (x < b and a < y) for _, a, b in rest for _, x, y in base) and overlap_free(text, rest) == rest


@pytest.mark.parametrize(("text", "want"), [("½", False), ("²³ 12 _ !", False), ("½ a", True), (None, False), ("", False), ("日", True), ("Ⅳ", False), ("ª", True)])
def test_letters(text, want):
    assert has_letter(text) is want


def test_counts_do_not_depend_on_the_window():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcß 日") for _ in range(rng.choice([0, 1, 2, 40, 300]))) for _ in range(60)]

    def dense(window):
        out = np.zeros((len(texts), 1 << 15), dtype=np.int64)
        for row, bucket, n in gram_counts(texts, window=window):
            np.add.at(out, (row, bucket), n)
        return out

    want = dense(1 << 20)
    assert all(want[k].sum() == 2 * len(t) + 1 for k, t in enumerate(texts))
    for window in (1, 2, 3, 17, 100):
        assert (dense(window) == want).all()


def test_a_text_of_five_million_characters_needs_little_memory():
    text = "lorem ipsum dolor " * 280_000
    tracemalloc.start()
    for _ in gram_counts([text]):
        pass
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()


def test_posterior_is_that_of_plain_naive_bayes(spark):
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))), lang) for k, (lang, letters) in enumerate([("x", "abc d"), ("y", "bcde "), ("z", "cdef ")] * 25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")

    bucket = {}  # grams that share a bucket are one gram

    def grams(text):
        padded = f" {text.lower()} "
        own = [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]
        return [bucket.setdefault(g, int(gram_buckets([g])[0][len(g) - 2])) for g in own]

    counts = {lang: {} for lang in "xyz"}
    for _, text, lang in rows:
        for g in grams(text):
            counts[lang][g] = counts[lang].get(g, 0) + 1
    totals = {lang: sum(own.values()) + 0.5 * (1 << 15) for lang, own in counts.items()}
    for r in predict_language(docs, fit_language(docs)).collect():
        text = rows[r.doc_id][1]
        if not has_letter(text):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        logs = {lang: sum(np.log((counts[lang].get(g, 0) + 0.5) / totals[lang]) for g in grams(text)) for lang in "xyz"}
        top = max(logs.values())
        want = {lang: np.exp(v - top) for lang, v in logs.items()}
        assert r.score == pytest.approx(max(want.values()) / sum(want.values()), rel=1e-6)
        assert want[r.lang_pred] == pytest.approx(1.0)


def test_one_row_repeated_beyond_a_group_is_dealt(spark):
    pieces = spark.range(3000).selectExpr("cast(NULL AS long) AS doc_id", "0 AS piece", "0L AS start", "7L AS length", "1L AS ids_crc32")
    got = pack(pieces, tokens=64, documents=64, attention=64 * 64, group=300)
    per_group = got.selectExpr("sequence_id div 4294967296 AS g").groupBy("g").count().collect()
    assert sum(r["count"] for r in per_group) == 3000 and max(r["count"] for r in per_group) < 600


def test_one_text_repeated_very_often_is_one_set_of_ranges(spark):
    text = " ".join(f"w{k}" for k in range(60))
    docs = spark.range(4000).selectExpr("7L AS doc_id", f"'{text}' AS text")
    found = find_repeats(docs, length=40, gram=16)
    assert {(len(r.spans), r.spans[0].a, r.spans[0].b) for r in found.collect()} == {(1, 0, len(text))}
    got = remove_repeats(found).collect()
    assert len(got) == 4000 and {(r.n_removed, r.kept_text) for r in got} == {(len(text), "")}


def test_the_bound_on_labels_holds_for_equal_keys(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.range(50_000).selectExpr("id % 3 AS doc_id", "cast(id % 2 AS int) AS toxic")
    assert labelled_texts(docs, labels, most_rows=1000).count() == 6
    rows = spark.range(20_000).selectExpr("CASE WHEN id % 2 = 0 THEN 'you zorkplag' ELSE concat('a fine day ', id % 5) END AS text", "cast((id + 1) % 2 AS int) AS toxic")
    model = fit_toxicity(rows, most_rows=1000)
    assert "zorkplag" in model.landmarks


def test_stages_keep_columns_named_like_their_own(spark, tmp_path):
    rows = [(k, f"some words of text number {k} that differ {k * k}", "en", "s", 40) for k in range(6)]
    docs = spark.createDataFrame(rows, DOCS).selectExpr("*", "'mine' AS own_id", "'mine' AS own_digest", "'mine' AS chosen_id", "-7.5D AS toxicity_score")
    spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.toxicity(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.toxicity_score for r in kept.collect()} <= {-7.5}
    once = one_of_each(docs)
    assert once.columns == docs.columns and {(r.own_id, r.chosen_id) for r in once.collect()} == {("mine", "mine")}
