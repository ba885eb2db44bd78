"""Operators against brute force, exact round trips and the libraries they stand for."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter as Bag

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from plumbline.llm.catalogue import ORACLES, QUERIES
from plumbline.llm.components import components
from plumbline.llm.embeddings import decode, near_vectors
from plumbline.llm.packing import Encoder, best_fit
from plumbline.llm.repeats import RunIndex, find_repeats, remove_repeats, segments, suffix_array
from plumbline.llm.simhash import index_pairs
from plumbline.llm.tokens import Counter, token_counts
from tests.compare import rows, tables

ROOT = os.environ.get("PLUMBLINE_TESTDATA", "/root/testdata/sf0.001")
needs_tables = pytest.mark.skipif(not os.path.isdir(ROOT), reason="test tables not present")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "text").collect()


def result(spark, name):
    return QUERIES[name](spark, ROOT).collect()


@needs_tables
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, name):
    df, rel = QUERIES[name](spark, ROOT), tables(ROOT).sql(ORACLES[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(rel.columns, rel.fetchall())


ALPHABET = [
    "a", "B", " ", "  ", "\n", "\t", "'s", "'", " 've", "É", "ß", "Σ", "İ", "J̌", "́", "1", "22", "²", "Ⅳ", ".", "!!", "...", ",", "_",
    "-", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x85", "\xa0", " ", "　", "日本", "\U0001f600", "​", "\x00", "the", "|", "#", "don't",
]


def fuzz(n=3000):
    rng = random.Random(5)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_encoder_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    want = [np.array(e.ids, dtype="<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(fuzz(), add_special_tokens=False)]
    assert Encoder(path).ids(fuzz()) == want


def test_counter_is_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(fuzz(), add_special_tokens=False)]
    assert Counter(path).counts(fuzz()) == want


@needs_tables
def test_token_counts(spark, docs):
    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = {r.doc_id: (len((r.text or "").encode()), len(own.encode(r.text or "", add_special_tokens=False).ids)) for r in docs}
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in result(spark, "op5_token_counts")} == want


def test_cache_is_used_and_grows(spark, tmp_path):
    path, cache = public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = spark.createDataFrame([(1, "one two"), (2, "one two"), (3, "three")], "doc_id long, text string")
    token_counts(first, path, cache).collect()
    assert spark.read.parquet(cache).count() == 2
    more = first.union(spark.createDataFrame([(4, "four"), (5, None)], "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_tokens) for r in token_counts(more, path, cache).collect()) == [(1, 2), (2, 2), (3, 1), (4, 1), (5, 0)]
    assert spark.read.parquet(cache).count() == 4
    # a stored count is taken as it is
    digest = bytearray(hashlib.sha256(b"five").digest())
    which = spark.read.parquet(cache).first().tokenizer
    spark.createDataFrame([(which, digest, 77)], "tokenizer string, digest binary, n_tokens int").write.mode("append").parquet(cache)
    assert token_counts(spark.createDataFrame([(9, "five")], "doc_id long, text string"), path, cache).first().n_tokens == 77


@needs_tables
def test_packing(spark, docs):
    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = result(spark, "op4_packing")
    ids = {r.doc_id: [*own.encode(r.text or "", add_special_tokens=False).ids, 0] for r in docs}
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert by_doc.keys() == ids.keys()
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert [r.start for r in pieces] == [2048 * k for k in range(len(pieces))]
        for r in pieces:
            part = ids[doc][r.start : r.start + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(part, dtype="<u4").tobytes()) and r.length == len(part)
        assert sum(r.length for r in pieces) == len(ids[doc])
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own_pieces in bins.values():
        at = 0
        for offset, length in sorted(own_pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 2048 + 1


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_best_fit_holds_all_capacities(rule):
    lengths = np.random.default_rng(2).integers(1, 200, 500)
    bins, places = best_fit(lengths, tokens=512, documents=5, attention=60_000, rule=rule)
    for b in np.unique(bins):
        own = lengths[bins == b]
        assert own.sum() <= 512 and len(own) <= 5 and (own**2).sum() <= 60_000
        order = np.argsort(places[bins == b])
        assert (places[bins == b][order] == np.concatenate([[0], np.cumsum(own[order])[:-1]])).all()
    with pytest.raises(ValueError):
        best_fit(np.array([513]), tokens=512)


# personal data and secrets, by the contract's patterns as they stand


def leftmost(pattern, text, flags=0):
    return list(re.finditer(pattern, text, flags))


def digits(text):
    return re.sub("[^0-9]", "", text)


def luhn(text):
    return sum(int(d) if k % 2 == 0 else sum(map(int, str(2 * int(d)))) for k, d in enumerate(reversed(text))) % 10 == 0


def plain_pii(text):
    out = [("email", *m.span()) for m in leftmost(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in leftmost(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [("card", *m.span()) for m in leftmost(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))]
    return out + [("phone", *m.span()) for m in leftmost(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(digits(m.group())) <= 15]


def plain_secrets(text):
    out = [
        ("assign", *m.span())
        for m in leftmost(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m.group(2)) >= 12
    ]
    out += [("access", *m.span()) for m in leftmost("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    return out + [("hex", *m.span()) for m in leftmost("[0-9a-f]+", text) if len(m.group()) >= 16]


PARTS = [
    "a@b.co", "x.y@z", "@", "@@", "ab", ".", "..", "1.2.3.4", "300.1.2.3", "1.2.3.4.5.6.7.8", "0001.02.3.4", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112",
    "+1 (212) 555-0100", "+1", "+", "-", " ", "(", "9" * 20, "token=", "Secret : '", "API_KEY=\"", "apikey:", "password", "abcdefabcdef1234", "AKIA", "ABCDEFGHIJKLMNOP12", "f" * 15,
    "ſ", "K", "é", "日", "\n",
]


def sensitive(n=4000):
    rng = random.Random(8)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def test_scanners_are_the_patterns():
    from plumbline.llm.spans import base_pii, base_secrets

    for text in sensitive():
        assert base_pii(text) == plain_pii(text), text
        assert base_secrets(text) == plain_secrets(text), text


@needs_tables
def test_pii_digests(spark, docs):
    want = {}
    for r in docs:
        own = plain_pii(r.text or "")
        own.sort(key=lambda s: (("email", "ip", "card", "phone").index(s[0]), s[1]))
        n = Bag(k for k, _, _ in own)
        want[r.doc_id] = (n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest())
    got = result(spark, "op6_pii")
    assert {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got} == want
    texts = {r.doc_id: plain_pii(r.text or "") for r in docs}
    for r in got:
        assert {f"{k}:{a}:{b}" for k, a, b in texts[r.doc_id]} <= set(r.spans.split(","))


@needs_tables
def test_secret_digests(spark, docs):
    want = {}
    for r in docs:
        own = sorted(plain_secrets(r.text or ""), key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))
        n = Bag(k for k, _, _ in own)
        want[r.doc_id] = (n["assign"], n["access"], n["hex"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in own).encode()).hexdigest())
    assert {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in result(spark, "op10_secrets")} == want


# repeats


def plain_repeats(texts, length):
    seen = Bag(t[k : k + length] for t in texts for k in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                gone[k : k + length] = b"\x01" * length
        runs = sum(1 for k in range(len(t)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((len(t), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


def repetitive(n, seed):
    rng = random.Random(seed)
    passages = ["".join(rng.choice("ab c") for _ in range(rng.randint(5, 60))) for _ in range(6)]
    return ["".join(rng.choice([*passages, rng.choice("xyzé"), "ab" * rng.randint(0, 30), "".join(rng.choice("abcd") for _ in range(20))]) for _ in range(rng.randint(0, 8))) for _ in range(n)]


@pytest.mark.parametrize("many", [1000, 2])
def test_repeats(spark, many):
    texts = repetitive(120, many)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(find_repeats(df, length=24, gram=8, many=many)).collect()}
    assert [got[k] for k in range(len(texts))] == plain_repeats([t.encode() for t in texts], 24)


def test_suffix_array_and_run_index():
    texts = [t.encode() for t in repetitive(12, 3) if t]
    index = RunIndex(texts)
    whole = b"".join(texts)
    ends = np.repeat(np.cumsum([len(t) for t in texts]), [len(t) for t in texts])
    want = sorted(range(len(whole)), key=lambda k: (whole[k : ends[k]], k))
    assert index.order.tolist() == want
    assert suffix_array(np.frombuffer(whole, dtype=np.uint8).astype(np.int32) + 1, ends - np.arange(len(whole))).tolist() == want

    def shared(a, b):
        x, y = whole[a : ends[a]], whole[b : ends[b]]
        return next((k for k, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))

    assert index.lengths().tolist() == [0, *[shared(a, b) for a, b in zip(want, want[1:], strict=False)]]
    assert len(index.run_starts) < len(whole)


def test_segments_cover_every_string_once():
    data = "".join(repetitive(20, 4)).encode()
    starts, counts, _, _ = segments(data, 24, 8)
    assert [k for a, n in zip(starts, counts, strict=True) for k in range(a, a + n)] == list(range(len(data) - 23))


# near copies


def plain_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(n, linked):
    root = list(range(n))

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


@needs_tables
def test_simhash(spark, docs):
    docs = sorted(docs, key=lambda r: r.doc_id)
    prints = np.array([plain_fingerprint(r.text) for r in docs], dtype=np.uint64)
    x, y = np.nonzero(np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 2)
    roots = plain_components(len(docs), zip(x.tolist(), y.tolist(), strict=True))
    want = {r.doc_id: (f"{int(p):016x}", docs[k].doc_id) for r, p, k in zip(docs, prints, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in result(spark, "op8_simhash")} == want


def test_gray_index_finds_all_pairs():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    codes = [base]
    for _ in range(12):
        codes.append(base ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40).astype(np.uint64)))
    codes = np.unique(np.concatenate(codes))
    groups = rng.integers(0, 2, len(codes))
    x, y = index_pairs(codes, groups, 2, most=500)
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 2) & (groups[:, None] == groups[None, :])
    assert sorted((min(p), max(p)) for p in zip(x.tolist(), y.tolist(), strict=True)) == sorted((a, b) for a, b in zip(*np.nonzero(near), strict=True) if a < b)


def test_components(spark):
    rng = random.Random(6)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)] + [(7, 7), (None, 3), (5, 4)]
    want = plain_components(300, [(a, b) for a, b in edges if a is not None])
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: r for k, r in enumerate(want) if r != k}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def clusters(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((n // 8, dim))
    near = [centres + rng.standard_normal(centres.shape) * s for s in (0.05, 0.1, 0.2, 0.25)]
    return np.concatenate([centres, *near, rng.standard_normal((n // 4, dim))])


@pytest.mark.parametrize("chunk", [1024, 4])
def test_vectors(spark, chunk):
    x = clusters(320, 64, 9)
    labels = np.arange(len(x)) % (320 // 8) % 3
    df = spark.createDataFrame([(k, v.tolist(), int(c)) for k, (v, c) in enumerate(zip(x, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    got = {r.vec_id: r for r in near_vectors(df, chunk=chunk).collect()}
    found = np.array([got[k].n_links for k in range(len(x))])
    assert (found <= near.sum(axis=1)).all()
    assert found.sum() >= 0.97 * near.sum() > 0
    if (found == near.sum(axis=1)).all():
        roots = plain_components(len(x), zip(*np.nonzero(near), strict=True))
        assert [got[k].component_id for k in range(len(x))] == roots


def test_decoding_finds_every_filter():
    from plumbline.llm.embeddings import FEWEST, LEAN, WORDS, code

    unit = clusters(80, 64, 3)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    first, second = code(64)
    scores = (unit[:, :32] @ first.T)[:, :, None] + (unit[:, 32:] @ second.T)[:, None, :]
    for own, s in zip(decode(unit), scores.reshape(len(unit), -1), strict=True):
        want = np.flatnonzero(s >= min(LEAN / 8 * np.sqrt(2), np.sort(s)[-FEWEST]) - 1e-12)
        assert own.tolist() == want.tolist() and own.max() < WORDS * WORDS


# learned operators, on what they have not seen


@needs_tables
def test_language_held_out(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{ROOT}/documents.parquet").select("doc_id", "lang").collect()}
    held = [r for r in result(spark, "op9_language") if r.held_out]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in held)
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) >= 0.95 * len(held) > 0


def test_toxicity_held_out(spark):
    from plumbline.llm.toxicity import fit_toxicity, score_toxicity

    rng = random.Random(4)
    words = ["".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    bad = ["zorkplag", "vexomund", "quibblar"]

    def bent(word):
        k = rng.randint(1, len(word) - 1)
        return rng.choice([word, word[:k] + rng.choice("*.x-") + word[k:], word + "en", word.upper(), " ".join(word)])

    def sentence(toxic):
        own = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        if toxic:
            own.insert(rng.randint(0, len(own)), bent(rng.choice(bad)))
        return " ".join(own)

    rows_ = [(k, sentence(k % 6 == 0), int(k % 6 == 0)) for k in range(1200)]
    df = spark.createDataFrame(rows_, "doc_id long, text string, toxic int")
    found = score_toxicity(df.where("doc_id >= 600"), fit_toxicity(df.where("doc_id < 600"))).collect()
    hits = sum(r.score >= 0.5 for r in found if r.toxic)
    wrong = sum(r.score >= 0.5 for r in found if not r.toxic)
    assert hits >= 0.85 * sum(r.toxic for r in found) and wrong <= 0.02 * len(found)


def test_toxicity_of_words_written_apart(spark):
    from plumbline.llm.toxicity import Similarity, fit_toxicity, score_toxicity

    rng = random.Random(5)
    words = ["".join(rng.choice("aeioubcdlmnprst") for _ in range(rng.randint(2, 9))) for _ in range(400)]
    bad = ["zorkplag", "vexomund", "quibblar", "wuzzig"]
    apart = {
        "two": lambda w: w[:3] + rng.choice(["**", "..", "-_"]) + w[3:],
        "points": ".".join, "stars": "*".join, "blanks and stars": " * ".join, "mixed": lambda w: "".join(c + rng.choice("*-._") for c in w)[:-1],
        "pairs": "--".join, "letters": "7".join,
    }

    def sentence(own):
        out = [rng.choice(words) for _ in range(rng.randint(3, 40))]
        out.insert(rng.randint(0, len(out)), own)
        return " ".join(out)

    learn = [(sentence(rng.choice(bad) if k % 6 == 0 else rng.choice(words)), int(k % 6 == 0)) for k in range(600)]
    model = fit_toxicity(spark.createDataFrame(learn, "text string, toxic int"))
    rows_ = [(name, sentence(f(rng.choice(bad)))) for name, f in apart.items() for _ in range(40)]
    rows_ += [("clean", sentence(f(rng.choice(words)))) for f in apart.values() for _ in range(40)]
    hits, total = Bag(), Bag(name for name, _ in rows_)
    for r in score_toxicity(spark.createDataFrame(rows_, "name string, text string"), model).collect():
        hits[r.name] += r.score >= 0.5
    assert all(hits[name] >= 0.85 * total[name] for name in apart), hits
    assert hits["clean"] <= 0.02 * total["clean"]

    own = Similarity(["moron", "idiot", "stupid"])
    for k, word in enumerate(own.landmarks):  # different letters between all of its own leave something of a word
        assert own.texts(["".join(c + x for c, x in zip(word, "xqzjkw"))[:-1]])[0, k] > 0
    assert own.texts(["the river"]).max() < 0.2


def test_span_classifier_learns_reliabilities():
    from plumbline.llm.pii import LABELERS, reliabilities

    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75, 0.6, 0.5])
    votes = np.where(rng.random((4000, len(LABELERS))) < right, truth[:, None], ~truth[:, None]).astype(int) + 1
    bag = Bag("".join(map(str, v)) for v in votes)
    names = sorted(bag)
    table, post, prior = reliabilities(names, np.array([float(bag[n]) for n in names]))
    assert abs(prior - 0.4) < 0.05
    assert np.abs(table[:, 1, 2] - right).max() < 0.08
    where = {n: p for n, p in zip(names, post, strict=True)}
    assert np.mean([(where["".join(map(str, v))] > 0.5) == t for v, t in zip(votes, truth, strict=True)]) > 0.95


# structures of secrets


def der(tag, body):
    size = bytes([len(body)]) if len(body) < 128 else bytes([0x82, len(body) >> 8, len(body) & 255])
    return bytes([tag]) + size + body


def test_structures():
    import base64
    import json

    from plumbline.llm.secrets import confirmed, structure

    rng = random.Random(2)
    key = der(0x30, der(2, b"\x00") + der(2, rng.randbytes(64)) + der(2, b"\x01\x00\x01"))
    assert structure(key) == "der" and structure(key[:-1]) is None and structure(rng.randbytes(90)) is None
    b64 = base64.b64encode(key).decode()
    ssh = b"openssh-key-v1\x00" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + rng.randbytes(40)
    head = base64.urlsafe_b64encode(json.dumps({"alg": "HS256", "typ": "JWT"}).encode()).decode().rstrip("=")
    token = f"{head}.{'QUJD' * 6}.{'c2ln' * 6}"
    assert [k for k, _, _ in confirmed(f"key {b64} end")] == ["der"]
    assert [k for k, _, _ in confirmed(f"key {key.hex()} end")] == ["der"]
    assert [k for k, _, _ in confirmed(base64.b64encode(ssh).decode())] == ["openssh"]
    assert confirmed(f"see {token}, ok") == [("jwt", 4, 4 + len(token))]
    pem = f"-----BEGIN PRIVATE KEY-----\n{b64[:40]}\n{b64[40:]}\n-----END PRIVATE KEY-----"
    assert confirmed(f"a {pem} b") == [("pem", 2, 2 + len(pem))]
    assert confirmed("x" * 80) == confirmed(base64.b64encode(rng.randbytes(80)).decode()) == confirmed(rng.randbytes(40).hex()) == []


def test_oracle_runs_on_short_items(spark):
    from plumbline.llm.decontamination import find_contaminated

    texts = [(1, "One two three four five six seven."), (2, "seven, EIGHT"), (3, "nine"), (4, None)]
    held = [(10, "zero one two three four five six seven eight"), (11, "x seven eight y"), (12, "Nine!"), (13, None), (14, "one two three four x five six seven")]
    docs = spark.createDataFrame(held, "doc_id long, text string")
    found = find_contaminated(docs, spark.createDataFrame(texts, "item_id long, text string"), block_bytes=10)
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.execute("CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", held)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", texts)
    rel = con.sql(ORACLES["op2_decontamination"])
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(rel.columns, rel.fetchall())
    assert found.count() == 4


def test_keys_and_tokens_inside_strings():
    import base64
    import json

    from plumbline.llm.secrets import confirmed

    key = der(0x30, der(0x02, b"\x00") + der(0x30, der(0x06, b"\x2a\x86\x48")) + der(0x04, bytes(range(200)) * 2))
    body = base64.encodebytes(key).decode()
    pem = f"-----BEGIN PRIVATE KEY-----\n{body}-----END PRIVATE KEY-----"
    for text in (json.dumps({"key": pem}), json.dumps(json.dumps({"key": pem})), json.dumps({"key": pem.replace("\n", "\r\n")}).replace("/", "\\/"), f"KEY='{pem}'"):
        first, last = text.index("-----BEGIN"), text.rindex("KEY-----") + len("KEY-----")
        assert confirmed(text) == [("pem", first, last)]
    for head in (' {"alg":"HS256"}', '{ "alg": "HS256"}', '{\n "alg": "none"}', '\r\n\t{"alg":"HS256"}'):
        token = ".".join(base64.urlsafe_b64encode(x).decode().rstrip("=") for x in (head.encode(), b'{"sub":"1"}', bytes(range(32))))
        assert confirmed(f"see {token} there") == [("jwt", 4, 4 + len(token))]
    assert not confirmed("Incredible-values.example.org and ID-numbers-12345.abcdefgh.x")


def test_words_of_other_scripts_differ():
    from plumbline.llm.toxicity import Similarity

    words = ["дебил", "придурок", "μαλακας", "حمار حمار".split()[0], "笨蛋白痴"]
    clean = ["кошка", "ячменный", "στοιχιο", "بيوت", "春天花园"]
    got = Similarity(words).kernel(words + clean)
    assert got.diagonal().min() > 0.99 and got[len(words) :].max() < 0.2


@pytest.mark.parametrize("limits", [{"documents": 3}, {"attention": 40_000}, {"documents": 5, "attention": 20_000, "rule": "dot"}])
def test_packing_under_tighter_limits(spark, limits):
    from plumbline.llm.packing import pack_documents

    rng, most = random.Random(6), 300
    texts = [" ".join(rng.choice(["red", "green", "house", "river"]) for _ in range(rng.choice([3, 20, 40, 150, 900]))) for _ in range(120)]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    got, plain = (pack_documents(own, path, most, **x).collect() for x in (limits, {}))
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(b) <= most and len(b) <= limits.get("documents", most) and sum(n * n for n in b) <= limits.get("attention", most**2) for b in bins.values())
    assert sum(r.length for r in got) == sum(r.length for r in plain)
    assert len(bins) > len({r.sequence_id for r in plain})
