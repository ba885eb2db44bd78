"""Personal data by weak supervision.

Candidates (pattern matches and anything shaped roughly like them) are voted on by labelers: patterns, gazetteers and
context. Expectation maximisation over the vote patterns estimates how reliable each labeler is, and its posteriors train
a logistic classifier of spans, which has the last word on what the patterns did not already settle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.spans import PII_KINDS, Span, base_pii, digits_of, luhn
from plumbline.llm.store import keep, map_batches

# The gazetteers of the context and list labelers.
CUES = {
    "email": {"email", "e-mail", "mail", "contact", "write", "correo", "courriel", "kontakt", "address"},
    "ip": {"ip", "host", "server", "address", "client", "from", "dirección", "adresse"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "debit", "payment", "tarjeta", "carte", "karte", "iban"},
    "phone": {"phone", "tel", "tel.", "telephone", "call", "mobile", "cell", "fax", "teléfono", "telefon", "téléphone"},
}
ENDINGS = {"com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "eu", "info", "ch", "at"}
AGAINST = {"token", "secret", "password", "hash", "sha", "commit", "version", "isbn", "id", "key"}

_AT = re.compile(r"[^\s@<>()\[\]|,;]{1,64}\s?(?:@|\(at\)|\[at\])\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|\(dot\)|\[dot\])\s?[A-Za-z0-9-]{1,63})+")
_DIGITS = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])++")
_QUADS = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])")
_WORD = re.compile(r"[\w.-]+")

LABELERS = ("pattern", "checksum", "shape", "gazetteer", "context", "against", "inside")
#: Votes are one of these digits each, so a pattern is a text of as many digits as there are labelers.
ABSTAIN, NO, YES = "0", "1", "2"


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """Kind, start, end and whether the base patterns found it; candidates that overlap a base span are left to it."""
    out = [(*s, True) for s in base_pii(text)]
    taken = bytearray(len(text))
    for _, a, b, _ in out:
        taken[a:b] = b"\1" * (b - a)

    def add(kind, a, b):
        if taken.find(1, a, b) < 0:
            out.append((kind, a, b, False))
            taken[a:b] = b"\1" * (b - a)

    if "@" in text or "(at)" in text or "[at]" in text:
        for m in _AT.finditer(text):
            add("email", *m.span())
    if re.search("[0-9]{2}", text):
        for m in _QUADS.finditer(text):
            add("ip", *m.span())
        for m in _DIGITS.finditer(text):
            n = len(digits_of(m.group()))
            if 9 <= n <= 11 and not m.group().isdigit():
                add("phone", *m.span())
            elif 13 <= n <= 19:
                add("card", *m.span())
    return out


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One digit per labeler, in the order of ``LABELERS``."""
    span = text[start:end]
    digits = digits_of(span)
    before = [w.lower().strip(".-:") for w in _WORD.findall(text[max(0, start - 48) : start])[-5:]]
    out = [YES if base else ABSTAIN]
    if kind == "card":
        out.append(YES if luhn(digits) else NO)
    elif kind == "ip":
        out.append(YES if all(int(p) <= 255 for p in span.split(".")) else NO)
    else:
        out.append(ABSTAIN)
    if kind == "card":
        out.append(YES if len(digits) in (15, 16) and digits[0] in "3456" else NO)
    elif kind == "phone":
        out.append(YES if "+" in span or "(" in span else NO if "." in span else ABSTAIN)
    elif kind == "ip":
        out.append(NO if span.startswith("0") or re.search(r"(^|\.)0[0-9]", span) else YES)
    else:
        out.append(YES if re.search(r"[A-Za-z]", span.split("@")[0]) else ABSTAIN)
    if kind == "email":
        out.append(YES if re.split(r"[.\])]\s?", span)[-1].lower() in ENDINGS else NO)
    else:
        out.append(ABSTAIN)
    out.append(YES if CUES[kind] & set(before) else ABSTAIN)
    out.append(NO if AGAINST & set(before) else ABSTAIN)
    left, right = text[start - 1 : start], text[end : end + 1]
    joined_on = kind != "email" and (left.isalnum() or right.isalnum() or left in ("_", "/", "#", "\"") and left != "")
    out.append(NO if joined_on else ABSTAIN)
    return "".join(out)


def shape(text: str, kind: str, start: int, end: int) -> int:
    """A few bits on how a span is written, for the classifier: separators, digit count, surroundings."""
    span = text[start:end]
    n = len(digits_of(span))
    return (
        (1 if " " in span else 0) | (2 if "-" in span else 0) | (4 if "(" in span or "[" in span else 0)
        | (8 if n >= 13 else 0) | (16 if text[start - 1 : start].isspace() or start == 0 else 0)
    )


SHAPE_BITS = 5


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and ``cands``, an array of (kind, start, end, base, votes, shape)."""
    fields = [("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("shape", pa.int32())]
    kind_of = pa.list_(pa.struct(fields))

    def find(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                own = candidates(text) if text else []
                out.append([
                    {"kind": k, "start": a, "end": b, "base": base, "votes": votes(text, k, a, b, base), "shape": shape(text, k, a, b)}
                    for k, a, b, base in own
                ])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, kind_of)], names=[id_col, "cands"])

    rows = docs.select(id_col, F.col(text_col).alias("text"))
    return map_batches(rows, find, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, cands array<struct<kind:string,start:long,end:long,base:boolean,votes:string,shape:int>>")


def reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation maximisation for independent labelers: P(vote | class) per labeler, each pattern's posterior, the prior."""
    codes = np.array([[int(c) for c in p] for p in patterns]).reshape(len(patterns), -1)
    n = codes.shape[1]
    yes, no = (codes == 2).sum(axis=1), (codes == 1).sum(axis=1)
    post = (yes + 0.5) / (yes + no + 1.0)
    table, prior = np.zeros((n, 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - post) * counts, post * counts])
        prior = (weight[1].sum() + 1) / (counts.sum() + 2)
        for j in range(n):
            for v in range(3):
                table[j, :, v] = weight[:, codes[:, j] == v].sum(axis=1) + 0.5
        table /= table.sum(axis=2, keepdims=True)
        logs = np.log([1 - prior, prior])[:, None] + sum(np.log(table[j][:, codes[:, j]]) for j in range(n))
        new = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return table, post, prior


def features(kind: str, pattern: str, bits: int) -> np.ndarray:
    votes_on = [float(c == v) for c in pattern for v in (NO, YES)]
    return np.array([1.0, *votes_on, *[float(bits >> k & 1) for k in range(SHAPE_BITS)], *[float(kind == k) for k in PII_KINDS]])


def train_classifier(rows: list[tuple[str, str, int, int]], rounds: int = 200, ridge: float = 1e-2) -> dict[tuple[str, str, int], float]:
    """Probability of each (kind, votes, shape), from rows with counts: per kind EM, then one logistic fit by Newton steps."""
    if not rows:
        return {}
    target = np.zeros(len(rows))
    for kind in PII_KINDS:
        own = [k for k, r in enumerate(rows) if r[0] == kind]
        if own:
            names = sorted({rows[k][1] for k in own})
            sums = np.array([float(sum(rows[k][3] for k in own if rows[k][1] == name)) for name in names])
            post = dict(zip(names, reliabilities(names, sums)[1], strict=True))
            target[own] = [post[rows[k][1]] for k in own]
    x = np.stack([features(k, v, s) for k, v, s, _ in rows])
    n = np.array([float(r[3]) for r in rows])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (n * (target - p)) - ridge * w)
        w += step / max(1.0, np.abs(step).max() / 4)
        if np.abs(step).max() < 1e-6:
            break
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return {r[:3]: float(v) for r, v in zip(rows, p, strict=True)}


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Per row: id and ``spans``, an array of (kind, start, end, base, p), in code points.

    Base spans always stay; others stay where the trained classifier gives them at least ``threshold``. Candidates are
    found once and kept in a table; the driver sees counts per kind, vote pattern and shape only (at most 4 x 3^7 x 32).
    A null text counts as empty, texts are read in full, repeated rows give repeated rows, an empty table an empty result;
    other columns are ignored.
    """
    table = keep(find_candidates(docs, id_col, text_col), "pii-candidates")
    grouped = table.select(F.explode("cands").alias("c")).groupBy("c.kind", "c.votes", "c.shape").count()
    rows = sorted((r.kind, r.votes, r.shape, r["count"]) for r in grouped.collect())
    model = train_classifier(rows)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind_of = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_()), ("p", pa.float64())]))

    def judge(batches):
        for batch in batches:
            out = []
            for own in batch.column("cands").to_pylist():
                scored = [(c, sent.value[c["kind"], c["votes"], c["shape"]]) for c in own]
                out.append([{"kind": c["kind"], "start": c["start"], "end": c["end"], "base": c["base"], "p": p} for c, p in scored if c["base"] or p >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, kind_of)], names=[id_col, "spans"])

    return map_batches(table, judge, f"{id_col} {table.schema[id_col].dataType.simpleString()}, spans array<struct<kind:string,start:long,end:long,base:boolean,p:double>>")


def pii_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from :func:`find_pii`: counts of base spans, their digest, all spans."""
    order = F.create_map(*[x for k, name in enumerate(PII_KINDS) for x in (F.lit(name), F.lit(k))])

    def text(spans):
        keyed = F.array_sort(F.transform(spans, lambda s: F.struct(order[s["kind"]].alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
        return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("spans", lambda s: s["base"])
    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in PII_KINDS]
    return found.select(id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


__all__ = ["Span", "find_pii", "pii_digests"]
