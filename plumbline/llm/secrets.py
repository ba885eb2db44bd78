"""Secret scans with structural confirmation.

Patterns alone call any long random word a secret. Here a candidate is decoded and its structure read: key encodings whose
nested lengths add up, private-key containers, signed tokens whose header names an algorithm. What confirms is reported
under the structure's own kind, beside the plain pattern matches.
"""

from __future__ import annotations

import base64
import binascii
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.spans import SECRET_KINDS, Span, base_secrets, joined, sha256
from plumbline.llm.store import map_batches

_LONG = re.compile(r"[A-Za-z0-9+/_-]{24,}+={0,2}")
_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){16,}+(?![0-9A-Fa-f])")
#: A header is a JSON object, perhaps behind white space: its first byte is a brace, blank, tab or line break.
_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])([eICD][A-Za-z0-9_-]{10,}+)\.([A-Za-z0-9_-]{4,}+)\.([A-Za-z0-9_-]*+)")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}?)PRIVATE KEY-----")
#: Line breaks and slashes as they are written inside quoted strings, also quoted more than once.
_ESCAPED_BREAK, _ESCAPED_SLASH = re.compile(r"\\+[nr]"), re.compile(r"\\+/")
_BEGIN_SSH = b"openssh-key-v1\x00"
_LONGEST_DEPTH = 16


def decoded(text: str) -> bytes | None:
    """Bytes of a base64 text in either alphabet, padded or not; None if it is neither."""
    body = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def elements(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """Tag, content start and content end of the tag-length-value items that fill a range exactly, or None."""
    out = []
    while start < end:
        if end - start < 2:
            return None
        tag, size, at = data[start], data[start + 1], start + 2
        if size & 0x80:
            n = size & 0x7F
            if not 1 <= n <= 4 or at + n > end:
                return None
            size, at = int.from_bytes(data[at : at + n], "big"), at + n
        if tag == 0 or at + size > end:
            return None
        out.append((tag, at, at + size))
        start = at + size
    return out


def nested(data: bytes, start: int, end: int, depth: int = 0) -> bool:
    """Do all lengths of a tree of tag-length-value items add up?"""
    items = elements(data, start, end)
    if items is None or depth > _LONGEST_DEPTH:
        return False
    return all(not tag & 0x20 or nested(data, a, b, depth + 1) for tag, a, b in items)


def structure(data: bytes) -> str | None:
    """``der`` for a key sequence, ``openssh`` for its container, ``pem`` and ``jwt`` for such texts; None for anything else."""
    if data.startswith(_BEGIN_SSH):
        at, left = len(_BEGIN_SSH), 3
        while left and at + 4 <= len(data):
            at, left = at + 4 + int.from_bytes(data[at : at + 4], "big"), left - 1
        return "openssh" if not left and at + 4 <= len(data) and 1 <= int.from_bytes(data[at : at + 4], "big") <= 64 else None
    if len(data) >= 16 and data[0] == 0x30:
        top = elements(data, 0, len(data))
        if top and len(top) == 1 and nested(data, top[0][1], top[0][2]):
            inner = elements(data, top[0][1], top[0][2])
            tags = {tag for tag, _, _ in inner}
            if len(inner) >= 2 and tags & {0x02, 0x30} and any(b - a >= 16 for _, a, b in inner):
                return "der"
    if data.startswith(b"-----BEGIN ") and b"PRIVATE KEY-----" in data:
        return "pem"
    if data[:1] in (b"e", b"I", b"C", b"D") and data.isascii() and (m := _SIGNED.match(data.decode())) and signed(m):
        return "jwt"
    return None


def signed(m: re.Match) -> bool:
    """Is the first part of a dotted token a JSON header that names its algorithm?"""
    head = decoded(m.group(1))
    try:
        fields = json.loads(head) if head else None
    except (ValueError, RecursionError):
        return False
    return isinstance(fields, dict) and isinstance(fields.get("alg"), str)


def confirmed(text: str) -> list[Span]:
    """Spans whose decoded content has a secret's structure, each under the name of that structure; they don't overlap."""
    found: list[Span] = []
    found += [("jwt", *m.span()) for m in _SIGNED.finditer(text) if signed(m)]
    if "PRIVATE KEY-----" in text:
        heads, feet = list(_PEM.finditer(text)), {}
        for m, later in zip(heads, [*heads[1:], None], strict=True):
            # the foot found for an earlier header serves as long as it lies ahead; none ahead then is none ahead now
            foot = f"-----END {m.group(1)}PRIVATE KEY-----"
            if 0 <= feet.get(foot, 0) < m.end():
                feet[foot] = text.find(foot, m.end())
            end = feet[foot] if later is None or feet[foot] <= later.start() else -1
            inner = _ESCAPED_SLASH.sub("/", _ESCAPED_BREAK.sub("\n", text[m.end() : end])) if end >= 0 else ""
            lines = [x for x in inner.split("\n") if ":" not in x]
            body = decoded("".join("".join(lines).split())) if lines else None
            if body and (structure(body) or "ENCRYPTED" in text[m.start() : m.end() + 60]):
                found.append(("pem", m.start(), end + len(foot)))
    if max(map(len, text.split()), default=0) < 24:
        return sorted(found, key=lambda s: s[1])
    taken = bytearray(len(text))
    for _, a, b in found:
        taken[a:b] = b"\1" * (b - a)
    for pattern, decode in ((_HEX, lambda x: bytes.fromhex(x)), (_LONG, decoded)):
        for m in pattern.finditer(text):
            if taken.find(1, *m.span()) >= 0:
                continue
            data = decode(m.group())
            kind = structure(data) if data else None
            if kind:
                found.append((kind, *m.span()))
                taken[m.start() : m.end()] = b"\1" * (m.end() - m.start())
    return sorted(found, key=lambda s: s[1])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, ``base`` (pattern matches) and ``confirmed`` (decoded structures), arrays of (kind, start, end), in code points.

    A null text counts as empty; empty arrays mean nothing was found. Texts of any length are read in full, in time in
    proportion to their length. A private key ends at its own foot: one with another header before that is not reported. Repeated rows give repeated rows, an empty table an empty result; other columns are
    ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches):
        for batch in batches:
            base, more = [], []
            for text in batch.column("text").to_pylist():
                own = base_secrets(text) if text else []
                base.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in own])
                more.append([dict(zip(("kind", "start", "end"), s, strict=True)) for s in (confirmed(text) if text else [])])
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(base, kind), pa.array(more, kind)], names=[id_col, "base", "confirmed"])

    rows = docs.select(id_col, F.col(text_col).alias("text"))
    spans = "array<struct<kind:string,start:long,end:long>>"
    return map_batches(rows, scan, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, base {spans}, confirmed {spans}")


def secret_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's columns from :func:`scan_secrets`: counts, digest of the base spans, all spans."""

    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def ordered(spans):
        order = F.create_map(*[x for k, name in enumerate((*SECRET_KINDS, "der", "jwt", "openssh", "pem")) for x in (F.lit(name), F.lit(k))])
        keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), order[s["kind"]].alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.array_sort(keyed)

    base = ordered(F.col("base"))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in SECRET_KINDS]
    return found.select(
        id_col, *counts, F.sha2(text(base), 256).alias("base_sha256"), text(ordered(F.concat("base", "confirmed"))).alias("spans"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """All columns and rows of ``docs``; each base or confirmed span in the text is replaced by ``mark``, overlapping spans by one.

    ``n_chars``, where there is such a column, is set to the new length. A null text stays null.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(at).to_pylist():
                if text:
                    spans = sorted((a, b) for _, a, b in base_secrets(text) + confirmed(text))
                    parts, done = [], 0
                    for a, b in spans:
                        if a >= done:
                            parts += [text[done:a], mark]
                        done = max(done, b)
                    text = "".join([*parts, text[done:]])
                out.append(text)
            cols = [pa.array(out, pa.string()) if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    done = map_batches(docs, run, docs.schema)
    return done.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else done


__all__ = ["confirmed", "joined", "redact", "scan_secrets", "secret_digests", "sha256", "structure"]
