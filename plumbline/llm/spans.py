"""Spans of sensitive strings in texts: scanners that stay linear on any text, and the digests of their results."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if k % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Addresses, leftmost first: each ``@`` is met with the local part before it and the domain after it."""
    free, at = 0, text.find("@")
    while at >= 0:
        start, low = at, max(free, at - 64)
        while True:  # the local part may be of any length; it is looked at in growing pieces
            m = _LOCAL.search(text, low, at)
            start = m.start() if m else at
            if start > low or low == free:
                break
            low = max(free, at - 4 * (at - low))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    """Dotted numbers in groups of four parts, each part at most 255."""
    for m in _DOTTED.finditer(text):
        run = m.group()
        if run.count(".") < 3:
            continue
        parts, at = run.split("."), m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m.group())) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 8 <= len(digits_of(m.group())) <= 15:
            yield m.span()


#: The contract's kinds of personal data, in its order.
PII_KINDS = ("email", "ip", "card", "phone")


def base_pii(text: str) -> list[Span]:
    found = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", a, b) for a, b in addresses(text)]
        found += [("card", a, b) for a, b in cards(text)]
        if "+" in text:
            found += [("phone", a, b) for a, b in phones(text)]
    return found


_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}+")

#: The contract's kinds of secrets, in its order.
SECRET_KINDS = ("assign", "access", "hex")


def base_secrets(text: str) -> list[Span]:
    found = []
    if "=" in text or ":" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
