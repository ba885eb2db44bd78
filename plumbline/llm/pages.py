"""Main text of web pages through wrappers inferred per host: union-free regular expressions over tag tokens.

A page is read into a stream of tokens, balanced tags and texts. Streams of one host are aligned one after the other with
the expression of the pages before: texts that differ become slots, neighbouring equal parts become repeated groups, parts
that only one side has become optional. What aligned so far is a wrapper, so wrappers of different tasks align with each
other in the same way and are combined in a tree. The wrapper shows where a host's pages carry their own text; a rule
taken from it is joined to the pages and applied to each of them.
"""

from __future__ import annotations

import hashlib
import html as references
import json
import re
from collections import Counter
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.store import keep, map_batches

#: Items beside each other in one expression; a longer row becomes one repeated group of optional items.
WIDE = 32
#: Longest repeated group looked for.
GROUP = 4
#: Levels told apart; what lies deeper counts as part of the element at that level.
DEEP = 48
#: Elements of wrappers that a task holds before it hands them on.
HELD = 200_000
#: Wrappers of one host that one step combines.
FAN = 32

# Names of elements as HTML defines them.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
OUTSIDE = set("html head body".split())
LEAVES = set("p h1 h2 h3 h4 h5 h6 li dt dd td th pre blockquote figcaption caption summary".split())
#: Elements that never belong to the main text.
APART = set("nav header footer aside form script style noscript template iframe object svg math canvas audio video button select option textarea input fieldset legend label dialog menu title xmp noembed noframes".split())
#: Words of class, id and role attributes that say the same.
APART_WORDS = set(
    "nav navbar navigation menu topbar header masthead footer colophon sidebar aside rail ad ads advert adverts advertisement banner promo promotion sponsor sponsored cookie cookies consent notice notices alert "
    "disclaimer popup modal overlay newsletter subscribe signup login comment comments respond reply replies disqus share sharing social breadcrumb breadcrumbs pagination pager related recommended widget form search skip toolbar complementary contentinfo".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(script|style|title|textarea|xmp|iframe|noembed|noframes|noscript)\b[^>]*+(?:>.*?(?:</\1\s*+>|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)",
    re.S | re.I,
)
_NAMED = re.compile(r"(?<![^\s\"'])(?:class|id|role)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>\"']++))", re.I)
_PARTS = re.compile(r"[-_:\s]+|(?<=[a-z])(?=[A-Z])")


def _label(name: str, attributes: str) -> tuple[str, bool]:
    """An element's label (its name and the words that name it, without those holding digits), and whether it stands apart."""
    words = []
    if attributes and "=" in attributes:
        words = sorted({w for m in _NAMED.finditer(attributes) for w in (m.group(1) or m.group(2) or m.group(3) or "").split() if not any(map(str.isdigit, w))})
    parts = [[p.lower() for p in _PARTS.split(w)] for w in words] if name not in ("article", "main") else []
    # "with-sidebar" says what is beside the element
    apart = name in APART or any(p in APART_WORDS for own in parts if own[0] not in ("with", "has", "no", "without") for p in own)
    return ".".join([name, *words]), apart


@dataclass
class Element:
    """An element of a page or of a wrapper."""

    label: str
    apart: bool = False
    optional: bool = False
    repeated: bool = False
    #: Pages (or repetitions) it was met in, characters outside and inside links.
    met: int = 1
    plain: int = 0
    linked: int = 0
    #: Digest of its own text while all are equal, "*" (a slot) once they differ, "" without text.
    text: str = ""
    items: list[Element] = field(default_factory=list)

    def pack(self) -> list:
        return [self.label, int(self.apart), int(self.optional), int(self.repeated), self.met, self.plain, self.linked, self.text, [e.pack() for e in self.items]]

    @classmethod
    def unpack(cls, row: list) -> Element:
        return cls(row[0], bool(row[1]), bool(row[2]), bool(row[3]), *row[4:8], [cls.unpack(r) for r in row[8]])

    def size(self) -> int:
        return 1 + sum(e.size() for e in self.items)

    def expression(self) -> str:
        """The union-free expression: children in brackets, # a text slot, + repeated, ? optional."""
        inner = [*(["#"] if self.text == "*" else ["'text'"] if self.text else []), *(e.expression() for e in self.items)]
        name = "" if self.label.startswith("(") else self.label
        return name + (f"({' '.join(inner)})" if inner else "") + ("+" if self.repeated else "") + ("?" if self.optional else "")


@dataclass
class Page:
    """A page's elements, its texts in page order, and for each text the block and the path of elements it stands in."""

    root: Element
    #: (path of labels, whether a part of the path stands apart, block, text)
    texts: list[tuple[tuple[str, ...], bool, int, str]]


def read(page: str | None) -> Page:
    """Tokens of a whole page as balanced elements. Missing end tags are supplied as HTML implies them; comments and scripts go."""
    root = Element("")
    texts: list[tuple[tuple[str, ...], bool, int, str]] = []
    if not page:
        return Page(root, texts)
    # open elements: name, element, whether it or one around it stands apart, path
    stack: list[tuple[str, Element, bool, tuple[str, ...]]] = [("", root, False, ())]
    own: dict[int, list[str]] = {}
    names: dict[tuple[str, str], tuple[str, bool]] = {}
    opened: Counter = Counter()
    block, link, last = 0, 0, 0

    def put(text: str) -> None:
        if "&" in text:
            text = references.unescape(text)
        _, element, apart, path = stack[-1]
        texts.append((path, apart, block, text))
        n = len(text) if not text.isspace() else 0
        if n:
            own.setdefault(id(element), []).append(text)
            if link:
                element.linked += n
            else:
                element.plain += n

    def shut(k: int) -> None:
        for name, *_ in stack[k:]:
            opened[name] -= 1
        del stack[k:]

    for token in _TOKEN.finditer(page):
        if token.start() > last:
            put(page[last : token.start()])
        last = token.end()
        name = token.group(3)
        if not name:
            continue
        name, closing = name.lower(), token.group(2)
        if name in OUTSIDE:
            block += 1
            continue
        inline = name in INLINE
        if name == "br":
            put(" ")
            continue
        if name == "a":
            link = 0 if closing else 1
        if not inline:
            block += 1
        if closing:
            if opened[name]:
                shut(next(k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == name))
            continue
        attributes = token.group(4)
        key = (name, attributes if "=" in attributes else "")
        found = names.get(key) or names.setdefault(key, _label(*key))
        if inline and not found[1] or name in VOID:
            continue
        if not inline:
            link = 0
            ended, holds = {"p", *_CLOSES.get(name, ())}, _HOLDS.get(name, ())
            while any(opened[e] for e in ended):
                k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] in ended or stack[k][0] in holds), 0)
                if not k or stack[k][0] in holds:
                    break
                shut(k)
        if attributes.endswith("/") and name in ("svg", "path", "use"):
            continue
        around = stack[-1]
        label, apart = found
        opened[name] += 1
        if len(stack) > DEEP:
            stack.append((name, around[1], around[2] or apart, around[3]))
            continue
        element = Element(label, apart)
        around[1].items.append(element)
        stack.append((name, element, around[2] or apart, (*around[3], label)))
    if last < len(page):
        put(page[last:])
    _digest(root, own)
    return Page(root, texts)


def _digest(element: Element, own: dict[int, list[str]]) -> None:
    """Own texts as digests; repeated neighbours are folded from the leaves up."""
    said = own.get(id(element))
    if said:
        element.text = hashlib.md5(" ".join(" ".join(said).split()).encode("utf-8", "surrogatepass")).hexdigest()[:12]
    for e in element.items:
        _digest(e, own)
    element.items = fold(element.items)


def _group(items: list[Element], repeated: bool) -> Element:
    return Element("(" + " ".join(e.label for e in items) + ")", all(e.apart for e in items), repeated=repeated, items=items)


def _into(groups: dict[str, Element], e: Element) -> None:
    if e.label in groups:
        groups[e.label] = merge(groups[e.label], e)
    else:
        groups[e.label] = e


def fold(items: list[Element]) -> list[Element]:
    """Neighbouring equal items, then neighbouring equal groups of items, as one repeated item each."""
    out: list[Element] = []
    for e in items:
        if out and out[-1].label == e.label:
            out[-1] = merge(out[-1], e)
            out[-1].repeated = True
        else:
            out.append(e)
    for size in range(2, GROUP + 1):
        k = 0
        while k + 2 * size <= len(out):
            labels = [e.label for e in out[k : k + size]]
            n = 1
            while [e.label for e in out[k + n * size : k + (n + 1) * size]] == labels:
                n += 1
            if n > 1:
                made = _group(out[k : k + size], True)
                for r in range(1, n):
                    made = merge(made, _group(out[k + r * size : k + (r + 1) * size], True))
                out[k : k + n * size] = [made]
            k += 1
    return _narrow(out)


def _narrow(items: list[Element]) -> list[Element]:
    """A row of at most ``WIDE`` items as it is; a longer one as one repeated group in which every label is optional."""
    if len(items) <= WIDE:
        return items
    groups: dict[str, Element] = {}
    for e in items:
        for own in e.items if e.label.startswith("(") else [e]:
            _into(groups, own)
    every = [groups[k] for k in sorted(groups)]
    for e in every:
        e.optional = True
    return [Element("(*)", all(e.apart for e in every), repeated=True, items=every)]


def _gather(items: list[Element], groups: list[Element]) -> list[Element]:
    """``items`` with stretches that spell one of ``groups`` put together as one repetition of it."""
    for g in groups:
        labels = [e.label for e in g.items]
        k = 0
        while k + len(labels) <= len(items):
            if [e.label for e in items[k : k + len(labels)]] == labels:
                items = [*items[:k], _group(items[k : k + len(labels)], g.repeated), *items[k + len(labels) :]]
            k += 1
    return items


def align(a: list[Element], b: list[Element]) -> list[Element]:
    """Two rows of items as one that covers both: the longest common row of labels stays, the rest becomes optional."""
    if [e.label for e in a] == [e.label for e in b]:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    if any(e.label == "(*)" for e in (*a, *b)):
        groups: dict[str, Element] = {}
        for e in (*a, *b):
            for own in e.items if e.label.startswith("(") else [e]:
                _into(groups, own)
        every = [groups[k] for k in sorted(groups)]
        for e in every:
            e.optional = True
        return [Element("(*)", all(e.apart for e in every), repeated=True, items=every)]
    a, b = _gather(a, [e for e in b if e.label.startswith("(")]), _gather(b, [e for e in a if e.label.startswith("(")])
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i].label == b[j].label else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].label == b[j].label:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or (i < n and best[i + 1][j] >= best[i][j + 1]):
            a[i].optional = True
            out.append(a[i])
            i += 1
        else:
            b[j].optional = True
            out.append(b[j])
            j += 1
    return _narrow(fold(out) if len({e.label for e in out}) < len(out) else out)


def merge(a: Element, b: Element) -> Element:
    """One element that covers both, which have the same label."""
    text = a.text if a.text == b.text else "*"
    items = align(a.items, b.items) if a.items or b.items else []
    return Element(a.label, a.apart and b.apart, a.optional or b.optional, a.repeated or b.repeated, a.met + b.met, a.plain + b.plain, a.linked + b.linked, text, items)


def _plain(e: Element) -> int:
    """Characters outside links in an element that does not stand apart."""
    return 0 if e.apart else e.plain + sum(_plain(x) for x in e.items)


def _paths(e: Element, name: str, path: tuple[str, ...] = ()) -> list[tuple[tuple[str, ...], Element]]:
    """Outermost elements of a name that do not stand apart."""
    out = []
    for x in e.items:
        if x.apart:
            continue
        here = path if x.label.startswith("(") else (*path, x.label)
        if x.label.split(".")[0] == name or (name == "main" and ".main" in x.label):
            out.append((here, x))
        else:
            out += _paths(x, name, here)
    return out


def _steady(e: Element) -> bool:
    """Is all text below the same on every page?"""
    return e.text != "*" and all(_steady(x) for x in e.items)


def rule_of(root: Element) -> dict:
    """Where a wrapper's pages carry their main text: paths of labels to take, and paths to leave out below them.

    Elements named article, else main, are taken if they hold a third of the text outside links that does not stand apart.
    Else the rule goes down from the root as long as one container holds three fifths of that text; below the container it
    ends at, lists that are mostly links are left out, and so are parts that read the same on all of three pages or more if
    they hold less text than those that differ.
    """
    total = _plain(root)
    for name in ("article", "main"):
        found = _paths(root, name)
        if found and (not total or 3 * sum(_plain(e) for _, e in found) >= total):
            return {"take": sorted({p for p, _ in found}), "skip": []}
    at, path = root, ()
    while True:
        below = [(e, path if e.label.startswith("(") else (*path, e.label)) for e in at.items if not e.apart and e.label.split(".")[0] not in LEAVES]
        heavy = [x for x in below if 5 * _plain(x[0]) >= 3 * _plain(at) > 0]
        if not heavy or at.plain * 5 > 2 * _plain(at):
            break
        at, path = heavy[0]
    steady, lists, kept = {}, set(), {}

    def look(e: Element, path: tuple[str, ...]) -> None:
        for x in e.items:
            if x.apart:
                continue
            here = path if x.label.startswith("(") else (*path, x.label)
            links, text = _linked(x), _plain(x)
            if links > text and x.label.split(".")[0] in ("ul", "ol", "div", "section", "table"):
                lists.add(here)
            elif root.met >= 3 and x.met >= root.met and not x.optional and not x.repeated and text and _steady(x):
                steady[here] = steady.get(here, 0) + text
            else:
                kept[here] = kept.get(here, 0) + x.plain
                look(x, here)

    look(at, path)
    own = at.plain + sum(kept.values())
    # where most of the text is the same everywhere, pages are copies of each other rather than framed by it
    skip = {*(lists if own + sum(steady.values()) else ()), *(steady if sum(steady.values()) < own else ())}
    return {"take": [path], "skip": sorted(skip - set(kept))}


def _linked(e: Element) -> int:
    return 0 if e.apart else e.linked + sum(_linked(x) for x in e.items)


def extract(page: Page, rule: dict | None) -> str:
    """The page's blocks below the rule's paths, white space as one blank each, parted by an empty line.

    A page without any of the paths is judged by its own structure.
    """

    def under(path: tuple[str, ...], roots: set) -> bool:
        return any(path[:k] in roots for k in lengths if k <= len(path))

    for own in (rule, None):
        if own is None:
            own = rule_of(page.root)
        take, skip = {tuple(p) for p in own["take"]}, {tuple(p) for p in own["skip"]}
        lengths = sorted({len(p) for p in (*take, *skip)})
        verdicts: dict[tuple[str, ...], tuple[bool, bool]] = {}
        blocks: dict[int, list[str]] = {}
        met = False
        for path, apart, block, text in page.texts:
            if path not in verdicts:
                verdicts[path] = under(path, take), under(path, skip)
            inside, left_out = verdicts[path]
            met |= inside
            if inside and not left_out and not apart:
                blocks.setdefault(block, []).append(text)
        if met or rule is None:
            break
    said = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n\n".join(filter(None, said))


def host_of(url) -> F.Column:
    """Host of an address, lower-cased; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per host of ``pages``: ``host``, ``n_pages``, ``wrapper`` (as JSON), ``expression`` (readable) and ``rule`` (JSON).

    Every page of a host is aligned: each task folds its pages into one wrapper per host, and these are combined in groups of
    about ``FAN``, however many pages a host has. A wrapper grows with the distinct elements of a host, not with its pages.
    Null and empty pages align as pages without elements; pages without an address share the empty host.
    """

    def learn(batches):
        place, held, size = TaskContext.get().partitionId(), {}, 0

        def hand():
            rows = list(held.items())
            return pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in rows], pa.string()), pa.array([place] * len(rows), pa.int64()), pa.array([json.dumps(w.pack()) for _, w in rows], pa.string())], names=["host", "part", "wrapper"]
            )

        for batch in batches:
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                found = read(page).root
                before = held.get(host)
                held[host] = merge(before, found) if before else found
                size += 0 if before else found.size()
            if size > HELD:
                yield hand()
                held, size = {}, 0
        yield hand()

    def combine(batches):
        now, wrapper = None, None

        def hand():
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.string()), pa.array([now[1]], pa.int64()), pa.array([json.dumps(wrapper.pack())], pa.string())], names=["host", "part", "wrapper"])

        for batch in batches:
            for host, bucket, packed in zip(*(batch.column(c).to_pylist() for c in ("host", "bucket", "wrapper")), strict=True):
                own = Element.unpack(json.loads(packed))
                if now == (host, bucket):
                    wrapper = merge(wrapper, own)
                else:
                    if now:
                        yield hand()
                    now, wrapper = (host, bucket), own
        if now:
            yield hand()

    schema = "host string, part long, wrapper string"
    source = pages.select(host_of(F.col(url_col)).alias("host"), F.col(html_col).alias("html"))
    parts = keep(map_batches(source, learn, schema), "wrappers")
    while (most := parts.groupBy("host").count().agg(F.max("count")).first()[0] or 0) > 1:
        bucket = F.pmod(F.xxhash64("host", "part", "wrapper"), F.lit(-(-most // FAN))).alias("bucket")
        dealt = parts.select("host", bucket, "part", "wrapper").repartition("host", "bucket").sortWithinPartitions("host", "bucket", "part", "wrapper")
        parts = keep(map_batches(dealt.select("host", "bucket", "wrapper"), combine, schema), "wrappers")

    def describe(batches):
        for batch in batches:
            own = [Element.unpack(json.loads(w)) for w in batch.column("wrapper").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("host"), pa.array([w.met for w in own], pa.int64()), batch.column("wrapper"), pa.array([w.expression() for w in own], pa.string()), pa.array([json.dumps(rule_of(w)) for w in own], pa.string())],
                names=["host", "n_pages", "wrapper", "expression", "rule"],
            )

    return map_batches(parts.select("host", "wrapper"), describe, "host string, n_pages long, wrapper string, expression string, rule string")


def main_texts(pages: DataFrame, wrappers: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row of ``pages``: its id, its address, ``text`` (its main text, "" if it has none) and ``n_chars`` (code points).

    ``wrappers`` are those of ``infer_wrappers`` and are inferred from ``pages`` where not given. Character references are
    decoded, white space inside a block becomes one blank, blocks are joined by an empty line in page order. Null and empty
    pages have an empty text; null ids and addresses are kept; repeated rows are rows of their own; an empty table gives an
    empty result; other columns are ignored. Rules join by host: a small table of them is broadcast by its measured size, a
    large one is shuffled, and a host with a large share of the pages is split by adaptive execution.
    """
    rules = keep((infer_wrappers(pages, url_col, html_col) if wrappers is None else wrappers).select(F.col("host").alias("host"), "rule"), "rules")

    def run(batches):
        known: dict[str, dict] = {}
        for batch in batches:
            texts = []
            for page, rule in zip(batch.column("html").to_pylist(), batch.column("rule").to_pylist(), strict=True):
                if rule is not None and rule not in known:
                    if len(known) > 10_000:
                        known.clear()
                    known[rule] = json.loads(rule)
                texts.append(extract(read(page), known.get(rule)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"]
            )

    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    kind = source.schema["id"].dataType.simpleString()
    joined = source.withColumn("host", host_of(F.col("url"))).join(rules, "host", "left").select("id", "url", "html", "rule")
    return map_batches(joined, run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
