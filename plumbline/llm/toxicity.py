"""Toxicity: a support vector machine over a gapped subsequence kernel, through Nystrom landmarks.

The kernel compares two words by the three-letter subsequences they share, each weighted by ``DECAY`` to the power of the
letters it spans, so inserted characters and changed endings cost a little and do not hide a word. A text's similarity to a
landmark word is that of its most similar word; the landmarks' own kernel matrix turns these similarities into Nystrom
features, on which a linear machine with squared hinge loss is trained.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.llm.store import held, keep, map_batches, slices, uncollected

DECAY, SPAN, LETTERS = 0.6, 7, 128
#: Similarities below this are zero: just under those of five- to eight-letter words with a character between all letters.
LEAST = 0.15
#: Longer words are looked at in windows of this many characters, each half over the next.
WINDOW = 24
MEMO = 300_000
_EDGES = ".,!?;:|#*$%&()[]{}<>\"'`~^=+-_/\\"
_SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S(?!\S)){3,}+")


@lru_cache(maxsize=64)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples of a word of n letters within ``SPAN`` letters, and their weights, scaled to norm 1."""
    found = [(i, j, k) for i in range(n) for k in range(i + 2, min(n, i + SPAN)) for j in range(i + 1, k)]
    if not found:
        return np.zeros((0, 3), dtype=np.int64), np.zeros(0)
    at = np.array(found)
    weight = DECAY ** (at[:, 2] - at[:, 0] + 1.0)
    return at, weight / np.sqrt((weight**2).sum())


def _codes(words: list[str], n: int) -> np.ndarray:
    """Letters as small numbers: a to z are 1 to 26, ASCII digits and marks share 27 to 31, other scripts the rest by code point."""
    raw = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), n)
    latin = np.where((raw >= 97) & (raw <= 122), raw - 96, np.where((raw >= 48) & (raw <= 57), 27, 28 + raw % 4))
    return np.where(raw < 128, latin, 32 + raw % (LETTERS - 32)).astype(np.int64)


def word_triples(words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence numbers (words x triples) and the weight of each triple, for words of n letters."""
    at, weight = _triples(n)
    codes = _codes(words, n)
    return (codes[:, at[:, 0]] * LETTERS + codes[:, at[:, 1]]) * LETTERS + codes[:, at[:, 2]], weight


def forms(text: str) -> set[str]:
    """Distinct words of a whole text, lower-cased; letters that stand alone in a row also make one word."""
    low = text.lower()
    out = set(low.split())
    if len(low) > 6:
        out.update("".join(m.group().split()) for m in _SPACED.finditer(low))
    return out


def joined(word: str) -> set[str]:
    """A word without what is put between its letters: any punctuation, or one and the same character between all of them."""
    out = set()
    if not word.isalnum():
        out.add("".join(filter(str.isalnum, word)))
    for own in (word, *out):
        letters = list(filter(None, own.split(own[1]))) if len(own) > 6 else []
        if len(letters) > 3 and max(map(len, letters)) == 1:
            out.add("".join(letters))
    return out


def windows(word: str) -> list[str]:
    word = word.strip(_EDGES)
    if len(word) < 7 and word.isalnum():
        return [word] if len(word) >= 3 else []
    out = []
    for own in (word, *sorted(joined(word) - {word})):
        if len(own) > WINDOW:
            out += [own[a : a + WINDOW] for a in range(0, len(own) - WINDOW // 2, WINDOW // 2)]
        elif len(own) >= 3:
            out.append(own)
    return out


class Similarity:
    """Kernel rows of words against landmarks; each distinct word is met once while it is remembered."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        own = [word_triples([word], len(word)) for word in landmarks]
        met = np.unique(np.concatenate([codes[0] for codes, _ in own])) if own else np.zeros(0, dtype=np.int64)
        #: Row of the table for each triple that a landmark holds, 0 for all others.
        self.place = np.zeros(LETTERS**3, dtype=np.int32)
        self.place[met] = np.arange(1, len(met) + 1)
        # landmarks that hold each triple, and their weights for it, triple after triple
        entries: list[dict[int, float]] = [{} for _ in range(len(met) + 1)]
        for k, (codes, weight) in enumerate(own):
            for at, w in zip(self.place[codes[0]].tolist(), weight.tolist(), strict=True):
                entries[at][k] = entries[at].get(k, 0.0) + w
        self.first = np.cumsum([0, *map(len, entries)])
        self.holder = np.array([k for e in entries for k in e], dtype=np.int64)
        self.share = np.array([w for e in entries for w in e.values()])
        self.forget()

    def forget(self) -> None:
        #: Words and parts of words with what they are like: landmark << 16 | the bits of the similarity as a half float.
        self.whole: dict[str, tuple[int, ...]] = {}
        self.parts: dict[str, tuple[int, ...]] = {}
        #: The same, not met since they were last looked through.
        self.old: tuple[dict, dict] = {}, {}

    def age(self) -> None:
        """Words met of late stay for another turn, the others go."""
        self.old, self.whole, self.parts = (self.whole, self.parts), {}, {}

    def kernel(self, words: list[str]) -> np.ndarray:
        """Words x landmarks. Only triples that a landmark holds are looked at, and only with the landmarks that hold them."""
        out = np.zeros((len(words), len(self.landmarks)), dtype=np.float32)
        by: dict[int, list[int]] = {}
        for k, word in enumerate(words):
            by.setdefault(len(word), []).append(k)
        for n, own in by.items():
            step = max(1, 400_000 // max(1, len(_triples(n)[1])))
            for a in range(0, len(own), step):
                part = own[a : a + step]
                codes, weight = word_triples([words[k] for k in part], n)
                at = self.place[codes]
                row, col = np.nonzero(at)
                if len(row):
                    begin = self.first[at[row, col]]
                    many = self.first[at[row, col] + 1] - begin
                    hit = np.repeat(np.arange(len(row)), many)
                    held_by = np.arange(len(hit)) - np.repeat(np.cumsum(many) - many - begin, many)
                    key = row[hit] * len(self.landmarks) + self.holder[held_by]
                    sums = np.bincount(key, weights=self.share[held_by] * weight[col[hit]], minlength=len(part) * len(self.landmarks))
                    out[part] = sums.reshape(len(part), -1)
        return out

    def learn(self, words: set[str]) -> None:
        if len(self.whole) > MEMO // 2:
            self.age()
        old_words, old_parts = self.old
        new = words.difference(self.whole)
        again = new.intersection(old_words)
        self.whole.update(zip(again, map(old_words.__getitem__, again), strict=True))
        made = {w: windows(w) for w in new.difference(again)}
        fresh = set().union(*made.values()).difference(self.parts)
        again = fresh.intersection(old_parts)
        self.parts.update(zip(again, map(old_parts.__getitem__, again), strict=True))
        rest = list(fresh.difference(again))
        for a in range(0, len(rest), 20_000):
            part = rest[a : a + 20_000]
            found = self.kernel(part)
            row, col = np.nonzero(found >= LEAST)
            packed = (col << 16 | found[row, col].astype(np.float16).view(np.uint16)).tolist()
            ends = np.searchsorted(row, np.arange(len(part) + 1)).tolist()
            self.parts.update(zip(part, (tuple(packed[i:j]) for i, j in zip(ends, ends[1:], strict=False)), strict=True))
        get = self.parts.__getitem__
        for word, own in made.items():
            self.whole[word] = get(own[0]) if len(own) == 1 else tuple(chain.from_iterable(map(get, own)))

    def texts(self, texts: list[str | None]) -> np.ndarray:
        """Texts x landmarks: the largest similarity of any of the text's words."""
        out = np.zeros((len(texts), len(self.landmarks)), dtype=np.float32)
        words = [forms(t) if t else set() for t in texts]
        self.learn(set().union(*words))
        near = [list(chain.from_iterable(map(self.whole.__getitem__, own))) for own in words]
        packed = np.fromiter(chain.from_iterable(near), dtype=np.int64)
        text = np.repeat(np.arange(len(texts)), [len(x) for x in near])
        values = (packed & 0xFFFF).astype(np.uint16).view(np.float16).astype(np.float32)
        np.maximum.at(out.reshape(-1), text * len(self.landmarks) + (packed >> 16), values)
        return out


@dataclass
class Model:
    landmarks: list[str] = field(default_factory=list)
    weights: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def scores(self, similar: np.ndarray) -> np.ndarray:
        margins = similar @ self.weights + self.bias if self.landmarks else np.full(len(similar), self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -40, 40)))


def nystrom(landmarks: list[str], ridge: float = 1e-2) -> np.ndarray:
    """Inverse square root of the landmarks' kernel matrix."""
    own = Similarity(landmarks).kernel(landmarks).astype(np.float64)
    own = (own + own.T) / 2
    values, vectors = np.linalg.eigh(own)
    return (vectors / np.sqrt(np.maximum(values, 0) + ridge)) @ vectors.T


def train_machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the rows within the margin; y is 1 or -1, classes weigh alike."""
    rows = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    cost = weight * np.where(y > 0, 0.5 / max(1, weight[y > 0].sum()), 0.5 / max(1, weight[y < 0].sum())) * weight.sum()
    w, keep_out = np.zeros(rows.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    for _ in range(rounds):
        inside = y * (rows @ w) < 1
        a, c = rows[inside], cost[inside]
        new = np.linalg.solve((a * c[:, None]).T @ a + np.diag(keep_out), a.T @ (c * y[inside]))
        # a shorter step where the full one does not lower the loss
        def loss(v):
            return (cost * np.maximum(0, 1 - y * (rows @ v)) ** 2).sum() + (keep_out * v * v).sum()

        step, before = 1.0, loss(w)
        while step > 1e-3 and loss(w + step * (new - w)) > before:
            step /= 2
        moved = step * (new - w)
        w = w + moved
        if np.abs(moved).max() < 1e-7:
            break
    return w[:-1], float(w[-1])


def calibrate(margins: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of a logistic curve through the margins, with the usual softened targets."""
    pos, neg = weight[y > 0].sum(), weight[y < 0].sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    rows, w = np.stack([margins, np.ones(len(margins))], axis=1), np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -40, 40)))
        step = np.linalg.solve((rows * (weight * p * (1 - p))[:, None]).T @ rows + 1e-6 * np.eye(2), rows.T @ (weight * (target - p)))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def bounded(rows: DataFrame, most_rows: int, by: str) -> DataFrame:
    """``rows``, which hold few rows of each ``by``, or where there are more than ``most_rows`` those whose hash of it is in the share that fits."""
    total = rows.count()
    if total <= most_rows:
        return rows
    return rows.where(F.pmod(F.xxhash64(by), F.lit(1 << 40)) < int((1 << 40) * 0.95 * most_rows / total))


def labelled_texts(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Texts with their labels (1 or 0); a text comes once for each different label of its id.

    About ``most_rows`` different labels are taken at most, whatever their ids repeat, so that they can be sent to every task
    of the scan. Labels without an id or a value are left out.
    """
    own = labels.select(id_col, (F.col(label_col) == 1).cast("int").alias(label_col)).dropna().distinct()
    return docs.select(id_col, text_col).join(F.broadcast(bounded(own, most_rows, id_col)), id_col)


def fit_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "toxic", landmarks: int = 128, most_rows: int = 20_000) -> Model:
    """Learn from labelled texts (sentences or documents); the label is 1 for toxic.

    Rows of equal text and label are one row with a weight. About ``most_rows`` such rows are learned from at most, those
    with the smallest hashes of their text; this and the number of landmarks bound what reaches the driver. Landmarks are the
    words most typical of toxic rows. Rows with a null text or label are left out. Without rows of both labels the model
    scores every text 0 (or 1, if all are toxic).
    """
    rows = labelled.select(F.col(text_col).alias("text"), (F.col(label_col) == 1).alias("bad")).where("text is not null and bad is not null")
    rows = keep(rows.groupBy("text", "bad").agg(F.count("*").alias("weight")), "labelled")
    rows = bounded(rows, most_rows, "text")

    def count(batches):
        sums: dict[str, list[int]] = {}
        for batch in batches:
            for text, bad, weight in zip(*(batch.column(c).to_pylist() for c in ("text", "bad", "weight")), strict=True):
                for word in {w for x in forms(text) for w in windows(x)}:
                    sums.setdefault(word, [0, 0])[bad] += weight
        words = list(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string()), pa.array([sums[w][1] for w in words], pa.int64()), pa.array([sums[w][0] for w in words], pa.int64())], names=["word", "bad", "good"],
        )

    sizes = {r.bad: r.n for r in rows.groupBy("bad").agg(F.sum("weight").alias("n")).collect()}
    n_bad, n_good = sizes.get(True, 0), sizes.get(False, 0)
    if not n_bad or not n_good:
        return Model(bias=30.0 if n_bad else -30.0)
    ratio = n_bad / n_good
    seen = map_batches(rows, count, "word string, bad long, good long").groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    excess = F.col("bad") - F.col("good") * ratio
    best = seen.where("bad >= 2").withColumn("z", excess / F.sqrt(F.col("bad") + F.col("good") * ratio + 1)).where("z > 0.5").orderBy(F.desc("z"), "word").limit(landmarks)
    words = [r.word for r in best.select("word").collect()]
    if not words:
        return Model(bias=30.0 if n_bad > n_good else -30.0)
    sent = labelled.sparkSession.sparkContext.broadcast(words)

    def measure(batches):
        own = Similarity(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            found = np.concatenate([own.texts(texts[a:b]) for a, b in slices(texts)]) if texts else np.zeros((0, len(words)), dtype=np.float32)
            yield pa.RecordBatch.from_arrays([batch.column("bad"), batch.column("weight"), pa.array(list(found), pa.list_(pa.float32()))], names=["bad", "weight", "x"])

    table = map_batches(rows, measure, "bad boolean, weight long, x array<float>").toPandas()  # at most most_rows x landmarks numbers
    x = np.stack(table["x"].to_numpy()).astype(np.float64)
    y = np.where(table["bad"].to_numpy(dtype=bool), 1.0, -1.0)
    weight = table["weight"].to_numpy(dtype=np.float64)
    order = np.lexsort((weight, *x.T[::-1], y))  # the same model whatever order rows arrive in
    x, y, weight = x[order], y[order], weight[order]
    root = nystrom(words)
    w, b = train_machine(x @ root, y, weight)
    slope, offset = calibrate(x @ root @ w + b, y, weight)
    return Model(words, root @ w, b, slope, offset)


def _scorer(landmarks: list[str]) -> Similarity:
    return held(("toxicity", *landmarks), lambda: Similarity(landmarks))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, the probability that the whole text is toxic; null counts as empty.

    All rows and columns stay (an input column named ``score_col`` is replaced); an empty table gives an empty result.
    """
    docs = docs.drop(score_col) if score_col in docs.columns else docs
    sent, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        own = _scorer(sent.value.landmarks)
        for batch in batches:
            texts = batch.column(at).to_pylist()
            with uncollected():
                scores = [sent.value.scores(own.texts(texts[a:b]).astype(np.float64)) for a, b in slices(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(scores) if scores else np.zeros(0))], names=[*batch.schema.names, score_col])

    schema = StructType([*docs.schema.fields]).add(score_col, "double")
    return map_batches(docs, run, schema)
