"""The gapped subsequence kernel against its definition."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from plumbline.llm.toxicity import DECAY, LEAST, SPAN, Similarity, calibrate, train_machine


def features(word):
    """Weights of three-letter subsequences within ``SPAN`` letters, by what they spell; all weights together have norm 1."""
    out, norm = Counter(), 0.0
    for i, j, k in combinations(range(len(word)), 3):
        if k - i < SPAN:
            weight = DECAY ** (k - i + 1)
            out[word[i] + word[j] + word[k]] += weight
            norm += weight * weight
    return {s: w / norm**0.5 for s, w in out.items()} if norm else {}


def words(rng, n, longest=12):
    return ["".join(rng.choice("abcde") for _ in range(rng.randrange(1, longest))) for _ in range(n)]


def test_kernel_is_its_definition():
    rng = random.Random(2)
    landmarks, own = words(rng, 20), words(rng, 200)
    want = [[sum(w * features(m).get(s, 0) for s, w in features(x).items()) for m in landmarks] for x in own]
    assert np.allclose(Similarity(landmarks).kernel(own), want, atol=1e-5)


def test_a_text_takes_the_largest_similarity_of_its_words_whatever_is_remembered():
    rng = random.Random(3)
    landmarks = words(rng, 10)
    texts = [" ".join(words(rng, rng.randrange(8), 7)) for _ in range(60)] + [None, ""]
    scorer = Similarity(landmarks)
    got = scorer.texts(texts)
    for row, text in zip(got, texts, strict=True):
        own = [w for w in (text or "").split() if len(w) >= 3 and (len(w) < 7 or len(set(w[1::2])) > 1)]
        plain = np.array(scorer.kernel(own)).max(axis=0) if own else np.zeros(10)
        plain[plain < LEAST] = 0
        if not any(len(w) >= 7 for w in (text or "").split()):
            assert np.allclose(row, plain, atol=2e-3)
    scorer.age()
    assert (scorer.texts(texts) == got).all()
    scorer.age(), scorer.age()
    assert (scorer.texts(texts) == got).all()


def test_weights_stand_for_repeated_rows():
    rng = np.random.default_rng(4)
    x, y = rng.standard_normal((40, 5)), np.where(rng.random(40) < 0.3, 1.0, -1.0)
    times = rng.integers(1, 5, 40)
    one, other = train_machine(x, y, times.astype(float)), train_machine(np.repeat(x, times, axis=0), np.repeat(y, times), np.ones(times.sum()))
    assert np.allclose(one[0], other[0], atol=1e-5) and one[1] == pytest.approx(other[1], abs=1e-5)
    margins = x @ one[0] + one[1]
    assert calibrate(margins, y, times.astype(float)) == pytest.approx(calibrate(np.repeat(margins, times), np.repeat(y, times), np.ones(times.sum())), abs=1e-4)
