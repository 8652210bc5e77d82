"""The toxicity classifier's n-grams, ratios, weights and scores against plain loops."""

from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from motionloom.llm import common, toxicity

M = (1 << 64) - 1


def bucket(gram: str) -> int:
    """The hash of an n-gram of three or more code points, from its definition."""
    word = [((ord(x) + 1) * 0x9E3779B97F4A7C15) & M for x in gram]
    word = [x ^ x >> 29 for x in word]
    h = word[0]
    for x in word[1:]:
        h = (h * 0xBF58476D1CE4E5B9 + x) & M
    return ((h ^ h >> 32) * 0x94D049BB133111EB & M) >> 44


def grams(text: str | None) -> Counter:
    """Buckets and times of the n-grams that stay within a word and one blank on either side."""
    fold = lambda x: chr(ord(x) + 32) if "A" <= x <= "Z" or 0xC0 <= ord(x) <= 0xDE and ord(x) != 0xD7 else x
    x = " " + "".join(" " if y in "\t\n\x0b\x0c\r \xa0  　" else fold(y) for y in text or "") + " "
    return Counter(bucket(x[i : i + n]) for n in toxicity.SIZES for i in range(len(x) - n + 1) if " " not in x[i + 1 : i + n - 1])


def examples() -> tuple[list[str | None], np.ndarray]:
    rng = np.random.default_rng(3)
    clean, bad = ["meadow", "river", "Ärger", "bread", "winter", "lantern"], ["skrumpf", "blargh", "Zonk"]
    texts = [" ".join(rng.choice(clean + bad * (k % 3 == 0), rng.integers(1, 30))) for k in range(90)] + [None, "", "\n"]
    return texts, np.array([k % 3 == 0 for k in range(90)] + [False] * 3)


def test_features():
    texts, _ = examples()
    data, offs = next((x[2], x[3]) for x in common.text_blocks(pa.array(texts, pa.string()), 1 << 30))
    doc, bucket_of, value = toxicity.features(data, offs)
    expected = [(i, b, math.log1p(n)) for i, t in enumerate(texts) for b, n in sorted(grams(t).items())]
    assert list(zip(doc.tolist(), bucket_of.tolist(), strict=True)) == [x[:2] for x in expected]
    assert np.allclose(value, [x[2] for x in expected])


def brute_fit(texts, toxic):
    """Weights and bias by the docstring's formulas, with dense loops."""
    found, n = [grams(t) for t in texts], len(texts)
    n1 = int(toxic.sum())
    df = defaultdict(lambda: [0, 0])
    for g, y in zip(found, toxic, strict=True):
        for b in g:
            df[b][int(y)] += 1
    a, ratio = toxicity.SMOOTH, {}
    for b, (d0, d1) in df.items():
        r = math.log((d1 + a) / (n1 + 2 * a)) - math.log((d0 + a) / (n - n1 + 2 * a))
        if d0 + d1 >= toxicity.MIN_DOCS and abs(r) > toxicity.ERRORS * math.sqrt(1 / (d1 + a) + 1 / (d0 + a)):
            ratio[b] = r
    ids = sorted(ratio)
    x = np.array([[ratio[b] * math.log1p(g[b]) if b in g else 0.0 for b in ids] for g in found])
    size = math.sqrt(max(1.0, (x * x).sum(axis=1).mean()))
    x /= size
    w, v, bias, pace = np.zeros(len(ids)), np.zeros(len(ids)), math.log(n1 / (n - n1)), 0.0
    for _ in range(toxicity.STEPS):
        g = 1 / (1 + np.exp(-(x @ w + bias))) - toxic
        v = 0.9 * v - 4.0 * (x.T @ g / n + toxicity.L2 * w / n)
        pace = 0.9 * pace - 0.4 * g.mean()
        w, bias = w + v, bias + pace
    return {b: w[k] * ratio[b] / size for k, b in enumerate(ids)}, bias


def test_fit_and_scores(spark):
    texts, toxic = examples()
    weights, bias = toxicity.fit([t or "" for t in texts], toxic)
    expected, base = brute_fit(texts, toxic)
    assert len(expected) > 10 and set(np.flatnonzero(weights).tolist()) == set(expected)
    assert all(weights[b] == pytest.approx(x, rel=1e-4, abs=1e-5) for b, x in expected.items()) and bias == pytest.approx(base, rel=1e-4)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    known = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 3 != 1]
    w, b = brute_fit([texts[i] for i in known], toxic[known])
    for r in toxicity.score(docs, labels).collect():
        z = b + sum(w.get(k, 0.0) * math.log1p(n) for k, n in grams(texts[r["_row"]["doc_id"]]).items())
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def test_very_long_text_in_steps(spark):
    """A text above one block, cut where it may be, scores as it does whole."""
    rng = np.random.default_rng(0)
    text = " ".join(rng.choice(["meadow", "rivér", "blargh", "🙂x", "a"], 400_000))
    weights = rng.standard_normal(toxicity.BUCKETS) * (rng.random(toxicity.BUCKETS) < 0.5) / 1e5
    data, offs = next((x[2], x[3]) for x in common.text_blocks(pa.array([text])))
    z = sum(weights[b] * math.log1p(n) for b, n in grams(text).items())
    assert toxicity.scores(data, offs, weights, 0.1)[0] == pytest.approx(1 / (1 + math.exp(-(z + 0.1))), abs=1e-9)
