"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

Features are the n-grams (``SIZES`` code points, A-Z and Latin capitals lower-cased,
white space as one blank) that stay within a word and the blanks around it, hashed
into ``BUCKETS`` buckets. A bucket's ratio is
log((df1 + A) / (n1 + 2A)) - log((df0 + A) / (n0 + 2A)), where df1 of n1 toxic and df0 of n0 clean training
documents have the bucket; ratios within ``ERRORS`` standard errors of 0 and buckets of fewer than ``MIN_DOCS`` documents
are left out. A document's value for a bucket is its ratio times the log of one more than the bucket's times in the document, over a common
scale; logistic regression is trained on these values.

Training uses a bounded sample of labelled rows: the first ``max_per_class`` of each
class in the order of ``common.order_key``. Every document is scored over its whole text.
Language, source, id and labels are not inputs of a score.

Defined cases. Null and empty texts have no features; their score is the bias alone.
Without both classes among the training rows every score is the share of toxic rows
(0 with no rows). Rows that repeat a doc_id are scored one by one; a label given
twice counts once, and a doc_id labelled both ways counts as toxic. An empty table gives no rows.

Scale. The sample's texts (a documented bound) are collected and the model (one float
per bucket) goes to the tasks; all else is one scan of the text without shuffle. Labels that
training may use are bounded before the join, so that this is a broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

SIZES = (3, 4, 5, 6)
BUCKETS = 1 << 20
#: Places that one step takes, so that a very long document needs no more memory than its code points.
STARTS = 1 << 18
MAX_PER_CLASS = 2000
SMOOTH, MIN_DOCS, ERRORS, L2, STEPS = 0.5, 3, 3.0, 0.03, 400
THRESHOLD = 0.7

_SPACES = np.array([9, 10, 11, 12, 13, 32, 0xA0, 0x2028, 0x2029, 0x3000], np.uint32)


def _points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points with a blank before and after each document, and each point's document."""
    whole, lengths = c.decoded(data, offs)
    doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 2)
    out = np.full(len(doc), 32, np.uint32)
    ends = np.cumsum(lengths + 2)
    inner = np.ones(len(doc), bool)
    inner[ends - 1] = inner[ends - lengths - 2] = False
    out[inner] = whole
    out[np.isin(out, _SPACES)] = 32
    capital = (out >= 65) & (out <= 90) | (out >= 0xC0) & (out <= 0xDE) & (out != 0xD7)
    out[capital] += 32
    return out, doc


def _steps(data: np.ndarray, offs: np.ndarray):
    """Points and their documents, STARTS places at a time with what their n-grams reach; and how many of the places count."""
    reach, begin = max(SIZES) - 1, True
    for part, at, extra, ended in c.overlapping(data, offs, reach):
        points, doc = _points(part, at)
        # Only the document's own beginning and end have a blank.
        inner = slice(None if begin else 1, None if ended else -1)
        points, doc, begin = points[inner], doc[inner], False
        own = len(points) - (extra + ended if extra else 0)
        for a in range(0, own, STARTS):
            yield points[a : a + STARTS + reach], doc[a : a + STARTS + reach], min(STARTS, own - a)


def features(data: np.ndarray, offs: np.ndarray, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, bucket) pairs, sorted, and the log of one more than their times; wanted: a mask of the buckets that count."""
    parts = [_grams(points, doc, points == 32, wanted, own) for points, doc, own in _steps(data, offs)]
    if len(parts) == 1:
        pairs, times = parts[0]
    else:
        pairs, at = np.unique(np.concatenate([p for p, _ in parts] or [np.zeros(0, np.int64)]), return_inverse=True)
        times = np.bincount(at, np.concatenate([t for _, t in parts] or [np.zeros(0)]), minlength=len(pairs))
    return pairs // BUCKETS, pairs % BUCKETS, np.log1p(times)


def _grams(points: np.ndarray, doc: np.ndarray, blank: np.ndarray, wanted: np.ndarray | None, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct document * BUCKETS + bucket of the n-grams from the first `starts` points, and their times."""
    n = len(points)
    blanks = np.zeros(n + 1, np.int32)
    np.cumsum(blank, out=blanks[1:])
    word = (points.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    word ^= word >> np.uint64(29)
    h = word[: n - 1] * np.uint64(0xBF58476D1CE4E5B9) + word[1:] if n > 1 else word[:0]
    found = []
    for size in range(3, max(SIZES) + 1):
        m = n - size + 1
        if m <= 0:
            break
        h = h[:m] * np.uint64(0xBF58476D1CE4E5B9) + word[size - 1 : size - 1 + m]
        if size not in SIZES:
            continue
        # No blank inside; the first and last may be blanks, which also keeps documents apart.
        at = np.flatnonzero((blanks[size - 1 : size - 1 + m] == blanks[1 : m + 1]) & (doc[:m] == doc[size - 1 : size - 1 + m]))
        at = at[: np.searchsorted(at, starts)]
        bucket = ((h[at] ^ h[at] >> np.uint64(32)) * np.uint64(0x94D049BB133111EB) >> np.uint64(44)).astype(np.int64)
        if wanted is not None:
            hit = wanted[bucket]
            at, bucket = at[hit], bucket[hit]
        found.append(doc[at].astype(np.int64) * BUCKETS + bucket)
    return np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)


def fit(texts: list[str], toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Weight of each bucket, and the bias."""
    weights, n1, n = np.zeros(BUCKETS), int(toxic.sum()), len(toxic)
    if not n1 or n1 == n:
        share = min(max(n1 / n if n else 0.0, 1e-6), 1 - 1e-6)
        return weights, float(np.log(share / (1 - share)))
    found = [[], [], []]
    for first, _, data, offs in c.text_blocks(pa.array(texts, pa.string())):
        d, b, t = features(data, offs)
        for x, y in zip(found, ((d + first).astype(np.int32), b.astype(np.int32), t.astype(np.float32)), strict=True):
            x.append(y)
    doc, bucket, often = (np.concatenate(x) for x in found)
    df1 = np.bincount(bucket[toxic[doc]], minlength=BUCKETS)
    df = np.bincount(bucket, minlength=BUCKETS)
    ratio = np.log((df1 + SMOOTH) / (n1 + 2 * SMOOTH)) - np.log((df - df1 + SMOOTH) / (n - n1 + 2 * SMOOTH))
    # Ratios that chance explains are noise in long texts: more than ERRORS standard errors count.
    error = np.sqrt(1 / (df1 + SMOOTH) + 1 / (df - df1 + SMOOTH))
    use = (df >= MIN_DOCS) & (np.abs(ratio) > ERRORS * error)
    keep = use[bucket]
    doc, bucket, often = doc[keep], bucket[keep], often[keep]
    ids = np.flatnonzero(use)
    col = np.searchsorted(ids, bucket)
    x, y = ratio[bucket] * often, toxic.astype(float)
    size = np.sqrt(max(1.0, np.bincount(doc, x * x, minlength=n).mean()))
    x = x / size
    w, v, bias, pace = np.zeros(len(ids)), np.zeros(len(ids)), float(np.log(n1 / (n - n1))), 0.0
    rate = 4.0
    for _ in range(STEPS):  # gradient descent with momentum, from zero: the same result in any run
        p = 1 / (1 + np.exp(-(np.bincount(doc, x * w[col], minlength=n) + bias)))
        g = p - y
        v = 0.9 * v - rate * (np.bincount(col, x * g[doc], minlength=len(ids)) / n + L2 * w / n)
        pace = 0.9 * pace - rate * g.mean() * 0.1
        w, bias = w + v, bias + pace
    weights[ids] = w * ratio[ids] / size
    return weights, float(bias)


def scores(data: np.ndarray, offs: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
    doc, bucket, often = features(data, offs, weights != 0)
    return 1 / (1 + np.exp(-(np.bincount(doc, weights[bucket] * often, minlength=len(offs) - 1) + bias)))


def _scorer(ids: np.ndarray, values: np.ndarray, bias: float):
    def kernel(batches):
        weights = np.zeros(BUCKETS)
        weights[ids] = values
        for batch in batches:
            found = [scores(data, offs, weights, bias) for _, _, data, offs in c.text_blocks(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(found) if found else np.zeros(0))], ["_row", "score"])

    return kernel


def held_out(doc_id):
    """True for documents whose labels training may not see."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, max_per_class: int = MAX_PER_CLASS) -> tuple[np.ndarray, float]:
    """fit over at most max_per_class labelled documents of each class that aren't held out."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("_toxic"))
    some = [known.where(F.col("_toxic") == k).orderBy(c.order_key(F.col("_id")), "_id").limit(max_per_class) for k in (0, 1)]
    rows = docs.select(F.col("doc_id").alias("_id"), "text").join(F.broadcast(some[0].union(some[1])), "_id").select("_id", "text", "_toxic").toLocalIterator()
    rows = sorted((r[0], r[1] or "", r[2]) for r in rows)
    return fit([r[1] for r in rows], np.array([r[2] == 1 for r in rows], bool))


def score(docs: DataFrame, labels: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), max_per_class: int = MAX_PER_CLASS) -> DataFrame:
    """Struct ``_row`` of the columns in keep, and the score of each row."""
    weights, bias = train(docs, labels, max_per_class)
    ids = np.flatnonzero(weights)
    given = docs.select(F.struct(*(F.col(f"`{k}`") for k in keep)).alias("_row"), F.col("text").alias("_text"))
    schema = T.StructType([given.schema["_row"], T.StructField("score", T.DoubleType())])
    return c.in_arrow(given, _scorer(ids, weights[ids], bias), schema)
