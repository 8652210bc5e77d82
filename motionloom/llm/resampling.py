"""Importance resampling towards a target distribution, with an exact draw of the k best.

Every text is a bag of hashed features (runs of 1 to ``max_n`` words; A-Z lower-cased, words of ASCII letters,
digits and everything beyond ASCII), a feature's bucket being the CRC-32 of its bytes modulo ``BUCKETS``. A
bucket's gain is a whole number of thousandths of the log-ratio between target and raw counts, and a document's
weight the floored mean of its features' gains, read from one array in each task. The score adds Gumbel
noise that a hash of the doc_id decides, so that the k highest scores are a draw without replacement, and reruns agree.

The k-th key is found by distributed radix selection: the key is (score falling, doc_id rising), its digits are
counted from the top, each in one aggregate over the rows that agree with the digits found so far, and the count says which
digit comes next. Only rows up to that key are sorted, by ranges, and ranked from the ranges' sizes.

Defined cases. Null and empty texts have no features and weight 0. A null doc_id is hashed as the empty string and comes
after all others of its score. Rows that repeat a doc_id are rows of their own; of those that tie at the end of the draw (equal
score and doc_id, hence equal weight) those with more features go first. Fewer than ``min_words`` words: scored, never drawn. An empty
table, or a draw of no rows, gives null ranks only; an empty target gives gains by the raw counts alone. Other columns aren't touched.

Scale. Two scans of the text, no shuffle of it; ``BUCKETS`` counts a task and 80 kB of gains a task are all that moves
of it. Scores are a written table of 40 bytes a row, which the selection reads once a digit (at most eight times, each with at most 65,536 counts).
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

BUCKETS, MAX_N, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
UNIT = 1000
#: Bits of a digit of the selection.
DIGIT = 16
#: Words of more bytes are hashed one by one.
LONG = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _crc_table() -> np.ndarray:
    x = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        x = np.where(x & 1, x >> np.uint32(1) ^ np.uint32(0xEDB88320), x >> np.uint32(1))
    return x


_CRC = _crc_table()


def _crc_on(state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 states carried on over data[start:end], one byte of all words at a time."""
    state, size = state.copy(), ends - starts
    order = np.argsort(-np.minimum(size, LONG + 1), kind="stable")
    long = int(np.count_nonzero(size > LONG))
    for i in order[:long].tolist():
        state[i] = ~np.uint32(zlib.crc32(data[starts[i] : ends[i]], int(~state[i])))
    order = order[long:]
    many = np.searchsorted(-size[order], -np.arange(LONG + 1), "left")  # words of more than j bytes
    at, x = starts[order], state[order]
    for j in range(LONG):
        k = int(many[j])
        if not k:
            break
        x[:k] = _CRC[(x[:k] ^ data[at[:k] + j]) & np.uint32(255)] ^ x[:k] >> np.uint32(8)
    state[order] = x
    return state


def feature_buckets(data: np.ndarray, offs: np.ndarray, max_n: int = MAX_N) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """(bucket, document) of all runs of n words, for each n, and the number of words of each document."""
    n = len(offs) - 1
    data = _LOWER[data]
    starts, ends, doc = c.words_of(data, offs, _IN_WORD[data])
    out, state = [], np.full(len(starts), 0xFFFFFFFF, np.uint32)
    blank = np.array([32], np.uint8)
    for m in range(max_n):
        at = np.flatnonzero(doc[m:] == doc[: max(len(doc) - m, 0)])
        if m:
            zero = np.zeros(len(at), np.int64)
            state[at] = _crc_on(state[at], blank, zero, zero + 1)
        state[at] = _crc_on(state[at], data, starts[at + m], ends[at + m])
        out.append(((~state[at] % np.uint32(BUCKETS)).astype(np.int64), doc[at]))
    return out, np.bincount(doc, minlength=n)


def _parts(column, max_n: int):
    """feature_buckets of a column's blocks, with the block's first and last row."""
    for first, last, data, offs in c.text_blocks(column):
        yield first, last, *feature_buckets(data, offs, max_n)


def _counter(max_n: int):
    def kernel(batches):
        found = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, features, _ in _parts(batch.column(0), max_n):
                for bucket, _ in features:
                    found += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], ["bucket", "n"])

    return kernel


def bucket_counts(texts: DataFrame, max_n: int = MAX_N) -> np.ndarray:
    """Features of the column text in each bucket."""
    counts = c.in_arrow(texts.select("text"), _counter(max_n), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(BUCKETS, np.int64)
    for r in counts.collect():  # at most BUCKETS rows
        out[r[0]] = r[1]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Whole thousandths of each bucket's log-ratio of target to raw, one added to each count."""
    s, t = raw.astype(np.float64), target.astype(np.float64)
    return np.floor(UNIT * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def _noise(doc_id: pa.Array, seed: int) -> np.ndarray:
    """Thousandths of Gumbel noise, from a hash of the ids."""
    h = [int(hashlib.sha256(f"{seed}:{'' if x is None else x}".encode()).hexdigest()[:8], 16) for x in doc_id.to_pylist()]
    return np.floor(-UNIT * np.log(-np.log((np.array(h, np.float64) + 0.5) / 4294967296))).astype(np.int64)


def _scorer(gain: np.ndarray, max_n: int, seed: int):
    def kernel(batches):
        for batch in batches:
            many, total, words = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, last, features, count in _parts(batch.column(1), max_n):
                words[first:last] = count
                for bucket, doc in features:
                    many[first:last] += np.bincount(doc, minlength=last - first)
                    total[first:last] += np.rint(np.bincount(doc, gain[bucket], last - first)).astype(np.int64)
            weight = total // np.maximum(many, 1)
            score = weight + _noise(batch.column(0), seed)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (many, words, weight, score))], ["doc_id", "n_features", "n_words", "weight", "score"])

    return kernel


def weighted(docs: DataFrame, target: DataFrame, *, max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, n_words, weight and score of each row of docs; target is a table with a column text."""
    gain = gains(bucket_counts(docs, max_n), bucket_counts(target, max_n))
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return c.in_arrow(given, _scorer(gain, max_n, seed), "doc_id long, n_features long, n_words long, weight long, score long")


def kth(rows: DataFrame, keys: list[str], k: int) -> tuple | None:
    """The values of keys (whole numbers, all rising, without nulls) in the k-th row (from 1) of their order; None without so many rows.

    Radix selection: a key's digits of DIGIT bits above its least value are counted one after another.
    """
    found: list[int] = []
    for key in keys:
        low, high = rows.agg(F.min(key), F.max(key)).first()
        if low is None:
            return None
        low, high = int(low), int(high)
        base = low
        for shift in reversed(range(0, max(1, (high - low).bit_length()), DIGIT)):
            digit = F.shiftrightunsigned(F.col(key) - F.lit(base), shift) if shift else F.col(key) - F.lit(base)
            counts = sorted(rows.groupBy(digit.alias("digit")).count().collect())  # at most 2**DIGIT rows
            for d, n in counts:
                if k <= n:
                    break
                k -= n
            else:
                return None
            base += d << shift
            rows = rows.where(F.col(key).between(base, base + (1 << shift) - 1))
        found.append(base)
    return tuple(found)


def draw(scored: DataFrame, k: int) -> DataFrame:
    """Adds rank (1, 2, ... for the k highest scores among rows that may be drawn, else null) to a written table of scores.

    Needs doc_id, n_features, score and the boolean may. Ties go to smaller doc_ids.
    """
    known = F.coalesce("doc_id", F.lit(0))
    order = {"_k0": -F.col("score"), "_k1": F.col("doc_id").isNull().cast("long"), "_k2": F.shiftright(known, 32), "_k3": known.bitwiseAND(0xFFFFFFFF), "_k4": -F.col("n_features")}
    last = kth(scored.where("may").withColumns(order), list(order), k) if k > 0 else None
    names = scored.columns
    if last is None:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    keyed = scored.withColumns(order)
    reached = F.struct(*order) <= F.struct(*(F.lit(x).cast("long") for x in last))
    chosen = keyed.where(F.col("may") & reached).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    chosen = c.written(chosen, "drawn", short=False)  # the ranges stay as they are
    first, sizes, before = Window.orderBy("_part"), chosen.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")), "_before"
    sizes = sizes.withColumn(before, F.sum("_n").over(first) - F.col("_n"))  # one row a range
    place = F.col("_at") - F.col("_first") + F.col(before) + 1
    ranked = chosen.join(F.broadcast(sizes), "_part").withColumn("rank", F.when(place <= k, place))  # rows that tie with the last may be too many
    rest = keyed.where(~(F.col("may") & reached)).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*names, "rank").union(rest.select(*names, "rank"))


def resample(docs: DataFrame, target: DataFrame, *, percent: int = PERCENT, min_words: int = MIN_WORDS, max_n: int = MAX_N, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row of docs: percent of the rows with min_words words or more are drawn."""
    scored = c.written(weighted(docs, target, max_n=max_n, seed=seed).withColumn("may", F.col("n_words") >= min_words), "scores")
    return draw(scored, percent * scored.where("may").count() // 100).select("doc_id", "n_features", "weight", "score", "rank")
