"""Quality rules: surface counts and a hashed n-gram log-likelihood ratio.

Each document is scored by how much likelier its hashed character 4-grams are
under a trusted-target multinomial than under the raw-corpus multinomial, divided
by the number of its 4-grams. The target is estimated from documents labelled as
good, at most ``max_target_docs`` of them (in the order of ``order_key``); the raw
multinomial counts every document. A document stays unless a base rule fails or
its score is below ``threshold``: every document is judged by the same comparison
of whole numbers, so that reruns, partitions and block sizes can't change a verdict.

Defined cases. Null and empty texts have no words and fail the base rule. A
document of fewer than four code points has score 0. With no labelled documents,
or an empty table, both multinomials are flat and all scores are 0 or near. Rows
that repeat a doc_id are judged one by one. Other columns pass through, whatever
their names.

Scale. Two scans of the text and no shuffle of it. Each task of the first scan
sums its counts into one row per bucket; 2**16 rows reach the driver at any size
of corpus. The ids of the target are a broadcast of at most ``max_target_docs`` rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

BUCKETS = 1 << 16
#: Multipliers of the four code points of a gram; the bucket is the sum modulo 2**16.
GRAM = (29791, 961, 31, 1)
#: Scores are kept as whole millionths.
UNIT = 1_000_000
MAX_TARGET_DOCS = 20_000
THRESHOLD = -0.25
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS.encode())] = True


def gram_buckets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each 4-gram of code points, and the first gram of each document (one entry more)."""
    points, lengths = c.decoded(data, offs)
    ends = np.cumsum(lengths)
    n = len(points) - 3
    grams = np.maximum(lengths - 3, 0)
    firsts = np.concatenate([[0], np.cumsum(grams)])
    if n <= 0:
        return np.zeros(0, np.int64), firsts
    bucket = sum(points[k : n + k] * np.uint32(m) for k, m in enumerate(GRAM)) & np.uint32(BUCKETS - 1)
    keep = np.ones(n, bool)
    for k in (1, 2, 3):  # grams that would cross into the next document
        at = ends[:-1] - k
        keep[at[(at >= 0) & (at < n)]] = False
    return bucket[keep].astype(np.int64), firsts


def _equal_windows(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows of WINDOW words at a and at b are the same words, byte by byte."""
    out = np.ones(len(a), bool)
    for k in range(WINDOW):
        size = ends[a + k] - starts[a + k]
        out &= size == ends[b + k] - starts[b + k]
        at = np.flatnonzero(out)
        for lot in np.array_split(at, 1 + int(size[at].sum()) // c.BLOCK) if len(at) else ():
            many = size[lot]
            ramp = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
            same = data[np.repeat(starts[a[lot] + k], many) + ramp] == data[np.repeat(starts[b[lot] + k], many) + ramp]
            out[lot] = np.logical_and.reduceat(same, np.cumsum(many) - many)
    return out


def _repeated(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Words of each document in windows of WINDOW words that stand twice or more in it."""
    m = len(starts) - WINDOW + 1
    if m <= 0:
        return np.zeros(n, np.int64)
    word = c.word_hashes(data, starts, ends)
    key = doc[:m].astype(c.U64)
    for k in range(WINDOW):
        key = c.mix(key * c.U64(c.BASES[0]) + word[k : m + k])
    at = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    at = at[np.argsort(key[at], kind="stable")]
    same = key[at][1:] == key[at][:-1]
    twice = np.zeros(len(starts) + 1, np.int64)  # +1 where a repeated window begins, -1 after its end
    pair = np.flatnonzero(same)
    equal = _equal_windows(data, starts, ends, at[pair], at[pair + 1])
    clash = np.unique(key[at[pair[~equal]]])
    good = pair[equal & ~np.isin(key[at[pair]], clash)]
    hit = np.unique(np.concatenate([at[good], at[good + 1], *(_exactly(data, starts, ends, at[key[at] == x]) for x in clash)]))
    np.add.at(twice, hit, 1)
    np.add.at(twice, hit + WINDOW, -1)
    return np.bincount(doc[np.cumsum(twice[:-1]) > 0], minlength=n)


def _exactly(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of windows with one hash, whose contents differ, those that stand twice or more."""
    found: dict[tuple, list[int]] = {}
    for i in at.tolist():
        found.setdefault(tuple(data[a:b].tobytes() for a, b in zip(starts[i : i + WINDOW], ends[i : i + WINDOW], strict=True)), []).append(i)
    return np.array([i for x in found.values() if len(x) > 1 for i in x], np.int64)


def surface(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each document."""
    n = len(offs) - 1
    starts, ends, doc = c.words_of(data, offs)
    out = {
        "n_words": np.bincount(doc, minlength=n),
        "word_chars": c.per_doc(~c.IS_SPACE[data] & ((data & 0xC0) != 0x80), offs),
        "n_symbols": c.per_doc(_SYMBOL[data], offs),
        "n_dup_lines": np.zeros(n, np.int64),
        "n_repeat_words": _repeated(data, starts, ends, doc, n),
    }
    for i in range(n):
        lines = [x for x in data[offs[i] : offs[i + 1]].tobytes().split(b"\n") if x.strip()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
    return out


def _count(batches):
    """One row per bucket and task: 4-grams in target documents and in all."""
    target, raw = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        is_target = np.array(batch.column(1).fill_null(False), bool)
        for first, last, data, offs in c.text_blocks(batch.column(0)):
            for part, at, _, _ in c.overlapping(data, offs, 3):
                bucket, firsts = gram_buckets(part, at)
                raw += np.bincount(bucket, minlength=BUCKETS)
                for i in np.flatnonzero(is_target[first:last]):
                    target += np.bincount(bucket[firsts[i] : firsts[i + 1]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(target[at]), pa.array(raw[at])], ["bucket", "target", "raw"])


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Millionths of log p_target - log p_raw per bucket, with one added to each count."""
    ratio = np.log((target + 1.0) / (target.sum() + float(BUCKETS))) - np.log((raw + 1.0) / (raw.sum() + float(BUCKETS)))
    return np.rint(ratio * UNIT).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, max_target_docs: int = MAX_TARGET_DOCS) -> np.ndarray:
    """log_ratios over the whole corpus; the target is at most max_target_docs labelled documents."""
    ids = labels.where("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").alias("_id")).distinct()
    ids = ids.orderBy(c.order_key(F.col("_id")), "_id").limit(max_target_docs).withColumn("_target", F.lit(True))
    text = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
    flagged = text.join(F.broadcast(ids), "_id", "left").select("_text", "_target")
    counts = c.in_arrow(flagged, _count, "bucket long, target long, raw long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("raw").alias("raw"))
    target, raw = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in counts.collect():  # at most BUCKETS rows
        target[r[0]], raw[r[0]] = r[1], r[2]
    return log_ratios(target, raw)


def _scorer(ratios: np.ndarray, threshold: float):
    limit = round(threshold * UNIT)

    def kernel(batches):
        for batch in batches:
            found = {k: [] for k in (*COUNTS, "score", "grams")}
            for _, _, data, offs in c.text_blocks(batch.column(1)):
                for k, v in surface(data, offs).items():
                    found[k].append(v)
                score, grams = np.zeros(len(offs) - 1, np.int64), np.zeros(len(offs) - 1, np.int64)
                for part, at, _, _ in c.overlapping(data, offs, 3):
                    bucket, firsts = gram_buckets(part, at)
                    total = np.concatenate([[0], np.cumsum(ratios[bucket])])
                    score += total[firsts[1:]] - total[firsts[:-1]]
                    grams += np.diff(firsts)
                found["score"].append(score)
                found["grams"].append(grams)
            x = {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in found.items()}
            failed = (x["n_words"] < MIN_WORDS) | (100 * x["n_repeat_words"] > MAX_REPEAT_PERCENT * x["n_words"])
            kept = ~failed & (x["score"] >= limit * x["grams"])
            score = x["score"] / np.maximum(x["grams"], 1) / UNIT
            arrays = [batch.column(0), *(pa.array(x[k].astype(np.int64)) for k in COUNTS), pa.array(failed), pa.array(kept), pa.array(score)]
            yield pa.RecordBatch.from_arrays(arrays, ["_row", *COUNTS, "base_failed", "kept", "score"])

    return kernel


def judge(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, max_target_docs: int = MAX_TARGET_DOCS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Struct ``_row`` of the columns in keep, the five counts, base_failed, kept and score of each row."""
    row = F.struct(*(F.col(f"`{k}`") for k in keep)).alias("_row")
    given = docs.select(row, F.col("text").alias("_text"))
    rest = T.StructType.fromDDL(f"{', '.join(f'{k} long' for k in COUNTS)}, base_failed boolean, kept boolean, score double")
    schema = T.StructType([given.schema["_row"], *rest.fields])
    return c.in_arrow(given, _scorer(fit(docs, labels, max_target_docs), threshold), schema)


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    names = docs.columns
    kept = judge(docs, labels, keep=tuple(names), **options).where("kept")
    return kept.select(*(F.col("_row").getField(k).alias(k) for k in names))
