"""Very long texts: through whole operators against brute force, and the memory that a worker's kernels take."""

from __future__ import annotations

import hashlib
import re
import subprocess
import sys
from collections import Counter

import numpy as np
import pytest
from test_corpus import brute_components, brute_quality, fingerprint, words_of

from motionloom.llm import common, exact, mixing, quality, simhash, suffix


def texts() -> list[str]:
    """A document above one block and one segment, another that shares a passage with it, its copy, and a run without blanks."""
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9))) for _ in range(3000)]
    long = " ".join(rng.choice(words, 230_000))
    passage = long[700_000:700_700]
    return [long, "Start. " + passage + " " + " ".join(rng.choice(words, 80)), long, "x" * 1_200_000, " ".join(rng.choice(words, 60)) + "\n" + passage[:300]]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "a" if i % 2 else None) for i, t in enumerate(texts())]
    assert len(rows[0][1]) > common.SEGMENT
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).cache()


def test_fingerprints_of_long_texts(table):
    prints = [fingerprint(t) for t in texts()]
    groups = brute_components(prints, list(range(len(prints))))
    found = {r["doc_id"]: (r["fp"] & (1 << 64) - 1, r["component_id"]) for r in simhash.near_groups(table).collect()}
    assert found == {i: (p, g) for i, (p, g) in enumerate(zip(prints, groups, strict=True))}


def test_repeats_in_long_texts(table):
    raw = [t.encode() for t in texts()]
    times = Counter(hash(t[i : i + 200]) for t in raw for i in range(len(t) - 199))
    found = {r["_row"]["doc_id"]: r for r in suffix.remove_repeats(table).collect()}
    for k, t in enumerate(raw):
        gone = np.zeros(len(t) + 1, np.int64)
        hits = np.array([i for i in range(len(t) - 199) if times[hash(t[i : i + 200])] > 1], np.int64)
        np.add.at(gone, hits, 1)
        np.add.at(gone, hits + 200, -1)
        gone = np.cumsum(gone[:-1]) > 0
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        assert (found[k]["n_bytes"], found[k]["n_removed"], found[k]["kept_sha256"]) == (len(t), int(gone.sum()), hashlib.sha256(kept).hexdigest())
        assert found[k]["n_spans"] == np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(int)) == 1)


def test_quality_and_sizes_of_long_texts(spark, table):
    found = {r["_row"]["doc_id"]: r for r in quality.judge(table, spark.createDataFrame([(0, 1)], "doc_id long, quality int")).collect()}
    for i, t in enumerate(texts()):
        assert tuple(found[i][k] for k in quality.COUNTS) == brute_quality(t)
    assert {r["_row"]["doc_id"]: r["size"] for r in mixing.mix(table).collect()} == {i: len(words_of(t)) for i, t in enumerate(texts())}


def test_copies_of_long_texts(table):
    found = {r["doc_id"]: r for r in exact.groups(table).collect()}
    assert [found[i]["keep_id"] for i in range(5)] == [0, 1, 0, 3, 4]
    assert all(found[i]["text_sha256"] == hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t).encode()).hexdigest() for i, t in enumerate(texts()))


@pytest.mark.parametrize(("crowd", "copies"), [(2, 4), (3, 40)])
def test_crowded_passages(spark, monkeypatch, crowd, copies):
    """A passage amid ever new text, with few and with many kinds of its parts: shards, parts and single strings agree with brute force."""
    monkeypatch.setattr(suffix, "CROWD", crowd)
    rng = np.random.default_rng(copies)
    letters = list("abcdefghiklmnoprstuvw ")
    passage = "".join(rng.choice(letters, 196))
    rows = [(k, "".join(rng.choice(letters, 150)) + passage + "".join(rng.choice(letters[:2], 3)) + "".join(rng.choice(letters, 150))) for k in range(copies)]
    rows += rows[:1] * 3
    times = Counter(t[i : i + 200] for _, t in rows for i in range(len(t) - 199))
    expected = sorted((k, sum(any(times[t[i : i + 200]] > 1 for i in range(max(0, p - 199), min(p, len(t) - 200) + 1)) for p in range(len(t)))) for k, t in rows)
    found = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["_row"]["doc_id"], r["n_removed"]) for r in found) == expected


MEMORY = """
import gc, sys
import numpy as np, pyarrow as pa
from motionloom.llm import common as c, packing, quality, simhash, suffix, toxicity
rng = np.random.default_rng(1)
words = np.array(["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9))) for _ in range(4000)])
column = pa.array([" ".join(rng.choice(words, 3_300_000))])
one, marks = pa.array([1]), np.arange(1000)
known = packing.tokens("byte_bpe_50k")
run = {
    "surface": lambda d, o: quality.surface(d, o),
    "grams": lambda d, o: list(quality._scorer(np.zeros(quality.BUCKETS, np.int64), -0.25)([pa.RecordBatch.from_arrays([one, column], ["_row", "t"])])),
    "fingerprints": lambda d, o: simhash.fingerprints(d, o),
    "pieces": lambda d, o: list(suffix._pieces([pa.RecordBatch.from_arrays([one, one, column], ["doc", "key", "text"])])),
    "removal": lambda d, o: suffix._removal(d, o, np.zeros(1000, np.int64), marks * 300, marks * 300 + 200),
    "tokens": lambda d, o: known.array(column[0].as_py()),
    "scores": lambda d, o: toxicity.scores(d, o, np.zeros(toxicity.BUCKETS), 0.0),
}[sys.argv[1]]
peak = lambda: int(next(x for x in open("/proc/self/status") if "VmHWM" in x).split()[1]) / 1024
gc.collect()
open("/proc/self/clear_refs", "w").write("5")
before = peak()
for _, _, data, offs in c.text_blocks(column):
    assert len(data) > 18_000_000
    run(data, offs)
print(peak() - before)
"""


@pytest.mark.parametrize(("kernel", "most"), [("surface", 300), ("grams", 300), ("fingerprints", 300), ("pieces", 120), ("removal", 50), ("tokens", 150), ("scores", 80)])
def test_memory_of_a_20_mb_text(kernel, most):
    out = subprocess.run([sys.executable, "-c", MEMORY, kernel], capture_output=True, text=True, timeout=300, check=True)
    assert float(out.stdout) < most
