"""The corpus pipeline: each stage on what the one before it kept."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from test_corpus import SCHEMA, brute_quality, fingerprint, link_groups, text_hash, words_of

import corpus_pipeline
from motionloom.llm import common, packing, quality, queries


def test_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "simhash near-dedup", "mixing to target weights", "best-fit packing"]
    kept = {r["doc_id"] for r in queries.op10_quality(spark, d).where("kept").collect()}
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out.append(common.written(stage(spark, out[-1], d), f"test-{k}"))
        if k < 4:
            assert out[-1].columns == columns
    rows = [x.collect() for x in out]
    assert {r["doc_id"] for r in rows[1]} == kept
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    assert sorted(norm(r["text"]) for r in rows[2]) == sorted({norm(r["text"]) for r in rows[1]})
    ids = {r["doc_id"] for r in rows[3]}
    assert ids <= {r["doc_id"] for r in rows[2]} and len(ids) == len(rows[3])
    times = Counter(r["doc_id"] for r in rows[4])
    assert set(times) <= ids and max(times.values()) <= 2
    assert Counter(r["doc_id"] for r in rows[5] if r["piece"] == 0) == times
    run = corpus_pipeline.run(spark, d)
    assert sorted(map(str, run.drop("sequence_id", "offset").collect())) == sorted(map(str, out[5].drop("sequence_id", "offset").collect()))


def brute_pipeline(rows: list[tuple], good: set) -> Counter:
    """Pieces (doc_id, piece, start, length, crc) of the whole pipeline over rows of doc_id, text, lang, source ..., by plain loops."""

    def buckets(t):
        p = [ord(x) for x in t or ""]
        return [sum(v * m for v, m in zip(p[i : i + 4], quality.GRAM, strict=True)) % quality.BUCKETS for i in range(len(p) - 3)]

    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(buckets(r[1]))
        target.update(buckets(r[1]) if r[0] in good else ())
    ratio = quality.log_ratios(*(np.array([c[i] for i in range(quality.BUCKETS)], float) for c in (target, raw)))

    def keeps(t):
        n, b = brute_quality(t), buckets(t)
        return n[0] >= 10 and 100 * n[4] <= 20 * n[0] and sum(ratio[x] for x in b) >= quality.THRESHOLD * quality.UNIT * len(b)

    rows = [r for r in rows if keeps(r[1])]
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1])].append(r)
    rows = [min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for g in groups.values()]
    near = defaultdict(list)
    for r, g in zip(rows, link_groups([fingerprint(r[1]) for r in rows]), strict=True):
        near[g].append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1]))) for g in near.values()]

    sizes, lines = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r[3]] += len(words_of(r[1]))
        lines[r[3]].append(r)
    order = sorted(s for s in sizes if s is not None) + [None] * (None in sizes)
    weight, left = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}, 1.5 * sum(sizes.values())
    share = dict.fromkeys(order, 0.0)
    while left > 1e-9:
        open_ = [s for s in order if share[s] < 2 * sizes[s] - 1e-9]
        for s in open_:
            share[s] += left * weight[s] / sum(weight[x] for x in open_)
        left = sum(max(0.0, share[s] - 2 * sizes[s]) for s in order)
        share = {s: min(v, 2.0 * sizes[s]) for s, v in share.items()}
    full, out = packing.tokens("byte_bpe_50k").full, Counter()
    for s in order:
        at = 0
        for r in sorted(lines[s], key=lambda r: ((r[0] % 2**31 * 1103515245 + 12345) % 2**31, len(words_of(r[1])))) * 2:
            n = len(words_of(r[1]))
            if 2 * max(0, min(n, int(share[s] + 1e-9) - at)) >= n:
                ids = np.array([*full.encode(r[1], add_special_tokens=False).ids, 2], "<u4")
                out.update((r[0], k, start, size, zlib.crc32(ids[start : start + size].tobytes())) for k, (start, size) in enumerate(packing.cut(len(ids))))
            at += n
    return out


def awkward() -> list[tuple]:
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstu"), rng.integers(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words, n)) + "."
    texts = [None, "", " \n ", "one", "spam spam spam " * 30, "#$% " * 20]
    base = prose(150)
    texts += [base, base, base.replace(" ", "  "), base.upper(), base + " tail", base[:500] + " other " + base[500:]]
    texts += [prose(int(n)) for n in rng.integers(10, 300, 30)] + [prose(9000), prose(40) + " <|endoftext|> " + prose(20)]
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4], None, 1, True, i) for i, t in enumerate(texts)]
    again = (20, prose(77), "en", "a", None, 1, True, 0)  # another text of a known id
    return [*rows, rows[20], rows[20], (None, None, None, None, None, None, None, None), again]


def test_whole_pipeline_against_brute_force(spark, tmp_path):
    rows = awkward()
    good = set(range(6, len(rows)))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in good], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    expected = brute_pipeline(rows, good)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in found) == expected
    assert len({k[0] for k in expected}) > 20 and max(expected.values()) == 2 and max(k[1] for k in expected) > 5
    places = defaultdict(list)
    for r in found:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        ends = [0, *(a + n for a, n in sorted(p))]
        assert ends[:-1] == [a for a, _ in sorted(p)] and ends[-1] <= 1024


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
