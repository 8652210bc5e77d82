"""Phrases, resampling and MinHash against brute force, on small tables with every awkward case."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.llm import common, minhash, phrases, resampling

from test_corpus import SCHEMA, documents


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of() -> list[tuple]:
    rows = documents()
    rng = np.random.default_rng(3)
    words = ["ab", "cd", "Ef", "gh", "ij", "kl", "mn", "öp", "q" * 60, "r\x00s"]
    add = [(1000 + i, " ".join(rng.choice(words, 40, p=[0.3, 0.2, 0.1, 0.1, 0.1, 0.05, 0.05, 0.04, 0.03, 0.03])) + rng.choice([". end", "\nnext: line", "\x0bx", "\t\ttab"]), rng.choice(["en", "de", ""]), "a", 0, 0, True, 1) for i in range(60)]
    base = " ".join(rng.choice([f"w{k}" for k in range(300)], 80))
    for i in range(40):  # chains of near copies, some just below the similarity that links
        w = base.split(" ")
        for k in rng.choice(80, int(i % 8), replace=False):
            w[k] = f"x{i}{k}"
        add.append((2000 + i, " ".join(w), None, "b", 0, 0, True, 1))
    return rows + [tuple(None if isinstance(x, str) and x == "" and k == 2 else (str(x) if isinstance(x, np.str_) else x) for k, x in enumerate(r)) for r in add]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_phrases(rows, max_words, min_count, absorb, top):
    out = []
    by: dict[str, Counter] = {}
    total: Counter = Counter()
    for r in rows:
        f = by.setdefault(r[2] or "und" if r[2] is not None else "und", Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(r[1])):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[r[2] if r[2] is not None else "und"] += len(w)
            for m in range(1, max_words + 1):
                f.update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    for lang, f in by.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= absorb * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, k = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out)


@pytest.mark.parametrize(("max_words", "min_count", "top", "head"), [(3, 10, 2000, 1 << 19), (3, 4, 50, 5), (4, 3, 30, 0), (2, 1, 2000, 100)])
def test_phrases_equal_brute_force(docs, max_words, min_count, top, head):
    found = phrases.collocations(docs, max_words=max_words, min_count=min_count, top=top, head=head)
    assert sorted(map(tuple, found.collect())) == brute_phrases(rows_of(), max_words, min_count, phrases.ABSORB, top)


def test_phrases_of_an_empty_table(empty):
    found = phrases.collocations(empty)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and found.count() == 0


def test_scores_pass_64_bits(spark):
    words = spark.createDataFrame([("en", b"a", 3 * 10**14, 1), ("en", b"b", 10**14 + 1, 2)], "lang string, word binary, n long, id long")
    pairs = spark.createDataFrame([([1, 2], 10**14 - 7)], "ids array<long>, n long")
    a, left, right = 10**14 - 7, 3 * 10**14, 10**14 + 1
    assert phrases.scored([pairs], words).select("a", "l", "r", "score").first() == (a, left, right, 1_000_000 * a * a // (left * right))


def test_radix_order_and_run_lengths():
    rng = np.random.default_rng(0)
    columns = [rng.integers(0, k, 5000).astype(np.uint32) for k in (7, 1 << 32, 3)]
    columns[1][rng.random(5000) < 0.5] = 256
    n = rng.integers(1, 9, 5000)
    keys, sums = phrases.run_lengths(columns, n)
    want = Counter()
    for *k, x in zip(*(x.tolist() for x in columns), n.tolist(), strict=True):
        want[tuple(k)] += x
    assert list(zip(*(x.tolist() for x in keys), strict=True)) == sorted(want) and sums.tolist() == [want[k] for k in sorted(want)]
    block = phrases._packed(keys, sums)
    again, counts = phrases._unpacked(block, len(sums), 3)
    assert all((x == y).all() for x, y in zip(keys, again, strict=True)) and (counts == sums).all()


def test_filters_know_all_they_were_made_of(spark):
    h = np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 3000)
    table = common.filter_of(spark.createDataFrame([(int(x),) for x in h], "h long"))
    assert common.passes(table, h.view(np.uint64)).all()
    assert common.passes(table, np.random.default_rng(2).integers(0, 1 << 63, 10_000).astype(np.uint64)).mean() < 0.01


def features(text, max_n):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    return [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, max_n + 1) for i in range(len(w) - n + 1)], len(w)


@pytest.mark.parametrize("max_n", [1, 3])
def test_resampling_equals_brute_force(spark, docs, max_n):
    target = [(1, documents()[12][1]), (2, None), (3, "The river and the mill. " * 3), (4, "")]
    rows = rows_of()
    s, t = Counter(b for r in rows for b in features(r[1], max_n)[0]), Counter(b for r in target for b in features(r[1], max_n)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    want = []
    for r in rows:
        f, n = features(r[1], max_n)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        want.append((r[0], len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= 20))
    order = sorted((x for x in want if x[4]), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[1]))
    drawn = Counter((*x[:4], k + 1) for k, x in enumerate(order[: 10 * len(order) // 100]))
    rest = Counter((*x[:4], None) for x in want) - Counter((*x[:4], None) for x in order[: 10 * len(order) // 100])
    found = resampling.resample(docs, spark.createDataFrame(target, "item_id long, text string"), max_n=max_n)
    assert Counter(map(tuple, found.collect())) == drawn + rest


@pytest.mark.parametrize("k", [0, 1, 7, 500, 999, 1000, 1001])
def test_draws_take_exactly_k(spark, k):
    rng = np.random.default_rng(k)
    rows = [(int(rng.integers(-(1 << 62), 1 << 62)) if i % 3 else i % 2, int(rng.integers(0, 4)), int(rng.integers(-3, 70_000)) if i % 5 else 7, bool(i % 4)) for i in range(1333)]
    table = spark.createDataFrame(rows, "doc_id long, n_features long, score long, may boolean").repartition(5).cache()
    found = resampling.draw(table, k).where("rank IS NOT NULL").orderBy("rank").collect()
    order = sorted((r for r in rows if r[3]), key=lambda r: (-r[2], r[0], -r[1]))
    want = order[:k] if k <= len(order) else []
    assert [tuple(r)[:4] for r in found] == want and [r[4] for r in found] == list(range(1, len(want) + 1))


def test_resampling_of_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(empty, none).count() == 0
    assert resampling.resample(docs, none).count() == docs.count()


def test_words_of_any_length_have_their_crc():
    texts = ["a" * 63, "b" * 64, "c" * 65, "d" * 100_000, "é" * 40, "x", "", "one two"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(x.encode()) for x in texts])])
    (bucket, doc), = resampling.feature_buckets(data, offs)[0]
    assert list(zip(doc.tolist(), bucket.tolist(), strict=True)) == [(i, b) for i, x in enumerate(texts) for b in features(x, 1)[0]]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))) if w else frozenset()


def brute_groups(rows, percent=85):
    sets = [shingles(r[1]) for r in rows]
    group = list(range(len(rows)))

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= percent * len(x | sets[j]):
                group[find(i)] = find(j)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    for i, r in enumerate(rows):
        own = least.get(find(i)) if sets[i] else r[0]
        yield r[0], len(sets[i]), own, own is None or own == r[0]


def test_minhash_equals_brute_force(docs):
    assert Counter(map(tuple, minhash.near_groups(docs).collect())) == Counter(brute_groups(rows_of()))


def test_minhash_of_a_crowd_around_the_limit(spark):
    """A crowd whose members have similarities around the limit with one another, so that no single centre links them all."""
    rng = np.random.default_rng(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for k in rng.choice(150, int(rng.integers(0, 14)), replace=False):
            w[k] = f"v{rng.integers(0, 3)}"
        rows.append((i, " ".join(w)))
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert Counter(map(tuple, found.collect())) == Counter(brute_groups(rows))


def test_minhash_makes_a_pair_in_one_of_its_buckets(spark):
    numbers = range(minhash.SKETCH + minhash.MAP)
    rows = [(k, node, node, 0, 10, *(0 for _ in numbers), [5, 7, 9]) for k in (5, 7, 9) for node in range(4)]
    mixed = spark.createDataFrame(rows, "key long, node long, component long, largest long, n long, " + ", ".join(f"s{k} long" for k in numbers) + ", keys array<long>")
    met = minhash._met(mixed, 85)
    assert sorted(tuple(sorted((r["a"], r["b"]))) for r in met.collect()) == [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)]


def test_minhash_of_empty_and_lonely_tables(spark, empty):
    assert minhash.near_groups(empty).count() == 0
    rows = [(1, "a b c"), (2, ""), (3, None), (None, " ")]
    found = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert Counter(map(tuple, found.collect())) == Counter([(1, 1, 1, True), (2, 0, 2, True), (3, 0, 3, True), (None, 0, None, True)])


@pytest.mark.parametrize("size", [1, 2, 7, 30, 200, 1000])
def test_signatures_agree_as_often_as_sets_are_similar(size):
    rng, share = np.random.default_rng(size), []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, size).astype(np.uint64)
        y = x[int(0.15 * size) :]
        a, b = minhash.signature(x), minhash.signature(y)
        share.append((a == b).mean() - len(y) / size)
        assert (minhash.band_keys(a) == minhash.band_keys(b)).any()
        p, q = minhash.sketch(a).view(np.uint64), minhash.sketch(b).view(np.uint64)
        assert np.bitwise_count((p[:4] ^ q[:4]) | (p[4:] ^ q[4:])).sum() <= minhash.DIFFER
        x, y = minhash.member_map(x).view(np.uint64), minhash.member_map(y).view(np.uint64)
        assert np.bitwise_count(y & ~x).sum() == 0 and np.bitwise_count(x & ~y).sum() <= int(0.15 * size)
    assert abs(np.mean(share)) < 0.01


def test_shingles_of_a_block_are_hashed_at_once(monkeypatch):
    """One pass over a block's words; sets meet as those of the shingles' texts do, short and empty documents included."""
    rng, calls, hashes = np.random.default_rng(3), [], common.word_hashes
    texts = ["", " \n", "a", "A", "a b", "b a", "ab", "a a a a", "a a", "a  b\tc", "A B C", "a b c d", "b c a"] + [" ".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(0, 9, 80)]
    monkeypatch.setattr(common, "word_hashes", lambda *a: (calls.append(1), hashes(*a))[1])
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offs = np.cumsum([0, *map(len, texts)])
    found = [set(x.tolist()) for x in minhash.shingle_sets(data, offs)]
    assert len(calls) == 1
    words = [t.lower().split() for t in texts]
    want = [{tuple(w[i : i + 3]) for i in range(max(len(w) - 2, min(len(w), 1)))} for w in words]
    assert all(len(x & y) == len(p & q) for x, p in zip(found, want, strict=True) for y, q in zip(found, want, strict=True))
