"""Forms for many rows, bounded in memory, against those for few."""

from __future__ import annotations

import threading
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom.operators import affinity, distance, metrics, transport
from motionloom.plans import methods, pipeline


def blobs() -> np.ndarray:
    rng = np.random.default_rng(5)
    return np.concatenate([rng.normal(c, 4, (25, 6)) for c in (0, 60, 140)]).round()


class Threads:
    """The exchange of tasks that are threads."""

    def __init__(self, rank: int, room: list, barrier: threading.Barrier) -> None:
        self.rank, self.room, self.barrier = rank, room, barrier

    def gather(self, value) -> list:
        self.room[self.rank] = value
        self.barrier.wait(60)
        out = list(self.room)
        self.barrier.wait(60)
        return out

    def total(self, values: np.ndarray) -> np.ndarray:
        return sum(self.gather(values))


def test_messages_in_files_equal_messages_in_memory(monkeypatch):
    """One task, or three: lots of a file give the labels of the matrix."""
    monkeypatch.setattr(affinity, "LOT", 300)  # four rows
    monkeypatch.setattr(affinity, "SLAB", 900)
    x = blobs()
    d = distance.cityblock(x, x) / 10
    for preference in (-((d.max()) ** 2), -300.0, -1.0):
        labels, found = affinity.cluster_matrix(d, preference)
        lots = affinity.cluster_matrix(d, preference, held=0)
        assert np.array_equal(lots[0], labels) and np.array_equal(lots[1], found)
        room, barrier, out = [None] * 3, threading.Barrier(3), [None] * 3
        parts = np.array_split(np.arange(len(x)), 3)

        def task(k: int, preference=preference, room=room, barrier=barrier, out=out, parts=parts) -> None:
            out[k] = affinity.propagate(affinity.Similarities(parts[k], x, 10.0), parts[k], preference, Threads(k, room, barrier), held=0)

        tasks = [threading.Thread(target=task, args=(k,)) for k in range(3)]
        for t in tasks:
            t.start()
        for t in tasks:
            t.join(120)
        assert np.array_equal(np.concatenate([o[0] for o in out]), labels) and all(np.array_equal(o[1], found) for o in out)


def test_messages_in_files_need_little_memory(monkeypatch):
    monkeypatch.setattr(affinity, "SLAB", 1 << 17)
    x = np.random.default_rng(1).integers(0, 50, (1500, 4)).astype(float)
    own = np.arange(1500)
    tracemalloc.start()
    affinity.propagate(affinity.Similarities(own, x, 1.0), own, -100.0, held=0, max_iter=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 8 * 1500 * 1500 / 2  # not half a matrix, of three


def test_block_rows_in_files(spark, monkeypatch):
    """No limit unless it is given; block rows in the files of several tasks give what one matrix does."""
    x = blobs()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "win long, vec array<double>")
    d = distance.cityblock(x, x) / 10
    labels, found = affinity.cluster_matrix(d, max_iter=8)
    want = {i: (int(k), int(found[k]) if k >= 0 else -1) for i, k in enumerate(labels)}
    got = lambda df: {r["win"]: (r["label"], r["exemplar"]) for r in df.collect()}
    pairs = distance.pairs(df).selectExpr("i", "j", "d / 10 AS d")
    assert got(affinity.dense(df, unit=10, held=0, max_iter=8)) == got(affinity.of_distances(pairs, df, held=0, max_iter=8)) == want
    monkeypatch.setattr(affinity, "ONE_TASK", 1)

    class Gathered:
        """The exchange by Spark's own means: slow, but without a socket."""

        def __init__(self, context) -> None:
            self.context, self.rank = context, context.partitionId()

        def gather(self, value) -> list:
            import base64
            import pickle

            return [pickle.loads(base64.b64decode(v)) for v in self.context.allGather(base64.b64encode(pickle.dumps(value)).decode())]

        def total(self, values):
            return sum(self.gather(values))

    monkeypatch.setattr(affinity, "Exchange", Gathered)
    assert got(affinity.dense(df, unit=10, held=0, max_iter=8)) == want
    assert got(affinity.of_distances(pairs, df, held=0, max_iter=8)) == want
    with pytest.raises(ValueError):
        affinity.of_distances(pairs, df, limit=74)


def test_easy_plans_need_no_newton_steps(monkeypatch):
    """Plain scaling reaches the same plans; costs are those of whole arrays, in any layout."""
    rng = np.random.default_rng(2)
    for n in (4, 20):
        a, b = rng.normal(0, 0.25, (2, 50, n, 4))
        cost = transport._ground(a, b)
        assert np.array_equal(cost, np.abs(a[:, :, None, :] - b[:, None, :, :]).sum(axis=-1))
        monkeypatch.setattr(transport, "EASY", 0)
        slow = transport.sinkhorn_cost(cost, 0.5)
        monkeypatch.setattr(transport, "EASY", 20)
        hard = transport.sinkhorn_cost(cost, 0.1)  # some are left after STEPS
        assert hard[1].all() and np.allclose(hard[0], [transport.sinkhorn_cost(c[None], 0.1)[0][0] for c in cost], atol=1e-8)
        monkeypatch.setattr(np.linalg, "solve", None)
        fast = transport.sinkhorn_cost(cost, 0.5)
        monkeypatch.undo()
        assert fast[1].all() and np.allclose(fast[0], slow[0], atol=1e-8)


def test_sliced_distances_ship_points(spark, monkeypatch):
    """The grid gets 4 values a point, not 100; distances are those of the projected rows, bit by bit."""
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(rng.normal(0, 1, (12, 60, 4)).astype(np.float32))], "win long, pts array<array<float>>")
    wide = transport.sliced_features(df)
    want = sorted(map(tuple, distance.pairs(wide).collect())), sorted(map(tuple, distance.cross(wide, wide.where("win < 3")).collect()))
    seen, join = [], distance.block_join
    monkeypatch.setattr(distance, "block_join", lambda a, b, *args, **kw: (seen.append(len(a.select("vec").first()[0])), join(a, b, *args, **kw))[1])
    got = sorted(map(tuple, transport.joint_distances(df, "sliced_w1").collect())), sorted(map(tuple, transport.joint_distances(df, "sliced_w1", df.where("win < 3")).collect()))
    assert got == want and seen == [240, 240]


def test_halves_of_more_rows_are_one_job(spark, monkeypatch):
    """Rows that are too many for a task, whose halves are not: all splits at once, with the scores of a small recording."""
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(blobs())], "win long, vec array<double>")
    want = pipeline.split_half(df, splits=2, unit=10)
    monkeypatch.setattr(affinity, "ONE_TASK", 20)
    monkeypatch.setattr(affinity, "dense", None)
    assert pipeline.split_half(df, splits=2, unit=10) == want and want["splits"] == 2


@pytest.mark.parametrize("whole", [True, False])
def test_silhouette_meets_no_pairs(spark, monkeypatch, whole):
    """Several groups of rows and values cut by batches, against all pairs; noise is left out, a single member scores 0."""

    def never(*_, **__):
        raise AssertionError("rows were compared in pairs")

    monkeypatch.setattr(distance, "_on_grid", never)
    monkeypatch.setattr(metrics, "GROUP", 40, raising=False)
    rng = np.random.default_rng(11)
    v = np.concatenate([rng.normal(c, 4, (50, 5)) for c in (0, 9, 30)])
    v = v.round() if whole else v
    label = np.repeat([3, 0, 7], 50)
    label[:3], label[60] = -1, 12
    used = np.flatnonzero(label >= 0)
    d = np.abs(v[used, None] - v[None, used]).sum(2)
    scores = []
    for i, own in enumerate(label[used]):
        means = {c: d[i, label[used] == c].sum() / max((label[used] == c).sum() - (c == own), 1) for c in set(label[used])}
        b = min(m for c, m in means.items() if c != own)
        scores.append(0 if (label[used] == own).sum() == 1 else (b - means[own]) / max(b, means[own]))
    rows = spark.createDataFrame([(i, [float(c) for c in x], int(k)) for i, (x, k) in enumerate(zip(v, label, strict=True))], "win long, vec array<double>, label int")
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = metrics.silhouette(rows, most=None).first()["silhouette"]
        alone = metrics.silhouette(rows.where("label = 3"), most=None).first()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert found == pytest.approx(np.mean(scores), abs=5.1e-5)
    assert alone["silhouette"] is None and alone["quality"] is None


def test_two_level_blocks_have_a_task_each(spark, monkeypatch):
    """Small blocks aren't put together in a task, and each gives the exemplars of its own matrix."""
    seen, write = {}, methods.materialised

    def noted(df, name, **options):
        seen[name] = df
        return write(df, name, **options)

    monkeypatch.setattr(methods, "materialised", noted)
    v = blobs()
    rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "win long, vec array<double>")
    labels = methods.cluster(rows, "ap_twolevel", blocks=3, unit=1.0).labels
    assert labels.count() == len(v)
    tasks = seen["candidates"].select("win", F.spark_partition_id().alias("task")).collect()
    exemplars = {r["win"] for r in tasks}
    assert len({r["task"] for r in tasks}) == 3
    expected = set()
    for a in range(0, len(v), 25):  # k-means finds the blobs
        x = v[a : a + 25]
        expected |= {a + int(k) for k in affinity.cluster_matrix(distance.cityblock(x, x), "median", max_iter=300)[1]}
    assert exemplars == expected


def test_ranking_of_neighbours_has_tasks_by_candidates(spark, monkeypatch):
    """Candidates of few bytes aren't ranked in few tasks, and neighbours stay the same."""
    monkeypatch.setattr(distance, "RANKED", 20, raising=False)
    v = blobs()
    rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "win long, vec array<double>")
    found = distance.neighbours(rows, 4).withColumn("task", F.spark_partition_id()).collect()
    d = np.abs(v[:, None] - v[None]).sum(2)
    np.fill_diagonal(d, np.inf)
    assert {(r["i"], r["rank"], r["j"]) for r in found} == {(i, n + 1, int(j)) for i in range(len(v)) for n, j in enumerate(np.lexsort((np.arange(len(v)), d[i]))[:4])}
    assert len({r["task"] for r in found}) > 8


def test_matrix_skips_no_method_by_size(spark, monkeypatch):
    """Without a limit of the caller's the full method runs at any number of windows."""
    monkeypatch.setattr(pipeline.S, "AP_FULL_LIMIT", 5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(blobs())], "win long, vec array<double>")
    row, sampled = pipeline.matrix({"b": df}, ("ap_full", "ap_sampled"), options={"unit": 10, "sample_size": 30})
    assert row["status"] == "ok" and row["n_clusters"] > 0 and sampled["ari_vs_ap_full"] is not None
    assert pipeline.matrix({"b": df}, ("ap_full",), options={"unit": 10, "limit": 5})[0]["status"] == "skipped"


def test_told_messages_are_few_and_give_the_labels_of_the_matrix(monkeypatch):
    """Of more rows than a task holds no matrix lies in memory or in files: what is told one by one is a small part of it, and labels stay the same."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(c, 6, (200, 8)) for c in (0, 30, 70, 90)]).round()
    own = np.arange(len(x))
    s = affinity.Similarities(own, x, 10.0)
    whole = s[:]
    preferences = (whole.min(), float(np.median(whole)))
    want = [affinity.propagate(whole, own, p) for p in preferences]
    sizes, keep = [], affinity.Told._keep
    monkeypatch.setattr(affinity.Told, "_keep", lambda self, k, entries: (sizes.append(len(entries[0])), keep(self, k, entries))[1])
    monkeypatch.setattr(affinity, "SLAB", 1 << 16)
    slabs = len(affinity.slabs(len(x), len(x)))
    for held in (0, 30_000):
        for p, (labels, found) in zip(preferences, want, strict=True):
            sizes.clear()
            got = affinity.propagate(s, own, p, held=held)
            assert np.array_equal(got[0], labels) and np.array_equal(got[1], found)
            assert max(sum(sizes[k : k + slabs]) for k in range(0, len(sizes), slabs)) < 0.25 * len(x) ** 2


def test_nearest_of_a_block_sorts_few_distances(monkeypatch):
    """A bound from minima of classes of columns, ties and a rest of columns without a class included."""
    rng = np.random.default_rng(8)
    left, right = rng.integers(0, 4, (20, 3)).astype(float), rng.integers(0, 4, (1003, 3)).astype(float)
    lk, rk = np.arange(20), np.arange(1003) + 5
    d = np.abs(left[:, None] - right[None]).sum(2)
    sizes, partition = [], np.partition
    monkeypatch.setattr(np, "partition", lambda x, *a, **kw: (sizes.append(x.shape[1]), partition(x, *a, **kw))[1])
    for k in (1, 7, 62):
        i, j, near = distance._least(lk, left, rk, right, k)
        want = [(n, int(m) + 5, d[n, m]) for n in range(20) for m in np.lexsort((rk, d[n]))[:k]]
        assert list(zip(i.tolist(), j.tolist(), near.tolist(), strict=True)) == want
    assert max(sizes) < 1003 / 10


def test_blocks_of_vectors_hold_the_messages_alone(monkeypatch):
    """A block's clusters are those of its matrix of distances, with three matrices at once instead of five."""
    monkeypatch.setattr(affinity, "SLAB", 1 << 15)
    rng = np.random.default_rng(9)
    x = rng.integers(0, 60, (700, 6)).astype(float)
    want = affinity.cluster_matrix(distance.cityblock(x, x) / 10, "median", max_iter=3)
    tracemalloc.start()
    got = affinity.cluster_vectors(x, 10, "median", max_iter=3)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    assert most < 4.6 * 8 * 700 * 700
