"""Distances, samples, clusterings and scores against numpy."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from motionloom import catalog
from motionloom.operators import affinity, density, distance, metrics, sampling, transport
from motionloom.plans import grid as plan_grid
from motionloom.plans import methods, pipeline
from motionloom.sources import files


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(c, 4, (25, 6)) for c in (0, 60, 140)]).round().astype(int)
    return x, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "win long, vec array<int>").repartition(4).cache()


def l1(x, y=None):
    y = x if y is None else y
    return np.abs(x[:, None].astype(float) - y[None]).sum(-1)


def test_joins(spark, blobs, monkeypatch):
    x, df = blobs
    d = l1(x)
    monkeypatch.setattr(distance, "BLOCK", 16)
    assert {(r["i"], r["j"]): r["d"] for r in distance.pairs(df).collect()} == {(i, j): d[i, j] for i in range(75) for j in range(i + 1, 75)}
    assert distance.pairs(df, radius=20).count() == (np.triu(d <= 20, 1)).sum()
    near = {r["i"]: (r["j"], r["d"]) for r in distance.nearest(df, df.where("win % 10 = 0").selectExpr("win div 10 as pos", "vec")).collect()}
    assert near == {i: (int(d[i, ::10].argmin()), d[i, ::10].min()) for i in range(75)}
    knn = distance.neighbours(df, 4).collect()
    for i in range(75):
        order = sorted((d[i, j], j) for j in range(75) if j != i)[:4]
        assert [(r["d"], r["j"]) for r in sorted((r for r in knn if r["i"] == i), key=lambda r: r["rank"])] == order
    close = {(r["i"], r["j"]) for r in distance.neighbours_in_cells(df, 4, cells=9, probes=4).collect()}
    assert len(close & {(r["i"], r["j"]) for r in knn}) / len(knn) > 0.9
    assert distance.min_affinity(df, unit=10) == -((d.max() / 10) ** 2)
    assert distance.min_affinity(df, mode="sampled", n_pairs=500, unit=10) >= -((d.max() / 10) ** 2)
    with pytest.raises(ValueError):
        distance.min_affinity(df, mode="other")


def test_sixteen_bits_hold_the_sums_of_ranges():
    rng = np.random.default_rng(3)
    for width in (1023, 1024, 32767, 32768):  # sums of 64 ranges up to and above 2**16
        x = rng.integers(0, 2, (40, 64)) * float(width) - width // 2
        x[0], x[1] = x.min(), x.max()
        assert np.array_equal(distance.cityblock(x, x[:7]), l1(x, x[:7]))
    single = np.array([[-20000.0], [20000.0], [12767.0]])
    assert np.array_equal(distance.cityblock(single, single), l1(single))


@pytest.mark.parametrize("upper", [True, False])
def test_a_task_has_one_cell_of_the_grid(spark, blobs, monkeypatch, upper):
    monkeypatch.setattr(distance, "PAIRS", 64)
    from pyspark import TaskContext

    def kernel(lk, lv, rk, rv, same):
        return np.full(1, TaskContext.get().partitionId()), np.array([len(lk) * len(rk)]), np.ones(1)

    met = distance.block_join(blobs[1], blobs[1], kernel, ("task", "n", "d"), upper=upper).groupBy("task").agg(F.count("*").alias("n")).collect()
    assert len(met) >= 32 and {r["n"] for r in met} == {1}


def test_search_in_cells_finds_nine_of_ten_neighbours(spark, data):
    """The registered query by its own defaults, against all distances."""
    x = catalog._embeddings(spark, data).orderBy("win").toPandas()
    wins, d = x["win"].to_numpy(), l1(np.array(x["vec"].tolist()))
    np.fill_diagonal(d, np.inf)
    exact = {(wins[i], wins[j]) for i in range(len(d)) for j in np.lexsort((wins, d[i]))[:5]}
    found = catalog.QUERIES["k_nearest_in_cells"](spark, data).collect()
    assert len(found) == len(exact) == 5 * len(wins)
    assert len({(r["i"], r["j"]) for r in found} & exact) >= 0.9 * len(exact)


def test_search_in_cells_prunes_and_fills_up(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c * 100, 3, (n, 6)) for c, n in enumerate((2, 60, 60, 60, 60, 60))]).round().astype(int)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "win long, vec array<int>").cache()
    exact = {(r["i"], r["j"], r["d"], r["rank"]) for r in distance.neighbours(df, 4).collect()}
    short = distance.neighbours_in_cells(df, 4, cells=30, probes=1).groupBy("i").count().where("count <> 4")
    assert short.isEmpty()
    monkeypatch.setattr(distance, "neighbours", None)  # well apart, a few cells do
    found = {(r["i"], r["j"], r["d"], r["rank"]) for r in distance.neighbours_in_cells(df, 4).collect()}
    assert len(found) == len(exact) == 4 * len(x) and len(found & exact) >= 0.9 * len(exact)


def test_nearest_of_a_block_by_distance_and_key():
    rng = np.random.default_rng(4)
    a, b, keys = rng.integers(0, 3, (20, 3)), rng.integers(0, 3, (30, 3)), np.arange(30) * 2
    i, j, d = distance._least(np.arange(20), a, keys, b, 7)
    want = [sorted((v, k) for v, k in zip(row, keys, strict=True))[:7] for row in l1(a, b)]
    assert list(zip(d, j, strict=True)) == [x for row in want for x in row] and i.tolist() == np.repeat(np.arange(20), 7).tolist()


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6))
def test_assignment_is_optimal(seed, n):
    cost = np.random.default_rng(seed).integers(0, 20, (5, n, n)).astype(float)
    best = [min(sum(m[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n))) for m in cost]
    assert transport.assignment(cost).tolist() == best
    table = cost[0]
    assert sum(table[a, b] for a, b in metrics.match_clusters(table)) == -transport.assignment(-cost[:1])[0]


def test_transport_bounds():
    rng = np.random.default_rng(0)
    a, b = rng.standard_normal((2, 3, 60, 4))
    m = transport._ground(a, b)
    exact = transport.assignment(m) / 60
    for reg, near in ((0.5, 0.5), (0.05, 0.1), (0.01, 0.01)):
        cost, reached = transport.sinkhorn_cost(m, reg)
        assert reached.all() and (cost >= exact - 1e-6).all() and np.allclose(cost, exact, rtol=near)
    assert not transport.sinkhorn_cost(m, 0.01, most=20)[1].any()
    p = np.sort(a @ transport.directions().T, axis=1) - np.sort(b @ transport.directions().T, axis=1)
    assert (np.abs(p).mean(axis=(1, 2)) <= exact).all()
    assert transport.assignment(transport._ground(a, a)).max() == 0


def test_samples(spark, blobs):
    x, df = blobs
    d = l1(x)
    first = [r["win"] for r in sampling.uniform(df, 10).orderBy("win").collect()]
    assert first == [r["win"] for r in sampling.uniform(df.repartition(7), 10).orderBy("win").collect()]
    rows = [r["win"] for r in sampling.k_centres(df, 6).orderBy("pos").collect()]
    far = np.full(75, np.inf)
    for a, b in zip(rows, rows[1:], strict=False):
        far = np.minimum(far, d[a])
        assert b == int(far.argmax())
    halves = [r["half"] for r in sampling.split_half(df).collect()]
    assert (halves.count("A"), halves.count("B")) == (37, 38)
    assert sampling.k_means_representatives(df, 5).count() <= 5
    assert sampling.stratified(df, 20, 4).count() == 20


def test_affinity_propagation(spark, blobs, monkeypatch):
    x, df = blobs
    d = l1(x) / 10
    labels, found = affinity.cluster_matrix(d)
    assert len(found) == 3 and (np.sort(np.bincount(labels)) == 25).all() and (np.diff(found) > 0).all()
    assert all(labels[e] == k for k, e in enumerate(found))
    one = {r["win"]: (r["label"], r["exemplar"]) for r in affinity.dense(df, unit=10).collect()}
    assert one == {i: (int(labels[i]), int(found[labels[i]])) for i in range(75)}
    monkeypatch.setattr(affinity, "ONE_TASK", 1)
    assert {r["win"]: (r["label"], r["exemplar"]) for r in affinity.dense(df, unit=10).collect()} == one
    with pytest.raises(ValueError):
        affinity.dense(df, limit=10)
    same = np.zeros((5, 5))
    assert affinity.cluster_matrix(same, -1.0)[0].tolist() == [0] * 5
    assert affinity.cluster_matrix(same, 1.0)[0].tolist() == list(range(5))


def test_graphs(spark):
    edges = spark.createDataFrame([(0, 1, -4.0), (1, 0, -1.0), (1, 2, -2.0), (3, 4, 0.0), (4, 3, 0.0)], "i long, j long, s double")
    assert {tuple(r) for r in affinity.graph(edges).collect()} == {(0, 1, -1.0), (1, 0, -1.0)}
    assert len(affinity.graph(edges, "union").collect()) == 6
    with pytest.raises(ValueError):
        affinity.graph(edges, "other")


def test_sparse_exemplars_in_one_task_or_several(spark, blobs, monkeypatch):
    _, df = blobs
    edges = affinity.graph(distance.similarity(distance.neighbours(df, 20), 10).select("i", "j", "s"), "union").cache()
    one = sorted(r[0] for r in affinity.sparse_exemplars(edges, df, -300.0).collect())
    monkeypatch.setattr(affinity, "ONE_TASK_EDGES", 0)
    assert one and one == sorted(r[0] for r in affinity.sparse_exemplars(edges, df, -300.0).collect())


def test_methods(spark, blobs):
    x, df = blobs
    for name in methods.METHODS:
        out = methods.cluster(df, name, unit=10, sample_size=30, neighbours_k=20, strata=5, blocks=3, min_cluster_size=5, preference=None if name in ("ap_full", "hdbscan") else -300.0)
        found = np.array([r["label"] for r in out.labels.orderBy("win").collect()])
        assert len(found) == 75
        truth = np.repeat([0, 1, 2], 25)
        pure = sum(np.bincount(truth[found == c]).max() for c in set(found) - {-1})
        assert pure >= 0.9 * 75, name
    with pytest.raises(ValueError):
        methods.cluster(df, "none")


def prim(reach: np.ndarray) -> list[tuple[int, int, float]]:
    """Edges (a < b, weight) of the spanning tree with the least edges in the order of weight, a, b."""
    inside, out = {0}, []
    while len(inside) < len(reach):
        w, a, b = min((reach[i, j], min(i, j), max(i, j)) for i in inside for j in range(len(reach)) if j not in inside)
        inside |= {a, b}
        out.append((a, b, w))
    return sorted(out)


def as_rows(edges) -> list[tuple]:
    return sorted(zip(*(x.tolist() for x in edges), strict=True))


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(2, 18))
def test_forests_of_parts_make_up_the_tree(seed, n):
    rng = np.random.default_rng(seed)
    x, core = rng.integers(0, 5, (n, 2)).astype(float), rng.integers(0, 3, n).astype(float)
    reach = np.maximum(np.maximum(l1(x), core[:, None]), core)
    tree = prim(reach)
    assert as_rows(density.forest_of_matrix(reach.copy(), np.arange(n), np.arange(n), True)) == tree
    left = np.sort(rng.choice(n, rng.integers(0, n), replace=False))
    right = np.setdiff1d(np.arange(n), left)
    parts = [density.forest_of_matrix(reach[np.ix_(a, b)].copy(), a, b, a is b) for a, b in ((left, left), (right, right), (left, right)) if len(a) and len(b)]
    assert as_rows(density.forest_of_edges(*(np.concatenate(v) for v in zip(*parts, strict=True)))) == tree


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6))
def test_equal_matchings_have_an_order(seed):
    rng = np.random.default_rng(seed)
    table = rng.integers(0, rng.integers(2, 5), (rng.integers(1, 6), rng.integers(1, 6))).astype(float)

    def all_of(i: int, used: frozenset):
        if i == table.shape[0]:
            yield 0, []
            return
        yield from all_of(i + 1, used)
        for j in range(table.shape[1]):
            if j not in used and table[i, j]:
                yield from ((least - table[i, j], [(i, j), *rest]) for least, rest in all_of(i + 1, used | {j}))

    assert metrics.match_clusters(table) == min(all_of(0, frozenset()))[1]


def test_scores(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-1, 4, 300), rng.integers(0, 3, 300)
    b[a == 2] = 1
    both = spark.createDataFrame([(i, int(x), int(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "win long, a int, b int")
    keep = a >= 0
    same_a, same_b = (v[keep][:, None] == v[keep][None] for v in (a, b))
    upper = np.triu_indices(keep.sum(), 1)
    r = metrics.agreement(both).first()
    assert r["ri"] == round(float((same_a == same_b)[upper].mean()), 4)
    assert metrics.agreement(both.withColumn("b", both["a"])).first()["ari"] == 1.0
    renamed = both.withColumn("b", (both["a"] * 7 + 3).cast("int"))
    assert metrics.agreement(renamed).first()["nmi"] == 1.0
    assert metrics.agreement(both.where("a = 1")).first()["ari"] is None
    assert metrics.ami(both.withColumn("b", both["a"])) == pytest.approx(1)
    noise = np.mean([metrics.adjusted_mutual_information(np.histogram2d(rng.integers(0, 5, 200), rng.integers(0, 5, 200), bins=5)[0]) for _ in range(30)])
    assert abs(noise) < 0.02
    stats = metrics.cluster_stats(both.selectExpr("win", "a as label")).first()
    assert stats["n_clusters"] == 4 and stats["n_noise"] == (a < 0).sum()


def test_transitions_and_runs(spark):
    rows = [(0, 0, "s"), (1, 0, "s"), (2, 1, "s"), (3, -1, "s"), (4, 1, "s"), (5, 1, "t"), (6, 0, "t")]
    df = spark.createDataFrame(rows, "win long, label int, folder string")
    assert {(r["a"], r["b"], r["n"], r["p"]) for r in metrics.transitions(df).collect()} == {(0, 0, 1, 0.5), (0, 1, 1, 0.5), (1, 0, 1, 1.0)}
    r = metrics.run_lengths(df).first()
    assert (r["k"], r["n_windows"], r["max_run"], r["median_run"], r["pct_single"]) == (3, 7, 2, 1.0, 60.0)
    xy = spark.createDataFrame([(i, float(i), float(i * i)) for i in range(6)], "place long, x double, y double")
    r = metrics.bootstrap_correlation(xy, 60).first()
    assert r["ci_lo"] <= r["r"] <= 1 and metrics.bootstrap_correlation(xy.limit(2)).first()["r"] is None


def test_published_run_statistics(spark):
    """Cluster sizes of the published labelling of 1,195 windows, by its table of sizes."""
    sizes = [198, 176, 173, 170, 108, 106, 103, 84, 77]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(np.repeat(range(9), sizes).tolist())], "win long, label int")
    r = metrics.cluster_stats(df).first()
    assert (r["n_clusters"], r["size_min"], r["size_max"], round(r["size_mean"], 1)) == (9, 77, 198, 132.8)


def test_matrix_store_and_report(spark, blobs, tmp_path):
    _, df = blobs
    store = pipeline.Store(spark, str(tmp_path / "store"))
    options = {"unit": 10, "sample_size": 30, "min_cluster_size": 5}
    first = pipeline.matrix({"b": df}, ("ap_full", "hdbscan"), store=store, options=options)
    again = pipeline.matrix({"b": df}, ("ap_full", "hdbscan"), store=store, options=options)
    assert first == again and first[1]["ari_vs_ap_full"] is not None
    assert pipeline.matrix({"b": df}, ("ap_full",), options={"limit": 5})[0]["status"] == "skipped"
    assert pipeline.matrix({"b": df}, ("none",))[0]["status"] == "error"
    text = files.report(first)
    assert "ap_full" in text and "not_run" in text


def test_stability(spark, blobs):
    _, df = blobs
    assert pipeline.split_half(df, splits=2, unit=10)["ami_mean"] > 0.9
    sweep = pipeline.preference_sweep(df, steps=3, splits=1, unit=10)
    assert len(sweep) == 3 and sum(r["best"] for r in sweep) == 1
    joint = spark.createDataFrame([(i, [[float(i // 4) * 5 + 0.01 * i] * 4] * 6) for i in range(8)], "win long, pts array<array<float>>")
    found = {r["win"]: r["label"] for r in pipeline.cluster_joint(joint, "exact_emd").collect()}
    assert not {found[i] for i in range(4)} & {found[i] for i in range(4, 8)}


def test_stability_takes_all_rows(spark, blobs, monkeypatch):
    """Of few rows a task a split, of more by block rows: the same; of too many: refused, not sampled."""
    _, df = blobs
    with pytest.raises(ValueError):
        pipeline.split_half(df, splits=1, unit=10, limit=37)
    with pytest.raises(ValueError):
        pipeline.preference_sweep(df, steps=2, splits=1, unit=10, limit=74)
    one = pipeline.preference_sweep(df, steps=2, splits=1, unit=10, limit=75), pipeline.split_half(df, splits=1, unit=10, limit=38)
    monkeypatch.setattr(affinity, "ONE_TASK", 1)
    monkeypatch.setattr(distance, "BLOCK", 16)
    monkeypatch.setattr(pipeline.grid, "split_scores", None)
    spread = pipeline.preference_sweep(df, steps=2, splits=1, unit=10, limit=75), pipeline.split_half(df, splits=1, unit=10, limit=38)
    assert [r["K"] for r in spread[0]] == [r["K"] for r in one[0]] and [r["best"] for r in spread[0]] == [r["best"] for r in one[0]]
    for a, b in zip((*spread[0], spread[1]), (*one[0], one[1]), strict=True):
        assert list(a.values()) == pytest.approx(list(b.values()))


def test_blocks_are_bounded_neighbourhoods(spark):
    """Large clusters are halved until they fit; a cut lies between far rows, and copies are dealt out."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(k * 100, 1, (60, 3)) for k in range(4)] + [np.full((100, 3), 7.0)])
    cluster = np.array([0] * 240 + [1] * 100)
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x, cluster, strict=True))], "win long, vec array<double>, cluster int")
    found = {r["win"]: r["block"] for r in sampling.bounded_blocks(df, 60).collect()}
    sizes = np.unique(list(found.values()), return_counts=True)[1]
    assert len(found) == 340 and sizes.max() <= 60
    assert all(len({found[60 * k + i] for i in range(60)}) == 1 for k in range(4)) and not {found[i] for i in range(240)} & {found[i] for i in range(240, 340)}
    assert sampling.bounded_blocks(df.where("win < 5"), 60).select("block").distinct().count() == 1


def test_runs_of_a_grid_are_those_of_single_calls(spark, blobs):
    """Every method and seed: the same clusters and scores as clustering by itself."""
    _, df = blobs
    full = methods.cluster(df, "ap_full", unit=10).labels
    names = ("ap_sampled", "ap_coreset", "ap_kmeans", "ap_stratified")
    for options, seeds in (({"sample_size": 30, "strata": 5, "preference": -300.0}, (1, 2)), ({"sample_size": 100}, (1,))):
        found = pipeline.seed_variance(df, "x", full, names, seeds, unit=10, **options)
        assert [(r["method"], r["seed"]) for r in found] == [(m, s) for m in names for s in seeds]
        for r in found:
            alone = methods.cluster(df, r["method"], seed=r["seed"], unit=10, **options).labels
            both = alone.select("win", F.col("label").alias("a")).join(full.select("win", F.col("label").alias("b")), "win")
            assert r["K"] == alone.select("label").distinct().count() and r["ari_vs_ap_full"] == metrics.agreement(both).first()["ari"], r


def test_runs_without_exemplars(spark):
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(6)], "win long, vec array<double>")
    near = plan_grid.nearest_runs(rows, spark.createDataFrame([(0, 0, [1.0]), (0, 1, [4.0]), (2, 5, [9.0])], "run long, pos long, vec array<double>"))
    assert sorted(map(tuple, near.collect())) == sorted([(0, i, int(i > 2)) for i in range(6)] + [(2, i, 5) for i in range(6)])


def test_affinity_over_given_distances(spark, blobs, monkeypatch):
    """One task, or block rows of several: the clusters of the matrix, for each kind of preference."""
    x, df = blobs
    pairs = distance.pairs(df).withColumn("d", F.col("d") / 10)
    for preference in (None, "median", -300.0):
        labels, found = affinity.cluster_matrix(l1(x) / 10, preference)
        want = {i: (int(k), int(found[k])) for i, k in enumerate(labels)}
        for most in (2500, 1):
            monkeypatch.setattr(affinity, "ONE_TASK", most)
            assert {r["win"]: (r["label"], r["exemplar"]) for r in affinity.of_distances(pairs, df, preference).collect()} == want
    one = spark.createDataFrame([(7, [0.0])], "win long, vec array<double>")
    assert affinity.of_distances(distance.pairs(one), one).collect()[0]["label"] == 0
    with pytest.raises(ValueError):
        affinity.of_distances(pairs, df, limit=74)


def test_figure_table_of_a_whole_table(spark, data):
    """Several rows meet in a cell: the largest counts, in whatever order they come."""
    x = catalog._embeddings(spark, data).selectExpr("win", "'d' || (win % 50) AS dataset", "'m' || (win % 3) AS method", "label")
    rows = x.toPandas()
    assert len(rows) > 300
    want = {(d, m): v for (d, m), v in rows.groupby(["dataset", "method"])["label"].max().items()}
    for order in ("win", "-win"):
        found = metrics.figure_table(x.orderBy(F.expr(order)).coalesce(1), "label", ["m0", "m1", "m2"]).collect()
        assert {(r["dataset"], m): r[m] for r in found for m in ("m0", "m1", "m2")} == want


def test_trees_from_blocks_are_the_same(spark, monkeypatch):
    """Whole-number vectors with many ties: blocks and tasks of any size give the tree of the whole matrix and its labelling."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.integers(0, 6, (60, 3)), rng.integers(20, 26, (50, 3)), rng.integers(0, 40, (15, 3))]).astype(float)
    df = spark.createDataFrame([(3 * i + 1, v.tolist()) for i, v in enumerate(x)], "win long, vec array<double>").repartition(4)
    core = np.sort(l1(x), axis=1)[:, 1]
    tree = prim(np.maximum(np.maximum(l1(x), core[:, None]), core))
    a, b, w = (np.array(v) for v in zip(*tree, strict=True))
    labels = density.stable_clusters(len(x), a, b, w, 10)
    assert len(set(labels.tolist()) - {-1}) == 2
    for block, edges in ((density.BLOCK, density.EDGES), (7, 50)):
        monkeypatch.setattr(density, "BLOCK", block)
        monkeypatch.setattr(density, "EDGES", edges)
        assert {r["win"]: r["label"] for r in density.hdbscan(df, 10).collect()} == {3 * i + 1: int(k) for i, k in enumerate(labels)}


def test_estimates_grow_with_pairs(spark):
    joint = spark.createDataFrame([(i, [[float(i % 7)] * 4] * 6) for i in range(40)], "win long, pts array<array<float>>")
    for name in ("sliced_w1", "exact_emd", "sinkhorn"):
        few, many = (transport.estimate_seconds(joint, name, n_splits=k, n_probe=20) for k in (1, 1000))
        assert 0 < few < many


def test_density_of_few_rows(spark):
    for n in (0, 1, 2):
        rows = density.hdbscan(spark.createDataFrame([(i, [float(i)]) for i in range(n)], "win long, vec array<double>"), 5).collect()
        assert sorted(map(tuple, rows)) == [(i, -1) for i in range(n)]


def test_density_of_many_rows(spark):
    """100,000 rows in three far groups and some noise, without a matrix of all pairs."""
    rng = np.random.default_rng(0)
    at, noise = rng.integers(0, 3, 100_000), rng.random(100_000) < 0.01
    x = np.where(noise[:, None], rng.integers(-20_000, 40_000, (100_000, 2)), rng.integers(0, 1500, (100_000, 2)) + at[:, None] * 9000)
    df = spark.createDataFrame(pa.table({"win": np.arange(100_000), "vec": pa.array(list(x.astype(np.int32)))}))
    found = np.array([r["label"] for r in density.hdbscan(df, 400).orderBy("win").collect()])
    groups = [found[(at == k) & ~noise] for k in range(3)]
    assert len(set(found.tolist()) - {-1}) == 3 and all((g == np.bincount(g + 1).argmax() - 1).mean() > 0.99 for g in groups)


def test_affinity_in_lots_is_the_same(monkeypatch):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, (120, 4)).astype(float)
    d = distance.cityblock(x, x)
    whole = affinity.cluster_matrix(d)
    monkeypatch.setattr(affinity, "LOT", 500)
    small = affinity.cluster_matrix(d)
    assert all(np.array_equal(a, b) for a, b in zip(whole, small, strict=True))
