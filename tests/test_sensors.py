"""Repair, signals and windows against small hand-made cases and numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionloom import schema as S
from motionloom.functions.expressions import digitise, highpass
from motionloom.operators import clean, sequence, signal, windows
from motionloom.plans import methods, pipeline
from motionloom.session import materialised
from motionloom.sources import files, matlab

NAMES = [f.name for f in S.PACKETS]


def packets(spark, rows):
    """rows of (register, ts, counter, value); value None means no sensor values."""
    out = [(i, 1.0, float(r), t, *([v] * 9), c, "s") for i, (r, t, c, v) in enumerate(rows)]
    return spark.createDataFrame(out, S.PACKETS)


def test_ragged_lines(spark):
    lines = ["head", "1,34,0.5,1,2", "", "3,x,1.5," + ",".join(map(str, range(14))), " 3 ,33, 2.5 "]
    found = files.ragged(spark.createDataFrame(list(enumerate(lines)), "_at long, value string")).orderBy("seq").collect()
    assert len(found) == 4 and found[0].asDict()["DataElement1"] == 2.0 and found[0]["DataElement2"] is None
    assert all(v is None for k, v in found[1].asDict().items() if k != "seq")
    assert found[2]["RegisterAddress"] is None and found[2]["DataElement13"] == 13.0
    assert (found[3]["Command"], found[3]["Timestamp"]) == (3.0, 2.5)


def test_gaps_are_filled(spark):
    rows = [(34, 1.0, 126.0, 1.0), (33, 1.01, 0.0, 9.0), (34, 1.02, 1.0, 2.0), (34, 1.03, 1.0, 3.0), (34, 1.04, 3.0, 4.0), (34, 1.05, None, 5.0), (34, 1.06, 9.0, 6.0)]
    found = clean.fill_missing(packets(spark, rows)).orderBy("pos").collect()
    assert [r["counter"] for r in found] == [126, 127, 0, 1, 1, 2, 3, None, 9]
    assert [r["inserted"] for r in found] == [False, True, True, False, False, True, False, False, False]
    assert [r["ts"] for r in found[:4]] == [1.0, 1.0067, 1.0133, 1.02]
    assert found[1]["command"] == 3 and found[1]["ax"] is None and found[1]["folder"] is None
    assert clean.fill_missing(packets(spark, [])).count() == 0


def test_published_gap(spark):
    rows = [(34, t, c, 1.0) for t, c in ((339.473, 27.0), (339.478, 28.0), (339.483, 30.0), (339.488, 31.0))]
    found = clean.fill_missing(packets(spark, rows)).orderBy("pos").collect()
    assert [(r["ts"], r["counter"]) for r in found][2] == (339.4805, 29.0)


@pytest.mark.parametrize(("bad", "kept"), [(6, 60), (7, 0)])
def test_lossy_windows_are_dropped(spark, bad, kept):
    rows = [(34, i * 0.005, float(i % 128), None if i < bad else 1.0) for i in range(119)]
    assert clean.drop_lossy(clean.fill_missing(packets(spark, rows))).count() == kept


def test_interpolation(spark):
    values = [None, 1.0, None, None, 2.0, 5.0, None, 6.0, None] + [7.0] * 51
    rows = [(34, i * 0.005, float(i), v) for i, v in enumerate(values)]
    got = [r["ax"] for r in clean.interpolate(clean.fill_missing(packets(spark, rows))).orderBy("pos").collect()]
    assert got[:9] == [None, 1, 1, 2, 2, 5, 6, 6, 6]  # 5.5 and 6.5 round to even


def test_neighbours_across_blocks(spark):
    df = spark.range(50).select(F.col("id").alias("pos"), (F.col("id") * 7 % 11).alias("v"))
    found = sequence.neighbour_columns(df, "pos", 2, 2, lambda w: {"s": F.sum("v").over(w.rowsBetween(-2, 2))}, block=8).orderBy("pos").collect()
    v = [i * 7 % 11 for i in range(50)]
    assert [r["s"] for r in found] == [sum(v[max(0, i - 2) : i + 3]) for i in range(50)]
    sparse = spark.createDataFrame([(i, i if i in (9, 30) else None) for i in range(40)], "pos long, v long")
    found = sequence.around(sparse, "pos", ["v"], block=4).orderBy("pos").collect()
    assert [r["_prev_v"] and r["_prev_v"]["v"] for r in found] == [None] * 9 + [9] * 21 + [30] * 10
    assert [r["_next_v"] and r["_next_v"]["v"] for r in found] == [9] * 10 + [30] * 21 + [None] * 9
    ranks = sequence.ranked(spark.createDataFrame([(x * 10,) for x in range(30)], "k long"), "k", "r", block=64).orderBy("k").collect()
    assert [r["r"] for r in ranks] == list(range(30))


def test_lots_of_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(sequence, "TASK_BLOCKS", 4)
    for n in (1000, 10_000):
        found = sequence.around(spark.range(n).select(F.col("id").alias("pos"), F.when(F.col("id") % 7 == 3, F.col("id")).alias("v")), "pos", ["v"], block=8)
        table = materialised(found, "around", lots=True)
        sizes = [r["n"] for r in table.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == n and max(sizes) <= 4 * 4 * 8  # no more rows in a task for a longer recording
        assert table.where("pos >= 3 AND _prev_v.v <> pos - (pos - 3) % 7").isEmpty()


def test_ends_of_blocks_sort_no_rows(spark):
    """Numbers travel as such, and their blocks' ends come from hash aggregates; names are found as well."""
    rows = [(i, float(i) if i % 11 == 4 else None, i if i in (9, 30) else None, f"s{i}" if i in (12, 13) else None) for i in range(40)]
    df = spark.createDataFrame(rows, "pos long, v double, w int, s string")
    found = sequence.around(df, "pos", ["v", "w", "s"], block=4).orderBy("pos").collect()
    for k in range(1, 4):
        name = df.columns[k]
        known = [(r[0], r[k]) for r in rows if r[k] is not None]
        for r in found:
            assert (tuple(r[f"_prev_{name}"]) if r[f"_prev_{name}"] else None) == max((x for x in known if x[0] <= r["pos"]), default=None)
            assert (tuple(r[f"_next_{name}"]) if r[f"_next_{name}"] else None) == min((x for x in known if x[0] >= r["pos"]), default=None)
    plan = sequence.around(df, "pos", ["v", "w"], block=4)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_clean_writes_no_more_files_together(spark, monkeypatch):
    """What is filled and kept stays in the tasks that made it, however few cores there are."""
    seen = {}
    plain = clean.materialised
    monkeypatch.setattr(clean, "materialised", lambda df, name, **kinds: (seen.update({name: kinds.get("lots")}), plain(df, name, **kinds))[1])
    rows = [(34, i * 0.005, float(i % 128), 1.0) for i in range(120) if i % 60 != 7]
    found = clean.clean(packets(spark, rows))[0]
    assert found.count() == 120 and found.where("folder IS NULL OR ax IS NULL").isEmpty()
    assert seen == {"filled": True, "kept": True, "clean": True}


def sequential(x):
    b0, pole = highpass()
    e = np.concatenate([2 * x[0] - x[6:0:-1], x, 2 * x[-1] - x[-2:-8:-1]])
    for _ in range(2):
        y = np.zeros(len(e))
        for i in range(1, len(e)):
            y[i] = pole * y[i - 1] + b0 * (e[i] - e[i - 1])
        e = y[::-1]
    return e[6:-6]


@pytest.mark.parametrize("n", [7, 60, 5000])
def test_filter_equals_the_sequential_one(spark, n):
    rng = np.random.default_rng(n)
    x = rng.standard_normal((n, 3)).cumsum(axis=0)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "pos long, x double, y double, z double")
    found = signal.zero_phase(df).orderBy("pos").collect()
    for k, name in enumerate(("x_ba", "y_ba", "z_ba")):
        assert np.allclose([r[name] for r in found], sequential(x[:, k]), atol=1e-12)


def test_filter_edge_cases(spark):
    flat = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(20)], "pos long, x double, y double, z double")
    assert {r["x_ba"] for r in signal.zero_phase(flat).collect()} == {0.0}
    with pytest.raises(ValueError):
        signal.zero_phase(flat.where("pos < 6"))


def test_median_frames(spark):
    v = [5.0, 1.0, None, 100.0, 2.0, 3.0, 9.0, 4.0]
    df = spark.createDataFrame(list(enumerate(v)), "pos long, x double")
    found = [r["x"] for r in signal.median_filtered(df, ("x",)).orderBy("pos").collect()]
    assert found == [float(np.median([y for y in v[max(0, i - 3) : i + 4] if y is not None])) for i in range(len(v))]


def test_bins(spark):
    values = [-2.0, -1.0, -0.7778, 0.0, 1.0, 5.0, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r[0] for r in df.orderBy("i").select(digitise(F.col("v"), S.EDGES["y_ga"])).collect()]
    assert found == [0, 1, 2, 5, 10, 10, 10, 0, 10, 10]


def test_window_features(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i * 0.005, "s", *map(float, rng.standard_normal(3)), float(abs(rng.standard_normal()))) for i in range(190)]
    sig = spark.createDataFrame(rows, "pos long, ts double, folder string, y_ga double, z double, z_gyro double, tot_accel double")
    hist = windows.histograms(sig)
    found = {r["win"]: r for r in hist.collect()}
    assert set(found) == {0, 1, 2}
    for r in found.values():
        for k, n in S.BINS.items():
            assert sum(r[f"{k}_{b}"] for b in range(n)) == 60
    a, b = ({r["win"]: np.array(r["cdf"], float) for r in f(hist).collect()} for f in (windows.cumulative, windows.cdf_features))
    for i in range(3):
        assert (np.diff(b[i][:11]) >= 0).all()
        assert np.abs(a[0] - a[i]).sum() / S.UNIT == pytest.approx(np.abs(b[0] - b[i]).sum())
    q = windows.quantiles(sig).where("win = 0").first()["q"]
    assert len(q) == 240 and q[:60] == sorted(q[:60])
    assert len(windows.joint(sig).first()["pts"]) == 60
    rep = windows.representatives(sig).where("win = 1").first()
    assert (rep["ts_start"], rep["ts_mid"]) == (pytest.approx(0.3), pytest.approx(0.45))


def test_clean_statistics_and_files(spark, tmp_path):
    rows = [(34, i * 0.005, float((i + (i > 70)) % 128), float(i)) for i in range(200)] + [(33, 0.1, 0.0, 1.0)]
    p = packets(spark, rows)
    out, stats = clean.clean(p, "walk")
    assert stats.first().asDict() == {"n_raw_motion": 200, "n_inserted": 1, "loss_pct": 0.5, "n_discarded_wins": 0, "n_final_windows": 3}
    files.write_cleaned(out, clean.others(p), str(tmp_path / "c"))
    back = files.read_cleaned(spark, str(tmp_path / "c"))
    assert back.count() == 181 and {r[0] for r in clean.motion(back).select("folder").distinct().collect()} == {"walk"}
    labels = spark.createDataFrame([(0, 2), (1, -1), (2, 0)], "win long, label int")
    table = files.result_table(labels, windows.representatives(out))
    files.write_csv(table.drop("win"), str(tmp_path / "l"), ("Timestamp",))
    assert [r["label"] for r in files.read_labels(spark, str(tmp_path / "l")).orderBy("Timestamp").collect()] == [2, -1, 0]
    assert [r["label"] for r in files.read_labels(spark, str(tmp_path / "l"), shift=False).orderBy("Timestamp").collect()] == [3, 0, 1]
    assert files.prior_timings(spark, str(tmp_path / "none")) == {}


def test_spans_agree_with_the_whole_recording(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.standard_normal((20_000, 4)), axis=0)
    x[rng.integers(0, 20_000, 50), 0] = np.nan
    rows = spark.createDataFrame([(i, 0.0, "a", *v) for i, v in enumerate(x.tolist())], "pos long, ts double, folder string, ax double, ay double, az double, gz double")
    rows = rows.withColumn("ax", F.when(~F.isnan("ax"), F.col("ax")))
    whole = signal.signals(rows).orderBy("pos").toPandas()
    monkeypatch.setattr(signal, "SPAN", 3000)
    spans = signal.signals(rows).orderBy("pos").toPandas()
    assert len(whole) == 20_000 and (whole["pos"] == spans["pos"]).all()
    for k in ("y_ga", "z", "z_gyro", "tot_accel"):
        assert np.allclose(whole[k].astype(float), spans[k].astype(float), rtol=0, atol=1e-9, equal_nan=True)


def test_log_files_keep_their_order(spark, tmp_path, monkeypatch):
    """Several files, split by Spark within lines' bounds, each with a header; lines count on from file to file."""
    want = []
    for k, lines in enumerate((700, 1, 0, 300)):
        rows = [f"{k},34,{i / 10},{i},{'x' if i % 3 else ''}" for i in range(lines)] if lines != 1 else [""]
        (tmp_path / f"log-{k}.csv").write_text("\n".join(["Command,RegisterAddress,Timestamp", *rows]) + "\n")
        want += [(None, None) if not r else (float(k), float(r.split(",")[3])) for r in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        found = files.ragged_csv(spark, str(tmp_path)).orderBy("seq").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["seq"] for r in found] == list(range(len(want)))
    assert [(r["Command"], r["DataElement0"]) for r in found] == want


@pytest.mark.parametrize("compress", [True, False])
def test_matlab_labels(spark, tmp_path, compress):
    values = [3, 1, 0, 255, 2, 2, 1]
    path = tmp_path / "labels.mat"
    path.write_bytes(matlab.encoded(np.array(values), compress=compress))
    assert [tuple(r) for r in matlab.labels(spark, str(path)).orderBy("win").collect()] == list(enumerate(values))
    with pytest.raises(KeyError, match="Clusters"):
        matlab.decoded(path.read_bytes(), "Other")
    with pytest.raises(Exception, match="'none' is not among the fields"):
        matlab.labels(spark, str(path), field="none").collect()
    assert matlab.decoded(matlab.encoded(np.array([70_000, 5]))).tolist() == [70_000, 5] and not len(matlab.decoded(matlab.encoded(np.array([], int))))


def test_a_writer_that_dies_leaves_the_store_as_it_was(spark, tmp_path, monkeypatch):
    store = pipeline.Store(spark, str(tmp_path))
    labels = lambda k: spark.createDataFrame([(i, k) for i in range(4)], "win long, label int")
    assert store.get("d", "m", {}, 4) is None
    store.put("d", "m", {}, methods.Clustering(labels(1), None, -2.5, 1.0))

    def dies(place, note):
        raise OSError("gone")

    monkeypatch.setattr(store, "_note", dies)
    with pytest.raises(OSError):
        store.put("d", "m", {}, methods.Clustering(labels(2), None, None, 1.0))
    monkeypatch.undo()
    found = store.get("d", "m", {}, 4)
    assert {r["label"] for r in found.labels.collect()} == {1} and found.preference == -2.5
    store.put("d", "m", {}, methods.Clustering(labels(3), None, None, 2.0))
    found = store.get("d", "m", {}, 4)
    assert {r["label"] for r in found.labels.collect()} == {3} and found.preference is None and found.seconds == 2.0
    assert store.get("d", "m", {}, 5) is None and store.get("d", "m", {"k": 1}, 4) is None
