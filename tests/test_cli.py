"""The command line over a small repaired log."""

from __future__ import annotations

import pytest

from motionloom import catalog, schema as S
from motionloom.operators import clean
from motionloom.plans import cli, pipeline
from motionloom.sources import events, files


@pytest.fixture(scope="module")
def log(spark, data, tmp_path_factory) -> str:
    path = str(tmp_path_factory.mktemp("cli") / "log")
    files.write_cleaned(catalog._clean(spark, data), clean.others(events.packets(spark, data)), path)
    return path


def test_cluster_and_joint_write_result_tables(spark, log, tmp_path, capsys):
    assert cli.main(["cluster", log, f"{tmp_path}/a", "--method", "ap_sparse", "--neighbours", "8", "--graph", "union", "--search", "exact", "--seed", "3", "--arena", "2d_wired"]) == 0
    assert "n_clusters" in capsys.readouterr().out
    a = spark.read.option("header", True).csv(f"{tmp_path}/a")
    assert {"ClusterIdx", "Timestamp", "Folder_Name"} <= set(a.columns) and a.count() == 15
    assert cli.main(["joint", log, f"{tmp_path}/b", "--method", "sliced_w1", "--directions", "10"]) == 0
    b = spark.read.option("header", True).csv(f"{tmp_path}/b")
    assert set(b.columns) == {"Timestamp", "ClusterIdx", "Method"} and b.count() == 15


def test_matrix_full_seeds_and_bench(log, tmp_path, capsys):
    assert cli.main(["matrix", f"a={log}", "--store", f"{tmp_path}/s", "--methods", "ap_full", "hdbscan", "--min-cluster-size", "3"]) == 0
    first = capsys.readouterr().out
    assert "ap_full" in first and "hdbscan" in first and "ap_coreset" not in first
    assert cli.main(["matrix", f"a={log}", "--store", f"{tmp_path}/s", "--methods", "ap_full", "hdbscan", "--min-cluster-size", "3", "--force"]) == 0
    assert cli.main(["full", f"a={log}", "--store", f"{tmp_path}/f", "--limit", "5"]) == 0
    assert "skipped" in capsys.readouterr().out
    assert cli.main(["seeds", log, "--methods", "ap_sampled", "--seeds", "2", "--sample-size", "8"]) == 0
    assert capsys.readouterr().out.count("'seed'") == 2
    assert cli.main(["bench", log, "--method", "ap_full"]) == 0
    assert "peak_mb" in capsys.readouterr().out


def test_unknown_arguments_are_refused(log):
    with pytest.raises(SystemExit):
        cli.main(["cluster", log, "x", "--arena", "4d"])
    with pytest.raises(SystemExit):
        cli.main(["matrix", f"a={log}", "--store", "s", "--methods", "nothing"])


def test_benchmark_counts_memory(spark, data):
    x = pipeline.benchmark(catalog._vectors(spark, data), "ap_full", unit=S.UNIT)
    assert x["n_windows"] == 15 and x["t_s"] > 0 and x["peak_mb"] > 100
