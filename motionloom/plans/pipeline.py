"""From packets to labels and scores: features of a recording, the method matrix, stability tests, a result store."""

from __future__ import annotations

import hashlib
import json
import os
import time
import traceback
import uuid
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import affinity, clean, metrics, sampling, signal, windows
from ..operators.distance import cross, min_affinity, nearest
from ..operators.sequence import ranked
from ..operators.transport import DIRECTIONS, joint_distances
from ..session import materialised
from . import grid
from .methods import Clustering, cluster


@dataclass
class Recording:
    """The tables of one recording: signals, windows' vectors (win, vec), representatives and repair statistics."""

    signals: DataFrame
    vectors: DataFrame
    representatives: DataFrame
    stats: DataFrame


def prepare(packets: DataFrame, label: str | None = None, feature: str = "histogram") -> Recording:
    """Repair, filter and cut a packet log; feature: histogram (cumulative counts in 1/600) or empirical (sorted samples)."""
    rows, stats = clean.clean(packets, label)
    signals = materialised(signal.signals(rows), "signals")
    if feature == "histogram":
        vectors = windows.cumulative(windows.histograms(signals)).withColumnRenamed("cdf", "vec")
    elif feature == "empirical":
        vectors = windows.quantiles(signals).withColumnRenamed("q", "vec")
    else:
        raise ValueError(f"unknown feature {feature!r}")
    return Recording(signals, materialised(vectors, "vectors"), windows.representatives(signals), stats)


class Store:
    """Results by data set, method and options, as tables under one folder.

    A result's labels go to a folder of their own; a note that names it is added last, and the latest note counts. So labels and note appear together,
    a writer that dies before its note leaves the result before as it was, and two writers don't mix.
    """

    NOTE = "labels string, preference double, seconds double, at double"

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, dataset: str, method: str, options: dict) -> str:
        key = json.dumps(options, sort_keys=True, default=str)
        return f"{self.path}/{dataset}/{method}/{hashlib.sha256(key.encode()).hexdigest()[:16]}"

    def get(self, dataset: str, method: str, options: dict, n: int) -> Clustering | None:
        """A stored result with as many rows as there are windows; its preference and seconds come with it."""
        place = self._place(dataset, method, options)
        try:
            note = self.spark.read.schema(self.NOTE).json(place + "/notes").orderBy(F.desc("at"), "labels").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        if note is None:
            return None
        labels = self.spark.read.parquet(f"{place}/{note['labels']}")
        return Clustering(labels, None, note["preference"], note["seconds"], options) if labels.count() == n else None

    def put(self, dataset: str, method: str, options: dict, result: Clustering) -> None:
        place, name = self._place(dataset, method, options), f"labels-{uuid.uuid4().hex}"
        result.labels.write.parquet(f"{place}/{name}")
        self._note(place, (name, result.preference, float(result.seconds), time.time()))

    def _note(self, place: str, note: tuple) -> None:
        self.spark.createDataFrame([note], self.NOTE).coalesce(1).write.mode("append").json(place + "/notes")


def matrix(recordings: dict[str, DataFrame], methods=S.METHODS, *, store: Store | None = None, force: bool | set[str] = False, options: dict | None = None) -> list[dict]:
    """One row per data set (win, vec) and method: status, sizes, silhouette, seconds, agreement with ap_full.

    force: False uses stored results, True runs all again, a set of methods those. The exact preference of ap_full is stored
    and handed to ap_sampled. Methods run at any number of windows; only if a limit is given, ap_full is skipped above it. Errors become rows.
    """
    out, options = [], options or {}
    for dataset, rows in recordings.items():
        n, found, reference = rows.count(), {}, None
        for method in methods:
            row = {"dataset": dataset, "method": method, "status": "ok", "n_windows": n}
            out.append(row)
            if method == "ap_full" and options.get("limit") is not None and n > options["limit"]:
                row["status"] = "skipped"
                continue
            own = dict(options)
            if method == "ap_sampled" and reference is not None and reference.preference is not None:
                own.setdefault("preference", reference.preference)
            try:
                again = force is True or isinstance(force, set) and method in force
                result = store.get(dataset, method, own, n) if store and not again else None
                if result is None:
                    result = cluster(rows, method, **own)
                    if store:
                        store.put(dataset, method, own, result)
                row |= score(rows, result)
                found[method] = result.labels
                reference = result if method == "ap_full" else reference
            except MemoryError:
                row["status"] = "oom"
            except Exception as e:  # a failed cell must not end the matrix; its trace is kept
                row |= {"status": "error", "message": str(e)[:200], "trace": traceback.format_exc()}
        if "ap_full" in found:
            ref = found["ap_full"].select("win", F.col("label").alias("b"))
            for row in out:
                if row["dataset"] == dataset and row["status"] == "ok" and row["method"] != "ap_full":
                    x = metrics.agreement(found[row["method"]].select("win", F.col("label").alias("a")).join(ref, "win")).first()
                    row |= {"ri_vs_ap_full": x["ri"], "ari_vs_ap_full": x["ari"]}
    return out


def score(rows: DataFrame, result: Clustering) -> dict:
    """Sizes, noise and silhouette of a result."""
    x = metrics.cluster_stats(result.labels).first()
    s = metrics.silhouette(rows.join(result.labels, "win")).first()
    return {"n_clusters": x["n_clusters"], "noise_pct": x["noise_pct"], "cluster_mean": x["size_mean"], "cluster_min": x["size_min"], "cluster_max": x["size_max"], "silhouette": s["silhouette"], "t_s": round(result.seconds, 2)}


def seed_variance(rows: DataFrame, dataset: str, reference: DataFrame, methods=("ap_sampled", "ap_coreset", "ap_kmeans", "ap_stratified"), seeds=range(1, 11), *, sample_size: int = S.AP_SAMPLE, preference=None, unit: float = S.UNIT, **options) -> list[dict]:
    """K, agreement with the reference labels and seconds for each method and seed; all runs are one job (plans.grid), whose seconds they share.

    Samples above affinity.ONE_TASK are too large for a task of their own and are clustered one after another. Up to sample_size rows all runs are the full method.
    """
    began, runs = time.perf_counter(), [(method, seed) for method in methods for seed in seeds]
    if rows.count() <= sample_size:
        full = cluster(rows, "ap_full", preference=preference, unit=unit).labels
        found = dict.fromkeys(range(len(runs)), grid.scores(full.withColumn("run", F.lit(0)), reference).first())
    elif sample_size > affinity.ONE_TASK:
        labels = None
        for k, (method, seed) in enumerate(runs):
            x = cluster(rows, method, seed=seed, sample_size=sample_size, preference=preference, unit=unit, **options).labels.select(F.lit(k).alias("run"), "win", "label")
            labels = x if labels is None else labels.union(x)
        found = {r["run"]: r for r in grid.scores(labels, reference).collect()}
    else:
        preference = min_affinity(rows, mode="sampled", unit=unit) if preference is None else preference
        labels = grid.cluster_samples(rows, grid.samples(rows, runs, sample_size, **options), preference, unit)
        found = {r["run"]: r for r in grid.scores(materialised(labels, "labels"), reference).collect()}  # one row a run
    seconds = round((time.perf_counter() - began) / max(1, len(runs)), 2)
    return [{"dataset": dataset, "method": method, "seed": seed, "K": found[k]["K"], "ari_vs_ap_full": found[k]["ari"], "t_s": seconds} for k, (method, seed) in enumerate(runs)]


#: A task of a split holds one half after the other, of up to so many times the rows that are worth one (five matrices of 200 MB).
HALVES = 2


def _places(rows: DataFrame, n: int, splits: int, seed: int) -> DataFrame:
    """split, win, half and place (from 0 in each half) of all rows, for each of the splits' orders."""
    order = np.concatenate([np.random.default_rng((seed, k)).permutation(n) for k in range(splits)])
    place = np.tile(np.arange(n), splits)
    table = pa.table({"split": np.repeat(np.arange(splits), n), "at": order, "half": (place >= n // 2).astype(np.int64), "place": np.where(place >= n // 2, place - n // 2, place)})
    return rows.sparkSession.createDataFrame(table).join(ranked(rows.select("win"), "win", "at"), "at").select("split", "win", "half", "place")


def _stability(rows: DataFrame, n: int, splits: int, seed: int, preferences: list, unit: float, limit: int, whole: bool) -> list[dict]:
    """K of all rows (if whole), and the splits' AMI, for each of the preferences: splits are rows of one job, or of one after another where a half is too large for a task."""
    places = materialised(_places(rows, n, splits, seed), "places")
    if n <= 2 * HALVES * affinity.ONE_TASK:
        apart = whole and n > affinity.ONE_TASK  # all rows are too many for a task, their halves are not
        if whole and not apart:
            places = places.union(places.where("split = 0").select(F.lit(-1).cast("long").alias("split"), "win", F.lit(None).cast("long").alias("half"), F.col("win").alias("place")))
        found = grid.split_scores(rows, places, preferences, unit).orderBy("split", "p").collect()  # one row a run
        counts = {r["p"]: r["K"] for r in found if r["split"] < 0}
        if apart:
            counts = {p: affinity.dense(rows, preference, unit=unit, limit=limit).where("label >= 0").select("label").distinct().count() for p, preference in enumerate(preferences)}
        return [{"K": counts.get(p), "amis": [r["ami"] for r in found if r["split"] >= 0 and r["p"] == p and r["ami"] is not None]} for p in range(len(preferences))]
    out = []
    for preference in preferences:
        amis = []
        for k in range(splits):
            a, b = (materialised(places.where((F.col("split") == k) & (F.col("half") == h)).join(rows.select("win", "vec"), "win").select("place", "vec"), "half") for h in (0, 1))
            found = affinity.dense(a, preference, unit=unit, limit=limit, key="place").where("label >= 0").select(F.col("exemplar").alias("place")).distinct()
            exemplars = materialised(a.join(found, "place"), "exemplars")
            if not exemplars.isEmpty():
                own = affinity.dense(b, preference, unit=unit, limit=limit, key="place").select(F.col("win").alias("i"), F.col("label").alias("a"))
                amis.append(metrics.ami(own.join(nearest(b, exemplars, key="place", other="place").select("i", F.col("j").alias("b")), "i")))
        out.append({"K": affinity.dense(rows, preference, unit=unit, limit=limit).where("label >= 0").select("label").distinct().count() if whole else None, "amis": amis})
    return out


def split_half(rows: DataFrame, *, splits: int = 5, seed: int = 42, preference=None, unit: float = 1.0, limit: int | None = None) -> dict:
    """Mean and population deviation of the AMI between clusters of half B and half B assigned to half A's exemplars.

    All rows take part, each half clustered on its own: all splits at once, a task each, where all rows fit one task's matrix, else by block rows.
    Halves above limit rows, if it is given, are refused.
    """
    n = rows.count()
    if limit is not None and n - n // 2 > limit:
        raise ValueError(f"half of {n} rows make too large a matrix; the limit is {limit}")
    amis = _stability(rows, n, splits, seed, [preference], unit, limit, False)[0]["amis"]
    return {"splits": len(amis), "ami_mean": float(np.mean(amis)) if amis else None, "ami_std": float(np.std(amis)) if amis else None}


def preference_sweep(rows: DataFrame, *, steps: int = 12, splits: int = 3, seed: int = 42, unit: float = 1.0, limit: int | None = None) -> list[dict]:
    """K and split-half AMI for preferences from the least to the median similarity, the best marked (the first on a tie).

    All rows take part, all preferences and splits at once, a task each, where all rows fit one task's matrix; above limit rows, if it is given, the matrix is refused.
    """
    n = rows.count()
    if limit is not None and n > limit:
        raise ValueError(f"{n} rows make too large a matrix; the limit is {limit}")
    preferences = [float(p) for p in np.linspace(*affinity.similarity_range(rows, unit), steps)]
    found = _stability(rows, n, splits, seed, preferences, unit, limit, True)
    out = [{"preference": p, "K": x["K"], "split_half_ami": float(np.mean(x["amis"])) if x["amis"] else None} for p, x in zip(preferences, found, strict=True)]
    best = max(range(len(out)), key=lambda k: (out[k]["split_half_ami"] if out[k]["split_half_ami"] is not None else -2, -k))
    return [r | {"best": k == best} for k, r in enumerate(out)]


def downstream(dataset: str, bundle: DataFrame, unit: float = S.UNIT, draws: int = 1000) -> dict:
    """How far conclusions from sampled labels agree with those from full ones: occupancy, transitions, raster, exemplars."""
    both = bundle.select("win", "folder", F.col("label_full").alias("a"), F.col("label_sampled").alias("b"))
    table, la, lb = metrics.table_of(metrics.contingency(both))
    matched = [(la[i], lb[j]) for i, j in metrics.match_clusters(table)]
    spark = bundle.sparkSession
    names = spark.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(matched)], "place long, a int, b int")
    share = lambda c: metrics.occupancy(both.select("win", F.col(c).alias("label")))
    xy = names.join(share("a").select(F.col("label").alias("a"), F.col("share").alias("x")), "a", "left").join(share("b").select(F.col("label").alias("b"), F.col("share").alias("y")), "b", "left")
    occupancy = metrics.bootstrap_correlation(xy.select("place", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y")), draws).first()

    def steps(c: str, name: str) -> DataFrame:
        known = names.select(F.col(c).alias("_k"), F.col("place").cast("int").alias("label"))
        x = both.join(F.broadcast(known), F.col(c) == F.col("_k"), "left").select("win", "folder", F.coalesce("label", F.lit(-1)).alias("label"))
        return metrics.transitions(x).select("a", "b", F.col("p").alias(name))

    k = len(matched)
    grid = spark.range(k * k).select(F.floor(F.col("id") / k).cast("int").alias("a"), (F.col("id") % k).cast("int").alias("b"), F.col("id").alias("place")) if k else spark.createDataFrame([], "a int, b int, place long")
    cells = grid.join(steps("a", "x"), ["a", "b"], "left").join(steps("b", "y"), ["a", "b"], "left").select("place", F.coalesce("x", F.lit(0.0)).alias("x"), F.coalesce("y", F.lit(0.0)).alias("y"))
    moves = metrics.bootstrap_correlation(materialised(cells, "cells"), draws).first()
    exemplars = lambda flag: bundle.where(flag).select(F.col("win").alias("pos"), "vec")
    near = metrics.exemplar_overlap(exemplars("is_ex_full"), exemplars("is_ex_sampled"), unit).first()
    return {"dataset": dataset, "K_full": len(la), "K_sampled": len(lb), "K_matched": k, "occupancy_r": occupancy["r"], "occupancy_ci_lo": occupancy["ci_lo"], "occupancy_ci_hi": occupancy["ci_hi"], "transition_r": moves["r"], "transition_ci_lo": moves["ci_lo"], "transition_ci_hi": moves["ci_hi"], "raster_agreement": metrics.raster_agreement(both, matched).first()[0]} | near.asDict()


def compare_features(dataset: str, histogram: DataFrame, empirical: DataFrame, reference: DataFrame, seed: int = 42) -> dict:
    """K-means on both feature sets at the reference's K: rank correlation of distances, agreement, silhouettes, winner."""
    n = min(histogram.count(), empirical.count())
    k = reference.where("label >= 0").select("label").distinct().count()
    pairs = metrics.random_pairs(histogram.sparkSession, n)

    def distances(rows: DataFrame, name: str) -> DataFrame:
        d = F.aggregate(F.zip_with("va", "vb", lambda a, b: F.abs(a - b).cast("double")), F.lit(0.0), lambda s, x: s + x)
        return pairs.join(rows.select(F.col("win").alias("i"), F.col("vec").alias("va")), "i").join(rows.select(F.col("win").alias("j"), F.col("vec").alias("vb")), "j").select("place", d.alias(name))

    ranks = metrics.rank_comparison(materialised(distances(histogram, "x").join(distances(empirical, "y"), "place"), "distances")).first()
    labels = {name: materialised(sampling.k_means(rows, k, seed)[0].select("win", F.col("cluster").alias("label")), name) for name, rows in (("h", histogram), ("e", empirical))}
    ari = lambda a, b: metrics.agreement(a.select("win", F.col("label").alias("a")).join(b.select("win", F.col("label").alias("b")), "win")).first()["ari"]
    h, e = ari(labels["h"], reference), ari(labels["e"], reference)
    sil = lambda rows, name: metrics.silhouette(rows.join(labels[name], "win")).first()["silhouette"]
    return {"dataset": dataset, "n_windows": n, "K": k, "spearman_rho": ranks["spearman_rho"], "flip_rate_pct": round(ranks["flip_rate_pct"], 1), "ari_histogram": h, "ari_empirical": e, "ari_hist_vs_emp": ari(labels["h"], labels["e"]), "sil_histogram": sil(histogram, "h"), "sil_empirical": sil(empirical, "e"), "winner": "histogram" if h >= e else "empirical", "delta_ari": round(h - e, 4), "status": "ok"}


def peak_memory() -> float:
    """The most memory in MB that the driver's processes on this machine (Python, JVM and their children) have held, where the system tells."""
    total = 0.0
    for status in Path("/proc").glob("[0-9]*/status"):
        try:
            found = dict(x.split(":", 1) for x in status.read_text().splitlines() if ":" in x)
            if int(found["PPid"]) and _below(int(status.parent.name)):
                total += int(found.get("VmHWM", "0 kB").split()[0]) / 1024
        except (OSError, KeyError, ValueError):
            continue
    return round(total, 1)


def _below(pid: int) -> bool:
    """Whether a process is this one or a descendant of it."""
    while pid > 1:
        if pid == os.getpid():
            return True
        try:
            pid = int(Path(f"/proc/{pid}/stat").read_text().rsplit(")", 1)[1].split()[1])
        except (OSError, ValueError, IndexError):
            return False
    return False


def benchmark(rows: DataFrame, method: str, **options) -> dict:
    """Windows, seconds, windows a second, clusters and peak memory in MB of one method."""
    n, began = rows.count(), time.perf_counter()
    found = cluster(rows, method, **options)
    clusters = found.labels.where("label >= 0").select("label").distinct().count()
    seconds = time.perf_counter() - began
    return {"method": method, "n_windows": n, "t_s": round(seconds, 3), "windows_per_s": round(n / seconds, 1), "n_clusters": clusters, "peak_mb": peak_memory()}


def cluster_joint(joint: DataFrame, method: str, *, reg: float = 0.5, preference=None, limit: int | None = None, n_directions: int = DIRECTIONS, seed: int = 42) -> DataFrame:
    """win and label: affinity propagation on transport distances between joint windows; above limit rows, if it is given, the matrix is refused."""
    n = joint.count()
    if limit is not None and n > limit:
        raise ValueError(f"{n} rows make too large a matrix; the limit is {limit}")
    distances = joint_distances(joint, method, reg=reg, n_directions=n_directions, seed=seed)
    return affinity.of_distances(distances, joint, preference, limit=limit).select("win", "label")


def assign_joint(joint: DataFrame, exemplars: DataFrame, method: str, *, reg: float = 0.05) -> DataFrame:
    """win, j and d of the nearest exemplar (win) of each joint window."""
    if method == "cityblock":
        return nearest(joint, exemplars, other="win")
    return joint_distances(joint, method, exemplars, reg=reg).groupBy("i").agg(F.min(F.struct("d", "j")).alias("m")).select(F.col("i").alias("win"), "m.j", "m.d")


__all__ = ["Recording", "Store", "assign_joint", "cluster_joint", "compare_features", "cross", "downstream", "matrix", "prepare", "preference_sweep", "score", "seed_variance", "split_half"]
