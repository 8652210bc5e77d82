"""The eight clustering methods over cumulative-count vectors, one plan each, and their dispatcher."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..operators import affinity, density, sampling
from ..operators.distance import min_affinity, nearest, neighbours, neighbours_in_cells, similarity
from ..session import in_arrow, materialised


@dataclass
class Clustering:
    """Labels (win, label), exemplars (pos, win), the preference used, and seconds."""

    labels: DataFrame
    exemplars: DataFrame | None = None
    preference: float | None = None
    seconds: float = 0.0
    options: dict = field(default_factory=dict)


def _exemplars(labels: DataFrame) -> DataFrame:
    return labels.where("label >= 0").groupBy(F.col("label").cast("long").alias("pos")).agg(F.max("exemplar").alias("win"))


def assign(rows: DataFrame, exemplars: DataFrame) -> DataFrame:
    """win and label of all rows: their nearest exemplar (pos, win), ties by the lowest position; no exemplars: all 0."""
    own = exemplars.join(rows.select("win", "vec"), "win").select("pos", "vec")
    found = nearest(rows, own).select(F.col("i").alias("win"), F.col("j").cast("int").alias("label"))
    return rows.select("win").join(found, "win", "left").select("win", F.coalesce("label", F.lit(0)).alias("label"))


def ap_full(rows: DataFrame, *, preference=None, unit: float = S.UNIT, limit: int | None = None, **_) -> Clustering:
    """Every row is a candidate; the preference is the least similarity unless given; above limit rows, if it is given, an error."""
    preference = min_affinity(rows, unit=unit) if preference is None else preference
    labels = affinity.dense(rows, preference, unit=unit, limit=limit)
    return Clustering(labels.select("win", "label"), _exemplars(labels), preference)


def _from_sample(rows: DataFrame, sample: DataFrame, preference, unit: float) -> Clustering:
    preference = min_affinity(rows, mode="sampled", unit=unit) if preference is None else preference
    sample = materialised(sample.select("win", "vec"), "sample")
    exemplars = materialised(_exemplars(affinity.dense(sample, preference, unit=unit)), "exemplars")
    return Clustering(materialised(assign(rows, exemplars), "assigned"), exemplars, preference)


def _sampled(take):
    def method(rows: DataFrame, *, sample_size: int = S.AP_SAMPLE, preference=None, seed: int = 42, unit: float = S.UNIT, **options) -> Clustering:
        if rows.count() <= sample_size:
            return ap_full(rows, preference=preference, unit=unit)
        return _from_sample(rows, take(rows, sample_size, seed, **options), preference, unit)

    return method


ap_sampled = _sampled(lambda rows, k, seed, **_: sampling.uniform(rows, k, seed))
ap_coreset = _sampled(lambda rows, k, seed, **_: sampling.k_centres(rows, k, seed))
ap_kmeans = _sampled(lambda rows, k, seed, **_: sampling.k_means_representatives(rows, k, seed))
ap_stratified = _sampled(lambda rows, k, seed, strata=200, **_: sampling.stratified(rows, k, strata, seed))


#: Rows whose matrix one task of the two-level method holds.
BLOCK_ROWS = 5000


def ap_twolevel(rows: DataFrame, *, blocks: int | None = None, preference=None, seed: int = 42, unit: float = S.UNIT, **_) -> Clustering:
    """K-means blocks in parallel, each with its own exemplars; these compete once more; all rows go to the nearest winner.

    Blocks of more than BLOCK_ROWS rows are halved, between rows far apart, until none is.
    """
    n = rows.count()
    blocked, _model = sampling.k_means(rows, blocks or max(4, n // 2500), seed)
    blocked = sampling.bounded_blocks(blocked.select("win", "vec", "cluster"), BLOCK_ROWS)
    kind = "median" if preference is None else preference

    def one(batches):
        batches = [x for x in batches if x.num_rows]
        if not batches:
            return
        win = np.concatenate([x.column(0).to_numpy() for x in batches])
        x = np.concatenate([x.column(1).flatten().to_numpy().reshape(x.num_rows, -1) for x in batches])
        order = np.argsort(win)
        win, x = win[order], x[order]
        _, found = affinity.cluster_vectors(x, unit, kind, max_iter=300)
        yield pa.RecordBatch.from_arrays([pa.array(win[found]), pa.array(list(x[found]), pa.list_(pa.float64()))], ["win", "vec"])

    # A block a task, large ones first: by a hash of the block, or with small partitions put together, some tasks would get several.
    sizes = materialised(blocked.groupBy("block").agg(F.count("*").alias("n")), "sizes")
    places = sizes.select("block", (F.row_number().over(Window.orderBy(F.desc("n"), "block")) - 1).alias("place"))  # one row per block
    own = blocked.join(F.broadcast(places), "block").repartitionById(max(1, sizes.count()), F.col("place"))
    own = own.select(F.col("win").cast("long").alias("win"), F.col("vec").cast("array<double>").alias("vec"))
    first = materialised(in_arrow(own, one, "win long, vec array<double>"), "candidates", lots=True)
    final = affinity.dense(first.dropDuplicates(["win"]), kind, unit=unit, max_iter=500, convergence=30)
    exemplars = materialised(_exemplars(final), "exemplars")
    return Clustering(materialised(assign(rows, exemplars), "assigned"), exemplars, preference)


def ap_sparse(rows: DataFrame, *, neighbours_k: int = 100, preference=None, graph: str = "mutual", search: str = "exact", unit: float = S.UNIT, **options) -> Clustering:
    """Messages along a neighbour graph only (see affinity.graph); labels by the nearest exemplar."""
    k = min(neighbours_k, max(1, rows.count() - 1))
    edges = neighbours(rows, k) if search == "exact" else neighbours_in_cells(rows, k)
    edges = materialised(affinity.graph(similarity(edges, unit).select("i", "j", "s"), graph), "graph", short=True)
    preference = min_affinity(rows, mode="sampled", unit=unit) if preference is None else preference
    found = affinity.sparse_exemplars(edges, rows, preference, **{k: v for k, v in options.items() if k in ("damping", "max_iter", "convergence", "allow_empty")})
    exemplars = materialised(found.select("win", (F.row_number().over(Window.orderBy("win")) - 1).cast("long").alias("pos")), "exemplars")  # one row per cluster
    return Clustering(materialised(assign(rows, exemplars), "assigned"), exemplars, preference)


def hdbscan(rows: DataFrame, *, min_cluster_size: int = 15, **_) -> Clustering:
    return Clustering(density.hdbscan(rows, min_cluster_size))


METHODS = {f: globals()[f] for f in S.METHODS}


def cluster(rows: DataFrame, method: str, **options) -> Clustering:
    """Runs one method over rows (win, vec); vec is in units of 1/unit."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; there are {', '.join(METHODS)}")
    began = time.perf_counter()
    out = METHODS[method](rows, **options)
    out.seconds, out.options = time.perf_counter() - began, options
    return out
