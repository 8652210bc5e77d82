"""Samples of windows: uniform, greedy K-centre, K-means representatives, stratified, splits, bootstraps."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import l1, shuffle_key
from ..session import in_arrow, materialised
from .distance import nearest
from .sequence import ranked


def uniform(df: DataFrame, n: int, seed: int = 42, key: str = "win") -> DataFrame:
    """n rows, the same whatever the partitioning."""
    return df.orderBy(shuffle_key(F.col(key), seed), key).limit(n)


def split_half(df: DataFrame, seed: int = 42, key: str = "win") -> DataFrame:
    """Adds half: 'A' for the first half of a random order, 'B' for the rest."""
    order = df.select(key).withColumn("_o", shuffle_key(F.col(key), seed) * (1 << 31) + F.pmod(F.col(key), F.lit(1 << 31)))
    places = ranked(order, "_o", "_p", block=1 << 50)
    n = df.count()
    return df.join(places.select(key, F.when(F.col("_p") < n // 2, "A").otherwise("B").alias("half")), key)


def bootstrap(df: DataFrame, draws: int, n: int, seed: int = 0) -> DataFrame:
    """draw and every column of df: `draws` resamples of n rows with replacement; df has a column place from 0 to n - 1."""
    spark = df.sparkSession
    picks = spark.range(draws * n).select(F.floor(F.col("id") / n).cast("long").alias("draw"), F.pmod(shuffle_key(F.col("id"), seed), F.lit(n)).alias("place"))
    return picks.join(df, "place")


def k_centres(df: DataFrame, k: int, seed: int = 0, key: str = "win", vec: str = "vec") -> DataFrame:
    """pos, key and vec of k rows: each next one is farthest from those before it (ties: lowest key), from a seeded first one."""
    return k_centres_of(df, k, [seed], key, vec).drop("run")


def k_centres_of(df: DataFrame, k: int, seeds: Sequence[int], key: str = "win", vec: str = "vec") -> DataFrame:
    """k_centres for each of the seeds; run is the seed's place.

    Rows stay where they are: tasks of one barrier stage hold their rows and distances, and exchange
    their farthest row for each seed in each step.
    """
    rows = df.select(F.col(key).cast("long").alias("win"), F.col(vec).cast("array<double>").alias("vec"))
    first = [uniform(rows, 1, seed).select("win").first() for seed in seeds]
    if first[0] is None:
        return rows.select(F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("pos"), "win", "vec")
    parts = slots(df)

    def kernel(batches):
        from pyspark import BarrierTaskContext

        from .barrier import Exchange

        exchange = Exchange(BarrierTaskContext.get())
        table = pa.Table.from_batches(batches) if (batches := list(batches)) else None
        wins = table.column(0).to_numpy() if table else np.zeros(0, np.int64)
        x = np.array(table.column(1).to_pylist(), np.float64) if table and len(table) else np.zeros((0, 0))
        chosen: list = [None] * len(seeds)
        for said in exchange.gather([(int(wins[at[0]]), x[at[0]]) if len(at := np.flatnonzero(wins == f[0])) else None for f in first]):
            chosen = [mine or known for mine, known in zip(said, chosen, strict=True)]
        far, out = np.full((len(seeds), len(wins)), np.inf), []
        for pos in range(k):
            offers: list = []
            for run, now in enumerate(chosen):
                if now and exchange.rank == 0:
                    out.append((run, pos, now[0], now[1].tolist()))
                if now and len(wins):
                    far[run] = np.minimum(far[run], np.abs(x - now[1]).sum(axis=1))
                    best = np.lexsort((wins, -far[run]))[0]
                offers.append((-far[run][best], int(wins[best]), x[best]) if now and len(wins) else None)
            said = exchange.gather(offers)
            for run, now in enumerate(chosen):
                top = min((v[run] for v in said if v[run]), key=lambda v: v[:2]) if now else None
                chosen[run] = top[1:] if top and top[0] < 0 else None  # else every row is chosen, or a copy of a chosen one
            if not any(chosen):
                break
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int64()) for v in columns[:3]), pa.array(columns[3], pa.list_(pa.float64()))], ["run", "pos", "win", "vec"])

    return materialised(in_arrow(rows.repartition(parts, "win"), kernel, "run long, pos long, win long, vec array<double>", barrier=True), "centres", barrier=True)


def slots(df: DataFrame) -> int:
    """Tasks of a barrier stage: all that the cluster runs at once."""
    return max(1, df.sparkSession.sparkContext.defaultParallelism)


def k_means(df: DataFrame, k: int, seed: int = 42, key: str = "win", vec: str = "vec", max_iter: int = 20):
    """Spark's own K-means over the vectors: (rows with column cluster, model)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = df.withColumn("_f", array_to_vector(F.col(vec).cast("array<double>")))
    model = KMeans(k=max(2, k), seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="cluster").fit(x)
    return model.transform(x).drop("_f"), model


def bounded_blocks(rows: DataFrame, most: int, key: str = "win", vec: str = "vec") -> DataFrame:
    """rows with column block for cluster: clusters of more than `most` rows are halved until none is, each time between two rows far apart.

    A half is what is nearer to one of the two, up to the median; if over a quarter of the rows tie with it, such as copies, these are dealt out by a hash. A round is a few aggregates over
    the large blocks alone, and there are as many as the largest one has halves to make.
    """
    x = materialised(rows.withColumn("block", F.col("cluster").cast("long")).drop("cluster"), "blocks")
    for step in range(60):
        large = materialised(x.groupBy("block").count().where(F.col("count") > most).select("block"), "large")
        if large.isEmpty():
            break
        own = x.join(large, "block").select("block", key, vec)

        def far_from(pivots: DataFrame, own=own) -> DataFrame:
            return own.join(pivots, "block").groupBy("block").agg(F.max_by(vec, F.struct(l1(F.col(vec), F.col("pivot")), -F.col(key))).alias("pivot"))

        one = materialised(far_from(own.groupBy("block").agg(F.min_by(vec, key).alias("pivot"))), "pivots")
        two = far_from(one).withColumnRenamed("pivot", "other")
        nearer = l1(F.col(vec), F.col("pivot")) - l1(F.col(vec), F.col("other"))
        sides = materialised(own.join(one, "block").join(two, "block").select("block", F.col(key).alias("_key"), nearer.alias("d")), "sides")
        middle = sides.groupBy("block").agg(F.percentile_approx("d", 0.5, 10_000).alias("m"))
        met = sides.join(middle, "block")
        ties = met.groupBy("block").agg((4 * F.count_if(F.col("d") == F.col("m")) > F.count("*")).alias("tied"))
        dealt = F.shiftrightunsigned(F.xxhash64("_key"), step).bitwiseAND(1)
        half = F.when(F.col("tied") & (F.col("d") == F.col("m")), dealt).otherwise((F.col("d") > F.col("m")).cast("long"))
        found = met.join(ties, "block").select("_key", half.alias("half"))
        x = materialised(x.join(found, F.col(key) == F.col("_key"), "left").withColumn("block", F.col("block") * 2 + F.coalesce("half", F.lit(0))).drop("_key", "half"), "blocks")
    return x


def k_means_representatives(df: DataFrame, k: int, seed: int = 42, key: str = "win", vec: str = "vec") -> DataFrame:
    """Rows nearest to the K-means centres, each once: at most k."""
    _, model = k_means(df, k, seed, key, vec)
    centres = df.sparkSession.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "pos long, vec array<double>")
    found = nearest(centres, df.select(F.col(key).alias("win"), F.col(vec).alias("vec")), key="pos", other="win")
    return df.join(found.select(F.col("j").alias(key)).distinct(), key)


def stratified(df: DataFrame, k: int, strata: int = 200, seed: int = 42, key: str = "win", vec: str = "vec") -> DataFrame:
    """k rows: up to k // strata of each K-means stratum, topped up at random from the rest."""
    rows, _ = k_means(df, strata, seed, key, vec)
    order = [shuffle_key(F.col(key), seed), F.col(key)]
    rows = materialised(rows.withColumn("_r", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))), "strata")
    per = max(1, k // strata)
    first = rows.where(F.col("_r") <= per)
    missing = k - first.count()
    if missing < 0:
        return first.orderBy(*order).limit(k).select(df.columns)
    rest = rows.where(F.col("_r") > per).orderBy(*order).limit(missing)
    return first.union(rest).select(df.columns)
