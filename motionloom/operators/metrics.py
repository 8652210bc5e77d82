"""Scores of clusterings: sizes, agreement, silhouette, occupancy, transitions, run lengths, correlations.

Label tables have win and label; -1 is noise.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expressions import shuffle_key
from ..session import in_arrow, materialised
from .distance import BLOCK, GROUP
from .sampling import uniform
from .sequence import average_ranks, neighbour_columns, ranked, running_total


def cluster_sizes(labels: DataFrame) -> DataFrame:
    """label and n, without noise."""
    return labels.where("label >= 0").groupBy("label").agg(F.count("*").alias("n"))


def cluster_stats(labels: DataFrame) -> DataFrame:
    """One row: clusters, mean, population deviation, least and greatest size, noise rows and percentage."""
    sizes = labels.groupBy("label").agg(F.count("*").alias("n"))
    real = F.when(F.col("label") >= 0, F.col("n"))
    noise = F.coalesce(F.sum(F.when(F.col("label") < 0, F.col("n"))), F.lit(0))
    return sizes.agg(
        F.count(real).alias("n_clusters"), F.avg(real).alias("size_mean"), F.stddev_pop(real).alias("size_std"), F.min(real).alias("size_min"), F.max(real).alias("size_max"),
        noise.alias("n_noise"), F.round(100.0 * noise / F.sum("n"), 2).alias("noise_pct"),
    )


def top_clusters(labels: DataFrame, k: int = 5) -> DataFrame:
    return cluster_sizes(labels).orderBy(F.desc("n"), "label").limit(k)


def contingency(both: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """a, b and n: how often two labels meet, without noise."""
    return both.where((F.col(a) >= 0) & (F.col(b) >= 0)).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(both: DataFrame, pred: str = "a", ref: str = "b", by: Sequence[str] = ()) -> DataFrame:
    """One row (or one for each value of the columns in by): ri, ari and nmi (arithmetic) of two labellings, from one pass of grouping sets.

    Rows whose pred is noise are left out; noise of ref counts as a cluster. Fewer than two rows or
    predicted clusters: null.
    """
    cells = both.where(F.col(pred) >= 0).groupBy(*by, F.col(pred).alias("a"), F.col(ref).alias("b")).agg(F.count("*").alias("n"))
    sets = cells.groupingSets([[*by, "a", "b"], [*by, "a"], [*by, "b"], [*by]], *by, "a", "b").agg(F.sum("n").alias("n"), F.grouping("a").alias("ga"), F.grouping("b").alias("gb"))
    n, pairs_of = F.col("n").cast("double"), F.col("n") * (F.col("n") - 1) / 2.0
    kind = {"c": (0, 0), "a": (0, 1), "b": (1, 0), "t": (1, 1)}
    when = {k: (F.col("ga") == x) & (F.col("gb") == y) for k, (x, y) in kind.items()}
    sums = sets.groupBy(*by).agg(
        *(F.coalesce(F.sum(F.when(w, pairs_of)), F.lit(0.0)).alias(f"p{k}") for k, w in when.items()),
        *(F.coalesce(F.sum(F.when(w, n * F.log(n))), F.lit(0.0)).alias(f"h{k}") for k, w in when.items()),
        F.max(F.when(when["t"], n)).alias("total"), F.count_if(when["a"]).alias("ka"),
    )
    pc, pa, pb, pt, total = (F.col(x) for x in ("pc", "pa", "pb", "pt", "total"))
    expected = pa * pb / pt
    ari = F.when((pa + pb) / 2 == expected, 1.0).otherwise((pc - expected) / ((pa + pb) / 2 - expected))
    ha, hb = F.log(total) - F.col("ha") / total, F.log(total) - F.col("hb") / total
    mi = F.log(total) + (F.col("hc") - F.col("ha") - F.col("hb")) / total
    enough = (total >= 2) & (F.col("ka") >= 2)
    nmi = F.when(ha + hb == 0, 1.0).otherwise(2 * mi / (ha + hb))
    return sums.select(*by, *(F.when(enough, F.round(v, 4)).alias(k) for k, v in (("ri", (pt + 2 * pc - pa - pb) / pt), ("ari", ari), ("nmi", nmi))))


def adjusted_mutual_information(table: np.ndarray) -> float:
    """AMI (arithmetic mean of entropies) of a contingency table, with the exact expectation under random labels."""
    table = table[table.sum(1) > 0][:, table.sum(0) > 0].astype(float)
    if not table.size:
        return 1.0
    n, a, b = table.sum(), table.sum(1), table.sum(0)
    if len(a) == len(b) == 1 or len(a) == len(b) == n:
        return 1.0
    with np.errstate(divide="ignore", invalid="ignore"):
        mi = np.nansum(table / n * np.log(n * table / np.outer(a, b)))
    entropy = lambda x: -(x / n * np.log(x / n)).sum()
    lg = np.array([math.lgamma(k + 1) for k in range(int(n) + 1)])
    expected, seen = 0.0, {}
    for x in a.astype(int):
        for y in b.astype(int):
            if (x, y) not in seen:
                k = np.arange(max(1, x + y - int(n)), min(x, y) + 1)
                log_p = lg[x] + lg[y] + lg[int(n) - x] + lg[int(n) - y] - lg[int(n)] - lg[k] - lg[x - k] - lg[y - k] - lg[int(n) - x - y + k]
                seen[x, y] = (k / n * np.log(n * k / (x * y)) * np.exp(log_p)).sum()
            expected += seen[x, y]
    mean = (entropy(a) + entropy(b)) / 2
    below = mean - expected
    below = min(below, -np.finfo(float).eps) if below < 0 else max(below, np.finfo(float).eps)
    return float((mi - expected) / below)


def table_of(cells: DataFrame) -> tuple[np.ndarray, list, list]:
    """A contingency table (a, b, n) as a matrix, with its row and column labels; as small as the numbers of clusters."""
    rows = cells.collect()
    a, b = sorted({r["a"] for r in rows}), sorted({r["b"] for r in rows})
    out = np.zeros((len(a), len(b)))
    for r in rows:
        out[a.index(r["a"]), b.index(r["b"])] += r["n"]
    return out, a, b


def ami(both: DataFrame, a: str = "a", b: str = "b") -> float:
    return adjusted_mutual_information(table_of(both.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")))[0])


def _means_by_cluster(batches):
    """Rows (cell, side, label, d, k, y, v), sorted: a cell's rows (side 0), then all clusters' values (side 1); to win, n, a and b of each row.

    The values y of a cluster in a dimension, with their numbers k, ascend, so that the sum of |x - y| takes a look at running sums; any part of
    them adds its own share. Dimension 0 is the label: its number is the cluster's size. One cluster's sums are held at a time.
    """
    here, left, held, sums, size, cluster = None, [], None, None, 0, None

    def begin():
        key, own, v = (np.concatenate(x) for x in zip(*left, strict=True))
        return {"key": key, "own": own, "v": np.ascontiguousarray(v.T), "n": np.zeros(len(key), np.int64), "a": np.zeros(len(key)), "b": np.full(len(key), np.inf), "met": np.zeros(len(key), bool)}

    def close():  # a cluster is complete
        if cluster is None:
            return
        same = held["own"] == cluster
        held["n"][same], held["a"][same] = size, sums[same] / max(size - 1, 1)
        held["b"][~same] = np.minimum(held["b"][~same], sums[~same] / size)
        held["met"] |= ~same

    def result():
        close()
        return pa.RecordBatch.from_arrays([pa.array(held["key"]), pa.array(held["n"]), pa.array(held["a"]), pa.array(held["b"], mask=~held["met"])], ["i", "n", "a", "b"])

    for batch in batches:
        cell, side, label, d, k = (batch.column(i).to_numpy() for i in range(5))
        y = batch.column(5).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(side) != 0) | ((side[1:] == 1) & ((np.diff(label) != 0) | (np.diff(d) != 0)))) + 1
        for first, last in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cell)], strict=True):
            if first == last:
                continue
            if cell[first] != here:
                if held:
                    yield result()
                here, held, cluster = cell[first], None, None
                left.clear()
            if not side[first]:
                left.append((k[first:last], label[first:last], batch.column(6).slice(first, last - first).flatten().to_numpy().reshape(last - first, -1)))
                continue
            if held is None:
                if not left:  # a cell without rows
                    continue
                held = begin()
                left.clear()
            if label[first] != cluster:
                close()
                cluster, size, sums = label[first], 0, np.zeros(len(held["key"]))
            if d[first] == 0:
                size += int(k[first:last].sum())
                continue
            count, total = (np.concatenate([[0.0], np.cumsum(w, dtype=float)]) for w in (k[first:last], k[first:last] * y[first:last]))
            x = held["v"][d[first] - 1]
            below = np.searchsorted(y[first:last], x, side="right")
            sums += x * (2 * count[below] - count[-1]) + (total[-1] - 2 * total[below])
    if held:
        yield result()


def silhouette(rows: DataFrame, *, key: str = "win", vec: str = "vec", most: int | None = 2000, seed: int = 42) -> DataFrame:
    """One row: silhouette (city-block) of up to `most` rows (None: all) that aren't noise, and quality; null with fewer than two clusters.

    Rows aren't compared in pairs: the city-block sum of a row and a cluster comes from running sums over the cluster's different values of each
    dimension, which go to each group of rows. Work grows with rows times clusters times dimensions, and with groups times different values
    (few for whole numbers, as many as the rows for others). Single members score 0.
    """
    x = rows.where("label >= 0")
    x = uniform(x, most, seed, key) if most else x
    x = materialised(x.select(F.col(key).cast("long").alias("k"), F.col("label").cast("long").alias("label"), F.col(vec).cast("array<double>").alias("v")), "rows")
    n, cores = x.count(), x.sparkSession.sparkContext.defaultParallelism
    groups = max(-(-n // GROUP), min(cores, n // BLOCK), 1)
    values = x.select("label", F.posexplode(F.concat(F.array(F.col("label").cast("double")), "v")).alias("d", "y")).groupBy("label", "d", "y").agg(F.count("*").alias("k"))
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("cell")
    table = materialised(values, "values").select(everywhere, F.lit(1).alias("side"), "label", "d", "k", "y", F.lit(None).cast("array<double>").alias("v"))
    own = x.select(F.pmod(F.xxhash64("k"), F.lit(groups)).cast("int").alias("cell"), F.lit(0).alias("side"), "label", F.lit(0).alias("d"), "k", F.lit(0.0).alias("y"), "v")
    met = own.union(table).repartitionById(groups, F.col("cell")).sortWithinPartitions("cell", "side", "label", "d", "y")
    each = in_arrow(met, _means_by_cluster, "i long, n long, a double, b double")
    one = F.when(F.col("b").isNull(), None).when(F.col("n") == 1, 0.0).when(F.greatest("a", "b") == 0, 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    score = each.agg(F.round(F.avg(one), 4).alias("silhouette"))
    return score.withColumn("quality", F.when(F.col("silhouette") > 0.5, "good").when(F.col("silhouette") > 0.25, "reasonable").when(F.col("silhouette").isNotNull(), "poor"))


def occupancy(labels: DataFrame) -> DataFrame:
    """label and share of all rows (noise is counted, but not listed)."""
    every = labels.groupBy("label").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy())  # one row per label
    return every.withColumn("share", share).where("label >= 0").select("label", "share")


def transitions(labels: DataFrame, order: str = "win", folder: str = "folder") -> DataFrame:
    """a, b, n and p: steps to the very next row in order, within a folder, neither row noise; p sums to 1 per a."""
    x = ranked(labels.select("label", folder, order), order, "_place")
    x = neighbour_columns(x, "_place", 0, 1, lambda w: {"_b_label": F.lead("label").over(w), "_b_folder": F.lead(folder).over(w)})
    x = x.where((F.col("label") >= 0) & (F.col("_b_label") >= 0) & (F.col(folder) == F.col("_b_folder")))
    cells = x.groupBy(F.col("label").alias("a"), F.col("_b_label").alias("b")).agg(F.count("*").alias("n"))
    return cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("a")))


def run_lengths(labels: DataFrame, order: str = "win", seconds: float = 0.3) -> DataFrame:
    """One row: label values (noise is one), rows, mean, median and longest run, mean duration, percentage of runs of one row."""
    x = ranked(labels.select("label", order), order, "_place")
    x = neighbour_columns(x, "_place", 1, 0, lambda w: {"_a_label": F.lag("label").over(w)})
    runs = running_total(x, "_place", (~F.col("label").eqNullSafe(F.col("_a_label"))).cast("long"), "run").groupBy("run", "label").agg(F.count("*").alias("n"))
    return runs.agg(
        F.countDistinct("label").alias("k"), F.sum("n").alias("n_windows"), F.round(F.avg("n"), 4).alias("mean_run"), F.percentile("n", F.lit(0.5)).alias("median_run"), F.max("n").alias("max_run"),
        F.round(seconds * F.avg("n"), 4).alias("mean_dur_s"), F.round(100.0 * F.count_if(F.col("n") == 1) / F.count("*"), 2).alias("pct_single"),
    )


def correlation(x: str, y: str):
    """Pearson's r; null without variance."""
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def bootstrap_correlation(xy: DataFrame, draws: int = 1000, seed: int = 0) -> DataFrame:
    """One row: r of x and y, and the 2.5 and 97.5 percentiles over resamples (those without variance are ignored); null below three rows.

    xy has one row per label or pair of labels, with place from 0.
    """
    from .sampling import bootstrap

    n = xy.count()
    whole = xy.agg(F.when(F.count("*") >= 3, correlation("x", "y")).alias("r"))
    if n < 3:
        return whole.select("r", F.lit(None).cast("double").alias("ci_lo"), F.lit(None).cast("double").alias("ci_hi"))
    each = bootstrap(xy, draws, n, seed).groupBy("draw").agg(correlation("x", "y").alias("r")).where("r IS NOT NULL")
    ci = each.agg(F.percentile("r", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).first()[0] or [None, None]
    return whole.select("r", F.lit(ci[0]).cast("double").alias("ci_lo"), F.lit(ci[1]).cast("double").alias("ci_hi"))


def match_clusters(table: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of an overlap table with the greatest sum, without pairs of no overlap.

    Of several such matchings the one whose list of pairs comes first: the first row that can have a partner has its first possible one, and so on.
    """
    n = max(table.shape)
    cost = np.zeros((n, n))
    cost[: table.shape[0], : table.shape[1]] = -table
    u, v, owner = np.zeros(n), np.zeros(n), np.full(n, -1)
    for i in range(n):
        least, way, used = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
        row, col = i, -1
        while True:
            reduced = cost[row] - u[row] - v
            better = ~used & (reduced < least)
            least[better], way[better] = reduced[better], col
            nxt = int(np.where(used, np.inf, least).argmin())
            delta = least[nxt]
            u[i] += delta
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            used[nxt] = True
            col = nxt
            if owner[col] < 0:
                break
            row = owner[col]
        while col >= 0:
            before = way[col]
            owner[col] = i if before < 0 else owner[before]
            col = before
    _first_of_equal(table, np.abs(cost - u[:, None] - v) < 1e-6, owner)
    return sorted((int(owner[j]), j) for j in range(table.shape[1]) if owner[j] < table.shape[0] and table[owner[j], j] > 0)


def _first_of_equal(table: np.ndarray, tight: np.ndarray, owner: np.ndarray) -> None:
    """Turns owner (the row of each column), a best matching, into the first of the best ones; all best ones have tight cells only."""
    fixed = np.zeros(len(owner), bool)  # columns
    for i in range(table.shape[0]):
        for j in np.flatnonzero(table[i] > 0).tolist():
            own = int(np.flatnonzero(owner == i)[0])
            if not tight[i, j] or fixed[j]:
                continue
            if own != j:  # the row that has j needs another column, along a path of tight cells that ends in i's own
                came, front = {own: -1}, [own]
                while front and j not in came:
                    col = front.pop()
                    for k in np.flatnonzero(tight[owner, col] & ~fixed).tolist():  # columns whose rows could take col
                        if k not in came and owner[k] != i:
                            came[k] = col
                            front.append(k)
                if j not in came:
                    continue
                col, row = j, i
                while col >= 0:
                    owner[col], row, col = row, owner[col], came[col]
            fixed[j] = True
            break


def raster_agreement(both: DataFrame, matched: list[tuple[int, int]], a: str = "a", b: str = "b") -> DataFrame:
    """One row: share of rows whose b is the partner of their a; labels without partner disagree."""
    pairs = both.sparkSession.createDataFrame(matched or [(None, None)], "_a int, _b int")
    x = both.join(F.broadcast(pairs), F.col(b) == F.col("_b"), "left")  # one row per cluster
    return x.agg(F.avg((F.col("_a").isNotNull() & (F.col("_a") == F.col(a))).cast("double")).alias("raster_agreement"))


def exemplar_overlap(full: DataFrame, sampled: DataFrame, unit: float = 1.0) -> DataFrame:
    """One row: mean and median distance of full exemplars to the nearest sampled one, and the share at distance 0. Both: pos, vec."""
    from .distance import nearest

    d = nearest(full, sampled, key="pos", other="pos").select((F.col("d") / unit).alias("d"))
    return d.agg(F.avg("d").alias("exemplar_mean_dist"), F.percentile("d", F.lit(0.5)).alias("exemplar_median_dist"), F.avg((F.col("d") == 0).cast("double")).alias("exemplar_frac_identical"))


def rank_comparison(pairs: DataFrame, lag: int = 49) -> DataFrame:
    """One row: Spearman's rho of x and y (average ranks), and the percentage of pairs up to `lag` places apart that the two order differently.

    pairs has place, x and y.
    """
    rho = average_ranks(pairs.select("x", "y"), ("x", "y")).agg(F.round(correlation("_rank_x", "_rank_y"), 4).alias("spearman_rho"))
    other = pairs.select(F.explode(F.sequence(F.col("place") - lag, F.col("place") - 1)).alias("place"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    met = pairs.join(other, "place")  # an equality join: each row is listed under the places before it
    flip = (F.col("x") < F.col("_x")) != (F.col("y") < F.col("_y"))
    flips = met.agg(F.round(100.0 * F.avg(flip.cast("double")), 4).alias("flip_rate_pct"))
    return rho.select("spearman_rho", F.lit(flips.first()[0]).cast("double").alias("flip_rate_pct"))


def seed_summary(runs: DataFrame) -> DataFrame:
    """Per dataset and method: mean, sample deviation, least and greatest K and ARI, and the number of seeds."""
    of = lambda c, name: (F.round(F.avg(c), 4).alias(f"{name}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{name}_std"), F.min(c).alias(f"{name}_min"), F.max(c).alias(f"{name}_max"))
    return runs.groupBy("dataset", "method").agg(*of("K", "K"), *of("ari_vs_ap_full", "ari"), F.count("*").alias("n_seeds"))


def figure_table(matrix: DataFrame, value: str, methods: list[str]) -> DataFrame:
    """dataset, and a column for each of methods with its value (the largest of several, null where there is none): the table behind a grouped bar chart."""
    return matrix.groupBy("dataset").pivot("method", methods).agg(F.max(value))


def cost_model(sizes: DataFrame) -> DataFrame:
    """n, bytes of a distance matrix, and modelled seconds of the older system: 0.5 ms a distance, 1000 iterations of n * n microseconds."""
    n = F.col("n").cast("double")
    return sizes.select("n", (n * n * 8).alias("matrix_bytes"), (n * n * 0.0005).alias("distance_s"), (1000 * n * n * 1e-6).alias("ap_s"))


def compare(both: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """One row: ari, nmi and a verdict for two label tables over the same windows; rows with a negative label are left out."""
    x = agreement(both.where((F.col(a) >= 0) & (F.col(b) >= 0)), a, b)
    verdict = F.when(F.col("ari") > 0.8, "excellent").when(F.col("ari") > 0.5, "good").when(F.col("ari") > 0.2, "moderate").otherwise("low")
    return x.select("ari", "nmi", verdict.alias("verdict"))


def random_pairs(spark: SparkSession, n: int, draws: int = 2000, seed: int = 42) -> DataFrame:
    """place, i and j: draws of two different rows below n."""
    x = spark.range(draws).select(F.col("id").alias("place"), F.pmod(shuffle_key(F.col("id"), seed), F.lit(n)).alias("i"), F.pmod(shuffle_key(F.col("id"), seed + 1), F.lit(n)).alias("j"))
    return x.withColumn("j", F.when(F.col("i") == F.col("j"), (F.col("j") + 1) % n).otherwise(F.col("j")))
