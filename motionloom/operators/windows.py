"""Features of fixed 60-sample windows: histograms, cumulative counts, quantiles, joint samples, representatives."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions.expressions import digitise, floored_log, running

CHANNELS = tuple(S.EDGES)


def in_windows(signals: DataFrame, window: int = S.WINDOW) -> DataFrame:
    """Adds win (from 0), place in the window, and log_tot."""
    return signals.withColumns({"win": F.floor(F.col("pos") / window).cast("long"), "place": (F.col("pos") % window).cast("int"), "log_tot": floored_log(F.col("tot_accel"))})


def histograms(signals: DataFrame, edges=S.EDGES, window: int = S.WINDOW) -> DataFrame:
    """win and counts per bin: <channel>_<bin> columns, whole windows only; one hash aggregate, no lists."""
    x = in_windows(signals, window).withColumns({f"_{k}": digitise(F.col(k), e) for k, e in edges.items()})
    counts = [F.count_if(F.col(f"_{k}") == b).cast("int").alias(f"{k}_{b}") for k, e in edges.items() for b in range(len(e) + 1)]
    return x.groupBy("win").agg(F.count("*").alias("_n"), *counts).where(F.col("_n") == window).drop("_n")


def counts_array(hist: DataFrame, edges=S.EDGES) -> DataFrame:
    """win and counts: the bins of all channels in one array."""
    return hist.select("win", F.array(*(F.col(f"{k}_{b}") for k, e in edges.items() for b in range(len(e) + 1))).alias("counts"))


def cumulative(hist: DataFrame, edges=S.EDGES) -> DataFrame:
    """win and cdf: running counts of each channel in units of 1/600, without the constant last ones.

    The city-block distance of two such arrays is 600 times the sum of the channels' one-dimensional Wasserstein
    distances, each divided by its number of bins less one; it is exact.
    """
    out = []
    for k, e in edges.items():
        sums = running([F.col(f"{k}_{b}") for b in range(len(e))])
        out += [(x * S.WEIGHTS[k]).cast("int") for x in sums]
    return hist.select("win", F.array(*out).alias("cdf"))


def cdf_features(hist: DataFrame, edges=S.EDGES, window: int = S.WINDOW) -> DataFrame:
    """win and cdf as 30 doubles, each channel divided by its number of bins less one."""
    out = []
    for k, e in edges.items():
        out += [x / (window * len(e)) for x in running([F.col(f"{k}_{b}") for b in range(len(e) + 1)])]
    return hist.select("win", F.array(*out).alias("cdf"))


def quantiles(signals: DataFrame, window: int = S.WINDOW) -> DataFrame:
    """win and q: each channel's samples in a window, sorted, divided by its scale."""
    x = in_windows(signals, window)
    lists = [F.sort_array(F.collect_list((F.col(k) / S.SCALES[k]).cast("float"))).alias(k) for k in CHANNELS]
    return x.groupBy("win").agg(F.count("*").alias("_n"), *lists).where(F.col("_n") == window).select("win", F.concat(*CHANNELS).alias("q"))


def joint(signals: DataFrame, window: int = S.WINDOW) -> DataFrame:
    """win and pts: the four channels of each sample, scaled, in time order."""
    x = in_windows(signals, window).withColumn("_p", F.array(*((F.col(k) / S.SCALES[k]).cast("float") for k in CHANNELS)))
    x = x.groupBy("win").agg(F.sort_array(F.collect_list(F.struct("place", "_p"))).alias("_s")).where(F.size("_s") == window)
    return x.select("win", F.transform("_s", lambda s: s["_p"]).alias("pts"))


def representatives(rows: DataFrame, window: int = S.WINDOW) -> DataFrame:
    """win, ts_start, ts_mid and folder (of the first sample) of whole windows."""
    x = rows.withColumns({"win": F.floor(F.col("pos") / window).cast("long"), "place": (F.col("pos") % window).cast("int")})
    pick = lambda c, p: F.max(F.when(F.col("place") == p, F.col(c)))
    return x.groupBy("win").agg(F.count("*").alias("_n"), pick("ts", 0).alias("ts_start"), pick("ts", window // 2).alias("ts_mid"), pick("folder", 0).alias("folder")).where(F.col("_n") == window).drop("_n")
