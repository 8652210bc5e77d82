"""Packet repair: fill missing packets, drop lossy windows, interpolate, label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..session import materialised
from .sequence import around, neighbour_columns, ranked


def motion(packets: DataFrame) -> DataFrame:
    """The motion register's packets."""
    return packets.where(F.col("register") == S.MOTION_REGISTER)


def others(packets: DataFrame) -> DataFrame:
    return packets.where(~F.col("register").eqNullSafe(F.lit(float(S.MOTION_REGISTER))))


def fill_missing(packets: DataFrame) -> DataFrame:
    """Motion rows with `pos` (place from 0) and `inserted`; a counter step of d > 1 gets d - 1 rows in between.

    Inserted rows have no sensor values; their times are evenly spaced, rounded to 0.1 ms. A step of 0, a missing
    counter, or the last row inserts nothing; steps of 128 or more alias.
    """
    rows = ranked(motion(packets), "seq", "_place")
    rows = neighbour_columns(rows, "_place", 0, 1, lambda w: {"_c1": F.lead("counter").over(w), "_t1": F.lead("ts").over(w)})
    step = F.coalesce(F.pmod((F.col("_c1") - F.col("counter")).cast("long"), F.lit(S.COUNTER_MODULUS)).cast("int"), F.lit(0))
    rows = rows.withColumn("_d", step).withColumn("_j", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_d"), F.lit(1)) - 1)))
    new, j = F.col("_j") > 0, F.col("_j")
    filled = {
        "command": F.when(new, F.lit(float(S.INSERTED_COMMAND))).otherwise(F.col("command")),
        "ts": F.when(new, F.round(F.col("ts") + j * (F.col("_t1") - F.col("ts")) / F.col("_d"), 4)).otherwise(F.col("ts")),
        "counter": F.when(new, F.pmod(F.col("counter") + j, F.lit(float(S.COUNTER_MODULUS)))).otherwise(F.col("counter")),
        "folder": F.when(~new, F.col("folder")),
        "inserted": new,
    } | {k: F.when(~new, F.col(k)) for k in S.SENSORS}
    rows = rows.withColumns(filled).withColumn("_key", F.col("_place") * S.COUNTER_MODULUS + j)
    return ranked(rows, "_key", "pos").drop("_place", "_c1", "_t1", "_d", "_j", "_key")


def drop_lossy(filled: DataFrame, window: int = S.WINDOW, most_percent: float = S.MAX_LOSS_PERCENT) -> DataFrame:
    """Rows of whole windows with at most most_percent incomplete rows; `pos` is counted anew."""
    bad = F.lit(False)
    for k in S.SENSORS:
        bad = bad | F.col(k).isNull()
    rows = filled.withColumn("win", F.floor(F.col("pos") / window).cast("long"))
    good = rows.groupBy("win").agg(F.count("*").alias("_n"), F.count_if(bad).alias("_bad")).where((F.col("_n") == window) & (100.0 * F.col("_bad") / window <= most_percent))
    return ranked(rows.join(good.select("win"), "win").withColumnRenamed("pos", "_old"), "_old", "pos").drop("_old", "win")


def interpolate(rows: DataFrame) -> DataFrame:
    """Missing sensor values by place between the nearest known ones; all values rounded half to even.

    Leading gaps stay missing, trailing ones take the last known value.
    """
    rows = around(rows, "pos", S.SENSORS)

    def value(k: str):
        a, b = F.col(f"_prev_{k}"), F.col(f"_next_{k}")
        between = a["v"] + (b["v"] - a["v"]) * (F.col("pos") - a["i"]) / (b["i"] - a["i"])
        return F.rint(F.when(F.col(k).isNotNull(), F.col(k)).when(a.isNull(), None).when(b.isNull(), a["v"]).otherwise(between))

    return rows.withColumns({k: value(k) for k in S.SENSORS}).drop(*(f"_{t}_{k}" for t in ("prev", "next") for k in S.SENSORS))


def clean(packets: DataFrame, label: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Repaired motion rows with `pos` (whole windows only), and one row of statistics.

    label names all rows; without it each row keeps its folder, and inserted rows take that of the row before.
    """
    filled = materialised(fill_missing(packets), "filled", lots=True)
    rows = materialised(interpolate(materialised(drop_lossy(filled), "kept", lots=True)), "clean", lots=True)
    folder = F.lit(label) if label is not None else None
    if folder is None:
        rows = around(rows, "pos", ["folder"]).withColumn("folder", F.coalesce("_prev_folder.v", "_next_folder.v")).drop("_prev_folder", "_next_folder")
    else:
        rows = rows.withColumn("folder", folder)
    whole = F.floor(F.count("*") / S.WINDOW).cast("long")
    before = filled.agg(F.count_if(~F.col("inserted")).alias("n_raw_motion"), F.count_if("inserted").alias("n_inserted"), whole.alias("_wins"), F.lit(0).cast("long").alias("n_final_windows"))
    zero = F.lit(0).cast("long")
    stats = before.union(rows.agg(zero, zero, zero, whole)).agg(*(F.sum(k).alias(k) for k in before.columns))
    loss = F.round(100.0 * F.col("n_inserted") / F.greatest(F.col("n_raw_motion") + F.col("n_inserted"), F.lit(1)), 2)
    return rows, stats.select("n_raw_motion", "n_inserted", loss.alias("loss_pct"), (F.col("_wins") - F.col("n_final_windows")).alias("n_discarded_wins"), "n_final_windows")
