"""Mixing sources to target weights along a time-varying curriculum.

Targets: sources in code-point order (null last) take the weights in turn and share
``share`` times all words; a source's target stops at ``max_repeats`` times its own
words, and the excess is shared again by weight until no source is above. The result
of that is one water level: target = min(cap, level * weight).

Positions: a source's documents form a supply line in a pseudo-random order, run
through up to max_repeats times. Its demand over training time t in [0, 1] is the
target times the integral of its weight schedule (piecewise linear, scaled to
integral 1). A copy that begins at word c of the line is used when demand reaches c:
its position is the inverse of the integral at c / target, in closed form for each linear
piece. A copy has a position if demand reaches it by time 1, and its words that demand reaches by then are taken: the document
in which demand ends is cut. Each copy is then range-sorted by its own position.

Defined cases. A null text has no words and size 0. Null sources are one source. Rows that
repeat a doc_id are documents of their own; those without one are ordered by a hash of their columns, which also decides between
rows with one doc_id. An empty table gives no rows. A source of no words
has target 0 and no positions. Other columns pass through, whatever their names.

Scale. Running sums need no task that holds a whole source: sources are cut into
buckets of the pseudo-random order (256 documents, or the square root of the largest
source), sums of buckets are added up first, then documents within a bucket. The
table of sources has one row per source.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as c

WEIGHTS, SHARE, MAX_REPEATS = (3.0, 1.0, 2.0), 1.5, 2
#: Schedules of the sources, in turn, as (time, weight): steady, rising, falling.
SCHEDULES = (((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)), ((0.0, 1.5), (0.5, 1.0), (1.0, 0.5)))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(c.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds place (from 0), weight and target to a table of source and source_size, one row each."""
    everything = Window.partitionBy()
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    x = sizes.withColumn("place", place).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights) + 1).cast("int")))
    x = x.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "place")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    x = x.withColumn("level", level).withColumn("filled", F.row_number().over(order))
    water = F.min_by("level", F.when(F.col("level") < F.col("ratio"), F.col("filled"))).over(everything)
    return x.withColumn("water", water).select("source", "source_size", "place", "weight", F.coalesce(F.least("cap", F.col("water") * F.col("weight")), "cap").alias("target"))


def position(u: Column, knots) -> Column:
    """Time at which the integral of a piecewise linear schedule, scaled to 1, reaches u."""
    pieces = [(t0, a, t1, b, (t1 - t0) * (a + b) / 2) for (t0, a), (t1, b) in zip(knots, knots[1:], strict=False)]
    total, done, out = sum(p[-1] for p in pieces), 0.0, None
    for t0, a, t1, b, area in pieces:
        need = u * total - F.lit(done)
        slope = (b - a) / (t1 - t0)
        at = need / a if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + need * 2 * slope, F.lit(0.0))) - a) / slope
        here = F.lit(t0) + F.least(F.greatest(at, F.lit(0.0)), F.lit(t1 - t0))
        out = F.when(need <= area, here) if out is None else out.when(need <= area, here)
        done += area
    return out.otherwise(F.lit(knots[-1][0]))


def mix(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """``_row`` of the columns in keep, size, source, source_size, target, taken, parts and positions (by copy) of each row.

    parts: words taken of each copy. positions: null for a copy of which nothing is taken.
    """
    row = F.struct(*(F.col(f"`{k}`") for k in keep)).alias("_row")
    tie = F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))))
    order = F.coalesce(c.order_key(F.col("doc_id")), F.pmod(tie, F.lit(1 << 31)))
    given = docs.select(row, F.col("doc_id").cast("long").alias("_id"), "source", F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("key"), n_words(F.col("text")).alias("size"), order.alias("order"), tie.alias("tie"))
    light = c.written(given if "text" not in keep else given.drop("_row"), "sizes")
    given = light if "text" not in keep else given
    sizes = c.written(light.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")), "sources")
    most = sizes.agg(F.max("n")).first()[0] or 1
    parts = 1 << max(0, math.ceil(math.log2(most / max(256, math.isqrt(most)))))
    bucket = F.floor(F.col("order") * parts / (1 << 31)).cast("long").alias("bucket")
    given, light = given.select("*", bucket), light.select("no", "key", "size", bucket)
    targets = source_targets(sizes.select("source", "source_size"), weights, share, max_repeats)
    targets = targets.select(F.col("source").isNull().alias("no"), F.coalesce("source", F.lit("")).alias("key"), "source_size", "target", "place")
    sums = light.groupBy("no", "key", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(Window.partitionBy("no", "key").orderBy("bucket")) - F.col("n"))
    sums = sums.join(targets, ["no", "key"]).drop("n")
    within = Window.partitionBy("no", "key", "bucket").orderBy("order", "_id", "size", "tie")
    begin = F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    x = given.withColumn("begin", begin)
    x = x.join(sums, ["no", "key", "bucket"]).withColumn("begin", F.col("before") + F.col("begin"))
    starts = [F.col("begin") + F.col("source_size") * k for k in range(max_repeats)]
    taken = [F.greatest(F.lit(0), F.least("size", F.floor("target") - s)).cast("long") for s in starts]

    def at(s: Column) -> Column:
        u, shape = s / F.col("target"), F.col("place") % len(schedules)
        out = F.when(shape == 0, position(u, schedules[0]))
        for k in range(1, len(schedules)):
            out = out.when(shape == k, position(u, schedules[k]))
        return out

    positions = F.array(*(F.when((t > 0) | (F.col("size") == 0) & (s < F.col("target")), at(s)) for s, t in zip(starts, taken, strict=True)))
    return x.select("_row", "_id", "order", "tie", "source", "size", "source_size", "target", F.array(*taken).alias("parts"), positions.alias("positions")).withColumn("taken", F.aggregate("parts", F.lit(0).cast("long"), lambda a, b: a + b))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The training order: docs' rows, once for each copy of which the mix takes at least half, range-sorted by position."""
    names = docs.columns
    x = mix(docs, keep=tuple(names), **options)
    copies = F.filter(F.transform("positions", lambda p, i: F.when((F.get("parts", i) * 2 >= F.col("size")), p)), lambda p: p.isNotNull())
    x = x.select("_row", "order", "_id", "tie", F.explode(copies).alias("position")).orderBy("position", "order", "_id", "tie")
    return x.select(*(F.col("_row").getField(k).alias(k) for k in names))
