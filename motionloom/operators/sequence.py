"""Order made explicit: positions, blocks and rows borrowed from neighbouring blocks.

Everything that the sensors' operators do depends on row order. A position column stands for it,
and no operator sorts all rows in one task: blocks of positions are handled apart, with the rows
they need from their neighbours, or with one carried value per block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import materialised

BLOCK = 4096
RANK_BLOCK = 1 << 16
#: Blocks that a task sorts at once where rows get many columns.
TASK_BLOCKS = 16


def running_total(df: DataFrame, key: str, value: Column, name: str, block: int = RANK_BLOCK) -> DataFrame:
    """Adds name: the sum of value (whole numbers) up to and including each row, in the order of key, a unique whole number.

    Totals per block of the key come first; their running sums have one row per block, and sums go on within blocks.
    """
    df = df.withColumn("_b", F.floor(F.col(key) / block).cast("long")).withColumn("_v", value.cast("long"))
    totals = df.groupBy("_b").agg(F.sum("_v").alias("_n"))
    before = totals.select("_b", (F.sum("_n").over(Window.orderBy("_b")) - F.col("_n")).alias("_before"))
    inside = F.sum("_v").over(Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(before, "_b").withColumn(name, F.col("_before") + inside).drop("_b", "_v", "_before")


def ranked(df: DataFrame, key: str, name: str, block: int = RANK_BLOCK) -> DataFrame:
    """Adds name: the row's place (from 0) in the order of key, a unique whole number."""
    return running_total(df, key, F.lit(1), name, block).withColumn(name, F.col(name) - 1)


def average_ranks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Adds _rank_x for each column x: the mean place (from 1) that its value has in the order of the column.

    Values are counted first and dealt out in ranges; ranges' totals have one row each, and sums go on within a range.
    """
    for x in columns:
        counts = df.groupBy(x).agg(F.count("*").alias("_n")).repartitionByRange(x).withColumn("_b", F.spark_partition_id())
        counts = materialised(counts, "values")  # the ranges stay as they are
        totals = counts.groupBy("_b").agg(F.sum("_n").alias("_t"))
        before = totals.select("_b", (F.sum("_t").over(Window.orderBy("_b")) - F.col("_t")).alias("_before"))
        inside = F.sum("_n").over(Window.partitionBy("_b").orderBy(x))
        ranks = counts.join(before, "_b").select(F.col(x).alias("_x"), (F.col("_before") + inside - (F.col("_n") - 1) / 2.0).alias(f"_rank_{x}"))
        df = df.join(ranks, F.col(x).eqNullSafe(F.col("_x"))).drop("_x")
    return df


def with_neighbours(df: DataFrame, key: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """Adds _b and _own: each row in its own block (_own) and, near a border, as a guest of the next one.

    A block gets the rows of `before` places before it and `after` places after it.
    """
    home = F.floor(F.col(key) / block).cast("long")
    first, last = F.floor((F.col(key) - after) / block).cast("long"), F.floor((F.col(key) + before) / block).cast("long")
    return df.withColumn("_home", home).withColumn("_b", F.explode(F.sequence(first, last))).withColumn("_own", F.col("_b") == F.col("_home")).drop("_home")


def neighbour_columns(df: DataFrame, key: str, before: int, after: int, make, block: int = BLOCK) -> DataFrame:
    """Adds the columns that make(window over the rows in order) names; rows see `before` and `after` places around their block."""
    window = Window.partitionBy("_b").orderBy(key)
    guests = with_neighbours(df, key, before, after, block)
    return guests.withColumns(make(window)).where("_own").drop("_b", "_own")


def around(df: DataFrame, key: str, columns: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Adds _prev_x and _next_x, structs of place and value of the nearest known value at or before / after each row.

    Tasks have TASK_BLOCKS blocks each, on average, however many rows there are: what they sort is wide. Rows travel to them without the structs.
    """
    last = df.agg(F.max(key)).first()[0]
    df = df.withColumn("_b", F.floor(F.col(key) / block).cast("long"))
    known = {x: F.when(F.col(x).isNotNull(), F.struct(F.col(key).alias("i"), F.col(x).alias("v"))) for x in columns}
    # Frames that look ahead are looked through in reverse order: a frame that only grows costs one step per row.
    past, future = (Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.asc("_b"), F.desc("_b")))  # one row per block
    carried = _ends(df, key, columns, known).select("_b", *(F.last(f"_last_{x}", True).over(past).alias(f"_before_{x}") for x in columns), *(F.last(f"_first_{x}", True).over(future).alias(f"_after_{x}") for x in columns))
    up, down = (Window.partitionBy("_b").orderBy(o).rowsBetween(Window.unboundedPreceding, 0) for o in (F.asc(key), F.desc(key)))
    df = df.repartition((last or 0) // (block * TASK_BLOCKS) + 1, "_b").join(carried, "_b").withColumns({f"_known_{x}": v for x, v in known.items()})
    df = df.withColumns({f"_prev_{x}": F.coalesce(F.last(f"_known_{x}", True).over(up), F.col(f"_before_{x}")) for x in columns} | {f"_next_{x}": F.coalesce(F.last(f"_known_{x}", True).over(down), F.col(f"_after_{x}")) for x in columns})
    return df.drop("_b", *(f"_{k}_{x}" for k in ("known", "before", "after") for x in columns))


def _ends(df: DataFrame, key: str, columns: Sequence[str], known: dict[str, Column]) -> DataFrame:
    """_b, _first_x and _last_x: the first and the last known value of each block.

    Numbers and their places are aggregated by hash. Spark sorts for the least and greatest struct, all that a task reads: only for what isn't a number, such as names.
    """
    numbers = [x for x in columns if isinstance(df.schema[x].dataType, T.NumericType)]
    names = [x for x in columns if x not in numbers]
    at = {x: F.when(F.col(x).isNotNull(), F.col(key)) for x in numbers}
    out = []
    if numbers:
        parts = [f.alias(f"_{n}_{x}") for x in numbers for n, f in (("i0", F.min(at[x])), ("v0", F.min_by(x, at[x])), ("i1", F.max(at[x])), ("v1", F.max_by(x, at[x])))]
        end = lambda x, n: F.when(F.col(f"_i{n}_{x}").isNotNull(), F.struct(F.col(f"_i{n}_{x}").alias("i"), F.col(f"_v{n}_{x}").alias("v")))
        out.append(df.groupBy("_b").agg(*parts).select("_b", *(end(x, n).alias(f"_{k}_{x}") for x in numbers for n, k in ((0, "first"), (1, "last")))))
    if names:
        out.append(df.groupBy("_b").agg(*(F.min(known[x]).alias(f"_first_{x}") for x in names), *(F.max(known[x]).alias(f"_last_{x}") for x in names)))
    return out[0].join(out[1], "_b") if len(out) > 1 else out[0]


def recurrence(df: DataFrame, key: str, inputs: dict[str, Column], pole: float, block: int = 1024) -> DataFrame:
    """Adds y for each name of inputs: y_i = pole * y_(i-1) + u_i, from y_(-1) = 0; key counts places from 0.

    Within a block y is a scaled running sum; what a block hands on is its last y. pole**block is so small
    that the three blocks before settle the carry in double precision, so that carries are a join and no scan.
    """
    q = (F.col(key) % block).cast("double")
    df = df.withColumn("_b", F.floor(F.col(key) / block).cast("long")).withColumns({f"_u_{k}": v for k, v in inputs.items()})
    run = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({f"_p_{k}": F.sum(F.col(f"_u_{k}") * F.pow(F.lit(pole), -q)).over(run) * F.pow(F.lit(pole), q) for k in inputs})
    ends = df.where(F.col(key) % block == block - 1).select("_b", *(f"_p_{k}" for k in inputs))
    terms = None
    for back in (1, 2, 3):
        x = ends.select((F.col("_b") + back).alias("_b"), *((F.col(f"_p_{k}") * pole ** (block * (back - 1))).alias(f"_c_{k}") for k in inputs))
        terms = x if terms is None else terms.union(x)
    carry = terms.groupBy("_b").agg(*(F.sum(f"_c_{k}").alias(f"_c_{k}") for k in inputs))
    df = df.join(carry, "_b", "left")
    return df.withColumns({k: F.col(f"_p_{k}") + F.coalesce(F.col(f"_c_{k}"), F.lit(0.0)) * F.pow(F.lit(pole), q + 1) for k in inputs}).drop("_b", *(f"_{t}_{k}" for t in "upc" for k in inputs))
