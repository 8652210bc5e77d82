"""Distances between windows: all pairs, rectangular, nearest exemplars, nearest neighbours.

Two sides meet on a grid: rows fall into groups by a hash of their key, and each cell of the grid, one group of either side, is
one key of a shuffle. A row is sent once for each group of the other side, so that the bytes moved grow with the square root of
the number of cells. In its task a cell's left rows are held, its right rows stream by, and a kernel reduces each pair of
blocks at once (to the few nearest, or to pairs within a radius): memory is bounded by GROUP rows, and nothing of size N * N is stored unless asked for.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import shuffle_key
from ..session import in_arrow, materialised
from .sequence import ranked

#: Rows of a block, and right rows that a search for the nearest takes at once.
BLOCK, WIDE = 512, 16384
#: Distances that are summed up at once, and how many of them in a row: numpy takes an entry of one side against long runs of the other fastest.
TILE, WIDTH = 1 << 16, 1 << 13
#: Columns of a class, of which the least distance bounds the search for the nearest.
RUN = 16
#: Rows of a group at most, and pairs of rows that are worth a cell of their own.
GROUP, PAIRS = 1 << 14, 1 << 16
#: Candidates for the nearest that one task ranks, about.
RANKED = 1 << 20
#: Rows whose exact neighbours tell how many cells a search must ask.
TRIAL = 256


def cityblock(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two matrices, dimension by dimension on tiles that stay in the cache.

    Whole numbers are added as such, in 16 bits where the sums of the dimensions' ranges fit, or in single precision below 2**24; both are exact.
    """
    out = np.empty((len(a), len(b)))
    if not out.size or not a.shape[1]:
        out[:] = 0
        return out
    low, high = np.minimum(a.min(axis=0), b.min(axis=0)), np.maximum(a.max(axis=0), b.max(axis=0))
    most = max(-low.min(), high.max())
    whole = (a == np.rint(a)).all() and (b == np.rint(b)).all()
    sums, widest = ((high - low).sum(), (high - low).max()) if whole else (np.inf, np.inf)
    small = sums < 1 << 16 and max(widest, most) < 1 << 15
    kind = np.int16 if small else np.float32 if sums < 1 << 24 and most < 1 << 23 else np.float64
    return sums_of(np.ascontiguousarray(a.T, kind), np.ascontiguousarray(b.T, kind), out)


def sums_of(left: np.ndarray, right: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The distances of cityblock into out; a row of left and right is a dimension. 16-bit whole numbers wrap around, so that sums are right as numbers without a sign."""
    kind, many = left.dtype, right.shape[1]
    width = min(many, WIDTH)
    height = min(left.shape[1], max(1, TILE // max(width, 1)))
    spare = np.empty((2, height, width), kind)
    for i in range(0, left.shape[1], height):
        for j in range(0, many, width):
            x, y = left[:, i : i + height, None], right[:, None, j : j + width]
            room, total = spare[:, : x.shape[1], : y.shape[2]]
            np.abs(np.subtract(x[0], y[0], out=total), out=total)
            for k in range(1, len(x)):
                np.subtract(x[k], y[k], out=room)
                np.abs(room, out=room)
                total += room
            out[i : i + height, j : j + width] = total.view(np.uint16) if kind == np.int16 else total
    return out


def _grid(n_left: int, n_right: int, upper: bool, cores: int, cost: int = 1) -> tuple[int, int]:
    """Groups of either side: few rows each, and cells enough to keep the cores busy, as far as there is work for them; cost: of a pair, in city-block distances."""
    cells = min(4 * cores, -(-n_left * n_right * cost // PAIRS))
    left, right = -(-n_left // GROUP), -(-n_right // GROUP)
    if upper:
        while left * (left + 1) // 2 < cells:
            left += 1
        return max(1, left), max(1, left)
    left, right = max(1, left), max(1, right)
    while left * right < cells:
        if n_left / left >= n_right / right:
            left += 1
        else:
            right += 1
    return left, right


def _on_grid(kernel: Callable, names: tuple[str, ...], groups: int, upper: bool, block: int, wide: int):
    """Rows (cell, side, k, v), sorted, to the kernel's results on all pairs of blocks of each cell."""

    def run(batches):
        here, left, right = None, [], []

        def side(parts: list) -> tuple[np.ndarray, np.ndarray]:
            if len(parts) > 1:
                parts[:] = [(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            return parts[0]

        def blocks(parts: list, size: int):
            k, v = side(parts)
            for a in range(0, len(k), size):
                yield a, k[a : a + size], v[a : a + size]

        def made(lk, lv, rk, rv, same: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in kernel(lk, lv, rk, rv, same)], list(names))

        def meet():
            if left and right:
                for _, rk, rv in blocks(right, wide):
                    for _, lk, lv in blocks(left, block):
                        yield made(lk, lv, rk, rv, False)
            elif left and upper and here // groups == here % groups:  # a group with itself
                for a, lk, lv in blocks(left, block):
                    for b, rk, rv in blocks(left, block):
                        if a <= b:
                            yield made(lk, lv, rk, rv, a == b)
            right.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            cell, which, key = (batch.column(i).to_numpy() for i in range(3))
            vectors = batch.column(3).flatten().to_numpy().reshape(len(key), -1)
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(which) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)], strict=True):
                if cell[a] != here:
                    yield from meet()
                    left.clear()
                    here = int(cell[a])
                (right if which[a] else left).append((key[a:b], vectors[a:b]))
                if which[a] and sum(len(p[0]) for p in right) >= wide:
                    k, v = side(right)
                    whole = len(k) // wide * wide
                    right[:] = [(k[:whole], v[:whole])]
                    yield from meet()
                    right[:] = [(k[whole:], v[whole:])] if whole < len(k) else []
        yield from meet()

    return run


def block_join(left: DataFrame, right: DataFrame, kernel: Callable, names: tuple[str, ...] = ("i", "j", "d"), *, upper: bool = False, key: str = "win", other: str = "win", vec: str = "vec", block: int | None = None, wide: int | None = None, cost: int = 1) -> DataFrame:
    """Meets all blocks of two sides; kernel(left keys, left vectors, right keys, right vectors, same block) gives arrays of names.

    upper: each pair of blocks once, for symmetric joins of a table with itself. cost: of one pair, in city-block distances. Keys ascend in a block of `block` left or `wide` right rows.
    """
    block = block or BLOCK
    rows = lambda df, k: materialised(df.select(F.col(k).cast("long").alias("k"), F.col(vec).cast("array<double>").alias("v")), "rows")
    a = rows(left, key)
    b = a if right is left else rows(right, other)
    n = a.count()
    groups, others = _grid(n, n if b is a else b.count(), upper, left.sparkSession.sparkContext.defaultParallelism, cost)
    own = lambda g: F.pmod(F.xxhash64("k"), F.lit(g))
    side = lambda df, which, cells: df.select(F.explode(cells).alias("cell"), F.lit(which).alias("side"), "k", "v")
    span = lambda first, last: F.when(first <= last, F.sequence(first, last))
    if upper:  # cells (x, y), x <= y, counted row by row; where x = y the left rows stand for both
        x, place = own(groups), F.expr(f"cell DIV {groups} * (2 * {groups} - 1 - cell DIV {groups}) DIV 2 + cell % {groups}")
        met = side(a, 0, F.transform(span(x, F.lit(groups - 1)), lambda y: x * groups + y)).union(side(a, 1, F.transform(span(F.lit(0).cast("long"), x - 1), lambda y: y * groups + x)))
        cells = groups * (groups + 1) // 2
    else:
        place = F.col("cell")
        met = side(a, 0, F.transform(span(F.lit(0).cast("long"), F.lit(others - 1).cast("long")), lambda y: own(groups) * others + y))
        met = met.union(side(b, 1, F.transform(span(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")), lambda y: y * others + own(others))))
        cells = groups * others
    # One cell a task: by a hash of the cell some tasks would get several, the more the more cells there are.
    met = met.repartitionById(cells, place.cast("int")).sortWithinPartitions("cell", "side", "k")
    types = ["long"] * (len(names) - 1) + ["double"]
    return in_arrow(met, _on_grid(kernel, names, groups, upper, block, wide or block), ", ".join(f"{n} {t}" for n, t in zip(names, types, strict=True)))


def _seen(view: Callable | None) -> Callable:
    """Distances of two blocks, of their rows as view makes them; a right block, which meets many left ones in a row, is made once."""
    held = [None, None]

    def measure(lv: np.ndarray, rv: np.ndarray) -> np.ndarray:
        if view is None:
            return cityblock(lv, rv)
        if held[0] is not rv:
            held[:] = [rv, view(rv)]
        return cityblock(held[1] if lv is rv else view(lv), held[1])

    return measure


def pairs(df: DataFrame, *, key: str = "win", vec: str = "vec", radius: float | None = None, view: Callable | None = None, cost: int = 1) -> DataFrame:
    """i < j and d for all pairs of rows (within radius, if given); view: see cross."""
    measure = _seen(view)

    def kernel(lk, lv, rk, rv, same):
        d = measure(lv, rv)
        keep = (lk[:, None] < rk[None]) if same else np.ones(d.shape, bool)
        if radius is not None:
            keep &= d <= radius
        a, b = np.nonzero(keep)
        return np.minimum(lk[a], rk[b]), np.maximum(lk[a], rk[b]), d[a, b]

    return block_join(df, df, kernel, upper=True, key=key, other=key, vec=vec, cost=cost)


def cross(left: DataFrame, right: DataFrame, *, key: str = "win", other: str = "win", vec: str = "vec", view: Callable | None = None, cost: int = 1) -> DataFrame:
    """i, j and d for all rows of left (i) and right (j).

    view makes the longer rows that are compared out of those that travel, block by block; cost: of such a pair, in city-block distances.
    """
    measure = _seen(view)

    def kernel(lk, lv, rk, rv, _):
        d = measure(lv, rv)
        return np.repeat(lk, len(rk)), np.tile(rk, len(lk)), d.ravel()

    return block_join(left, right, kernel, key=key, other=other, vec=vec, cost=cost)


def _least(lk, lv, rk, rv, k: int):
    """Of each left row the k nearest right rows of this block (in ascending order of keys), ties by the lowest key."""
    d = cityblock(lv, rv)
    k = min(k, d.shape[1])
    if not d.size or np.isnan(d).any():
        order = np.lexsort((np.broadcast_to(rk, d.shape), d), axis=1)[:, :k]
        return np.repeat(lk, order.shape[1]), rk[order].ravel(), np.take_along_axis(d, order, 1).ravel()
    # The k nearest and all that tie with the last, and few more: the k-th least of the minima of disjoint classes of columns isn't below the k-th distance.
    classes = d.shape[1] // RUN if d.shape[1] >= RUN * k else d.shape[1]
    low = d[:, : RUN * classes].reshape(len(d), RUN, classes).min(axis=1) if classes < d.shape[1] else d
    a, b = np.nonzero(d <= np.partition(low, k - 1, axis=1)[:, k - 1 : k])
    near = d[a, b]
    order = np.lexsort((b, near, a))
    place = np.arange(len(a)) - np.searchsorted(a, a)
    order = order[place < k]
    return lk[a[order]], rk[b[order]], near[order]


def _ranks(x: DataFrame, k: int, left: int, right: int) -> DataFrame:
    """The k first of each i by d and j, with rank from 1; each of left rows has up to k candidates for WIDE of right rows.

    Candidates grow with the square of the rows and are packed well, so that partitions of few bytes would hold ever more of them: tasks are by their number.
    """
    parts = max(x.sparkSession.sparkContext.defaultParallelism, left * k * -(-right // WIDE) // RANKED)
    rank = F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))
    return x.repartition(parts, "i").withColumn("rank", rank).where(F.col("rank") <= k)


def nearest(df: DataFrame, exemplars: DataFrame, *, key: str = "win", other: str = "pos", vec: str = "vec", k: int = 1) -> DataFrame:
    """i, j and d: the k nearest exemplars of each row, ties by the lowest position; rank from 1 if k > 1."""
    x = block_join(df, exemplars, lambda lk, lv, rk, rv, _: _least(lk, lv, rk, rv, k), key=key, other=other, vec=vec, block=BLOCK // 4, wide=WIDE)
    if k == 1:
        return x.groupBy("i").agg(F.min(F.struct("d", "j")).alias("m")).select("i", "m.j", "m.d")
    return _ranks(x, k, df.count(), exemplars.count())


def _others(left: DataFrame, df: DataFrame, k: int, key: str, vec: str) -> DataFrame:
    """i, j, d and rank: the k nearest other rows in df of each row of left, exact, ties by the lowest key."""

    def kernel(lk, lv, rk, rv, _):
        i, j, d = _least(lk, lv, rk, rv, k + 1)
        keep = i != j
        return i[keep], j[keep], d[keep]

    x = block_join(left, df, kernel, key=key, other=key, vec=vec, block=BLOCK // 4, wide=WIDE)
    return _ranks(x, k, left.count(), df.count())


def neighbours(df: DataFrame, k: int, *, key: str = "win", vec: str = "vec") -> DataFrame:
    """i, j, d and rank: the k nearest other rows of each row, exact, ties by the lowest key."""
    return _others(df, df, k, key, vec)


def neighbours_in_cells(df: DataFrame, k: int, *, cells: int | None = None, probes: int | None = None, recall: float = 0.95, seed: int = 42, key: str = "win", vec: str = "vec") -> DataFrame:
    """neighbours, approximately: rows meet in cells around sampled centres; each row asks its nearest `probes` cells.

    Cells default to the square root of the rows (64 at least). Probes default to as many as find the share `recall` of the exact
    neighbours of TRIAL rows; if that is over half of the cells, they save too little and all rows are compared. A row whose
    cells hold fewer than k others is compared with all rows.
    """
    n = df.count()
    if n < 2:
        return neighbours(df, k, key=key, vec=vec)
    cells = min(n, cells or max(int(n**0.5), 64))
    centres = df.orderBy(shuffle_key(F.col(key), seed), key).limit(cells).select(vec, F.row_number().over(Window.orderBy(key)).cast("long").alias("pos"))
    centres = materialised(centres, "centres")
    if probes is None:
        home = nearest(df, centres, key=key, vec=vec).select(F.col("i").alias("_i"), F.col("j").alias("cell"))
        trial = materialised(df.orderBy(shuffle_key(F.col(key), seed + 1), key).limit(TRIAL).select(key, vec), "trial")
        order = nearest(trial, centres, key=key, vec=vec, k=max(cells, 2)).select("i", F.col("j").alias("cell"), F.col("rank").alias("asked"))
        wanted = _others(trial, df, k, key, vec).select("i", F.col("j").alias("_i")).join(home, "_i").join(order, ["i", "cell"])
        probes = int(wanted.agg(F.expr(f"percentile_disc({float(recall)}) WITHIN GROUP (ORDER BY asked)")).first()[0])
        if probes > cells // 2:
            return neighbours(df, k, key=key, vec=vec)
    probes = min(cells, probes)
    asked = materialised(nearest(df, centres, key=key, vec=vec, k=max(probes, 2)), "probes")
    rows = df.select(F.col(key).cast("long").alias("i"), F.col(vec).cast("array<double>").alias("v"))
    home = asked.where("rank = 1").select(F.col("j").alias("cell"), F.col("i").alias("_i")).join(rows.select(F.col("i").alias("_i"), F.col("v").alias("_v")), "_i")
    visits = asked.where(F.col("rank") <= probes).select(F.col("j").alias("cell"), "i").join(rows, "i")
    d = F.aggregate(F.zip_with("v", "_v", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
    met = visits.join(home, "cell").where("i <> _i").select("i", F.col("_i").alias("j"), d.alias("d"))
    met = materialised(met.withColumn("rank", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("rank") <= k), "met")
    full = met.where(F.col("rank") == min(k, n - 1)).select(F.col("i").alias(key))
    short = materialised(df.select(F.col(key).cast("long").alias(key), vec).join(full, key, "left_anti"), "short")
    if short.isEmpty():
        return met
    return met.join(short.select(F.col(key).alias("i")), "i", "left_anti").select("i", "j", "d", "rank").union(_others(short, df, k, key, vec).select("i", "j", "d", "rank"))


def similarity(edges: DataFrame, unit: float = 1.0) -> DataFrame:
    """Adds s = -(d / unit) ** 2."""
    d = F.col("d") / F.lit(float(unit))
    return edges.withColumn("s", -(d * d))


def min_affinity(df: DataFrame, *, mode: str = "exact", n_pairs: int = 500_000, seed: int = 42, unit: float = 1.0, key: str = "win", vec: str = "vec") -> float:
    """-(largest distance)**2 over all pairs, or over n_pairs random ones (at or above the exact value)."""
    if mode == "exact":
        biggest = block_join(df, df, lambda lk, lv, rk, rv, _: (lk[:1], rk[:1], np.array([cityblock(lv, rv).max()])), upper=True, key=key, other=key, vec=vec).agg(F.max("d")).first()[0]
    elif mode == "sampled":
        n = df.count()
        rows = ranked(df.select(key, F.col(vec).cast("array<double>").alias("v")), key, "_p").select("_p", "v")
        draws = df.sparkSession.range(n_pairs).select(F.pmod(shuffle_key(F.col("id"), seed), F.lit(n)).alias("a"), F.pmod(shuffle_key(F.col("id"), seed + 1), F.lit(n)).alias("b"))
        draws = draws.withColumn("b", F.when(F.col("a") == F.col("b"), (F.col("b") + 1) % n).otherwise(F.col("b")))
        met = draws.join(rows.select(F.col("_p").alias("a"), F.col("v").alias("va")), "a").join(rows.select(F.col("_p").alias("b"), F.col("v").alias("vb")), "b")
        biggest = met.agg(F.max(F.aggregate(F.zip_with("va", "vb", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x))).first()[0]
    else:
        raise ValueError(f"unknown mode {mode!r}")
    return -((biggest or 0.0) / unit) ** 2
