"""Column expressions: binning, cumulative counts, whole-number distances, filters."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import schema as S


def digitise(x: Column, edges: Sequence[float]) -> Column:
    """Bin of x: how many inner edges it has reached; missing values and NaN fall into the last bin."""
    x = F.coalesce(x, F.lit(float("nan")))
    out = F.lit(0)
    for e in edges:
        out = out + (x >= F.lit(float(e))).cast("int")
    return out


def floored_log(x: Column) -> Column:
    return F.log(F.greatest(x, F.lit(S.LOG_FLOOR)))


def running(counts: Sequence[Column]) -> list[Column]:
    """Cumulative sums of a list of columns."""
    out: list[Column] = []
    for x in counts:
        out.append(out[-1] + x if out else x)
    return out


def l1(a: Column, b: Column) -> Column:
    """City-block distance of two arrays."""
    zero = F.lit(0).cast("double")
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), zero, lambda s, x: s + x)


def l1_whole(a: Column, b: Column) -> Column:
    """City-block distance of two arrays of whole numbers, exact."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


def shuffle_key(x: Column, seed: int) -> Column:
    """A pseudo-random order of whole numbers that any SQL engine can compute."""
    modulus = 2147483647
    mixed = F.pmod(x.cast("long") * F.lit(48271) + F.lit((seed + 1) * 7919), F.lit(modulus))
    return F.pmod(F.pmod(mixed * F.lit(69621), F.lit(modulus)) + F.shiftright(mixed, 7), F.lit(modulus))


#: The same in DuckDB's SQL.
SHUFFLE_KEY_SQL = "(((({x} * 48271 + ({seed} + 1) * 7919) % 2147483647) * 69621 % 2147483647 + ((({x} * 48271 + ({seed} + 1) * 7919) % 2147483647) >> 7)) % 2147483647)"


def highpass(cutoff_hz: float = S.HIGHPASS_HZ, rate_hz: float = S.RATE_HZ) -> tuple[float, float]:
    """b0 and the pole of the first-order Butterworth high-pass (bilinear transform)."""
    k = math.tan(math.pi * cutoff_hz / rate_hz)
    return 1 / (1 + k), (1 - k) / (1 + k)
