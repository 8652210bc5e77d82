"""Signals from cleaned motion rows: scaling, median filter, zero-phase high-pass, gravity and total acceleration.

Median and filter run in one pass: rows are dealt out by spans of positions, each with BORDER rows lent from either side, over which the filter's
memory vanishes (its pole to that power is below 1e-16), and a kernel takes a span at once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from ..functions.expressions import highpass
from ..session import in_arrow, materialised
from .sequence import with_neighbours

#: Rows of a span, and rows that it borrows on either side.
SPAN, BORDER = 1 << 16, 4096
#: Rows of a step of the recurrence: its running sums are scaled by powers of the pole, which stay within 1e5.
STEP = 1024
CHANNELS = ("x", "y", "z", "z_gyro")


def scaled(rows: DataFrame) -> DataFrame:
    """pos, ts, folder and the used channels in g and degrees per second."""
    acc, gyro = S.ACC_RANGE, S.GYRO_RANGE
    return rows.select("pos", "ts", "folder", (F.col("ax") * acc / S.ADC).alias("x"), (-F.col("ay") * acc / S.ADC).alias("y"), (F.col("az") * acc / S.ADC).alias("z"), (F.col("gz") * gyro / S.ADC).alias("z_gyro"))


def _median(x: np.ndarray, reach: int) -> np.ndarray:
    """Running median of 2 * reach + 1 values; cut at the ends, missing values (NaN) are skipped."""
    wide = np.concatenate([np.full(reach, np.nan), x, np.full(reach, np.nan)])
    sets = np.sort(np.lib.stride_tricks.sliding_window_view(wide, 2 * reach + 1), axis=1)  # NaN last
    known = np.count_nonzero(~np.isnan(sets), axis=1)
    at = np.arange(len(x))
    low, high = sets[at, np.maximum(known - 1, 0) // 2], sets[at, np.minimum(known // 2, 2 * reach)]
    return np.where(known > 0, low + (high - low) * 0.5, np.nan)


def _recurrence(u: np.ndarray, pole: float) -> np.ndarray:
    """y_i = pole * y_(i-1) + u_i from 0: scaled running sums in steps, and one carry a step. Missing u add nothing."""
    n, q = len(u), np.arange(STEP, dtype=float)
    steps = np.zeros((-(-n // STEP), STEP))
    steps.ravel()[:n] = np.nan_to_num(u)
    steps = np.cumsum(steps * pole**-q, axis=1) * pole**q
    carry, hand_on = 0.0, pole ** (q + 1)
    for step in steps:
        step += carry * hand_on
        carry = step[-1]
    return steps.ravel()[:n]


def _high_passed(x: np.ndarray, first: bool, last: bool, b0: float, pole: float, pad: int) -> np.ndarray:
    """The high-pass forward and backward; where the recording begins or ends it is extended oddly by pad rows."""
    head = 2 * x[0] - x[pad:0:-1] if first else x[:0]
    tail = 2 * x[-1] - x[-2 : -2 - pad : -1] if last else x[:0]
    y = np.concatenate([head, x, tail])
    for _ in range(2):
        y = _recurrence(b0 * np.diff(y, prepend=y[:1]), pole)[::-1]
    return y[len(head) : len(y) - len(tail)]


def _in_spans(rows: DataFrame, compute, columns: tuple[str, ...], added: tuple[str, ...], border: int) -> DataFrame:
    """rows with the columns that compute(columns' values, first, last) makes of a span with its borders; first, last: whether it has the recording's ends."""
    n = rows.agg(F.max("pos")).first()[0]
    keep = [f for f in rows.schema if f.name not in added]
    names = [f.name for f in keep]
    schema = T.StructType([*keep, *(T.StructField(k, T.DoubleType()) for k in added)])

    def kernel(batches):
        here, held = None, []

        def made() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            pos = table["pos"].to_numpy()
            values = {k: table[k].to_numpy().astype(float) for k in columns}
            found = compute(values, pos[0] == 0, pos[-1] == n)
            own = pa.array(table["_own"].to_numpy(zero_copy_only=False))
            out = [table[k].combine_chunks() for k in names] + [pa.array(found[k], from_pandas=True) for k in added]
            out = [x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out]
            return pa.RecordBatch.from_arrays(out, [*names, *added]).filter(own)

        for batch in batches:
            span = batch.column("_b").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(span)) + 1).tolist(), len(span)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if here is not None and span[a] != here:
                    yield made()
                here = span[a]
                held.append(batch.slice(a, b - a))
        if held:
            yield made()

    spans = with_neighbours(rows, "pos", border, border, SPAN).where((F.col("_b") >= 0) & (F.col("_b") <= F.floor(F.lit(n or 0) / SPAN)))
    return in_arrow(spans.repartition("_b").sortWithinPartitions("_b", "pos"), kernel, schema)


def median_filtered(rows: DataFrame, columns=CHANNELS, reach: int = S.MEDIAN_REACH) -> DataFrame:
    """Centred running median of 2 * reach + 1 rows; the frame is cut at the ends, missing values are skipped."""
    return _in_spans(rows, lambda v, first, last: {k: _median(x, reach) for k, x in v.items()}, tuple(columns), tuple(columns), reach)


def _need(rows: DataFrame, pad: int) -> None:
    n = rows.agg(F.max("pos")).first()[0]
    if n is None or n + 1 <= pad:
        raise ValueError(f"the filter needs more than {pad} rows")


def zero_phase(rows: DataFrame, columns=("x", "y", "z"), cutoff_hz: float = S.HIGHPASS_HZ, rate_hz: float = S.RATE_HZ) -> DataFrame:
    """Adds x_ba ...: the first-order high-pass, forward and backward over the rows extended oddly at both ends.

    Needs more than FILTER_PAD rows. The filter's steady state makes the first output 0 in each direction.
    """
    (b0, pole), pad = highpass(cutoff_hz, rate_hz), S.FILTER_PAD
    _need(rows, pad)
    return _in_spans(rows, lambda v, first, last: {f"{k}_ba": _high_passed(x, first, last, b0, pole, pad) for k, x in v.items()}, tuple(columns), tuple(f"{k}_ba" for k in columns), BORDER)


def signals(rows: DataFrame) -> DataFrame:
    """pos, ts, folder, y_ga, z, z_gyro and tot_accel of each row."""
    (b0, pole), pad = highpass(), S.FILTER_PAD
    x = materialised(scaled(rows), "scaled", lots=True)
    _need(x, pad)

    def compute(v: dict, first: bool, last: bool) -> dict:
        v = {k: _median(x, S.MEDIAN_REACH) for k, x in v.items()}
        return v | {f"{k}_ba": _high_passed(v[k], first, last, b0, pole, pad) for k in ("x", "y", "z")}

    # Medians at the outermost borrowed rows see fewer values than they should; the filter forgets them as well.
    x = _in_spans(x, compute, CHANNELS, (*CHANNELS, "x_ba", "y_ba", "z_ba"), BORDER)
    total = F.sqrt(F.col("x_ba") * F.col("x_ba") + F.col("y_ba") * F.col("y_ba") + F.col("z_ba") * F.col("z_ba"))
    return x.select("pos", "ts", "folder", (F.col("y") - F.col("y_ba")).alias("y_ga"), "z", "z_gyro", total.alias("tot_accel"))
