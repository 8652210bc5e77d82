"""An extension beyond batch: counter gaps of a live packet stream, by session.

Zero-phase filtering needs the future, so that streamed output is limited to what causal state can tell.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import schema as S

OUTPUT = "folder string, seq long, ts double, counter double, missing int"
STATE = "counter double, ts double"


def _gaps(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get[0] if state.exists else None
    for rows in batches:
        rows = rows.sort_values("seq")
        before = rows["counter"].shift(1)
        if last is not None and len(rows):
            before.iloc[0] = last
        step = ((rows["counter"] - before) % S.COUNTER_MODULUS).fillna(0).astype(int)
        hit = rows[step > 1].assign(missing=step[step > 1] - 1, folder=key[0])
        if len(rows):
            last = float(rows["counter"].iloc[-1])
            state.update((last, float(rows["ts"].iloc[-1])))
        yield hit[["folder", "seq", "ts", "counter", "missing"]]


def counter_gaps(packets: DataFrame) -> DataFrame:
    """Packets before which others are missing, and how many; works on a stream or a static table of motion packets."""
    return packets.where(packets["register"] == S.MOTION_REGISTER).groupBy("folder").applyInPandasWithState(_gaps, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
