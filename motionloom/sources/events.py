"""The tables of the test data as sensor recordings.

The event stream stands in for a packet log by whole-number arithmetic alone, so that any SQL engine makes
the same packets: bursts of ten rows are lost out of each thousand, every fiftieth packet belongs to another register,
and four behaviours take turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: name: expression over event_id (i), hash (h) and behaviour (r), the same in Spark and DuckDB but for the division.
_FIELDS = {
    "ax": "h % 4096 - 2048 + 2000 * r",
    "ay": "{h7} % 8192 - 4096 - 3000 * r + 6000",
    "az": "{h11} % 8192 - 4096 + 2500 * (r - 1)",
    "gx": "{h13} % 2048 - 1024",
    "gy": "{h17} % 2048 - 1024",
    "gz": "({h19} % 4096 - 2048) * (1 + r)",
    "mx": "-30",
    "my": "-18",
    "mz": "-34",
}


def _select(divide: str, double: str, string: str) -> str:
    of = lambda a, b: divide.format(a=a, b=b)
    inner = f"SELECT event_id AS i, event_id * 7919 + user_id * 104729 + CAST(round(value * 100) AS BIGINT) * 31 AS h, {of('event_id', 240)} % 4 AS r FROM events WHERE NOT (event_id % 1000 BETWEEN 500 AND 509)"
    fields = ", ".join(f"CAST({v.format(**{f'h{n}': of('h', n) for n in (7, 11, 13, 17, 19)})} AS {double}) AS {k}" for k, v in _FIELDS.items())
    return f"SELECT i AS seq, CAST(1 AS {double}) AS command, CAST(CASE WHEN i % 50 = 49 THEN 33 ELSE 34 END AS {double}) AS register, 100 + i * CAST(0.005 AS {double}) AS ts, {fields}, CAST(i % 128 AS {double}) AS counter, 's' || CAST({of('i', 2500)} AS {string}) AS folder FROM ({inner}) e"


PACKETS_SQL = _select("({a} // {b})", "DOUBLE", "VARCHAR")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packet log of the event stream (schema.PACKETS)."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value")
    return spark.sql(_select("({a} DIV {b})", "DOUBLE", "STRING").replace("FROM events", "FROM {events}"), events=events)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """win, vec and label: the embeddings as precomputed features with reference labels."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("win"), F.col("embedding").alias("vec"), F.col("label").cast("int").alias("label"))


__all__ = ["PACKETS_SQL", "packets", "vectors"]
