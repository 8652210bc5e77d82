"""Session defaults and tables in the shared folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

ROOT = str(Path(__file__).resolve().parents[1])
#: Files for each core of the cluster that a written table has at most.
FILES = 4


def session(name: str = "motionloom", **conf: str) -> SparkSession:
    """A session with the settings that the operators are written for; conf overrides them."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | conf
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster shares (spark.checkpoint.dir).

    Where that setting is missing, a session within one machine (master local, as in tests) gets a
    temporary folder; a cluster gets an error, since its executors don't see each other's folders.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir", None) or getattr(context, "_motionloom_tables", None)
    if not base:
        if not context.master.split("[")[0] == "local":
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {context.master} share")
        base = context._motionloom_tables = tempfile.mkdtemp(prefix="motionloom-")
    return f"{base.rstrip('/')}/motionloom/{uuid.uuid4().hex}-{name}"


def compact(df: DataFrame, short: bool = True) -> DataFrame:
    """df in few partitions, so that few files are written.

    short: rows are a small digest of what they were made from; they are dealt out anew, to one partition a core, and what makes them
    keeps its tasks. Otherwise neighbouring partitions are taken together, up to FILES for each core, and their order stays.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if short else df.coalesce(FILES * cores)


def materialised(df: DataFrame, name: str, *, short: bool = False, barrier: bool = False, lots: bool = False) -> DataFrame:
    """df as a written table: cuts the lineage and survives lost executors. short: see compact; barrier: its last stage is a barrier stage, whose partitions stay.

    lots: partitions are lots of bounded size and stay as well, since a task that takes several in turn holds what it sorts for all of them.
    """
    spark, schema, path = df.sparkSession, df.schema, scratch(df.sparkSession, name)
    (df if barrier or lots else compact(df, short)).write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def in_arrow(df: DataFrame, kernel, schema: str | T.StructType, barrier: bool = False) -> DataFrame:
    """df.mapInArrow(kernel), with this library on the workers' import path."""
    env = df.sparkSession.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)
    return df.mapInArrow(kernel, schema, barrier=barrier)
