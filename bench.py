"""Times the headline queries; prints one line of JSON.

BENCH_SF_DIR (default /root/testdata/sf0.1) holds the tables, BENCH_CPUS (default 8) is the number of cores. Clustering
times cover the clustering call only, from the windows' vectors, as the published numbers do; the others cover
the whole query from its tables. The methods run on 1,195 windows, where the sampled ones take all rows (as published), and on 13,799,
where they take a sample of 10,000; the larger table has windows that begin every seven samples of the same recording.
HDBSCAN also runs on 47,028, every other sample. peak_mb is the most memory that all processes together have held.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from motionloom import schema as S  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from motionloom.operators import transport, windows  # noqa: E402
from motionloom.operators.sequence import ranked  # noqa: E402
from motionloom.plans import methods, pipeline  # noqa: E402
from motionloom.session import materialised, session  # noqa: E402
from motionloom.sources import events  # noqa: E402


def timed(run) -> float:
    began = time.perf_counter()
    run()
    return round(time.perf_counter() - began, 3)


def overlapping(signals, stride: int):
    """win and vec of the windows that begin every `stride` samples."""
    far = S.WINDOW * 10_000_000
    shifted = None
    for k in range(0, S.WINDOW, stride):
        x = signals.where(F.col("pos") >= k).withColumn("pos", F.col("pos") - k + far * (k // stride))
        shifted = x if shifted is None else shifted.union(x)
    found = windows.cumulative(windows.histograms(shifted)).withColumnRenamed("cdf", "vec")
    return ranked(materialised(found, "shifted").withColumnRenamed("win", "at"), "at", "win").select("win", "vec")


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()  # starts the session
    done = lambda df: df.write.format("noop").mode("overwrite").save()
    found: dict[str, float] = {}
    box: dict = {}

    def prepare() -> None:
        box["x"] = pipeline.prepare(events.packets(spark, d))
        done(box["x"].vectors)

    found["prepare_windows"] = timed(prepare)
    vectors = box["x"].vectors
    for n in (1195, 13_799):
        rows = vectors.where(f"win < {n}") if n <= 1566 else materialised(overlapping(box["x"].signals, 7).where(f"win < {n}"), "overlapping")
        for name in S.METHODS:
            found[f"{name}_{n}"] = timed(lambda name=name, rows=rows: done(methods.cluster(rows, name, neighbours_k=100).labels))
    rows = materialised(overlapping(box["x"].signals, 2).where("win < 47028"), "overlapping")
    found["hdbscan_47028"] = timed(lambda: done(methods.cluster(rows, "hdbscan").labels))
    joint = materialised(windows.joint(box["x"].signals).where("win < 400"), "joint")
    found["sliced_w1_400"] = timed(lambda: done(transport.joint_distances(joint, "sliced_w1")))
    found["exact_emd_400"] = timed(lambda: done(transport.joint_distances(joint, "exact_emd")))
    found["sinkhorn_400"] = timed(lambda: done(transport.joint_distances(joint, "sinkhorn", reg=0.5)))
    full = methods.ap_full(vectors.where("win < 1195")).labels
    found["seed_variance_1195"] = timed(lambda: pipeline.seed_variance(vectors.where("win < 1195"), "events", full, sample_size=400, strata=100))
    try:
        from motionloom.llm import queries as corpus
    except ImportError:
        corpus = None
    for name, query in sorted(corpus.QUERIES.items()) if corpus else ():
        found[name] = timed(lambda query=query: done(query(spark, d)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(found.values()), 3), "unit": "sec", "queries": found, "peak_mb": pipeline.peak_memory(), "sf": float(Path(d).name.removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
