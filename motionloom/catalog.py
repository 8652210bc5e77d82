"""The registered queries of the sensor operators over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S
from .functions.expressions import floored_log
from .operators import affinity, clean, density, distance, metrics, sampling, signal, transport, windows
from .operators.sequence import ranked
from .plans import methods, oracle, pipeline
from .plans.oracle import sql
from .session import materialised, scratch
from .sources import events, files, matlab

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(oracle_sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def register(f):
        QUERIES[f.__name__] = f
        if oracle_sql:
            ORACLE_SQL[f.__name__] = oracle_sql
        return f

    return register


def _clean(spark: SparkSession, d: str) -> DataFrame:
    return clean.clean(events.packets(spark, d))[0]


def _signals(spark: SparkSession, d: str) -> DataFrame:
    return materialised(signal.signals(_clean(spark, d)), "signals")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    """win and vec: cumulative counts in 1/600."""
    return materialised(windows.cumulative(windows.histograms(_signals(spark, d))).withColumnRenamed("cdf", "vec"), "vectors")


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    """win, vec (whole thousandths) and label."""
    return events.vectors(spark, d).withColumn("vec", F.transform("vec", lambda x: F.round(x.cast("double") * 1000).cast("int")))


def _both(spark: SparkSession, d: str) -> DataFrame:
    """win, a (nearest of the first eight embeddings, some noise) and b (reference label)."""
    x = _embeddings(spark, d)
    near = distance.nearest(x, x.where("win < 8").select(F.col("win").alias("pos"), "vec"))
    a = F.when(F.col("i") % 13 == 5, -1).otherwise(F.col("j").cast("int"))
    return x.join(near.select(F.col("i").alias("win"), a.alias("a")), "win").select("win", "a", F.col("label").alias("b"))


def _labels(spark: SparkSession, d: str) -> DataFrame:
    """win, label (nearest of every sixteenth window; far ones noise) and folder of the windows."""
    signals = _signals(spark, d)
    v = windows.cumulative(windows.histograms(signals)).withColumnRenamed("cdf", "vec")
    near = distance.nearest(v, v.where("win % 16 = 0").select(F.floor(F.col("win") / 16).cast("long").alias("pos"), "vec"))
    label = F.when(F.col("d") > 500, -1).otherwise(F.col("j").cast("int"))
    return near.select(F.col("i").alias("win"), label.alias("label")).join(windows.representatives(signals).select("win", "folder"), "win")


def _rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


# Sources and repair


@query(sql("SELECT seq, command, register, ts, ax, gz, counter, folder FROM packets", "packets"))
def packet_log(spark, d):
    return events.packets(spark, d).select("seq", "command", "register", "ts", "ax", "gz", "counter", "folder")


@query(sql("SELECT seq AS line, command AS c0, register AS c1, CASE WHEN seq % 7 = 3 THEN NULL ELSE counter END AS c12, CASE WHEN seq % 5 = 0 THEN 1.5 END AS c14 FROM packets", "packets"))
def ragged_scan(spark, d):
    """Lines of varying width, with cells that aren't numbers, parsed as a packet log."""
    p = events.packets(spark, d)
    cells = [F.col("command").cast("string"), F.col("register").cast("string"), F.col("ts").cast("string"), *(F.col(k).cast("string") for k in S.SENSORS)]
    counter = F.when(F.col("seq") % 7 == 3, F.lit("n/a")).otherwise(F.col("counter").cast("string"))
    line = F.concat_ws(",", *cells, counter, F.when(F.col("seq") % 5 == 0, F.lit(",1.5")))
    head = spark.createDataFrame([(-1, "Command,RegisterAddress,Timestamp")], "_at long, value string")
    raw = files.ragged(head.union(p.select(F.col("seq").alias("_at"), line.alias("value"))))
    ids = ranked(p.select(F.col("seq").alias("line")), "line", "seq")
    return raw.join(ids, "seq").select("line", F.col("Command").alias("c0"), F.col("RegisterAddress").alias("c1"), F.col("DataElement9").alias("c12"), F.col("DataElement11").alias("c14"))


@query(ORACLE_SQL["ragged_scan"])
def log_files(spark, d):
    """The same lines written as several log files, each with a header, and read as one log."""
    p, path = events.packets(spark, d), scratch(spark, "logs")
    cells = [F.col("command").cast("string"), F.col("register").cast("string"), F.col("ts").cast("string"), *(F.col(k).cast("string") for k in S.SENSORS)]
    counter = F.when(F.col("seq") % 7 == 3, F.lit("n/a")).otherwise(F.col("counter").cast("string"))
    line = F.concat_ws(",", *cells, counter, F.when(F.col("seq") % 5 == 0, F.lit(",1.5")))
    lines = p.repartitionByRange(5, "seq").sortWithinPartitions("seq").select(line.alias("Command,RegisterAddress,Timestamp"))
    lines.write.option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    ids = ranked(p.select(F.col("seq").alias("line")), "line", "seq")
    raw = files.ragged_csv(spark, path)
    return raw.join(ids, "seq").select("line", F.col("Command").alias("c0"), F.col("RegisterAddress").alias("c1"), F.col("DataElement9").alias("c12"), F.col("DataElement11").alias("c14"))


@query(sql("SELECT win, label + 1 AS label FROM labelled", "labelled"))
def matlab_labels(spark, d):
    """Labels of the windows as the content of a MATLAB file, and read from it."""
    v = _vectors(spark, d)
    near = distance.nearest(v, v.where("win % 16 = 0").select(F.floor(F.col("win") / 16).cast("long").alias("pos"), "vec"))
    return matlab.labels_of(matlab.contents(near.select(F.col("i").alias("win"), (F.col("j") + 1).alias("label"))))


@query(sql("SELECT seq, ts, ax, counter FROM packets WHERE register = 34", "packets"))
def motion_filter(spark, d):
    return clean.motion(events.packets(spark, d)).select("seq", "ts", "ax", "counter")


@query(sql("SELECT pos, inserted, command, ts, counter, ax, folder FROM filled", "filled"))
def gap_fill(spark, d):
    return clean.fill_missing(events.packets(spark, d)).select("pos", "inserted", "command", "ts", "counter", "ax", "folder")


@query(sql("SELECT pos, ts, counter, ax FROM kept", "kept"))
def window_loss(spark, d):
    return clean.drop_lossy(clean.fill_missing(events.packets(spark, d))).select("pos", "ts", "counter", "ax")


@query(sql(f"SELECT pos, folder, {', '.join(S.SENSORS)} FROM clean", "clean"))
def interpolation(spark, d):
    return _clean(spark, d).select("pos", "folder", *S.SENSORS)


@query(sql("SELECT count(*) FILTER (WHERE NOT inserted) AS n_raw_motion, count(*) FILTER (WHERE inserted) AS n_inserted, round(100.0 * count(*) FILTER (WHERE inserted) / greatest(count(*), 1), 2)::DOUBLE AS loss_pct, count(*) // 60 - (SELECT count(*) // 60 FROM kept) AS n_discarded_wins, (SELECT count(*) // 60 FROM kept) AS n_final_windows FROM filled", "kept"))
def clean_stats(spark, d):
    return clean.clean(events.packets(spark, d))[1]


@query(sql(f"SELECT {float(S.MOTION_REGISTER)}::DOUBLE AS register, k.ts, k.counter, c.folder, {', '.join(f'c.{k}' for k in S.SENSORS)} FROM clean c JOIN kept k USING (pos) UNION ALL SELECT register, ts, counter, folder, {', '.join(S.SENSORS)} FROM packets WHERE register IS DISTINCT FROM {S.MOTION_REGISTER}", "clean"))
def cleaned_log(spark, d):
    """Repaired motion rows and other registers' packets, written as one table and read again."""
    path = scratch(spark, "cleaned")
    files.write_cleaned(_clean(spark, d), clean.others(events.packets(spark, d)), path)
    return files.read_cleaned(spark, path).select("register", "ts", "counter", "folder", *S.SENSORS)


# Signals


@query(sql("SELECT pos, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(z_gyro, 6) AS z_gyro FROM scaled", "scaled"))
def adc_scale(spark, d):
    x = signal.scaled(_clean(spark, d))
    return x.select("pos", *(F.round(k, 6).alias(k) for k in ("x", "y", "z", "z_gyro")))


@query(sql("SELECT pos, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(z_gyro, 6) AS z_gyro FROM med", "med"))
def median_filter(spark, d):
    x = signal.median_filtered(signal.scaled(_clean(spark, d)))
    return x.select("pos", *(F.round(k, 6).alias(k) for k in ("x", "y", "z", "z_gyro")))


@query(sql("SELECT pos, round(y_ga, 6) AS y_ga, round(tot_accel, 6) AS tot_accel, round(ln(greatest(tot_accel, 1e-10)), 5) AS log_tot FROM signals", "signals"))
def body_signals(spark, d):
    x = signal.signals(_clean(spark, d))
    return x.select("pos", F.round("y_ga", 6).alias("y_ga"), F.round("tot_accel", 6).alias("tot_accel"), F.round(floored_log(F.col("tot_accel")), 5).alias("log_tot"))


# Windows


@query(sql("SELECT * FROM hist", "hist"))
def window_histogram(spark, d):
    return windows.histograms(_signals(spark, d))


@query(sql("SELECT win, array_to_string(vec, ',') AS cdf FROM cdf", "cdf"))
def window_cdf(spark, d):
    return _vectors(spark, d).select("win", F.array_join(F.col("vec").cast("array<string>"), ",").alias("cdf"))


_SORTED = ", ".join(f"list_sort(list(({k} / {S.SCALES[k]})::FLOAT)) AS {k}" for k in windows.CHANNELS)


@query(sql(f"SELECT win, place, {', '.join(f'round({k}[place + 1]::DOUBLE, 4) AS {k}' for k in windows.CHANNELS)} FROM (SELECT win, {_SORTED}, unnest(range({S.WINDOW})) AS place FROM win GROUP BY win HAVING count(*) = {S.WINDOW})", "win"))
def window_quantiles(spark, d):
    q = windows.quantiles(_signals(spark, d)).withColumn("place", F.explode(F.sequence(F.lit(0), F.lit(S.WINDOW - 1))))
    return q.select("win", F.col("place").cast("long").alias("place"), *(F.round(F.get("q", F.col("place") + i * S.WINDOW).cast("double"), 4).alias(k) for i, k in enumerate(windows.CHANNELS)))


@query(sql("SELECT win, place, " + ", ".join(f"round(({k} / {S.SCALES[k]})::FLOAT::DOUBLE, 4) AS {k}" for k in windows.CHANNELS) + " FROM win WHERE win IN (SELECT win FROM reps)", "reps"))
def window_joint(spark, d):
    x = windows.joint(_signals(spark, d)).select("win", F.posexplode("pts").alias("place", "p"))
    return x.select("win", F.col("place").cast("long").alias("place"), *(F.round(F.col("p")[i].cast("double"), 4).alias(k) for i, k in enumerate(windows.CHANNELS)))


@query(sql("SELECT * FROM reps", "reps"))
def window_representatives(spark, d):
    return windows.representatives(_clean(spark, d))


@query(sql("SELECT l.win, l.label + 1 AS ClusterIdx, r.ts_mid AS Timestamp, r.folder AS Folder_Name FROM seq_labels l JOIN reps r USING (win)", "seq_labels"))
def result_table(spark, d):
    return files.result_table(_labels(spark, d).select("win", "label"), windows.representatives(_clean(spark, d)))


@query(sql("SELECT l.win, r.ts_start AS Timestamp, l.label AS ClusterIdx, 'sliced_w1' AS Method FROM labelled l JOIN reps r USING (win)", "labelled"))
def joint_result_table(spark, d):
    signals = _signals(spark, d)
    v = windows.cumulative(windows.histograms(signals)).withColumnRenamed("cdf", "vec")
    near = distance.nearest(v, v.where("win % 16 = 0").select(F.floor(F.col("win") / 16).cast("long").alias("pos"), "vec"))
    return files.joint_result_table(near.select(F.col("i").alias("win"), F.col("j").alias("label")), windows.representatives(signals), "sliced_w1")


@query(sql("SELECT CASE WHEN l.label = -1 THEN -1 ELSE l.label END AS label, r.ts_mid AS Timestamp, r.folder AS Folder_Name FROM seq_labels l JOIN reps r USING (win)", "seq_labels"))
def label_scan(spark, d):
    """A result table written as CSV and read back as labels."""
    path = scratch(spark, "labels")
    files.write_csv(files.result_table(_labels(spark, d).select("win", "label"), windows.representatives(_clean(spark, d))).drop("win"), path)
    return files.read_labels(spark, path)


@query(sql("SELECT win, label FROM labelled", "labelled"))
def stored_result(spark, d):
    """A clustering put into the result store and taken out again."""
    x = _vectors(spark, d)
    near = distance.nearest(x, x.where("win % 16 = 0").select(F.floor(F.col("win") / 16).cast("long").alias("pos"), "vec"))
    found = methods.Clustering(near.select(F.col("i").alias("win"), F.col("j").cast("int").alias("label")), None, -1.5, 2.0)
    store = pipeline.Store(spark, scratch(spark, "store"))
    store.put("events", "nearest", {"every": 16}, found)
    return store.get("events", "nearest", {"every": 16}, x.count()).labels.select("win", "label")


@query(sql("SELECT l.win, r.ts_mid AS ts, r.folder, l.label AS label_full, s.label AS label_sampled, l.win % 16 = 0 AS is_ex_full, l.win % 32 = 0 AS is_ex_sampled, array_to_string(c.vec, ',') AS vec FROM labelled l JOIN (SELECT win, arg_min(pos, (d, pos))::INT AS label FROM to_ex WHERE pos % 2 = 0 GROUP BY win) s USING (win) JOIN reps r USING (win) JOIN cdf c USING (win)", "labelled"))
def bundle_table(spark, d):
    """Both labellings, their exemplars and the vectors of all windows, written and read again."""
    signals = _signals(spark, d)
    v = materialised(windows.cumulative(windows.histograms(signals)).withColumnRenamed("cdf", "vec"), "vectors")
    near = lambda n: distance.nearest(v, v.where(f"win % {n} = 0").select(F.floor(F.col("win") / 16).cast("long").alias("pos"), "vec")).select(F.col("i").alias("win"), F.col("j").cast("int").alias("label"))
    marks = lambda n: v.where(f"win % {n} = 0").select("win")
    table = materialised(files.bundle(v, windows.representatives(signals), near(16), near(32), marks(16), marks(32)), "bundle")
    return table.withColumn("vec", F.array_join(F.col("vec").cast("array<string>"), ","))


@query("SELECT 'd' || (vec_id % 3) AS dataset, 'm' || vec_id AS method, CASE WHEN vec_id % 4 > 0 THEN vec_id / 8.0::DOUBLE END AS t_dist_s, label * 0.5::DOUBLE AS t_algo_s, vec_id / 4.0::DOUBLE AS t_s FROM embeddings WHERE vec_id % 5 > 0")
def recorded_timings(spark, d):
    """Seconds of earlier runs, written as CSV with missing and foreign cells, and read again."""
    x, path = events.vectors(spark, d), scratch(spark, "timings")
    seconds = [F.when(F.col("win") % 4 > 0, F.col("win") / 8.0).alias("t_dist_s"), (F.col("label") * 0.5).alias("t_algo_s"), F.when(F.col("win") % 5 > 0, (F.col("win") / 4.0).cast("string")).otherwise("n/a").alias("t_s")]
    files.write_csv(x.select(F.concat(F.lit("d"), F.col("win") % 3).alias("dataset"), F.concat(F.lit("m"), "win").alias("method"), *seconds), path)
    return files.timings(spark, path)


# Distances


@query(sql("SELECT a.win AS i, b.win AS j, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2])))::BIGINT AS d FROM cdf a JOIN cdf b ON a.win < b.win", "cdf"))
def pairwise_l1(spark, d):
    return distance.pairs(_vectors(spark, d)).select("i", "j", F.col("d").cast("long").alias("d"))


@query(sql("SELECT win AS i, pos AS j, d FROM to_ex", "to_ex"))
def rectangular_l1(spark, d):
    v = _vectors(spark, d)
    ex = v.where("win % 16 = 0").select(F.floor(F.col("win") / 16).cast("long").alias("pos"), "vec")
    return distance.cross(v, ex, other="pos").select("i", "j", F.col("d").cast("long").alias("d"))


@query(sql("SELECT win, label AS pos, d FROM labelled", "labelled"))
def nearest_exemplar(spark, d):
    v = _vectors(spark, d)
    ex = v.where("win % 16 = 0").select(F.floor(F.col("win") / 16).cast("long").alias("pos"), "vec")
    return distance.nearest(v, ex).select(F.col("i").alias("win"), F.col("j").cast("int").alias("pos"), F.col("d").cast("long").alias("d"))


@query(sql("SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM emb_d WHERE i <> j) WHERE rank <= 5", "emb_d"))
def k_nearest(spark, d):
    return distance.neighbours(_embeddings(spark, d), 5).select("i", "j", F.col("d").cast("long").alias("d"), F.col("rank").cast("long").alias("rank"))


@query(sql("SELECT i, j, round(-(d / 1000.0) * (d / 1000.0), 4) AS s FROM emb_d WHERE i < j", "emb_d"))
def similarity_edges(spark, d):
    return distance.similarity(distance.pairs(_embeddings(spark, d)), 1000).select("i", "j", F.round("s", 4).alias("s"))


@query(sql("SELECT round(-(max(d) / 1000.0) * (max(d) / 1000.0), 4) AS preference FROM emb_d", "emb_d"))
def min_affinity(spark, d):
    return _rows(spark, [{"preference": round(distance.min_affinity(_embeddings(spark, d), unit=1000), 4)}], "preference double")


_DRAWS = f"""draws AS (SELECT a, CASE WHEN a = b THEN (b + 1) % n ELSE b END AS b FROM (SELECT {oracle.order_key('id', 42)} % n AS a, {oracle.order_key('id', 43)} % n AS b, n FROM (SELECT unnest(range(500000)) AS id), (SELECT count(*) AS n FROM emb))),
pos AS (SELECT win, row_number() OVER (ORDER BY win) - 1 AS p FROM emb)"""


@query(sql("SELECT round(-(max(e.d) / 1000.0) * (max(e.d) / 1000.0), 4) AS preference FROM draws JOIN pos x ON x.p = a JOIN pos y ON y.p = b JOIN emb_d e ON e.i = x.win AND e.j = y.win", "emb_d").replace("\nSELECT", f", {_DRAWS}\nSELECT", 1))
def min_affinity_sampled(spark, d):
    """The least similarity of 500,000 random pairs."""
    return _rows(spark, [{"preference": round(distance.min_affinity(_embeddings(spark, d), mode="sampled", unit=1000), 4)}], "preference double")


@query(ORACLE_SQL["k_nearest"])
def k_nearest_in_cells(spark, d):
    """The search in cells; it compares all rows where cells would lose too many neighbours, as they would here."""
    return distance.neighbours_in_cells(_embeddings(spark, d), 5).select("i", "j", F.col("d").cast("long").alias("d"), F.col("rank").cast("long").alias("rank"))


_SCALE = float(S.WINDOW * transport.DIRECTIONS)
_PROJECTED = ", ".join("list_sort(list((" + " + ".join(f"({k} / {S.SCALES[k]})::FLOAT::DOUBLE * {float(v) / _SCALE!r}::DOUBLE" for k, v in zip(windows.CHANNELS, u, strict=True)) + f") ORDER BY place)) AS v{n}" for n, u in enumerate(transport.directions()))
_SLICED = f"sliced AS (SELECT win, {_PROJECTED} FROM win GROUP BY win HAVING count(*) = {S.WINDOW}), flat AS (SELECT win, flatten([{', '.join(f'v{n}' for n in range(transport.DIRECTIONS))}]) AS vec FROM sliced)"


@query(sql("SELECT a.win AS i, b.win AS j, round(list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: abs(p[1] - p[2]))), 5) AS d FROM flat a JOIN flat b ON a.win < b.win", "win").replace("\nSELECT", f", {_SLICED}\nSELECT", 1))
def sliced_distance(spark, d):
    return transport.joint_distances(windows.joint(_signals(spark, d)), "sliced_w1").select("i", "j", F.round("d", 5).alias("d"))


@query()
def exact_transport(spark, d):
    return transport.joint_distances(windows.joint(_signals(spark, d)), "exact_emd")


@query()
def entropic_transport(spark, d):
    return transport.joint_distances(windows.joint(_signals(spark, d)), "sinkhorn", reg=0.5)


#: Clouds of four points in four dimensions from the vectors, in thousandths: sums of four neighbouring entries each. Small enough for SQL, which tries all assignments.
_CLOUDS = """pts AS (SELECT win, list_transform(range(4), lambda k: list_transform(range(4), lambda c: list_sum(vec[16 * k + 4 * c + 1 : 16 * k + 4 * c + 4]) / 1000.0::DOUBLE)) AS p FROM emb),
cost AS (SELECT x.win AS i, y.win AS j, list_transform(range(16), lambda m: list_sum(list_transform(range(4), lambda c: abs(x.p[m // 4 + 1][c + 1] - y.p[m % 4 + 1][c + 1])))) AS m FROM pts x JOIN pts y ON y.win % 16 = 0)"""
_ORDERS = "orders AS (SELECT a.k AS a, b.k AS b, c.k AS c, d.k AS d FROM (SELECT unnest(range(4)) AS k) a, (SELECT unnest(range(4)) AS k) b, (SELECT unnest(range(4)) AS k) c, (SELECT unnest(range(4)) AS k) d WHERE len(list_distinct([a.k, b.k, c.k, d.k])) = 4)"
_SCALED = """k AS (SELECT i, j, m, list_transform(m, lambda x: exp(-x / 0.5::DOUBLE)) AS k FROM cost),
plans(i, j, u, v, step) AS (
  SELECT i, j, NULL::DOUBLE[], [1.0, 1.0, 1.0, 1.0]::DOUBLE[], 0 FROM k
  UNION ALL
  SELECT i, j, u, list_transform(range(4), lambda b: 0.25::DOUBLE / (u[1] * k[b + 1] + u[2] * k[b + 5] + u[3] * k[b + 9] + u[4] * k[b + 13])), step FROM (
    SELECT i, j, k, list_transform(range(4), lambda a: 0.25::DOUBLE / (k[4 * a + 1] * v[1] + k[4 * a + 2] * v[2] + k[4 * a + 3] * v[3] + k[4 * a + 4] * v[4])) AS u, step + 1 AS step FROM plans JOIN k USING (i, j) WHERE step < 200)
)"""


def _clouds(spark, d):
    x = _embeddings(spark, d)
    point = lambda k: F.array(*(sum((F.col("vec")[16 * k + 4 * c + e] for e in range(1, 4)), F.col("vec")[16 * k + 4 * c]) / 1000.0 for c in range(4)))
    return x.select("win", F.array(*(point(k) for k in range(4))).alias("pts"))


@query(sql("SELECT i, j, round(min(m[a + 1] + m[b + 5] + m[c + 9] + m[d + 13]) / 4, 6) AS d FROM cost, orders GROUP BY i, j", "emb").replace("\nSELECT", f", {_CLOUDS}, {_ORDERS}\nSELECT", 1))
def exact_transport_of_points(spark, d):
    """Exact transport between clouds of few points: all rows against every sixteenth."""
    x = _clouds(spark, d)
    return transport.joint_distances(x, "exact_emd", x.where("win % 16 = 0")).select("i", "j", F.round("d", 6).alias("d"))


@query(oracle.recursive(f"{_CLOUDS}, {_SCALED}", "SELECT i, j, round(list_sum(list_transform(range(16), lambda e: u[e // 4 + 1] * k[e + 1] * v[e % 4 + 1] * m[e + 1])), 6) AS d, true AS converged FROM plans JOIN k USING (i, j) WHERE step = 200", "emb"))
def entropic_transport_of_points(spark, d):
    """Entropic transport between clouds of few points: all rows against every sixteenth."""
    x = _clouds(spark, d)
    return transport.joint_distances(x, "sinkhorn", x.where("win % 16 = 0"), reg=0.5).select("i", "j", F.round("d", 6).alias("d"), "converged")


# Samples


@query(sql(f"SELECT win FROM emb ORDER BY {oracle.order_key('win', 42)}, win LIMIT 100", "emb"))
def uniform_sample(spark, d):
    return sampling.uniform(_embeddings(spark, d), 100).select("win")


@query(sql(f"SELECT win, CASE WHEN row_number() OVER (ORDER BY {oracle.order_key('win', 42)}, win) <= (SELECT count(*) // 2 FROM emb) THEN 'A' ELSE 'B' END AS half FROM emb", "emb"))
def split_half(spark, d):
    return sampling.split_half(_embeddings(spark, d)).select("win", "half")


_CORESET = f"""picked(pos, wins) AS (
  SELECT 0, [(SELECT win FROM emb ORDER BY {oracle.order_key('win', 0)}, win LIMIT 1)]
  UNION ALL
  SELECT pos + 1, list_append(wins, (SELECT arg_min(i, (-m, i)) FROM (SELECT i, min(d) AS m FROM emb_d WHERE list_contains(wins, j) GROUP BY i))) FROM picked WHERE pos < 24
)"""


@query(sql("SELECT pos::BIGINT AS pos, wins[pos + 1] AS win FROM picked", "emb_d").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT", f", {_CORESET}\nSELECT", 1))
def coreset_sample(spark, d):
    return sampling.k_centres(_embeddings(spark, d), 25).select("pos", "win")


@query(sql(f"SELECT draw, place, count(*) AS n FROM (SELECT id // (SELECT count(*) FROM emb) AS draw, {oracle.order_key('id', 0)} % (SELECT count(*) FROM emb) AS place FROM (SELECT unnest(range(20 * (SELECT count(*) FROM emb))) AS id)) JOIN emb ON win = place GROUP BY 1, 2", "emb"))
def bootstrap_sample(spark, d):
    """How often each row is drawn in twenty resamples with replacement."""
    x = _embeddings(spark, d).select(F.col("win").alias("place"))
    return sampling.bootstrap(x, 20, x.count()).groupBy("draw", "place").agg(F.count("*").alias("n"))


@query()
def kmeans_sample(spark, d):
    return sampling.k_means_representatives(_embeddings(spark, d), 25).select("win")


@query()
def stratified_sample(spark, d):
    return sampling.stratified(_embeddings(spark, d), 100, 10).select("win")


# Scores


@query(sql("SELECT count(*) FILTER (WHERE a >= 0) AS n_clusters, avg(n) FILTER (WHERE a >= 0) AS size_mean, round(stddev_pop(n) FILTER (WHERE a >= 0), 6) AS size_std, min(n) FILTER (WHERE a >= 0) AS size_min, max(n) FILTER (WHERE a >= 0) AS size_max, coalesce(sum(n) FILTER (WHERE a < 0), 0)::BIGINT AS n_noise, round(100.0 * coalesce(sum(n) FILTER (WHERE a < 0), 0) / sum(n), 2)::DOUBLE AS noise_pct FROM (SELECT a, count(*) AS n FROM ab GROUP BY a)", "ab"))
def cluster_stats(spark, d):
    return metrics.cluster_stats(_both(spark, d).select("win", F.col("a").alias("label"))).withColumn("size_std", F.round("size_std", 6))


@query(sql("SELECT a AS label, count(*) AS n FROM ab WHERE a >= 0 GROUP BY a ORDER BY n DESC, a LIMIT 5", "ab"))
def top_clusters(spark, d):
    return metrics.top_clusters(_both(spark, d).select("win", F.col("a").alias("label")))


@query(sql("SELECT a, b, count(*) AS n FROM ab WHERE a >= 0 AND b >= 0 GROUP BY a, b", "ab"))
def contingency(spark, d):
    return metrics.contingency(_both(spark, d))


#: The best matching by dynamic programming: row by row, over the sets of columns (as bits) that are taken.
_MATCHED = """cells AS (SELECT a, b, count(*) AS n FROM ab WHERE a >= 0 AND b >= 0 GROUP BY a, b),
rows_ AS (SELECT a, row_number() OVER (ORDER BY a) AS r FROM (SELECT DISTINCT a FROM cells)),
cols_ AS (SELECT b, (1 << (row_number() OVER (ORDER BY b) - 1))::BIGINT AS bit FROM (SELECT DISTINCT b FROM cells)),
best(r, mask, total, pairs) AS (
  SELECT 0::BIGINT, 0::BIGINT, 0::BIGINT, []::STRUCT(a INT, b INT, n BIGINT)[]
  UNION ALL
  SELECT r, mask, max(total), arg_min(pairs, {'least': -total, 'pairs': pairs}) FROM (
    SELECT best.r + 1 AS r, mask | coalesce(c.bit, 0) AS mask, total + coalesce(x.n, 0) AS total, CASE WHEN x.n > 0 THEN list_append(pairs, {'a': w.a::INT, 'b': c.b::INT, 'n': x.n}) ELSE pairs END AS pairs
    FROM best JOIN rows_ w ON w.r = best.r + 1 LEFT JOIN (SELECT * FROM cols_ UNION ALL SELECT NULL, 0) c ON (mask & c.bit) = 0 LEFT JOIN cells x ON x.a = w.a AND x.b = c.b
  ) GROUP BY r, mask
)"""


@query(sql("SELECT p.a::BIGINT AS a, p.b::BIGINT AS b, p.n AS n FROM (SELECT unnest(pairs) AS p FROM (SELECT pairs FROM best WHERE r = (SELECT count(*) FROM rows_) ORDER BY total DESC, pairs LIMIT 1))", "ab").replace("WITH ", "WITH RECURSIVE ", 1).replace("\nSELECT", f", {_MATCHED}\nSELECT", 1))
def matched_clusters(spark, d):
    """Pairs of clusters of two labellings with the greatest overlap in all; of equal matchings the first list of pairs."""
    table, a, b = metrics.table_of(metrics.contingency(_both(spark, d)))
    return _rows(spark, [{"a": int(a[i]), "b": int(b[j]), "n": int(table[i, j])} for i, j in metrics.match_clusters(table)], "a long, b long, n long")


_AGREE = """
, cells AS (SELECT a, b, count(*)::DOUBLE AS n FROM ab WHERE a >= 0 {more} GROUP BY a, b),
ra AS (SELECT sum(n) AS n FROM cells GROUP BY a), rb AS (SELECT sum(n) AS n FROM cells GROUP BY b),
v AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM cells) AS pc, (SELECT sum(n * (n - 1) / 2) FROM ra) AS pa, (SELECT sum(n * (n - 1) / 2) FROM rb) AS pb, (SELECT sum(n) FROM cells) AS t,
  (SELECT sum(n * ln(n)) FROM cells) AS hc, (SELECT sum(n * ln(n)) FROM ra) AS ha, (SELECT sum(n * ln(n)) FROM rb) AS hb),
x AS (SELECT *, t * (t - 1) / 2 AS pt FROM v),
agree AS (SELECT round((pt + 2 * pc - pa - pb) / pt, 4) AS ri, round((pc - pa * pb / pt) / ((pa + pb) / 2 - pa * pb / pt), 4) AS ari,
  round(2 * (ln(t) + (hc - ha - hb) / t) / (2 * ln(t) - (ha + hb) / t), 4) AS nmi FROM x)
"""


@query(sql("", "ab").rstrip() + _AGREE.format(more="") + "SELECT * FROM agree")
def agreement(spark, d):
    return metrics.agreement(_both(spark, d))


@query(sql("", "ab").rstrip() + _AGREE.format(more="AND b >= 0") + "SELECT ari, nmi, CASE WHEN ari > 0.8 THEN 'excellent' WHEN ari > 0.5 THEN 'good' WHEN ari > 0.2 THEN 'moderate' ELSE 'low' END AS verdict FROM agree")
def label_comparison(spark, d):
    return metrics.compare(_both(spark, d))


_AMI = """cells AS (SELECT a, b, count(*)::DOUBLE AS n FROM ab GROUP BY a, b), ra AS (SELECT a, sum(n) AS x FROM cells GROUP BY a), rb AS (SELECT b, sum(n) AS y FROM cells GROUP BY b),
t AS (SELECT sum(n) AS t FROM cells),
h AS (SELECT (SELECT sum(n / t * ln(n * t / (x * y))) FROM cells JOIN ra USING (a) JOIN rb USING (b), t) AS mi, (SELECT -sum(x / t * ln(x / t)) FROM ra, t) AS ha, (SELECT -sum(y / t * ln(y / t)) FROM rb, t) AS hb),
k AS (SELECT x, y, t, unnest(range(greatest(1, x + y - t)::BIGINT, least(x, y)::BIGINT + 1))::DOUBLE AS k FROM ra, rb, t),
e AS (SELECT sum(k / t * ln(t * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(t - x + 1) + lgamma(t - y + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(t - x - y + k + 1))) AS e FROM k)"""


@query(sql("SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM h, e", "ab").replace("\nSELECT", f", {_AMI}\nSELECT", 1))
def adjusted_mutual_information(spark, d):
    return _rows(spark, [{"ami": round(metrics.ami(_both(spark, d)), 6)}], "ami double")


@query(sql("SELECT label, round(count(*) / (SELECT count(*) FROM seq_labels), 6) AS share FROM seq_labels WHERE label >= 0 GROUP BY label", "seq_labels"))
def occupancy(spark, d):
    return metrics.occupancy(_labels(spark, d)).select("label", F.round("share", 6).alias("share"))


@query(sql("SELECT a, b, n, round(n / sum(n) OVER (PARTITION BY a), 6) AS p FROM (SELECT label AS a, b, count(*) AS n FROM (SELECT label, folder, lead(label) OVER (ORDER BY win) AS b, lead(folder) OVER (ORDER BY win) AS f FROM seq_labels) WHERE folder = f AND label >= 0 AND b >= 0 GROUP BY 1, 2)", "seq_labels"))
def transition_matrix(spark, d):
    return metrics.transitions(_labels(spark, d)).select("a", "b", "n", F.round("p", 6).alias("p"))


@query(sql("SELECT count(DISTINCT label) AS k, sum(n)::BIGINT AS n_windows, round(avg(n), 4) AS mean_run, median(n)::DOUBLE AS median_run, max(n) AS max_run, round(0.3::DOUBLE * avg(n), 4) AS mean_dur_s, round(100.0::DOUBLE * count(*) FILTER (WHERE n = 1) / count(*), 2) AS pct_single FROM (SELECT label, run, count(*) AS n FROM (SELECT label, sum(c) OVER (ORDER BY win) AS run FROM (SELECT win, label, (label IS DISTINCT FROM lag(label) OVER (ORDER BY win))::INT AS c FROM seq_labels)) GROUP BY label, run)", "seq_labels"))
def run_lengths(spark, d):
    return metrics.run_lengths(_labels(spark, d))


@query(sql("SELECT round(avg(s), 4) AS silhouette, CASE WHEN round(avg(s), 4) > 0.5 THEN 'good' WHEN round(avg(s), 4) > 0.25 THEN 'reasonable' ELSE 'poor' END AS quality FROM (SELECT i, CASE WHEN max(n) FILTER (WHERE own) = 1 THEN 0 ELSE (min(m) FILTER (WHERE NOT own) - max(m) FILTER (WHERE own)) / greatest(min(m) FILTER (WHERE NOT own), max(m) FILTER (WHERE own)) END AS s FROM (SELECT e.i, x.label = y.label AS own, y.label, count(*) AS n, sum(e.d) / CASE WHEN x.label = y.label THEN greatest(count(*) - 1, 1) ELSE count(*) END AS m FROM emb_d e JOIN emb x ON e.i = x.win JOIN emb y ON e.j = y.win GROUP BY e.i, x.label, y.label) GROUP BY i)", "emb_d"))
def silhouette(spark, d):
    return metrics.silhouette(_embeddings(spark, d), most=None)


@query(ORACLE_SQL["silhouette"].replace(" FROM emb_d e JOIN emb x", " FROM emb_d e JOIN few x").replace("JOIN emb y", "JOIN few y").replace("\nSELECT", f", few AS (SELECT * FROM emb ORDER BY {oracle.order_key('win', 42)}, win LIMIT 200)\nSELECT", 1))
def silhouette_of_sample(spark, d):
    """The silhouette of a sample of 200 rows."""
    return metrics.silhouette(_embeddings(spark, d), most=200)


_PEARSON = f"""xy AS (SELECT label AS place, avg(vec[1]) AS x, avg(vec[2]) AS y FROM emb GROUP BY label), n AS (SELECT count(*) AS n FROM xy),
picks AS (SELECT id // n AS draw, {oracle.order_key('id', 0)} % n AS place FROM (SELECT unnest(range(1000 * n)) AS id, n FROM n)),
draws AS (SELECT draw, covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0) AS r FROM picks JOIN xy USING (place) GROUP BY draw)"""


@query(sql("SELECT (SELECT round(corr(x, y), 6) FROM xy) AS r, round(quantile_cont(r, 0.025), 6) AS ci_lo, round(quantile_cont(r, 0.975), 6) AS ci_hi FROM draws WHERE r IS NOT NULL", "emb").replace("\nSELECT", f", {_PEARSON}\nSELECT", 1))
def pearson(spark, d):
    """Pearson's r with its bootstrap interval (1000 draws)."""
    x = _embeddings(spark, d).groupBy("label").agg(F.avg(F.col("vec")[0]).alias("x"), F.avg(F.col("vec")[1]).alias("y"))
    found = metrics.bootstrap_correlation(materialised(x.withColumn("place", F.col("label").cast("long")), "xy"))
    return found.select(*(F.round(k, 6).alias(k) for k in ("r", "ci_lo", "ci_hi")))


@query(sql("SELECT round(corr(rx, ry), 4) AS spearman_rho, (SELECT round(100.0::DOUBLE * avg(((p.x < q.x) <> (p.y < q.y))::INT), 4) FROM pts p JOIN pts q ON q.place BETWEEN p.place + 1 AND p.place + 49) AS flip_rate_pct FROM (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM pts)", "emb").replace("\nSELECT", ", pts AS (SELECT win AS place, vec[1] AS x, vec[1] + vec[2] AS y FROM emb)\nSELECT", 1))
def rank_comparison(spark, d):
    x = _embeddings(spark, d).select(F.col("win").alias("place"), F.col("vec")[0].alias("x"), (F.col("vec")[0] + F.col("vec")[1]).alias("y"))
    return metrics.rank_comparison(x)


@query(sql("SELECT avg((a = b)::INT::DOUBLE) AS raster_agreement FROM ab", "ab"))
def raster_agreement(spark, d):
    return metrics.raster_agreement(_both(spark, d), [(k, k) for k in range(8)])


@query(sql("SELECT round(avg(d), 6) AS exemplar_mean_dist, round(median(d), 6) AS exemplar_median_dist, round(avg((d = 0)::INT), 6) AS exemplar_frac_identical FROM (SELECT i, min(d) / 1000.0 AS d FROM emb_d WHERE j IN (SELECT min(win) FROM emb GROUP BY label) GROUP BY i)", "emb_d"))
def exemplar_overlap(spark, d):
    """All rows against the first row of each label."""
    x = _embeddings(spark, d).select(F.col("win").alias("pos"), "vec", "label")
    first = x.groupBy("label").agg(F.min("pos").alias("pos")).select("pos")
    return metrics.exemplar_overlap(x.select("pos", "vec"), x.join(first, "pos").select("pos", "vec"), 1000).select(*(F.round(k, 6).alias(k) for k in ("exemplar_mean_dist", "exemplar_median_dist", "exemplar_frac_identical")))


@query("SELECT 'd' || (vec_id % 3) AS dataset, 'm' || (vec_id % 2) AS method, round(avg(label), 4) AS K_mean, round(stddev_samp(label), 4) AS K_std, min(label)::INT AS K_min, max(label)::INT AS K_max, round(avg(vec_id / 7.0::DOUBLE), 4) AS ari_mean, round(stddev_samp(vec_id / 7.0::DOUBLE), 4) AS ari_std, min(vec_id / 7.0::DOUBLE) AS ari_min, max(vec_id / 7.0::DOUBLE) AS ari_max, count(*) AS n_seeds FROM embeddings GROUP BY 1, 2")
def seed_summary(spark, d):
    x = events.vectors(spark, d)
    return metrics.seed_summary(x.select(F.concat(F.lit("d"), F.col("win") % 3).alias("dataset"), F.concat(F.lit("m"), F.col("win") % 2).alias("method"), F.col("label").alias("K"), (F.col("win") / 7.0).alias("ari_vs_ap_full")))


@query("SELECT 'd' || (vec_id % 50) AS dataset, max(label) FILTER (WHERE vec_id % 3 = 0) AS ap_full, max(label) FILTER (WHERE vec_id % 3 = 1) AS ap_sampled, max(label) FILTER (WHERE vec_id % 3 = 2) AS hdbscan FROM embeddings GROUP BY 1")
def figure_table(spark, d):
    x = events.vectors(spark, d)
    method = F.element_at(F.array(F.lit("ap_full"), F.lit("ap_sampled"), F.lit("hdbscan")), (F.col("win") % 3 + 1).cast("int"))
    return metrics.figure_table(x.select(F.concat(F.lit("d"), F.col("win") % 50).alias("dataset"), method.alias("method"), "label"), "label", ["ap_full", "ap_sampled", "hdbscan"])


@query("SELECT count(*) AS n, count(*)::DOUBLE * count(*) * 8 AS matrix_bytes, count(*)::DOUBLE * count(*) * 0.0005 AS distance_s, 1000 * count(*)::DOUBLE * count(*) * 1e-6 AS ap_s FROM embeddings")
def cost_model(spark, d):
    return metrics.cost_model(events.vectors(spark, d).agg(F.count("*").alias("n")))


# Clusterings


#: Size of the samples and further options of the registered methods.
_SAMPLE, _NEIGHBOURS = 100, 30
_CENTRES = f"""ap_picked(pos, wins) AS (
  SELECT 1, [(SELECT win FROM cdf ORDER BY {oracle.order_key('win', 42)}, win LIMIT 1)]
  UNION ALL
  SELECT pos + 1, list_append(wins, (SELECT CASE WHEN max(m) > 0 THEN arg_min(i, (-m, i)) END FROM (SELECT x.win AS i, min(list_sum(list_transform(list_zip(x.vec, y.vec), lambda p: abs(p[1] - p[2])))) AS m FROM cdf x JOIN cdf y ON list_contains(wins, y.win) GROUP BY x.win))) FROM ap_picked WHERE pos < {_SAMPLE}
),
ap_sample AS (SELECT win, vec FROM cdf WHERE (SELECT count(*) FROM cdf) <= {_SAMPLE} OR win IN (SELECT unnest(wins) FROM ap_picked))"""
_METHOD_SQL = {
    "ap_full": oracle.recursive(oracle.affinity("cdf", oracle.LEAST), "SELECT i AS win, label FROM ap_labels"),
    "ap_sampled": oracle.sampled_affinity(f"ap_sample AS (SELECT win, vec FROM cdf ORDER BY {oracle.order_key('win', 42)}, win LIMIT {_SAMPLE})", _SAMPLE),
    "ap_coreset": oracle.sampled_affinity(_CENTRES, _SAMPLE),
    "ap_sparse": oracle.sparse_affinity(_NEIGHBOURS),
    "hdbscan": oracle.recursive(oracle.density("cdf", 5), "SELECT * FROM db_labels"),
}


def _method(name: str):
    def run(spark, d):
        x = methods.cluster(_vectors(spark, d), name, sample_size=_SAMPLE, neighbours_k=_NEIGHBOURS, min_cluster_size=5, strata=10)
        return x.labels.select("win", "label")

    run.__name__, run.__doc__ = name, f"Labels of the windows by {name}."
    return query(_METHOD_SQL.get(name))(run)


for _name in S.METHODS:
    _method(_name)


@query(oracle.recursive(f"{_SLICED}, {oracle.affinity('flat', 'SELECT -pow(max(d), 2) FROM ap_d', 1.0)}", "SELECT i AS win, label FROM ap_labels", "win"))
def ap_from_distances(spark, d):
    """Affinity propagation over transport distances of joint windows."""
    return pipeline.cluster_joint(windows.joint(_signals(spark, d)), "sliced_w1")


@query()
def kmeans_baseline(spark, d):
    return sampling.k_means(_embeddings(spark, d), 10)[0].select("win", F.col("cluster").alias("label"))


@query(oracle.recursive(oracle.density("emb", 10), "SELECT * FROM db_labels", "emb"))
def density_of_vectors(spark, d):
    return density.hdbscan(_embeddings(spark, d).select("win", "vec"), 10)


_NEAR = "nearby AS (SELECT * FROM (SELECT i, j, d, row_number() OVER (PARTITION BY i ORDER BY d, j) AS rank FROM emb_d WHERE i <> j) WHERE rank <= 10)"


@query(sql("SELECT x.i, x.j, round(-(x.d / 1000.0) * (x.d / 1000.0), 4) AS s FROM nearby x JOIN nearby y ON x.i = y.j AND x.j = y.i WHERE x.d <> 0", "emb_d").replace("\nSELECT", f", {_NEAR}\nSELECT", 1))
def sparse_graph(spark, d):
    """The mutual neighbour graph that sparse affinity propagation runs on."""
    return affinity.graph(distance.similarity(distance.neighbours(_embeddings(spark, d), 10), 1000).select("i", "j", "s")).select("i", "j", F.round("s", 4).alias("s"))


# Evaluations


@query()
def method_matrix(spark, d):
    rows = pipeline.matrix({"events": _vectors(spark, d)}, S.METHODS, options={"sample_size": 100, "neighbours_k": 30, "min_cluster_size": 5, "strata": 10})
    return _rows(spark, rows, "dataset string, method string, status string, n_windows long, n_clusters long, noise_pct double, silhouette double, t_s double, ri_vs_ap_full double, ari_vs_ap_full double")


@query()
def preference_sweep(spark, d):
    return _rows(spark, pipeline.preference_sweep(_vectors(spark, d), unit=S.UNIT), "preference double, K long, split_half_ami double, best boolean")


@query()
def split_half_stability(spark, d):
    return _rows(spark, [pipeline.split_half(_vectors(spark, d), unit=S.UNIT)], "splits long, ami_mean double, ami_std double")


@query()
def seed_variance(spark, d):
    v = _vectors(spark, d)
    full = methods.ap_full(v)
    return _rows(spark, pipeline.seed_variance(v, "events", full.labels, sample_size=100, strata=10), "dataset string, method string, seed long, K long, ari_vs_ap_full double, t_s double")


@query()
def downstream_agreement(spark, d):
    signals = _signals(spark, d)
    v = materialised(windows.cumulative(windows.histograms(signals)).withColumnRenamed("cdf", "vec"), "vectors")
    full = methods.ap_full(v)
    sampled = methods.ap_sampled(v, sample_size=100, preference=full.preference)
    table = materialised(files.bundle(v, windows.representatives(signals), full.labels, sampled.labels, full.exemplars, sampled.exemplars), "bundle")
    names = "K_full long, K_sampled long, K_matched long, occupancy_r double, occupancy_ci_lo double, occupancy_ci_hi double, transition_r double, transition_ci_lo double, transition_ci_hi double, raster_agreement double, exemplar_mean_dist double, exemplar_median_dist double, exemplar_frac_identical double"
    return _rows(spark, [pipeline.downstream("events", table)], "dataset string, " + names)


@query()
def feature_comparison(spark, d):
    signals = _signals(spark, d)
    h = materialised(windows.cumulative(windows.histograms(signals)).withColumnRenamed("cdf", "vec"), "histogram")
    e = materialised(windows.quantiles(signals).withColumnRenamed("q", "vec"), "empirical")
    row = pipeline.compare_features("events", h, e, methods.ap_full(h).labels)
    return _rows(spark, [row], "dataset string, n_windows long, K long, spearman_rho double, flip_rate_pct double, ari_histogram double, ari_empirical double, ari_hist_vs_emp double, sil_histogram double, sil_empirical double, winner string, delta_ari double, status string")
