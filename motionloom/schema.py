"""Calibration constants and table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values of the sensor and its windows.
WINDOW, RATE_HZ = 60, 200
ACC_RANGE, GYRO_RANGE, ADC = 4, 1000, 32768
MOTION_REGISTER, INSERTED_COMMAND, COUNTER_MODULUS, MAX_LOSS_PERCENT = 34, 3, 128, 10
HIGHPASS_HZ, FILTER_PAD, MEDIAN_REACH = 0.5, 6, 3
LOG_FLOOR = 1e-10
#: Inner bin edges of the four channels; a value on an edge falls into the bin above it.
EDGES = {
    "y_ga": (-1.0, -0.7778, -0.5556, -0.3333, -0.1111, 0.1111, 0.3333, 0.5556, 0.7778, 1.0),
    "z": (-1.5, -1.2222, -0.9444, -0.6667, -0.3889, -0.1111, 0.1667, 0.4444, 0.7222, 1.0),
    "z_gyro": (-100.0, -50.0, 0.0, 50.0, 100.0),
    "log_tot": (-3.0,),
}
ARENAS = dict.fromkeys(("3d_wired", "2d_wired", "3d_wireless", "2d_wireless"), EDGES)
BINS = {k: len(v) + 1 for k, v in EDGES.items()}
#: Divisors of the quantile and joint features.
SCALES = {"y_ga": 2.0, "z": 2.5, "z_gyro": 200.0, "log_tot": 3.0}
#: A distance is a whole number of 1/600: weights of the channels' cumulative counts.
UNIT, WEIGHTS = 600, {"y_ga": 1, "z": 1, "z_gyro": 2, "log_tot": 10}

SENSORS = ("ax", "ay", "az", "gx", "gy", "gz", "mx", "my", "mz")

PACKETS = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("command", T.DoubleType()), T.StructField("register", T.DoubleType()), T.StructField("ts", T.DoubleType())]
    + [T.StructField(k, T.DoubleType()) for k in (*SENSORS, "counter")]
    + [T.StructField("folder", T.StringType())]
)
LABELS = T.StructType([T.StructField("ClusterIdx", T.IntegerType()), T.StructField("Timestamp", T.DoubleType()), T.StructField("Folder_Name", T.StringType())])
JOINT_LABELS = T.StructType([T.StructField("Timestamp", T.DoubleType()), T.StructField("ClusterIdx", T.IntegerType()), T.StructField("Method", T.StringType())])

METHODS = ("hdbscan", "ap_full", "ap_sampled", "ap_coreset", "ap_sparse", "ap_twolevel", "ap_kmeans", "ap_stratified")
AP_SAMPLE, AP_FULL_LIMIT, SPARSE_NEIGHBOURS = 10_000, 25_000, 1_000
#: Arenas, which share one set of edges.
ARENAS = ("3d_wired", "2d_wired", "3d_wireless", "2d_wireless")
