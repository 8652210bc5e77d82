"""Behavioural analysis of wearable inertial-sensor recordings on Spark."""
