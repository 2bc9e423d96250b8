"""Attitude log frames: twelve float64 values at 10 Hz."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brinewave.functions.columns import ATTITUDE_CLOCK_SHIFT

# The twelve channels in file order.
CHANNELS = [
    "yaw",
    "roll",
    "pitch",
    "accel_x",
    "accel_y",
    "accel_z",
    "gyro_x",
    "gyro_y",
    "gyro_z",
    "temperature",
    "time_sensor",
    "time_comp",
]


def attitude_rows(frames: DataFrame, values: str) -> DataFrame:
    """Frames with an array of twelve values to named columns; the computer clock is shifted."""
    named = [F.col(values)[i].alias(name) for i, name in enumerate(CHANNELS)]
    kept = [c for c in frames.columns if c != values]
    return frames.select(*kept, *named).withColumn("time_comp", F.col("time_comp") + ATTITUDE_CLOCK_SHIFT)
