"""Device presets as a six-row dimension table."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

SPEED_OF_SOUND = 1540.0

# What every preset starts from. Bands in Hz (0 and None are open ends), `dist`, `win_lo` and
# `win_hi` in samples, noise threshold (None is off) and band, angles of view in degrees, image size in pixels, array radius in metres (side / sqrt 3)
# and the bearing of each sensor in degrees.
DEFAULTS = dict(
    ref_channel=3,
    impulsive_lo=1000.0,
    impulsive_hi=None,
    threshold_impulsive=None,
    ratio=4.0,
    dist=800,
    win_lo=-300,
    win_hi=700,
    train_min=5,
    train_interval=0.1,
    tonal_lo=2500.0,
    tonal_hi=24000.0,
    threshold_tonal=None,
    nfft_s=0.01,
    freq_width_db=3.0,
    freq_maxbandwidth=10000.0,
    percent_quiet=0.01,
    threshold_noise=None,
    noise_lo=1.0,
    noise_hi=500.0,
    fov_x=54.0,
    fov_y=34.0,
    img_w=3840,
    img_h=2160,
    name_layout=None,
    side=0.4,
    sensors=[150.0, -90.0, 30.0],
)
# What each preset changes.
PRESETS = dict(
    clicker=dict(ratio=12.0, dist=15000, train_min=2, train_interval=8.0),
    triangle_40cm=dict(
        impulsive_lo=5000.0, impulsive_hi=180000.0, ratio=9.0, dist=200, win_lo=-130, win_hi=130, name_layout="dots"
    ),
    triangle_15cm=dict(
        impulsive_lo=5000.0,
        impulsive_hi=24000.0,
        threshold_impulsive=0.005 * 32767,
        threshold_tonal=-20.0,
        fov_x=62.61721188568244,
        fov_y=35.793211268714096,
        side=0.14722,
        sensors=[-30.0, 90.0, -150.0],
    ),
    triangle_dash_names=dict(name_layout="dash_dots"),
    single_sensor=dict(
        ref_channel=1,
        impulsive_lo=5000.0,
        tonal_lo=900.0,
        tonal_hi=None,
        freq_maxbandwidth=1910.0,
        nfft_s=0.02,
        name_layout="compact",
        side=0.0,
        sensors=[0.0],
    ),
    triangle_50cm=dict(
        threshold_impulsive=0.01, threshold_tonal=-20.0, train_min=7, train_interval=1.0, side=0.5, sensors=[90.0, -30.0, 210.0]
    ),
)

SCHEMA = (
    "device string, ref_channel int, impulsive_lo double, impulsive_hi double, threshold_impulsive double, "
    "ratio double, dist int, win_lo int, win_hi int, train_min int, train_interval double, tonal_lo double, "
    "tonal_hi double, threshold_tonal double, nfft_s double, freq_width_db double, freq_maxbandwidth double, "
    "percent_quiet double, threshold_noise double, noise_lo double, noise_hi double, fov_x double, fov_y double, img_w int, img_h int, name_layout string, c double, "
    "rx array<struct<x: double, y: double, z: double>>"
)


def preset(name: str) -> dict:
    return {**DEFAULTS, **PRESETS[name]}


def geometry(name: str) -> list[tuple[float, float, float]]:
    """Sensor positions in metres."""
    p = preset(name)
    radius = p["side"] / math.sqrt(3)
    return [(radius * math.cos(math.radians(a)), radius * math.sin(math.radians(a)), 0.0) for a in p["sensors"]]


def devices(spark) -> DataFrame:
    rows = []
    for name in PRESETS:
        p = preset(name)
        plain = [v for k, v in p.items() if k not in ("side", "sensors")]
        rows.append((name, *plain, SPEED_OF_SOUND, geometry(name)))
    return spark.createDataFrame(rows, SCHEMA)


def with_device(df: DataFrame) -> DataFrame:
    """Add the preset's columns to rows that name their device."""
    return df.join(F.broadcast(devices(df.sparkSession)), "device")  # six fixed rows
