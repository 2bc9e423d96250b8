"""Filters and envelopes on blocks with halos.

A block is filtered together with its halos and the halos are dropped, so the
result does not depend on how a recording is cut: a job fails where an inner edge has a
halo shorter than the filter's settling length, which follows from its slowest pole
(`kernels.settling_length`). Bands that settle slowly (a few hertz at a high rate) fit no
halo of samples: those run on a thinned series (`recordings.noise_hits`).

An envelope settles as its filter does if the band excludes 0 Hz and half the rate; where it holds
either, the envelope's far parts fall off slowly (as one over the distance) and blocks agree only to about 1e-4.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brinewave.functions import kernels
from brinewave.operators.blocks import _padded, needs_halo

ORDER = 4  # fixed value: filter order
ENVELOPE_LIMIT = 10_000.0  # fixed value: low-pass of the smoothed envelope, Hz


def filter_blocks(
    blocks: DataFrame,
    fs: float,
    band: tuple[float, float],
    stops: list[tuple[float, float]] = (),
    envelope: bool = False,
    order: int = ORDER,
    keep_halo: int = 0,
    pad: int = 0,
) -> DataFrame:
    """Zero-phase band filter, optionally the envelope of the result.

    With keep_halo the output keeps that many filtered samples on both sides, so
    that a peak search can follow without another shuffle. Halos must cover it and the filter's settling length.
    Blocks are followed by at least `pad` zeros, for recordings shorter than the filter rings.
    """
    held = settled(blocks, fs, band, stops, order, keep_halo)

    @F.arrow_udf("struct<l: array<double>, m: array<double>, r: array<double>>")
    def run(left: pa.Array, mid: pa.Array, right: pa.Array) -> pa.Array:
        parts = ([], [], [])
        for x, before, n in _padded(left, mid, right):
            y = kernels.zero_phase(x, fs, band, stops, order, envelope, pad)
            parts[0].append(y[max(before - keep_halo, 0) : before])
            parts[1].append(y[before : before + n])
            parts[2].append(y[before + n : before + n + keep_halo])
        return pa.StructArray.from_arrays([kernels.lists_from(p) for p in parts], names=["l", "m", "r"])

    done = held.withColumn("_f", run("left_halo", "samples", "right_halo"))
    return done.withColumns(
        {"left_halo": F.col("_f.l"), "samples": F.col("_f.m"), "right_halo": F.col("_f.r")}
    ).drop("_f")


def settled(blocks: DataFrame, fs: float, band, stops=(), order: int = ORDER, more: int = 0) -> DataFrame:
    """The same blocks; a job fails where an inner edge has a halo shorter than the filter's settling length and `more`."""
    need = kernels.settling_length(fs, band, stops, order) + more
    return needs_halo(blocks, need, f"a filter that settles in {need - more} samples") if need else blocks


def envelope_lowpassed(blocks: DataFrame, fs: float, limit: float = ENVELOPE_LIMIT, band: tuple[float, float] = (0, np.inf)) -> DataFrame:
    """Envelope of the block (in a band) and its halos, then low-passed. Halos cover the settling of both."""

    @F.arrow_udf("array<double>")
    def run(left: pa.Array, mid: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, before, n in _padded(left, mid, right):
            y = kernels.zero_phase(kernels.zero_phase(x, fs, band, envelope=True), fs, (0, limit))
            out.append(y[before : before + n])
        return kernels.lists_from(out)

    held = settled(blocks, fs, (0, limit), more=kernels.settling_length(fs, band))
    return held.withColumn("samples", run("left_halo", "samples", "right_halo"))


def decimated(blocks: DataFrame, fs: float, factor: int) -> DataFrame:
    """Every factor-th sample after a low-pass, as blocks of the slower rate.

    The grid is that of the recording (samples 1, 1 + factor, ...), whatever the block length.
    """
    low = filter_blocks(blocks, fs, (0, 0.4 * fs / factor))

    @F.arrow_udf("array<double>")
    def pick(mid: pa.Array, start: pa.Array) -> pa.Array:
        return kernels.lists_from([x[(1 - s) % factor :: factor] for x, s in zip(kernels.rows_of(mid), start.to_pylist())])

    start = F.ceil((F.col("start_idx") - 1) / factor) + 1
    thin = low.select("recording_id", "channel", "block_id", start.alias("start_idx"), pick("samples", "start_idx").alias("samples"))
    return thin.where(F.size("samples") > 0)
