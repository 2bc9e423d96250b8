"""Impulse detection on blocks with halos.

Raw samples are read and filtered once. The same kernel gives the envelope's candidate
peaks and, for an automatic threshold, the counts of its values by the first 16 bits of
their patterns and the envelope itself; these are written, and the quantile is narrowed
down on them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brinewave.functions import kernels
from brinewave.operators import windows
from brinewave.operators.blocks import _padded, needs_halo
from brinewave.operators.filters import settled
from brinewave.operators.order_statistics import COUNTS, block_quantile, counted_by_pattern
from brinewave.session import cut_lineage

REC = "recording_id"
CLASS = "class"  # column of rows whose settings differ: a key of the settings
QUANTILE = 0.75  # fixed value: the automatic threshold is this quantile of the envelope times a ratio
PEAKS = "array<struct<at: bigint, peak: double>>"


def envelope_peaks(x: np.ndarray, before: int, size: int, fs: float, band, dist: int) -> tuple[np.ndarray, np.ndarray]:
    """The envelope of a block with its halos, and the places of the peaks inside the block."""
    y = kernels.zero_phase(x, fs, band, envelope=True)
    begin = max(before - dist, 0)
    at = kernels.local_peaks(y[begin : before + size + dist], dist) + begin
    return y, at[(at >= before) & (at < before + size)]


def searched(blocks: DataFrame, fs: float, band: tuple[float, float], ref_channel: int, dist: int, keep: bool) -> DataFrame:
    """recording_id, start_idx and `peaks` of the reference channel's envelope per block; with keep also `counts` and `envelope`."""

    @F.arrow_udf(f"struct<peaks: {PEAKS}" + (f", counts: {COUNTS}, envelope: array<double>>" if keep else ">"))
    def run(left: pa.Array, mid: pa.Array, right: pa.Array) -> pa.Array:
        at, tops, cores = [], [], []
        for x, before, n in _padded(left, mid, right):
            y, found = envelope_peaks(x, before, n, fs, band, dist)
            at.append(found - before)
            tops.append(y[found])
            cores.append(y[before : before + n])
        peaks = kernels.structs_from([len(a) for a in at], at=at, peak=tops)
        more = [counted_by_pattern(cores), kernels.lists_from(cores)] if keep else []
        return pa.StructArray.from_arrays([peaks, *more], names=["peaks", "counts", "envelope"][: 1 + len(more)])

    one = settled(blocks.where(F.col("channel") == ref_channel), fs, band, more=dist)
    return one.select(REC, "start_idx", run("left_halo", "samples", "right_halo").alias("_f")).select(REC, "start_idx", "_f.*")


def auto_threshold(found: DataFrame, ratio: float) -> DataFrame:
    """Upper quartile of the envelope times ratio per recording, exact, from what `searched` kept."""
    first = found.select(REC, F.inline("counts"))
    q = block_quantile(found, [REC], "envelope", QUANTILE, "_q", first)
    return q.select(REC, (F.col("_q") * ratio).alias("threshold"))


def detect_impulses(
    blocks: DataFrame,
    fs: float,
    band: tuple[float, float],
    ref_channel: int = 3,
    dist: int = 800,
    threshold: float | None = None,
    ratio: float = 4.0,
) -> DataFrame:
    """Envelope peaks above the threshold as detections (kind 'impulse').

    Needs halos of the filter's settling length plus dist. det_id is the sample
    number, which is unique within a recording.
    """
    found = searched(blocks, fs, band, ref_channel, dist, keep=threshold is None)
    if threshold is None:
        found = cut_lineage(found)
    peaks = found.select(REC, "start_idx", F.inline("peaks")).select(REC, (F.col("start_idx") + F.col("at")).alias("idx"), "peak")
    if threshold is None:
        marked = peaks.join(auto_threshold(found, ratio), REC)
    else:
        marked = peaks.withColumn("threshold", F.lit(float(threshold)))
    return marked.where(F.col("peak") > F.col("threshold")).select(
        REC,
        F.lit("impulse").alias("kind"),
        F.col("idx").alias("det_id"),
        "idx",
        ((F.col("idx") - 1) / F.lit(float(fs))).alias("t_s"),
        "peak",
        "threshold",
    )


def detected_windows(
    wide: DataFrame, fs: float, band: tuple[float, float], lo: int, hi: int, halo: int, threshold: float, ref_channel: int = 3, dist: int = 800
) -> DataFrame:
    """Detections above a known threshold, each with its window idx + lo .. idx + hi of raw samples of all channels.

    Detection and windows are one pass over rows that hold all channels (`schemas.WIDE_BLOCKS`): nothing is
    joined or exchanged. Columns: those of detect_impulses, first_idx, last_idx, channels and clipped.
    Halos must cover the filter's settling length and dist, and the window.
    """
    found = f"idx bigint, peak double, first_idx bigint, last_idx bigint, channels {windows.WINDOW}, clipped boolean"
    schema = StructType([wide.schema[REC], *StructType.fromDDL(found)])
    fields = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rec, start, before, size, channels in zip(*(batch.column(c) for c in (REC, "start_idx", "before", "size", "channels"))):
                start, before, size = start.as_py(), before.as_py(), size.as_py()
                x = next((c["samples"].values.to_numpy(zero_copy_only=False) for c in channels if c["channel"].as_py() == ref_channel), None)
                if x is None:
                    continue
                y, at = envelope_peaks(x, before, size, fs, band, dist)
                at = at[y[at] > threshold]
                idx = start - before + at
                first, last = windows.clip(idx + lo, idx + hi, start, before, size, len(x), halo)
                cut = windows.window_lists(channels, start - before, first, last)
                columns = [pa.array([rec.as_py()] * len(at)), idx, y[at], idx + lo, idx + hi, cut, (first > idx + lo) | (last < idx + hi)]
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, fields)], schema=fields)

    held = settled(wide, fs, band, more=dist)
    found = held.select(REC, "start_idx", "before", "size", "channels").mapInArrow(run, schema)
    kind, seconds = F.lit("impulse").alias("kind"), ((F.col("idx") - 1) / F.lit(float(fs))).alias("t_s")
    columns = ["idx", seconds, "peak", F.lit(float(threshold)).alias("threshold"), "first_idx", "last_idx", "channels", "clipped"]
    return found.select(REC, kind, F.col("idx").alias("det_id"), *columns)


@dataclass(frozen=True)
class Search:
    """How the impulses of a class of recordings are found; no threshold means an automatic one."""

    fs: float
    band: tuple[float, float]
    ref_channel: int
    dist: int
    threshold: float | None
    ratio: float

    @property
    def halo(self) -> int:
        return kernels.settling_length(self.fs, self.band) + self.dist


def detect_by_class(wide: DataFrame, searches: dict[int, Search]) -> DataFrame:
    """detect_impulses over rows of all channels (`schemas.WIDE_BLOCKS`), each by the settings of its `class`.

    One pass reads and filters the reference channels of all recordings, whatever their rates are; what it gives
    (peaks, counts, the envelopes of classes with an automatic threshold) is written. Columns: those of detect_impulses, and class.
    """
    kept = {k for k, s in searches.items() if s.threshold is None}

    @F.arrow_udf(f"struct<peaks: {PEAKS}, counts: {COUNTS}, envelope: array<double>>")
    def run(kinds: pa.Array, starts: pa.Array, befores: pa.Array, sizes: pa.Array, rows: pa.Array) -> pa.Array:
        at, tops, cores = [], [], []
        for kind, before, size, channels in zip(kinds.to_pylist(), befores.to_pylist(), sizes.to_pylist(), rows):
            s = searches[kind]
            x = next(c["samples"].values.to_numpy(zero_copy_only=False) for c in channels if c["channel"].as_py() == s.ref_channel)
            y, found = envelope_peaks(x, before, size, s.fs, s.band, s.dist)
            if s.threshold is not None:
                found = found[y[found] > s.threshold]
            at.append(found - before)
            tops.append(y[found])
            cores.append(y[before : before + size] if kind in kept else y[:0])
        peaks = kernels.structs_from([len(a) for a in at], at=at, peak=tops)
        return pa.StructArray.from_arrays([peaks, counted_by_pattern(cores), kernels.lists_from(cores)], names=["peaks", "counts", "envelope"])

    def of_class(value) -> Column:
        return F.coalesce(*[F.when(F.col(CLASS) == k, F.lit(value(s))) for k, s in searches.items()])

    held = needs_halo(wide, of_class(lambda s: s.halo), "a search for impulses")
    columns = [F.col(c) for c in (CLASS, "start_idx", "before", "size", "channels")]
    found = cut_lineage(held.select(REC, CLASS, "start_idx", run(*columns).alias("_f")).select(REC, CLASS, "start_idx", "_f.*"))
    peaks = found.select(REC, CLASS, "start_idx", F.inline("peaks")).select(REC, CLASS, (F.col("start_idx") + F.col("at")).alias("idx"), "peak")
    fixed = peaks.where(~F.col(CLASS).isin(list(kept))) if kept else peaks
    marked = fixed.withColumn("threshold", of_class(lambda s: s.threshold).cast("double"))
    if kept:
        own = found.where(F.col(CLASS).isin(list(kept)))
        limits = auto_threshold(own, 1.0).select(REC, F.col("threshold").alias("_q"))
        auto = peaks.where(F.col(CLASS).isin(list(kept))).join(limits, REC).withColumn("threshold", F.col("_q") * of_class(lambda s: s.ratio)).drop("_q")
        marked = marked.unionByName(auto)
    kind, seconds = F.lit("impulse").alias("kind"), ((F.col("idx") - 1) / of_class(lambda s: s.fs)).alias("t_s")
    return marked.where(F.col("peak") > F.col("threshold")).select(REC, kind, F.col("idx").alias("det_id"), "idx", seconds, "peak", "threshold", CLASS)
