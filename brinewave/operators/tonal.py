"""Tonal detection on frame spectra."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brinewave.functions import kernels
from brinewave.operators.groups import per_group
from brinewave.operators.order_statistics import exact_quantile, select_ranks
from brinewave.operators.spectra import _frames, band_bins, checked_start, frame_spectra, select_band
from brinewave.operators.tiles import number_rows
from brinewave.session import cut_lineage

REC = "recording_id"
TIE_TILE = 100_000  # frames per tile when equally quiet frames are numbered
AUTO_MARGIN_DB = 8.0  # fixed value: automatic threshold above the median


@dataclass(frozen=True)
class TonalSettings:
    fs: float
    nfft: int
    low: float
    high: float | None
    ref_channel: int = 3
    threshold: float | None = None
    percent_quiet: float = 0.01
    freq_width_db: float = 3.0
    freq_maxbandwidth: float = 10000.0
    variant: str = "level"  # or "amplitude"
    ref_compat: bool = True
    min_one: bool = False

    @property
    def bins(self) -> tuple[int, int]:
        return band_bins(self.low, self.high, self.fs, self.nfft, self.ref_compat)

    @property
    def bin_scale(self) -> float:
        """What a bin counts for in the bandwidth; the reference takes the band's second frequency."""
        width = self.fs / self.nfft
        return (self.bins[0] + 1) * width if self.ref_compat else width


@kernels.arrow_function("array<double>")
def largest_per_bin(channels: pa.Array) -> pa.Array:
    """Elementwise maximum of the spectra of one frame."""
    out = []
    for spectra in channels:
        out.append(np.max([s.values.to_numpy(zero_copy_only=False) for s in spectra], axis=0))
    return kernels.lists_from(out)


def levels_of(power: np.ndarray, variant: str) -> np.ndarray:
    """Decibels (minus infinity for no power at all), or amplitudes for the amplitude variant."""
    with np.errstate(divide="ignore"):
        return 10 * np.log10(power) if variant == "level" else np.sqrt(power)


def near_peak(level: np.ndarray, s: TonalSettings) -> int:
    """How many bins of the reference channel are close to its peak; all of them in silence."""
    with np.errstate(divide="ignore", invalid="ignore"):
        r = 20 * np.log10(level) if s.variant == "amplitude" else level
        below = np.nan_to_num(r.max() - r, nan=0.0, posinf=np.inf)
    return int(np.sum(below < s.freq_width_db))


def frame_levels(blocks: DataFrame, s: TonalSettings) -> DataFrame:
    """Per frame: `mag`, the largest level over channels per bin, and `near_peak`, the reference channel's count (null without it).

    Levels are decibels (minus infinity for no power at all), or amplitudes for the amplitude variant.
    """

    @F.arrow_udf("bigint")
    def near(refs: pa.Array) -> pa.Array:
        counts = np.zeros(len(refs), "i8")
        some = np.flatnonzero(refs.is_valid().to_numpy(zero_copy_only=False))
        counts[some] = [near_peak(r, s) for r in kernels.rows_of(refs.drop_null())]
        return pa.array(counts, mask=refs.is_null().to_numpy(zero_copy_only=False))

    spectra = select_band(frame_spectra(blocks, s.nfft, s.fs), "power", *s.bins)
    level = (lambda p: F.when(p > 0, F.lit(10.0) * F.log10(p)).otherwise(float("-inf"))) if s.variant == "level" else F.sqrt
    rows = spectra.select(REC, "channel", "frame", F.transform("power", level).alias("v"))
    grouped = rows.groupBy(REC, "frame").agg(  # one short array per channel
        F.collect_list("v").alias("all"), F.max(F.when(F.col("channel") == s.ref_channel, F.col("v"))).alias("ref")
    )
    return grouped.select(REC, "frame", largest_per_bin("all").alias("mag"), near("ref").alias("near_peak"))


CLASS = "class"  # column of rows whose settings differ: a key of the settings


def wide_frame_levels(wide: DataFrame, settings: dict[int, TonalSettings]) -> DataFrame:
    """frame_levels of rows that hold all channels (`schemas.WIDE_BLOCKS`), each by the settings of its `class`.

    A block's frames are made and reduced over its channels in one place: nothing is shuffled.
    """

    @F.arrow_udf("array<struct<frame: bigint, mag: array<double>, near_peak: bigint>>")
    def run(kinds: pa.Array, starts: pa.Array, befores: pa.Array, sizes: pa.Array, rows: pa.Array) -> pa.Array:
        lengths, frames, mags, nears = [], [], [], []
        for kind, start, before, size, channels in zip(kinds.to_pylist(), starts.to_pylist(), befores.to_pylist(), sizes.to_pylist(), rows):
            s = settings[kind]
            low, high = s.bins
            found = {}
            for c in channels:
                x = c["samples"].values.to_numpy(zero_copy_only=False)
                first, y = _frames(x[before : before + size], x[before + size :], start, s.nfft, s.nfft)
                found[c["channel"].as_py()] = levels_of(kernels.frame_powers(y, s.nfft, s.nfft, s.fs)[:, low : high + 1], s.variant)
            most, ref = np.max(list(found.values()), axis=0), found.get(s.ref_channel)
            lengths.append(len(most))
            if len(most):
                frames.append(first + np.arange(len(most)))
                mags += list(most)
                nears += [None] * len(most) if ref is None else [near_peak(r, s) for r in ref]
        flat = [pa.array(np.concatenate([np.zeros(0, "i8"), *frames])), kernels.lists_from(mags), pa.array(nears, pa.int64())]
        items = pa.StructArray.from_arrays(flat, names=["frame", "mag", "near_peak"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), items)

    nfft = F.coalesce(*[F.when(F.col(CLASS) == k, F.lit(s.nfft)) for k, s in settings.items()])
    start = checked_start(wide, nfft, nfft)
    return wide.select(REC, CLASS, F.inline(run(F.col(CLASS), start, F.col("before"), F.col("size"), F.col("channels"))))


def quiet_frames(levels: DataFrame, percent: float, min_one: bool = False) -> DataFrame:
    """The quietest share of the frames of each recording, by summed level, earlier frames first on ties.

    Where the share is below one frame, all frames are taken (min_one: one frame).
    """
    total = F.aggregate("mag", F.lit(0.0), lambda a, v: a + v)
    rows = levels.withColumn("_sum", total)
    wanted = F.rint(F.col("n") * percent)
    count = F.when(wanted >= 1, wanted).otherwise(F.lit(1) if min_one else F.col("n"))
    cut = select_ranks(rows, [REC], "_sum", {"_cut": count - 1})
    rows = rows.join(per_group(cut.select(REC, "_cut", "_cut_rank")), REC)
    tied = number_rows(rows.where(F.col("_sum") == F.col("_cut")), [REC], "frame", [], TIE_TILE, "_n")
    kept_ties = tied.where(F.col("_n") <= F.col("_cut_rank") + 1).select(*levels.columns)
    return rows.where(F.col("_sum") < F.col("_cut")).select(*levels.columns).unionByName(kept_ties)


def noise_floor(frames: DataFrame, lowest: bool = False) -> DataFrame:
    """Per recording an array with the largest (or lowest) level of each bin over the given frames."""
    rows = frames.select(REC, F.posexplode("mag").alias("bin", "v"))
    best = rows.groupBy(REC, "bin").agg((F.min("v") if lowest else F.max("v")).alias("v"))
    listed = best.groupBy(REC).agg(F.sort_array(F.collect_list(F.struct("bin", "v"))).alias("l"))
    return listed.select(REC, F.col("l.v").alias("floor"))


FEATURES = "struct<stat: double, peak_bin: bigint>"


def frame_features(mag: Column, floor: Column, s: TonalSettings, stat=np.max) -> Column:
    """Statistic and peak bin over the floor."""
    amplitude = s.variant == "amplitude"

    @F.arrow_udf(FEATURES)
    def run(mags: pa.Array, floors: pa.Array) -> pa.Array:
        stats, bins = [], []
        for m, f in zip(kernels.rows_of(mags), kernels.rows_of(floors)):
            with np.errstate(invalid="ignore"):
                over = np.where(np.isneginf(m), m, m - f)  # silence is not over any floor
            if amplitude:
                with np.errstate(divide="ignore"):
                    over = 20 * np.log10(np.maximum(over, 0))
            stats.append(float(stat(over)))
            bins.append(int(np.argmax(over)))
        return pa.StructArray.from_arrays([pa.array(stats), pa.array(bins)], names=["stat", "peak_bin"])

    return run(mag, floor)


def tonal_frames(blocks: DataFrame, s: TonalSettings, stat=np.max) -> DataFrame:
    """Every frame of the reference channel with its statistic, peak frequency, bandwidth gate and whether it is a detection."""
    return frames_of_levels(cut_lineage(frame_levels(blocks, s)), s, stat)


def frames_of_levels(levels: DataFrame, s: TonalSettings, stat=np.max) -> DataFrame:
    """The same from a written table of frame levels, which is read several times.

    Frames without the reference channel count for floors and thresholds, but have no gate and are left out.
    """
    if s.variant == "amplitude":
        floor = noise_floor(levels, lowest=True)
    elif s.percent_quiet > 0:
        floor = noise_floor(quiet_frames(levels, s.percent_quiet, s.min_one))
    else:
        floor = levels.select(REC).distinct().withColumn("floor", F.array_repeat(F.lit(0.0), s.bins[1] - s.bins[0] + 1))
    rows = levels.join(per_group(floor), REC).select(
        REC, "frame", "near_peak", frame_features(F.col("mag"), F.col("floor"), s, stat).alias("f")
    )
    width = s.fs / s.nfft
    rows = rows.select(
        REC,
        "frame",
        ((F.col("frame") * s.nfft + s.nfft / 2) / s.fs).alias("t_s"),
        F.col("f.stat").alias("stat_db"),
        ((F.col("f.peak_bin") + s.bins[0]) * width).alias("peak_freq"),
        (F.col("near_peak") * s.bin_scale < s.freq_maxbandwidth).alias("is_narrow"),
    )
    if s.threshold is None:
        rows = cut_lineage(rows)
        middle = exact_quantile(rows, [REC], "stat_db", 0.5, "_median")
        rows = rows.join(middle, REC).withColumn("threshold", F.col("_median") + AUTO_MARGIN_DB).drop("_median")
    else:
        rows = rows.withColumn("threshold", F.lit(float(s.threshold)))
    rows = rows.where(F.col("is_narrow").isNotNull())
    hit = F.col("is_narrow") & (F.col("stat_db") > F.col("threshold"))
    return _mark_detections(rows, hit, s.ref_compat)


def _mark_detections(rows: DataFrame, hit: Column, drop_last: bool) -> DataFrame:
    if not drop_last:
        return rows.withColumn("is_det", hit)
    last = rows.groupBy(REC).agg(F.max(F.when(hit, F.col("frame"))).alias("_last"))
    marked = rows.join(last, REC)
    return marked.withColumn("is_det", hit & (F.col("frame") < F.col("_last"))).drop("_last")


def simple_tonal_frames(blocks: DataFrame, s: TonalSettings) -> DataFrame:
    """Reference channel only, fixed threshold, no floor and no bandwidth gate."""
    spectra = select_band(
        frame_spectra(blocks.where(F.col("channel") == s.ref_channel), s.nfft, s.fs), "power", *s.bins
    )
    rows = spectra.select(
        REC,
        "frame",
        ((F.col("frame") * s.nfft + s.nfft / 2) / s.fs).alias("t_s"),
        (F.lit(10.0) * F.log10(F.array_max("power"))).alias("stat_db"),
    )
    return _mark_detections(rows, F.col("stat_db") > F.lit(float(s.threshold)), s.ref_compat)


def tonal_detections(frames: DataFrame, fs: float) -> DataFrame:
    """Detected frames as detections: idx is the rounded sample number of the frame's time."""
    hits = frames.where("is_det")
    return hits.select(REC, F.col("frame").alias("det_id"), F.rint(F.col("t_s") * fs).cast("bigint").alias("idx"), F.col("stat_db").alias("peak"))
