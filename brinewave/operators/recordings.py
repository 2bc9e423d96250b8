"""Whole jobs over many recordings: detect, group, localize, convert."""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from brinewave.functions import columns as fc, kernels
from brinewave.operators import blocks as blk, directions, impulses, quantization, segments, sessions, tdoa, tonal, trains, windows
from brinewave.operators.filters import decimated, filter_blocks
from brinewave.operators.groups import small_side
from brinewave.session import cut_lineage
from brinewave.sources import devices

REC = "recording_id"
DENSITY_TILE = 2**20  # samples whose detection density one task holds at a time
NOISE_FRAMES = 10  # fixed value: a noise frame is ten spectrum frames long


@dataclass
class Detections:
    """The tables of one job."""

    impulses: DataFrame
    trains: DataFrame
    members: DataFrame
    tonal_frames: DataFrame
    tonals: DataFrame
    tonal_segments: DataFrame
    noise: DataFrame
    counts: DataFrame


def noise_hits(blocks: DataFrame, fs: float, ref_channel: int, nfft_s: float, threshold: float, band=(1.0, 500.0), factor: int = 100) -> DataFrame:
    """Loud frames of a low band: low-passed and thinned out in the blocks, then band-passed.

    The thinned series gets halos of its band's settling length in its own blocks.
    """
    slow = fs / factor
    one = blocks.where(F.col("channel") == ref_channel)
    thin = blk.to_samples(decimated(one, fs, factor))
    narrow = (band[0], min(band[1], 0.4 * slow))
    settles = kernels.settling_length(slow, narrow)
    again = blk.from_samples(thin, 65_536, settles)
    frames = blk.frame_energy(filter_blocks(again, slow, narrow, pad=2 * settles), int(round(nfft_s * slow * NOISE_FRAMES)))
    return blk.noise_frames(frames, threshold)


def _tonal_settings(device: dict, fs: float) -> tonal.TonalSettings:
    return tonal.TonalSettings(
        fs=fs,
        nfft=kernels.frame_length(device["nfft_s"], fs),
        low=device["tonal_lo"],
        high=device["tonal_hi"],
        ref_channel=device["ref_channel"],
        threshold=device["threshold_tonal"],
        percent_quiet=device["percent_quiet"],
        freq_width_db=device["freq_width_db"],
        freq_maxbandwidth=device["freq_maxbandwidth"],
    )


def _no_noise(tonals: DataFrame) -> DataFrame:
    return tonals.where("false").select(REC, F.lit(0).cast("bigint").alias("frame"), F.lit(0.0).alias("energy"))


def detect_all(blocks: DataFrame, fs: float, n_samples: DataFrame | int | None, device: dict, tile_s: float = 60.0, noise_threshold: float | None = None) -> Detections:
    """Impulses, trains, tonal frames and segments, noise, and one counts row per recording.

    All recordings of a call have the same rate (`detect_recordings` takes them as they are). n_samples closes
    what stays open: one number, a table (recording_id, n_samples), which also names the recordings, or the lengths that the
    blocks have. The noise threshold is the device's where none is given. Detections are written once and read by
    everything after.
    """
    if noise_threshold is None:
        noise_threshold = np.inf if device["threshold_noise"] is None else device["threshold_noise"]
    if n_samples is None:
        last = F.col("start_idx") + F.size("samples") - 1
        n_samples = cut_lineage(blocks.groupBy(REC).agg(F.max(last).alias("n_samples")))
    tile = int(tile_s * fs)
    ref = device["ref_channel"]
    array = blocks.where(F.col("channel") <= len(device["sensors"]))
    high = device["impulsive_hi"] or np.inf
    found = cut_lineage(
        impulses.detect_impulses(
            array, fs, (device["impulsive_lo"], high), ref, device["dist"], device["threshold_impulsive"], device["ratio"]
        )
    )
    interval = int(round(device["train_interval"] * fs))
    members = trains.train_members(found, device["train_min"], interval, tile).where("is_member")
    runs = trains.click_trains(found, device["train_min"], interval, tile, n_samples)
    settings = _tonal_settings(device, fs)
    frames = cut_lineage(tonal.tonal_frames(array, settings))
    tonals = tonal.tonal_detections(frames, fs)
    spans = sessions.density_segments(tonals, n_samples, DENSITY_TILE)
    if np.isinf(noise_threshold):
        noise = _no_noise(tonals)
    else:
        noise = noise_hits(blocks, fs, ref, device["nfft_s"], noise_threshold, (device["noise_lo"], device["noise_hi"]))
    names = n_samples if isinstance(n_samples, DataFrame) else blocks.select(REC).distinct()
    counts = segments.counts_table(found, runs, tonals, spans, noise, names)
    if np.isinf(noise_threshold):
        counts = counts.withColumn("num_noise", F.lit(-1).cast("bigint"))
    return Detections(found, runs, members, frames, tonals, spans, noise, counts)


CLASS = impulses.CLASS
MOST_CLASSES = 256  # kinds of recordings (device and rate) in one call


@dataclass
class Kinds:
    """Recordings of any rates and devices: rows by class, and what each class is."""

    table: DataFrame
    of: dict[int, tuple[dict, float]]

    def each(self, df: DataFrame):
        for k, (device, fs) in self.of.items():
            yield device, fs, df.where(F.col(CLASS) == k).drop(CLASS)


def kinds(recordings: DataFrame) -> Kinds:
    """Classes of a table (recording_id, fs, device, n_samples, sync_s): its distinct devices and rates, at most MOST_CLASSES."""
    table = cut_lineage(recordings.select(REC, F.col("fs").cast("double").alias("fs"), "device", F.col("n_samples").cast("bigint").alias("n_samples"), F.col("sync_s").cast("double").alias("sync_s")))
    found = sorted((r.device, r.fs) for r in table.select("device", "fs").distinct().limit(MOST_CLASSES + 1).collect())
    if len(found) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} kinds of recordings in one call")
    if not found:
        raise ValueError("no recordings are given")
    number = F.coalesce(*[F.when((F.col("device") == d) & (F.col("fs") == fs), F.lit(k)) for k, (d, fs) in enumerate(found)], F.lit(None).cast("int"))
    return Kinds(table.withColumn(CLASS, number), {k: (devices.preset(d) | {"device": d}, fs) for k, (d, fs) in enumerate(found)})


def _union(tables: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, tables)


def detect_recordings(wide: DataFrame, recordings: DataFrame, tile_s: float = 60.0) -> Detections:
    """detect_all over recordings whose rates, lengths and devices are columns of a table.

    `wide` are rows of all channels with halos (`schemas.WIDE_BLOCKS`), `recordings` has recording_id, fs, n_samples, device
    (a preset) and sync_s. Raw samples are read once for impulses and once for tonal frames, however many rates there are,
    and once more for the noise of classes that have a threshold; names and lengths come from the table. Recordings
    without samples get a row of zeros; samples of recordings that the table lacks are passed over.
    """
    known = kinds(recordings)
    rows = wide.join(small_side(known.table.select(REC, CLASS), known.table), REC)
    searches = {
        k: impulses.Search(fs, (d["impulsive_lo"], d["impulsive_hi"] or np.inf), d["ref_channel"], d["dist"], d["threshold_impulsive"], d["ratio"])
        for k, (d, fs) in known.of.items()
    }
    lengths = known.table.select(REC, "n_samples")
    found = cut_lineage(impulses.detect_by_class(rows, searches))
    array = rows.withColumn("channels", _of_array(known.of))
    levels = cut_lineage(tonal.wide_frame_levels(array, {k: _tonal_settings(d, fs) for k, (d, fs) in known.of.items()}))
    members, runs, frames, tonals, noise = [], [], [], [], []
    for device, fs, own in known.each(found):
        interval, tile = int(round(device["train_interval"] * fs)), int(tile_s * fs)
        members.append(trains.train_members(own, device["train_min"], interval, tile).where("is_member"))
        runs.append(trains.click_trains(own, device["train_min"], interval, tile, lengths))
    for device, fs, own in known.each(levels):
        frames.append(tonal.frames_of_levels(own, _tonal_settings(device, fs)).withColumn("fs", F.lit(fs)))
    every = cut_lineage(_union(frames))
    for fs in sorted({fs for _, fs in known.of.values()}):
        tonals.append(tonal.tonal_detections(every.where(F.col("fs") == fs), fs))
    tonal_hits = cut_lineage(_union(tonals))
    spans = sessions.density_segments(tonal_hits, lengths, DENSITY_TILE)
    for device, fs, own in known.each(rows):
        if device["threshold_noise"] is not None:
            band = (device["noise_lo"], device["noise_hi"])
            noise.append(noise_hits(blk.narrow(own), fs, device["ref_channel"], device["nfft_s"], device["threshold_noise"], band))
    hits = _union(noise) if noise else _no_noise(tonal_hits)
    counts = segments.counts_table(found, _union(runs), tonal_hits, spans, hits, known.table)
    off = [k for k, (d, _) in known.of.items() if d["threshold_noise"] is None]
    counts = counts.join(known.table.select(REC, CLASS), REC)
    counts = counts.withColumn("num_noise", F.when(F.col(CLASS).isin(off), F.lit(-1).cast("bigint")).otherwise(F.col("num_noise"))).drop(CLASS)
    return Detections(found.drop(CLASS), _union(runs), _union(members), every.drop("fs"), tonal_hits, spans, hits, counts)


def _within(most, c):
    return c["channel"] <= most


def _of_array(of: dict[int, tuple[dict, float]]):
    """The channels that have a sensor in the array of the row's class."""
    most = F.coalesce(*[F.when(F.col(CLASS) == k, F.lit(len(d["sensors"]))) for k, (d, _) in of.items()])
    return F.filter("channels", functools.partial(_within, most))


def localize_recordings(wide: DataFrame, dets: DataFrame, recordings: DataFrame, block_len: int, halo: int, methods: list[str], fps: float) -> DataFrame:
    """localize over recordings whose rates, devices and clock offsets are columns of a table.

    Windows of all classes are cut in one pass over rows that hold all channels, and written; no samples are exchanged.
    """
    known = kinds(recordings)
    mine = dets.select(REC, "det_id", "idx").join(small_side(known.table.select(REC, CLASS, "sync_s"), known.table), REC)

    def edge(name: str):
        return F.col("idx") + F.coalesce(*[F.when(F.col(CLASS) == k, F.lit(d[name])) for k, (d, _) in known.of.items()])

    spans = mine.select(REC, "det_id", "idx", CLASS, "sync_s", edge("win_lo").alias("first_idx"), edge("win_hi").alias("last_idx"))
    cut = cut_lineage(windows.cut_wide(wide, spans, block_len, halo))
    tracks = []
    for device, fs, own in known.each(cut):
        most = F.lit(len(device["sensors"]))
        array = own.withColumn("channels", F.filter("channels", functools.partial(_within, most)))
        tracks.append(_tracks(tdoa.delays(array, methods, device["ref_channel"], fs), device, fs, fps, F.col("sync_s")))
    return _union(tracks)


def localize(
    blocks: DataFrame,
    dets: DataFrame,
    fs: float,
    block_len: int,
    device_name: str,
    methods: list[str],
    fps: float,
    sync_s: float = 0.0,
) -> DataFrame:
    """Pixel tracks of detections by several delay methods: delays, angles, pixels, video frames."""
    device = devices.preset(device_name) | {"device": device_name}
    array = blocks.where(F.col("channel") <= len(device["sensors"]))
    delays = tdoa.detection_delays(
        array, dets, device["win_lo"], device["win_hi"], block_len, methods, device["ref_channel"], fs
    )
    return _tracks(delays, device, fs, fps, F.lit(sync_s))


def _tracks(delays: DataFrame, device: dict, fs: float, fps: float, sync_s) -> DataFrame:
    """Delays to angles, pixels and video frames."""
    found = directions.directions(delays, devices.geometry(device["device"]), fs, devices.SPEED_OF_SOUND, device["ref_channel"])
    frame = fc.video_frame((F.col("idx") - 1) / F.lit(float(fs)), fps)
    shifted = F.rint(frame + sync_s * fps).cast("bigint")
    return found.select(
        REC,
        "det_id",
        "method",
        "az",
        "el",
        "residual",
        shifted.alias("frame"),
        fc.pixel_x(F.col("az"), device["fov_x"], device["img_w"]).alias("px"),
        fc.pixel_y(F.col("el"), device["fov_y"], device["img_h"]).alias("py"),
    )


def convert(samples: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Quantize long samples: their counts as 16-bit integers with step and bias, and the round-trip errors."""
    corrections = cut_lineage(quantization.corrections(quantization.value_counts(samples)))
    joined = samples.join(small_side(corrections), [REC, "channel"])
    raw = quantization.to_counts(F.col("x"), F.col("step"), F.col("bias"))
    stored = joined.select(*samples.columns, raw.alias("raw"), "step", "bias").drop("x")
    return stored, quantization.round_trip_errors(samples, corrections)
