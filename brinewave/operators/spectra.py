"""Framed spectra of blocks.

Frames start at whole multiples of the hop over the recording. The block that
holds a frame's first sample computes it, with a right halo of nfft - 1 samples
unless blocks are whole multiples of the frame. One row per frame holds the
spectrum as an array, bin k of it at place k + 1.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brinewave.functions import kernels

REC = "recording_id"
KEYS = [REC, "channel"]
PSD_NFFT = 512  # fixed value: frame of the averaged density, half overlapped, Hamming window


def _frames(x: np.ndarray, right: np.ndarray, start: int, nfft: int, hop: int):
    """Number of the first frame that starts in the block, and its samples from there on."""
    first = -(-(start - 1) // hop)
    skip = first * hop - (start - 1)
    count = max(0, -(-(len(x) - skip) // hop))
    return first, np.concatenate([x, right])[skip : skip + (count - 1) * hop + nfft] if count else x[:0]


def checked_start(blocks: DataFrame, nfft: int | Column, hop: int | Column) -> Column:
    """start_idx; a job fails where the last frame of the block before needs more samples of this block than a halo has.

    Halos are cut alike on both sides, so the left one tells what the block before had.
    """
    if "channels" in blocks.columns:
        halo = F.col("before")
        right = F.size(F.col("channels")[0]["samples"]) - halo - F.col("size")
        size = F.col("size")
    else:
        halo = F.size("left_halo") if "left_halo" in blocks.columns else F.lit(0)
        right = F.size("right_halo") if "right_halo" in blocks.columns else F.lit(0)
        size = F.size("samples")
    before = F.col("start_idx") - 1
    need = F.floor((before - 1) / hop) * hop + nfft - before
    lost = (before > 0) & (need > halo) & (need <= size + right)
    said = F.concat(F.lit("frames over the edge of a block need a halo of "), need.cast("string"), F.lit(" samples"))
    return F.when(lost, F.raise_error(said).cast("bigint")).otherwise(F.col("start_idx"))


def frame_spectra(
    blocks: DataFrame, nfft: int, fs: float, hop: int | None = None, window: str | None = None, amplitude: bool = False
) -> DataFrame:
    """recording_id, channel, frame and `power`: one-sided power density, or with
    `amplitude` the arrays `re` and `im` of 2 / nfft times the transform."""
    hop = hop or nfft
    taper = np.hamming(nfft) if window == "hamming" else None
    with_right = "right_halo" in blocks.columns
    right_col = F.col("right_halo") if with_right else F.array().cast("array<double>")

    names = ["re", "im"] if amplitude else ["power"]

    @F.arrow_udf(f"array<struct<frame: bigint, {', '.join(f'{n}: array<double>' for n in names)}>>")
    def run(mid: pa.Array, right: pa.Array, start: pa.Array) -> pa.Array:
        lengths, frames, spectra = [], [np.zeros(0, "i8")], [np.zeros((0, nfft // 2 + 1), complex if amplitude else float)]
        for x, more, s in zip(kernels.rows_of(mid), kernels.rows_of(right), start.to_pylist()):
            first, y = _frames(x, more, s, nfft, hop)
            if len(y) < nfft:
                lengths.append(0)
                continue
            if amplitude:
                cut = np.lib.stride_tricks.sliding_window_view(y, nfft)[::hop]
                spectra.append(np.fft.rfft(cut if taper is None else cut * taper, axis=1) / nfft * 2)
            else:
                spectra.append(kernels.frame_powers(y, nfft, hop, fs, taper))
            lengths.append(len(spectra[-1]))
            frames.append(first + np.arange(lengths[-1]))
        z = np.concatenate(spectra)
        ends = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in ((z.real, z.imag) if amplitude else (z,))]
        items = pa.StructArray.from_arrays([pa.array(np.concatenate(frames)), *lists], names=["frame", *names])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), items)

    return blocks.select(*KEYS, F.inline(run(F.col("samples"), right_col, checked_start(blocks, nfft, hop))))


def bin_frequency(bin_no: Column, fs: float, nfft: int) -> Column:
    return bin_no * F.lit(fs / nfft)


def frame_start(frame: Column, fs: float, hop: int) -> Column:
    return frame * F.lit(hop / fs)


def band_bins(low: float, high: float | None, fs: float, nfft: int, ref_compat: bool = False) -> tuple[int, int]:
    """First and last bin (from 0) of a band.

    The reference behaviour takes the rounded bin number as a place counted from
    one, so its band lies one bin lower.
    """
    top = fs / 2 if high is None or np.isinf(high) else high
    first, last = int(np.rint(low / fs * nfft)), int(np.rint(top / fs * nfft))
    if ref_compat:
        return max(first, 1) - 1, last - 1
    return first, min(last, nfft // 2)


def select_band(spectra: DataFrame, column: str, first: int, last: int) -> DataFrame:
    return spectra.withColumn(column, F.slice(column, first + 1, last - first + 1))


def _per_bin(blocks: DataFrame, nfft: int, hop: int, reduce, result: str, *, taper=None) -> DataFrame:
    """`reduce` on the one-sided transforms of a block's frames: one value per bin and block.

    Frames are reduced where they are made; a block sends nfft / 2 + 1 numbers on.
    """
    right_col = F.col("right_halo") if "right_halo" in blocks.columns else F.array().cast("array<double>")

    @F.arrow_udf("struct<n: bigint, v: array<double>>")
    def run(mid: pa.Array, right: pa.Array, start: pa.Array) -> pa.Array:
        counts, values = [], []
        for x, more, s in zip(kernels.rows_of(mid), kernels.rows_of(right), start.to_pylist()):
            _, y = _frames(x, more, s, nfft, hop)
            n = (len(y) - nfft) // hop + 1 if len(y) >= nfft else 0
            counts.append(n)
            if n:
                cut = np.lib.stride_tricks.sliding_window_view(y, nfft)[::hop]
                values.append(reduce(np.fft.rfft(cut if taper is None else cut * taper, axis=1)))
            else:
                values.append(np.zeros(0))
        return pa.StructArray.from_arrays([pa.array(counts, type=pa.int64()), kernels.lists_from(values)], names=["n", "v"])

    reduced = blocks.select(*KEYS, run(F.col("samples"), right_col, checked_start(blocks, nfft, hop)).alias("r"))
    return reduced.select(*KEYS, F.col("r.n").alias("n"), F.posexplode("r.v").alias("bin", result))


def max_spectrum(blocks: DataFrame, nfft: int) -> DataFrame:
    """Largest normalized magnitude over time per channel and bin."""
    rows = _per_bin(blocks, nfft, nfft, lambda z: np.abs(z).max(axis=0) / nfft * 2, "top")
    return rows.groupBy(*KEYS, "bin").agg(F.max("top").alias("amplitude"))


def averaged_density(blocks: DataFrame, fs: float, nfft: int = PSD_NFFT) -> DataFrame:
    """Power density in dB averaged over half-overlapped Hamming frames, per channel and bin.

    Blocks need a right halo of nfft - 1.
    """
    taper = np.hamming(nfft)
    weight = np.full(nfft // 2 + 1, 2.0) / (fs * np.sum(taper * taper))
    weight[[0, -1] if nfft % 2 == 0 else [0]] /= 2
    hop = nfft - nfft // 2
    rows = _per_bin(blocks, nfft, hop, lambda z: (np.abs(z) ** 2).sum(axis=0) * weight, "p", taper=taper)
    mean = rows.groupBy(*KEYS, "bin").agg((F.sum("p") / F.sum("n")).alias("p"))
    return mean.select(
        *KEYS, "bin", bin_frequency(F.col("bin"), fs, nfft).alias("freq"), (F.lit(10.0) * F.log10("p")).alias("level_db")
    )
