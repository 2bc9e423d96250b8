"""Blocks of samples: building them, halos, statistics and in-block transforms.

A block row holds consecutive samples of one channel. Work that looks at
neighbouring samples uses the halos, so it needs no shuffle once they are there:
the PCM reader adds them while reading, `with_halos` adds them to stored blocks
with one shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brinewave.functions import kernels
from brinewave.operators.groups import per_group
from brinewave.operators.tiles import TILE, add_tiles

REC = "recording_id"
KEYS = [REC, "channel"]


def from_samples(samples: DataFrame, block_len: int, halo: int = 0) -> DataFrame:
    """Long sample rows (recording_id, channel, idx, x) to blocks of block_len with halos."""
    zero = samples.withColumn("_at", F.col("idx") - 1)
    tiled = add_tiles(zero, "_at", block_len, before=halo, after=halo)
    first, end = F.col(TILE) * block_len, (F.col(TILE) + 1) * block_len
    grouped = tiled.groupBy(*KEYS, TILE).agg(F.sort_array(F.collect_list(F.struct("_at", "x"))).alias("l"))
    left = F.filter("l", lambda s: s["_at"] < first)
    mid = F.filter("l", lambda s: (s["_at"] >= first) & (s["_at"] < end))
    right = F.filter("l", lambda s: s["_at"] >= end)
    return grouped.select(
        *KEYS,
        F.col(TILE).alias("block_id"),
        (first + 1).alias("start_idx"),
        mid["x"].alias("samples"),
        left["x"].alias("left_halo"),
        right["x"].alias("right_halo"),
    ).where(F.size("samples") > 0)


def needs_halo(blocks: DataFrame, n: int | Column, why: str) -> DataFrame:
    """The same blocks; a job over them fails where an inner edge has less than n samples of halo.

    Halos are cut alike on both sides, so the left one tells: it is short only
    where the recording begins. Rows of all channels state theirs in `before`.
    """
    column, kind = ("before", "int") if "before" in blocks.columns else ("left_halo", "array<double>")
    have = F.col("before") if column == "before" else F.size("left_halo")
    need = (n if isinstance(n, Column) else F.lit(n)).cast("bigint")
    want = F.least(need, F.col("start_idx") - 1)
    said = F.concat(F.lit(f"{why} needs a halo of "), need.cast("string"), F.lit(" samples; a block has "), have.cast("string"))
    return blocks.withColumn(column, F.when(have < want, F.raise_error(said).cast(kind)).otherwise(F.col(column)))


def with_halos(blocks: DataFrame, halo: int) -> DataFrame:
    """Add `halo` samples of the neighbouring blocks; blocks that are shorter than it (but the last) fail the job."""
    size = F.size("samples")
    cut = F.least(F.lit(halo), size)
    none = F.lit(None).cast("array<double>")
    start = F.lit(None).cast("bigint")
    pieces = F.array(
        F.struct(
            F.col("block_id").alias("to"), F.col("start_idx").alias("s"), F.col("samples").alias("m"), none.alias("l"), none.alias("r")
        ),
        F.struct(
            (F.col("block_id") + 1).alias("to"),
            start.alias("s"),
            none.alias("m"),
            F.slice("samples", size - cut + 1, cut).alias("l"),
            none.alias("r"),
        ),
        F.struct(
            (F.col("block_id") - 1).alias("to"), start.alias("s"), none.alias("m"), none.alias("l"), F.slice("samples", F.lit(1), cut).alias("r")
        ),
    )
    sent = blocks.select(*KEYS, F.inline(pieces))
    pick = {n: F.first(n, ignorenulls=True) for n in ("s", "m", "l", "r")}
    empty = F.array().cast("array<double>")
    return (
        sent.groupBy(*KEYS, F.col("to").alias("block_id"))
        .agg(*[v.alias(n) for n, v in pick.items()])
        .where(F.col("m").isNotNull())
        .select(
            *KEYS,
            "block_id",
            F.col("s").alias("start_idx"),
            F.col("m").alias("samples"),
            F.coalesce("l", empty).alias("left_halo"),
            F.coalesce("r", empty).alias("right_halo"),
        )
        .transform(needs_halo, halo, "a halo over more than one block")
    )


def wide(blocks: DataFrame) -> DataFrame:
    """Blocks with halos to rows that hold all channels (`schemas.WIDE_BLOCKS`); one shuffle, to be stored once.

    The PCM source gives such rows without one.
    """
    entry = F.struct("channel", F.concat("left_halo", "samples", "right_halo").alias("samples"))
    one = lambda c: F.first(c).cast("int")
    return blocks.groupBy(REC, "block_id", "start_idx").agg(
        one(F.size("left_halo")).alias("before"), one(F.size("samples")).alias("size"), F.sort_array(F.collect_list(entry)).alias("channels")
    )


def narrow(wide: DataFrame) -> DataFrame:
    """Rows of all channels to one row per channel, without a shuffle."""
    kept = [c for c in wide.columns if c not in ("channels", "before", "size")]
    rows = wide.select(*kept, "before", "size", F.inline("channels"))
    end = F.col("before") + F.col("size")
    return rows.select(
        *kept, "channel", F.slice("samples", F.col("before") + 1, F.col("size")).alias("samples"),
        F.slice("samples", F.lit(1), F.col("before")).alias("left_halo"), F.slice("samples", end + 1, F.size("samples") - end).alias("right_halo"),
    )


def to_samples(blocks: DataFrame, column: str = "samples", first: str = "start_idx") -> DataFrame:
    """One row per sample; for sparse windows and small data."""
    kept = [c for c in blocks.columns if c not in (column, first, "samples", "left_halo", "right_halo", "block_id")]
    rows = blocks.select(*kept, F.col(first).alias("_first"), F.posexplode(column).alias("_p", "x"))
    return rows.select(*kept, (F.col("_first") + F.col("_p")).alias("idx"), "x")


STATS = "struct<n: bigint, energy: double, mean: double, m2: double, lo: double, hi: double, lo_at: bigint, hi_at: bigint>"


@kernels.arrow_function(STATS)
def block_stats(samples: pa.Array) -> pa.Array:
    """Count, energy, mean, squared deviations, extrema and their first positions (from 0)."""
    out = {k: [] for k in ("n", "energy", "mean", "m2", "lo", "hi", "lo_at", "hi_at")}
    for x in kernels.rows_of(samples):
        lo, hi, mean = int(x.argmin()), int(x.argmax()), float(x.mean())
        row = (len(x), float(np.dot(x, x)), mean, float(((x - mean) ** 2).sum()), float(x[lo]), float(x[hi]), lo, hi)
        for key, value in zip(out, row):
            out[key].append(value)
    return pa.StructArray.from_arrays([pa.array(v) for v in out.values()], names=list(out))


def channel_stats(blocks: DataFrame, *keys: str) -> DataFrame:
    """Extrema with first index, energy, largest magnitude, level and deviation per channel.

    One small row per block is combined; samples are read once and never shuffled.
    """
    keys = list(keys) or KEYS
    s = blocks.select(*keys, "start_idx", block_stats("samples").alias("s"))
    lo_at, hi_at = F.col("start_idx") + F.col("s.lo_at"), F.col("start_idx") + F.col("s.hi_at")
    total = F.sum(F.col("s.n") * F.col("s.mean"))
    spread = F.sum(F.col("s.m2") + F.col("s.n") * F.col("s.mean") * F.col("s.mean"))
    out = s.groupBy(*keys).agg(
        F.sum("s.n").alias("n"),
        F.min(F.struct(F.col("s.lo").alias("v"), lo_at.alias("at"))).alias("_lo"),
        F.max(F.struct(F.col("s.hi").alias("v"), (-hi_at).alias("at"))).alias("_hi"),
        F.sum("s.energy").alias("energy"),
        F.sqrt((spread - total * total / F.sum("s.n")) / (F.sum("s.n") - 1)).alias("deviation"),
    )
    low, high = F.col("_lo.v"), F.col("_hi.v")
    return out.select(
        *keys,
        "n",
        low.alias("min_val"),
        high.alias("max_val"),
        F.col("_lo.at").alias("min_idx"),
        (-F.col("_hi.at")).alias("max_idx"),
        "energy",
        F.greatest(high, -low).alias("max_abs"),
        (F.lit(20.0) * F.log10(high - low)).alias("level_db"),
        "deviation",
    )


def normalized(blocks: DataFrame) -> DataFrame:
    """Samples divided by the largest magnitude of their channel."""
    top = per_group(channel_stats(blocks).select(*KEYS, "max_abs"))
    joined = blocks.join(top, KEYS)
    return joined.withColumn("samples", F.transform("samples", lambda v: v / F.col("max_abs"))).drop("max_abs")


def ambient_levels(files: DataFrame) -> DataFrame:
    """Deviation per file and channel, and its ratio to the first file (by path).

    `files` are blocks with a `path` column.
    """
    levels = channel_stats(files, "path", "channel").select("path", "channel", "deviation")
    first = levels.groupBy("channel").agg(F.min_by("deviation", "path").alias("_first"))
    return levels.join(first, "channel").select("path", "channel", "deviation", (F.col("deviation") / F.col("_first")).alias("ratio"))


def add_signals(a: DataFrame, b: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Sum of two signals over the shorter length; both are blocks on the same grid.

    Recordings meet by their own id, or as `pairs` (recording_id, other_id) says; the result has
    the ids of a.
    """
    other = b.select(REC, "channel", "block_id", F.col("samples").alias("_b"))
    if pairs is not None:
        partner = pairs.select(REC, "other_id")
        other = other.withColumnRenamed(REC, "other_id").join(partner, "other_id").drop("other_id")
    n = F.least(F.size("samples"), F.size("_b"))
    total = F.zip_with(F.slice("samples", F.lit(1), n), F.slice("_b", F.lit(1), n), lambda x, y: x + y)
    return a.join(other, [REC, "channel", "block_id"]).withColumn("samples", total).drop("_b")


def _padded(left: pa.Array, mid: pa.Array, right: pa.Array):
    for a, x, b in zip(kernels.rows_of(left), kernels.rows_of(mid), kernels.rows_of(right)):
        yield np.concatenate([a, x, b]), len(a), len(x)


@kernels.arrow_function("array<double>")
def teager_energy(left: pa.Array, mid: pa.Array, right: pa.Array) -> pa.Array:
    """x[i]^2 - x[i-1]*x[i+1]; x^2 at the ends of the recording. Needs a halo of 1."""
    out = []
    for x, before, n in _padded(left, mid, right):
        y = x * x
        y[1:-1] -= x[:-2] * x[2:]
        out.append(y[before : before + n])
    return kernels.lists_from(out)


def sliding_sum(width: int) -> Column:
    """Sum of x[i] .. x[i + width - 1] where all of them exist. Needs a right halo of width - 1."""

    @F.arrow_udf("array<double>")
    def run(mid: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, more in zip(kernels.rows_of(mid), kernels.rows_of(right)):
            whole = np.concatenate([x, more[: width - 1]])
            out.append(np.convolve(whole, np.ones(width), mode="valid")[: len(x)] if len(whole) >= width else whole[:0])
        return kernels.lists_from(out)

    return run("samples", "right_halo")


def centred_kernel(kernel: np.ndarray) -> Column:
    """sum_k kernel[k] * x[i + L/2 - k], zero before the recording begins. Needs a halo of L.

    Defined for i up to n_samples - L; callers drop later samples.
    """
    length, half = len(kernel), len(kernel) // 2

    @F.arrow_udf("array<double>")
    def run(left: pa.Array, mid: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, before, n in _padded(left, mid, right):
            first = before + half  # place of sample i = 0 of the block in the full convolution
            out.append(np.convolve(x, kernel)[first : first + n])
        return kernels.lists_from(out)

    return run("left_halo", "samples", "right_halo")


def peaks_in_blocks(blocks: DataFrame, dist: int) -> DataFrame:
    """Local maxima with `dist` lower samples on both sides. Needs halos of dist."""

    @F.arrow_udf("array<struct<at: bigint, peak: double>>")
    def run(left: pa.Array, mid: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for x, before, n in _padded(left, mid, right):
            at = kernels.local_peaks(x, dist)
            at = at[(at >= before) & (at < before + n)]
            out.append((at - before, x[at]))
        return kernels.structs_from([len(at) for at, _ in out], at=[at for at, _ in out], peak=[x for _, x in out])

    held = needs_halo(blocks, dist, "a peak search")
    found = held.select(*KEYS, "start_idx", F.inline(run("left_halo", "samples", "right_halo")))
    return found.select(*KEYS, (F.col("start_idx") + F.col("at")).alias("idx"), "peak")


def frame_energy(blocks: DataFrame, frame_len: int, n_samples: DataFrame | None = None) -> DataFrame:
    """Mean energy of consecutive frames; frames that are not full are dropped.

    A block reports the energy of its part of each frame, parts are then summed.
    """

    @F.arrow_udf("array<struct<frame: bigint, n: bigint, e: double>>")
    def parts(mid: pa.Array, start: pa.Array) -> pa.Array:
        out = []
        for x, s in zip(kernels.rows_of(mid), start.to_pylist()):
            frame = (np.arange(len(x)) + s - 1) // frame_len
            cuts = np.flatnonzero(np.diff(frame, prepend=frame[0] - 1))
            sums = np.add.reduceat(x * x, cuts)
            out.append((frame[cuts], np.diff(np.append(cuts, len(x))), sums))
        frames, counts, energies = zip(*out) if out else ((), (), ())
        return kernels.structs_from([len(f) for f in frames], frame=list(frames), n=list(counts), e=list(energies))

    rows = blocks.select(*KEYS, F.inline(parts("samples", "start_idx")))
    summed = rows.groupBy(*KEYS, "frame").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    return summed.where(F.col("n") == frame_len).select(*KEYS, "frame", (F.col("e") / frame_len).alias("energy"))


def noise_frames(frames: DataFrame, threshold: float, drop_last: bool = True) -> DataFrame:
    """Frames whose energy is above the threshold; the last one of a recording is dropped as an option.

    An infinite threshold turns the detector off: no rows (its count is then -1).
    """
    hits = frames.where(F.col("energy") > threshold)
    if not drop_last:
        return hits
    last = hits.groupBy(REC).agg(F.max("frame").alias("_last"))
    return hits.join(last, REC).where(F.col("frame") < F.col("_last")).drop("_last")

