"""Delays between channels in the window of each detection."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brinewave.functions import kernels
from brinewave.operators import windows
from brinewave.operators.blocks import needs_halo
from brinewave.operators.filters import ENVELOPE_LIMIT
from brinewave.operators.groups import small_side
from brinewave.session import cut_lineage

REC = "recording_id"
# Cut-out of the reference signal around the detection, and the share of the maximum that triggers.
REF_LO, REF_HI = -30, 33
TRIGGER_SHARE = 0.75


# Methods take x[window, channel, sample] of equal windows and give one number per window and channel.


def _to_reference(x: np.ndarray, ref: int | np.ndarray, **_) -> np.ndarray:
    every = np.arange(len(x))
    found = kernels.delays(x, x[every, ref])
    found[every, ref] = 0
    return found


def _max_energy(x, **_):
    return _to_reference(x, (x * x).sum(axis=2).argmax(axis=1))


def _max_peak(x, first, idx, **_):
    ref = np.abs(x).max(axis=2).argmax(axis=1)
    begin, end = np.maximum(idx + REF_LO - first, 0), np.minimum(idx + REF_HI - first, x.shape[2] - 1)
    out = np.zeros(x.shape[:2], dtype=np.int64)
    for a, b in np.unique(np.stack([begin, end], axis=1), axis=0):  # windows at a recording's ends have cut-outs of their own
        mine = np.flatnonzero((begin == a) & (end == b))
        out[mine] = kernels.delays(x[mine], x[mine, ref[mine], a : b + 1])
    return out


def _envelope(x, ref, **_):
    return _to_reference(kernels.envelope(x), ref)


def _envelope_filtered(x, ref, fs, **_):
    return _to_reference(kernels.zero_phase(kernels.envelope(x), fs, (0, ENVELOPE_LIMIT)), ref)


def _max(x, ref, **_):
    at = x.argmax(axis=2)
    return at - at[:, [ref]]


def _min(x, ref, **_):
    at = x.argmin(axis=2)
    return at - at[:, [ref]]


def _vote(x, upwards):
    up = upwards.sum(axis=1, keepdims=True) > x.shape[1] / 2
    return np.where(up, x.argmax(axis=2), x.argmin(axis=2)) + 1


def _minmax(x, **_):
    """Places (from 1) of the maxima; of the minima where most channels are constant."""
    return _vote(x, x.max(axis=2) > x.min(axis=2))


def _minmax_abs(x, **_):
    """Places of the maxima or minima, whichever is larger in magnitude on most channels."""
    return _vote(x, np.abs(x.max(axis=2)) > np.abs(x.min(axis=2)))


def _trigger(x, **_):
    """First place (from 1) whose magnitude is above a share of the signed maximum, 0 where none is."""
    loud = np.abs(x) > x.max(axis=2, keepdims=True) * TRIGGER_SHARE
    return np.where(loud.any(axis=2), loud.argmax(axis=2) + 1, 0)


def _trigger_denoised(x, **_):
    return _trigger(kernels.haar_denoise(x))


METHODS: dict[str, Callable[..., np.ndarray]] = {
    "raw": _to_reference,
    "max_energy": _max_energy,
    "max_peak": _max_peak,
    "envelope": _envelope,
    "envelope_filtered": _envelope_filtered,
    "max": _max,
    "min": _min,
    "minmax": _minmax,
    "minmax_abs": _minmax_abs,
    "trigger": _trigger,
    "trigger_denoised": _trigger_denoised,
}
DEFAULT_METHOD = "minmax"


def delays(cut: DataFrame, methods: list[str], ref_channel: int, fs: float) -> DataFrame:
    """recording_id, det_id, idx, method, delays (one per channel, ascending) for cut windows.

    All methods read the same windows, so they share one join with the blocks.
    A delay is positive when the channel is later than its reference.
    """
    chosen = {m: METHODS[m] for m in methods}

    @F.arrow_udf("array<struct<method: string, delays: array<int>>>")
    def run(samples: pa.Array, first: pa.Array, idx: pa.Array) -> pa.Array:
        begins, places = (c.to_numpy(zero_copy_only=False) for c in (first, idx))
        rows: list[list[dict]] = [[] for _ in range(len(samples))]
        for mine, x in kernels.stacked(samples):
            args = dict(ref=ref_channel - 1, fs=fs, first=begins[mine], idx=places[mine])
            for m, fn in chosen.items():
                for i, found in zip(mine, fn(x, **args).astype(np.int32)):
                    rows[i].append({"method": m, "delays": found})
        return pa.array(rows, type=pa.list_(pa.struct([("method", pa.string()), ("delays", pa.list_(pa.int32()))])))

    named = run(F.col("channels.samples"), F.col("channels")[0]["first_idx"], F.col("idx"))
    kept = [c for c in cut.columns if c not in ("channels", "first_idx", "last_idx")]
    return cut.select(*kept, F.inline(named))


def detection_delays(
    blocks: DataFrame, dets: DataFrame, lo: int, hi: int, block_len: int, methods: list[str], ref_channel: int, fs: float
) -> DataFrame:
    """Delays in the window idx + lo .. idx + hi of each detection."""
    return delays(windows.cut_windows(blocks, dets, lo, hi, block_len), methods, ref_channel, fs)


def segment_delays(
    blocks: DataFrame, segments: DataFrame, block_len: int, ref_channel: int, max_lag: int, halo: int | None = None
) -> DataFrame:
    """Delays over segments start_idx .. end_idx of any length, of at most max_lag samples either way.

    A block adds the products of its own reference samples to the correlation at each lag, and the
    sums over a segment's blocks are its correlation: what moves is 2 * max_lag + 1 numbers for each block and
    channel, and no row grows with the segment. Blocks hold all channels (`schemas.WIDE_BLOCKS`) with a halo of
    at least max_lag, which is the most that the array allows: its largest distance / speed of sound * rate.
    A recording without the reference channel has no delays.
    """
    spans = segments.select(REC, F.col("start_idx").alias("first_idx"), F.col("end_idx").alias("last_idx"))
    parts = windows.over_spans(blocks, spans, block_len, _partial_correlation(ref_channel, max_lag), "channel int, corr array<double>", max_lag if halo is None else halo)
    lags = parts.select(REC, "first_idx", "last_idx", "channel", F.posexplode("corr").alias("_p", "_c"))
    summed = lags.groupBy(REC, "first_idx", "last_idx", "channel", (F.col("_p") - max_lag).alias("lag")).agg(F.sum("_c").alias("c"))
    # magnitudes at nine decimals; of equal ones the lag nearest to zero, then the larger one
    rank = F.struct(F.round(F.abs("c"), 9), -F.abs("lag"), F.col("lag"))
    best = summed.groupBy(REC, "first_idx", "last_idx", "channel").agg(F.max_by("lag", rank).alias("delay"))
    delay = F.when(F.col("channel") == ref_channel, 0).otherwise(F.col("delay")).cast("int")
    listed = best.groupBy(REC, "first_idx", "last_idx").agg(F.array_sort(F.collect_list(F.struct("channel", delay.alias("delay")))).alias("l"))
    start = F.col("first_idx")
    return listed.select(REC, start.alias("det_id"), start.alias("idx"), F.lit("segment").alias("method"), F.col("l.delay").alias("delays"))


def _partial_correlation(ref_channel: int, max_lag: int):
    """Per span and channel: sum over a block's own reference samples i of x[i + lag] * ref[i], both inside the span."""

    def cut(channels: dict[int, np.ndarray], available: int, start: int, size: int, first: int, last: int) -> list[tuple]:
        low, high = max(first, start), min(last, start + size - 1)
        if high < low or ref_channel not in channels:
            return []
        ref = channels[ref_channel][low - available : high - available + 1]
        out = []
        for channel, x in sorted(channels.items()):
            begin, end = max(first, low - max_lag, available), min(last, high + max_lag, available + len(x) - 1)
            part = x[begin - available : end - available + 1]
            padded = np.concatenate([np.zeros(begin - low + max_lag), part, np.zeros(high + max_lag - end)])
            out.append((channel, kernels.correlate(padded, ref)[len(ref) - 1 : len(ref) + 2 * max_lag]))
        return out

    return cut


def timed_delays(
    blocks: DataFrame, dets: DataFrame, length_s: float, block_len: int, ref_channel: int, fs: float
) -> DataFrame:
    """Delays over a window of fixed length from each detection's time on."""
    return detection_delays(blocks, dets, 0, int(round(length_s * fs)), block_len, ["raw"], ref_channel, fs)


def per_channel(tdoa: DataFrame) -> DataFrame:
    """One row per detection, method and channel."""
    return tdoa.select(
        REC, "det_id", "method", F.posexplode("delays").alias("_p", "delay")
    ).select(REC, "det_id", "method", (F.col("_p") + 1).alias("channel"), "delay")


def pair_delays(blocks: DataFrame, first_channel: int, second_channel: int) -> DataFrame:
    """Delay and correlation peak between two channels of each block."""

    @F.arrow_udf("struct<delay: int, peak: double>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        found = [kernels.delay(x, y) for x, y in zip(kernels.rows_of(a), kernels.rows_of(b))]
        return pa.StructArray.from_arrays(
            [pa.array([d for d, _ in found], type=pa.int32()), pa.array([p for _, p in found])], names=["delay", "peak"]
        )

    x = blocks.where(F.col("channel") == first_channel).select(REC, "block_id", F.col("samples").alias("_x"))
    y = blocks.where(F.col("channel") == second_channel).select(REC, "block_id", F.col("samples").alias("_y"))
    return x.join(y, [REC, "block_id"]).select(REC, "block_id", run("_x", "_y").alias("d")).select(REC, "block_id", "d.delay", "d.peak")


SHARE_OF_SAMPLES = 10  # fixed value: more peaks than a tenth of the samples are no arrivals


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal of exactly these samples."""
    step = np.zeros(len(x))
    step[: (len(x) + 1) // 2] = 2
    step[0] = 1
    if len(x) % 2 == 0:
        step[len(x) // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * step)


class Hills:
    """Peaks of a series in order, each given back with its prominence as soon as that is known.

    The prominence is the height above the higher of two valleys: the lowest places on the way to a higher peak, or to the
    series' end, on either side. Of equal peaks the earlier one is the higher. Only peaks without a higher one since are held.
    """

    def __init__(self):
        self.held: list[list] = []  # height, left valley, lowest place since, what to give back
        self.lowest = np.inf

    def down(self, low: float) -> None:
        """The lowest place since the last peak."""
        self.lowest = min(self.lowest, low)
        if self.held:
            self.held[-1][2] = min(self.held[-1][2], low)

    def up(self, height: float, what) -> Iterator[tuple[float, float, object]]:
        """A peak; gives height, prominence and mark of those that it outdoes."""
        while self.held and self.held[-1][0] < height:
            yield self._off()
        self.held.append([height, self.held[-1][2] if self.held else self.lowest, np.inf, what])

    def end(self) -> Iterator[tuple[float, float, object]]:
        while self.held:
            yield self._off()

    def _off(self) -> tuple[float, float, object]:
        height, left, since, what = self.held.pop()
        if self.held:
            self.held[-1][2] = min(self.held[-1][2], left, since)
        return height, height - max(left, since), what


def _standing(m: np.ndarray, at: np.ndarray, first: int, end: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Which peaks of a block may stand out by `least` in the whole series, and the lowest places before, between and after them.

    A peak that is too low against a valley which ends at a higher peak of the block is so whatever lies outside.
    """
    heights = m[at]
    edges = np.concatenate([[first], at, [end]])
    valleys = np.array([m[a:b].min() if b > a else np.inf for a, b in zip(edges, edges[1:])])
    stays = np.ones(len(at), dtype=bool)
    for leftwards in (True, False):
        stack: list[tuple[float, float]] = []  # height, lowest place between a peak and the one held before it
        for i in range(len(at)) if leftwards else reversed(range(len(at))):
            low = valleys[i if leftwards else i + 1]
            while stack and (stack[-1][0] < heights[i] or not leftwards and stack[-1][0] == heights[i]):
                low = min(low, stack.pop()[1])
            stays[i] &= not stack or heights[i] - low >= least
            stack.append((heights[i], low))
    kept = np.flatnonzero(stays)
    cuts = np.concatenate([[0], kept + 1, [len(valleys)]])
    return kept, np.array([valleys[a:b].min() for a, b in zip(cuts, cuts[1:])])


def arrivals(blocks: DataFrame, reference: np.ndarray, n: int, prominence: float = 0.2, min_gap: int = 1) -> DataFrame:
    """Up to n arrivals of a reference signal per recording and channel: recording_id, channel, idx, strength, re, im.

    The matched filter correlates with the analytic reference, divided by its deviation and length; strength is the
    magnitude and re and im the complex amplitude. Peaks (the largest of min_gap samples on either side) whose topographic
    prominence is at least that share of the channel's largest magnitude are ranked by strength, and the first n come in
    the order of time. Where more than a tenth of the samples are such peaks, none is an arrival.

    Blocks need halos of len(reference) + min_gap. Raw samples are read once; a block gives its peaks that may stand out and the
    valleys between them, which are put together along the channel, held only as far as a higher peak may still come.
    """
    ref = analytic(np.asarray(reference, dtype=float))
    scale = 2 / (np.std(ref, ddof=1) * len(ref))  # the signal's analytic form has twice its positive frequencies

    @F.arrow_udf("struct<top: double, n: bigint, at: array<bigint>, height: array<double>, re: array<double>, im: array<double>, low: array<double>>")
    def run(left: pa.Array, mid: pa.Array, right: pa.Array, start: pa.Array) -> pa.Array:
        out: list[tuple] = []
        for a, x, b, s in zip(kernels.rows_of(left), kernels.rows_of(mid), kernels.rows_of(right), start.to_pylist()):
            whole = np.concatenate([a, x, b])
            size = kernels.fast_length(len(whole) + len(ref))
            z = np.fft.ifft(np.fft.fft(whole, size) * np.conj(np.fft.fft(ref, size)))[: len(whole)] * scale
            m, first, end = np.abs(z), len(a), len(a) + len(x)
            at = kernels.local_peaks(m, min_gap)
            at = at[(at >= first) & (at < end)]
            # the ends of the recording are high ground, though no peaks
            if s == 1 and len(m) > 1 and m[0] > m[1]:
                at = np.concatenate([[0], at])
            if len(b) == 0 and len(m) > 1 and m[-1] > m[-2]:
                at = np.concatenate([at, [len(m) - 1]])
            top = float(m[first:end].max()) if len(x) else 0.0
            kept, lows = _standing(m, at, first, end, prominence * top)
            at = at[kept]
            out.append((top, len(x), at - first, m[at], z.real[at], z.imag[at], lows))
        columns = list(zip(*out)) if out else [()] * 7
        lists = [pa.array([v.tolist() for v in columns[2]], pa.list_(pa.int64())), *(kernels.lists_from(list(c)) for c in columns[3:])]
        fields = [pa.array(columns[0], pa.float64()), pa.array(columns[1], pa.int64()), *lists]
        return pa.StructArray.from_arrays(fields, names=["top", "n", "at", "height", "re", "im", "low"])

    held = needs_halo(blocks, len(ref) + min_gap, "a matched filter")
    hills = held.select(REC, "channel", "start_idx", run("left_halo", "samples", "right_halo", "start_idx").alias("h"))
    found = cut_lineage(hills.select(REC, "channel", "start_idx", "h.*"))
    known = cut_lineage(found.groupBy(REC, "channel").agg(F.max("top").alias("_top"), F.sum("n").alias("_n"), F.max(F.col("start_idx") + F.col("n") - 1).alias("_last")))
    rows = found.drop("top", "n").join(small_side(known), [REC, "channel"])
    ordered = rows.repartition(REC, "channel").sortWithinPartitions(REC, "channel", "start_idx")
    kinds = [f"{c} {blocks.schema[c].dataType.simpleString()}" for c in (REC, "channel")]
    return ordered.mapInArrow(_ranked(n, prominence), ", ".join(kinds) + ", idx bigint, strength double, re double, im double")


def _ranked(n: int, prominence: float):
    """Blocks' hills in order to a channel's arrivals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, hills, count, best, least, tenth = None, Hills(), 0, [], 0.0, 0.0
        kinds = None

        def take(done) -> None:
            nonlocal count
            for height, rise, what in done:
                if what is not None and rise >= least:
                    count += 1
                    heapq.heappush(best, (height, -what[0], what))
                    if len(best) > n:
                        heapq.heappop(best)

        def finish() -> pa.RecordBatch:
            take(hills.end())
            rows = sorted((what[0], height, *what[1:]) for height, _, what in best) if count <= tenth else []
            values = [[me[0]] * len(rows), [me[1]] * len(rows), *([r[k] for r in rows] for k in range(4))]
            names = [REC, "channel", "idx", "strength", "re", "im"]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds)], names)

        for batch in batches:
            kinds = [*(batch.schema.field(c).type for c in (REC, "channel")), pa.int64(), *[pa.float64()] * 3]
            for row in batch.to_pylist():
                key = (row[REC], row["channel"])
                if me is not None and key != me:
                    yield finish()
                    hills, count, best = Hills(), 0, []
                me, least, tenth = key, prominence * row["_top"], row["_n"] / SHARE_OF_SAMPLES
                for at, height, re, im, low in zip(row["at"], row["height"], row["re"], row["im"], row["low"]):
                    idx = row["start_idx"] + at
                    hills.down(low)
                    inside = 1 < idx < row["_last"]
                    take(hills.up(height, (idx, re, im) if inside else None))
                hills.down(row["low"][-1])
        if me is not None:
            yield finish()

    return run
