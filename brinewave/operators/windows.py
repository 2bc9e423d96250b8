"""Windows of samples around detections.

Raw samples stay in the tasks that scan them; windows are cut there, and only the cut-outs move on.

Spans that are few (checked) are sent to the scan as a broadcast join. Others are *dealt*: written
once in files by (recording, run of blocks), so that a scan task, which reads consecutive blocks,
opens the few files that concern them. Either way no exchange holds samples of a block.

Two forms of blocks:

* one row per channel (`cut_spans`, `cut_windows`): a span's cut-outs are then grouped by span;
* all channels in a row with their halos (`schemas.WIDE_BLOCKS`, from the PCM source with `wide` or from
  `blocks.wide`): a span lies in the row of the block where it begins, so that a window is complete as
  it is cut and nothing is grouped (`cut_wide`). Halos must be as long as a span may reach beyond its block.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from brinewave.operators.blocks import needs_halo
from brinewave.operators.groups import is_small
from brinewave.session import cut_lineage, job_dir, opened

REC = "recording_id"
RUN = 64  # consecutive blocks whose spans are dealt together: what a scan task of the PCM source reads
PART_ROWS = 100_000  # spans of one part, on average
PART = "_part"


@dataclass(frozen=True)
class Dealt:
    """Spans, a row for each block that they touch, in files by part."""

    folder: str
    parts: int
    spans: StructType

    def part(self) -> Column:
        run = F.floor(F.col("block_id") / RUN)
        return F.pmod(F.xxhash64(F.col(REC).cast("string"), run), F.lit(self.parts)).cast("int")

    def also(self, more: str) -> StructType:
        """The spans' own columns and more."""
        return StructType([f for f in self.spans if f.name != "block_id"] + list(StructType.fromDDL(more)))


def touched(spans: DataFrame, block_len: int, whole: bool) -> DataFrame:
    """Spans with block_id: that of the block where they begin, or (a row for each) of all blocks they touch."""
    first = F.floor((F.greatest(F.col("first_idx"), F.lit(1)) - 1) / block_len)
    last = F.floor((F.greatest(F.col("last_idx"), F.lit(1)) - 1) / block_len)
    return spans.withColumn("block_id", first if whole else F.explode(F.sequence(first, last)))


def deal(spread: DataFrame) -> Dealt:
    """Write spans with their block_id in files by part; `spread` is a written table."""
    dealt = Dealt(f"{job_dir(spread.sparkSession)}/{uuid.uuid4().hex}", max(1, -(-spread.count() // PART_ROWS)), spread.schema)
    spread.withColumn(PART, dealt.part()).repartition(PART).write.partitionBy(PART).parquet(dealt.folder)
    return dealt


@functools.lru_cache(maxsize=4)
def part_of(folder: str, part: int) -> tuple[pa.Table | None, dict[tuple, np.ndarray]]:
    """The spans of a part, and the rows of each (recording, block)."""
    system, inner = opened(f"{folder}/{PART}={part}")
    found = system.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    tables = [pq.read_table(f.path, filesystem=system, partitioning=None) for f in found if f.path.endswith(".parquet")]
    if not tables:
        return None, {}
    table = pa.concat_tables(tables).combine_chunks()
    rows: dict[tuple, list[int]] = {}
    for i, key in enumerate(zip(table.column(REC).to_pylist(), table.column("block_id").to_pylist())):
        rows.setdefault(key, []).append(i)
    return table, {k: np.array(v) for k, v in rows.items()}


def _spans_of(batch: pa.RecordBatch, folder: str) -> Iterator[tuple[int, pa.Table]]:
    """The rows of a batch whose block has spans, with these."""
    keys = zip(*(batch.column(c).to_pylist() for c in (PART, REC, "block_id")))
    for i, (part, rec, block) in enumerate(keys):
        table, rows = part_of(folder, part)
        if (mine := rows.get((rec, block))) is not None:
            yield i, table.take(pa.array(mine))


def _slices(x: np.ndarray, first: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """x[first:end] for many places, as lists."""
    size = end - first
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(x[at], pa.float64()))


def _as(schema: pa.Schema, table: pa.Table, **new: pa.Array) -> pa.RecordBatch:
    columns = [new[f.name] if f.name in new else table.column(f.name).combine_chunks() for f in schema]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _channel_pieces(folder: str, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, spans in _spans_of(batch, folder):
                x = batch.column("samples")[i].values.to_numpy(zero_copy_only=False)
                start, channel = (batch.column(c)[i].as_py() for c in ("start_idx", "channel"))
                begin = np.maximum(_numbers(spans, "first_idx"), start)
                end = np.minimum(_numbers(spans, "last_idx"), start + len(x) - 1)
                some = np.flatnonzero(end >= begin)
                begin, end = begin[some], end[some]
                yield _as(
                    schema, spans.take(pa.array(some)), channel=pa.array(np.full(len(some), channel)), piece_idx=pa.array(begin),
                    piece=_slices(x, begin - start, end - start + 1),
                )

    return run


def cut_pieces(blocks: DataFrame, spans: DataFrame, block_len: int) -> DataFrame:
    """The pieces of each block that fall into a span [first_idx, last_idx]."""
    spread = cut_lineage(touched(spans, block_len, whole=False))
    ready = blocks.select(REC, "channel", "block_id", "start_idx", "samples")
    if not is_small(spread):
        dealt = deal(spread)
        schema = dealt.also(f"channel {blocks.schema['channel'].dataType.simpleString()}, piece_idx bigint, piece array<double>")
        return ready.withColumn(PART, dealt.part()).mapInArrow(_channel_pieces(dealt.folder, to_arrow_schema(schema)), schema)
    joined = ready.join(F.broadcast(spread), [REC, "block_id"])
    begin = F.greatest(F.col("first_idx"), F.col("start_idx"))
    end = F.least(F.col("last_idx"), F.col("start_idx") + F.size("samples") - 1)
    piece = F.slice("samples", (begin - F.col("start_idx") + 1).cast("int"), (end - begin + 1).cast("int"))
    return joined.where(end >= begin).select(*spans.columns, "channel", begin.alias("piece_idx"), piece.alias("piece"))


def cut_spans(blocks: DataFrame, spans: DataFrame, block_len: int) -> DataFrame:
    """One row per span: `channels` holds struct<channel, first_idx, samples>, channels ascending.

    `spans` needs recording_id, det_id, first_idx, last_idx. Spans are clipped at
    the ends of the recording; `clipped` says so.
    """
    keys = list(spans.columns)
    # one shuffle by span serves both groupings
    pieces = cut_pieces(blocks, spans, block_len).repartition(*keys)
    per_channel = pieces.groupBy(*keys, "channel").agg(
        F.sort_array(F.collect_list(F.struct("piece_idx", "piece"))).alias("p")
    )
    joined = per_channel.select(
        *keys,
        F.struct(
            "channel", F.col("p")[0]["piece_idx"].alias("first_idx"), F.flatten("p.piece").alias("samples")
        ).alias("c"),
    )
    cut = joined.groupBy(*keys).agg(F.sort_array(F.collect_list("c")).alias("channels"))
    full = F.col("last_idx") - F.col("first_idx") + 1
    return cut.withColumn("clipped", F.size(F.col("channels")[0]["samples"]) < full)


def window_lists(channels: pa.ListScalar, available: int, begin: np.ndarray, end: np.ndarray) -> pa.ListArray:
    """For windows begin..end of a block: list<struct<channel, first_idx, samples>>, the block's channels in ascending order.

    `available` is the sample number that the block's lists begin with.
    """
    entries = sorted(((c["channel"].as_py(), c["samples"].values.to_numpy(zero_copy_only=False)) for c in channels), key=lambda e: e[0])
    n, k = len(begin), len(entries)
    cuts = pa.concat_arrays([_slices(x, begin - available, end - available + 1) for _, x in entries])
    by_window = cuts.take(pa.array(np.arange(n * k).reshape(k, n).T.ravel()))
    fields = [pa.array(np.tile([c for c, _ in entries], n), pa.int64()), pa.array(np.repeat(begin, k), pa.int64()), by_window]
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * k, pa.int32()), pa.StructArray.from_arrays(fields, names=["channel", "first_idx", "samples"]))


WINDOW = "array<struct<channel: bigint, first_idx: bigint, samples: array<double>>>"


def clip(first: np.ndarray, last: np.ndarray, start: int, before: int, size: int, held: int, halo: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the windows first..last of a block, cut at the ends of the recording; ValueError where the halo is too short.

    A right halo that is not full tells that the recording ends in it.
    """
    end = start - before + held - 1
    ends_here = end - (start + size - 1) < halo
    if len(last) and (last.max() > end and not ends_here or np.maximum(first, 1).min() < start - before):
        raise ValueError(f"a window reaches beyond a halo of {halo} samples")
    return np.maximum(first, start - before), np.minimum(last, end)


def _whole_windows(folder: str, schema: pa.Schema, halo: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, spans in _spans_of(batch, folder):
                start, before, size = (batch.column(c)[i].as_py() for c in ("start_idx", "before", "size"))
                channels = batch.column("channels")[i]
                held = len(channels[0]["samples"])
                first, last = _numbers(spans, "first_idx"), _numbers(spans, "last_idx")
                begin, end = clip(first, last, start, before, size, held, halo)
                some = np.flatnonzero(end >= begin)
                begin, end = begin[some], end[some]
                yield _as(
                    schema, spans.take(pa.array(some)), channels=window_lists(channels, start - before, begin, end),
                    clipped=pa.array((begin > first[some]) | (end < last[some])),
                )

    return run


def cut_wide(wide: DataFrame, spans: DataFrame, block_len: int, halo: int) -> DataFrame:
    """As cut_spans, from blocks that hold all channels and halos of `halo` samples: each window is cut whole in one row.

    No samples are exchanged, not even cut-outs. A span that reaches further than the halo fails the job.
    """
    dealt = deal(cut_lineage(touched(spans, block_len, whole=True)))
    schema = dealt.also(f"channels {WINDOW}, clipped boolean")
    ready = wide.select(REC, "block_id", "start_idx", "before", "size", "channels").withColumn(PART, dealt.part())
    return ready.mapInArrow(_whole_windows(dealt.folder, to_arrow_schema(schema), halo), schema)


def over_spans(wide: DataFrame, spans: DataFrame, block_len: int, func, out: str, halo: int) -> DataFrame:
    """func on every block of all channels and every span that touches it, its rows beside the span's columns.

    func(channels, available, start, size, first, last) gets {channel: samples with halos}, the number of their first sample,
    the block's own stretch and the span, and gives tuples of the columns `out`. Recordings' ends cut the halos; an inner edge
    with less than `halo` samples fails the job.
    """
    dealt = deal(cut_lineage(touched(spans, block_len, whole=False)))
    schema = dealt.also(out)
    fields = to_arrow_schema(schema)
    kept = len(dealt.spans) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, mine in _spans_of(batch, dealt.folder):
                start, before, size = (batch.column(c)[i].as_py() for c in ("start_idx", "before", "size"))
                channels = {c["channel"].as_py(): c["samples"].values.to_numpy(zero_copy_only=False) for c in batch.column("channels")[i]}
                found = [func(channels, start - before, start, size, a, b) for a, b in zip(_numbers(mine, "first_idx"), _numbers(mine, "last_idx"))]
                again = mine.take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found])))
                new = {f.name: pa.array([row[k] for f_ in found for row in f_], f.type) for k, f in enumerate(list(fields)[kept:])}
                yield _as(fields, again, **new)

    held = needs_halo(wide, halo, "a look beyond a block")
    ready = held.select(REC, "block_id", "start_idx", "before", "size", "channels").withColumn(PART, dealt.part())
    return ready.mapInArrow(run, schema)


def around(dets: DataFrame, lo: int, hi: int) -> DataFrame:
    """Spans from idx + lo to idx + hi."""
    return dets.select(REC, "det_id", "idx", (F.col("idx") + lo).alias("first_idx"), (F.col("idx") + hi).alias("last_idx"))


def cut_windows(blocks: DataFrame, dets: DataFrame, lo: int, hi: int, block_len: int, halo: int | None = None) -> DataFrame:
    """Windows idx + lo .. idx + hi; blocks that hold all channels are cut as they are (their halo must be given)."""
    if "channels" not in blocks.columns:
        return cut_spans(blocks, around(dets, lo, hi), block_len)
    if halo is None:
        raise ValueError("blocks of all channels need their halo")
    return cut_wide(blocks, around(dets, lo, hi), block_len, halo)


def window_rows(windows: DataFrame) -> DataFrame:
    """One row per window, channel and sample."""
    rows = windows.select(REC, "det_id", F.inline("channels"))
    rows = rows.select(REC, "det_id", "channel", "first_idx", F.posexplode("samples").alias("_p", "x"))
    return rows.select(REC, "det_id", "channel", (F.col("first_idx") + F.col("_p")).alias("idx"), "x")


def window_values(windows: DataFrame, func, out: str) -> DataFrame:
    """func (a column of samples to a column) for every window and channel."""
    rows = windows.select(REC, "det_id", F.inline("channels"))
    return rows.select(REC, "det_id", "channel", func(F.col("samples")).alias(out))


def window_function(windows: DataFrame, func, schema: str) -> DataFrame:
    """func on a pandas frame of windows (recording_id, det_id, channel, first_idx, samples), batch by batch."""
    rows = windows.select(REC, "det_id", F.inline("channels"))
    return rows.mapInPandas(lambda batches: (func(b) for b in batches), schema)


def largest(samples: Column) -> Column:
    return F.array_max(F.transform(samples, F.abs))
