"""Raw interleaved PCM as blocks with halos, in batch and as a stream.

Frames have a fixed width, so one file splits into any number of tasks, each
reading its own byte range. A block row carries the neighbouring samples of its
channel (the halos), so that filters and peak searches need no shuffle.

    spark.dataSource.register(PcmSource)
    spark.read.format("pcm").option("channels", 4).option("fs", 500000).load(folder)

Filters on start_idx and channel are pushed into the byte ranges and columns read
with the option pushdown, which `read_pcm` sets where spark.sql.python.filterPushdown.enabled
is true; Spark refuses such a reader elsewhere. With the option wide a row holds all
channels of a block, from which windows are cut without a shuffle (`operators.windows`).
"""

from __future__ import annotations

import json
import posixpath
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
)
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructType

from brinewave import schemas
from brinewave.functions.kernels import lists_from
from brinewave.session import opened

SCHEMA = schemas.BLOCKS.replace("recording_id string", "recording_id string, path string")
ARROW_SCHEMA = pa.schema(
    [
        ("recording_id", pa.string()),
        ("path", pa.string()),
        ("channel", pa.int32()),
        ("block_id", pa.int64()),
        ("start_idx", pa.int64()),
        ("samples", pa.list_(pa.float64())),
        ("left_halo", pa.list_(pa.float64())),
        ("right_halo", pa.list_(pa.float64())),
    ]
)
WIDE_SCHEMA = schemas.WIDE_BLOCKS.replace("recording_id string", "recording_id string, path string")
WIDE_ARROW = pa.schema(
    [
        *list(ARROW_SCHEMA)[:2],
        ("block_id", pa.int64()),
        ("start_idx", pa.int64()),
        ("before", pa.int32()),
        ("size", pa.int32()),
        ("channels", pa.list_(pa.struct([("channel", pa.int32()), ("samples", pa.list_(pa.float64()))]))),
    ]
)
# Channels, rate and sample type of a recorder file where nothing else is said.
CHANNELS, RATE, SAMPLE_TYPE = 5, 400_000, "int16"


@dataclass(frozen=True)
class Layout:
    """How the files are laid out and cut."""

    channels: int
    fs: float
    dtype: str
    block_len: int
    halo: int
    task_blocks: int
    skip_s: float
    duration_s: float | None
    wide: bool

    @property
    def frame_bytes(self) -> int:
        return np.dtype(self.dtype).itemsize * self.channels

    @staticmethod
    def of(options: dict) -> Layout:
        get = {k.lower(): v for k, v in options.items()}.get
        duration = get("duration_s")
        return Layout(
            channels=int(get("channels", CHANNELS)),
            fs=float(get("fs", RATE)),
            dtype=np.dtype(get("dtype", SAMPLE_TYPE)).newbyteorder("<").str,
            block_len=int(get("block_len", 131_072)),
            halo=int(get("halo", 0)),
            task_blocks=int(get("task_blocks", 64)),
            skip_s=float(get("skip_s", 0)),
            duration_s=None if duration is None else float(duration),
            wide=str(get("wide", "false")).lower() == "true",
        )

    def frame_range(self, size: int) -> tuple[int, int]:
        """First and end frame (from 0) to read of a file of `size` bytes; both are whole frames."""
        total = size // self.frame_bytes
        first = min(int(self.skip_s * self.fs), total)
        return first, total if self.duration_s is None else min(first + int(self.fs * self.duration_s), total)


@dataclass(frozen=True)
class Ranges(InputPartition):
    """Blocks first .. end - 1 of one file; frames from `begin` on, up to `limit`, are the recording."""

    path: str
    name: str
    begin: int
    limit: int
    first: int
    end: int
    channels: tuple[int, ...]


def list_pcm(path: str, suffix: str = ".bin") -> list[tuple[str, int]]:
    """Visible files below a folder (or the one file), by name, with their sizes."""
    system, inner = opened(path)
    # files keep the scheme and host of the folder, so that any executor opens them where they are
    root = path.rstrip("/")[: -len(inner.rstrip("/"))] if "://" in path and path.rstrip("/").endswith(inner.rstrip("/")) else ""
    info = system.get_file_info(inner)
    if info.type == pafs.FileType.File:
        found = [info]
    else:
        found = system.get_file_info(pafs.FileSelector(inner, recursive=True))
    visible = [
        (root + f.path, f.size)
        for f in found
        if f.type == pafs.FileType.File and f.path.endswith(suffix) and not posixpath.basename(f.path).startswith(".")
    ]
    return sorted(visible)


def recording_name(path: str, folder: str) -> str:
    """A file's path below the folder, without its ending; the plain name if the folder is the file itself."""
    inside = posixpath.relpath(opened(path)[1], opened(folder)[1])
    return posixpath.splitext(posixpath.basename(path) if inside == "." else inside)[0]


def _read_frames(path: str, layout: Layout, first: int, end: int) -> np.ndarray:
    system, inner = opened(path)
    with system.open_input_file(inner) as f:
        raw = f.read_at((end - first) * layout.frame_bytes, first * layout.frame_bytes)
    return np.frombuffer(raw, dtype=layout.dtype).reshape(-1, layout.channels)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows), type=pa.float64()))


def read_blocks(part: Ranges, layout: Layout) -> Iterator[pa.RecordBatch]:
    """One batch per block: a row for each wanted channel, or one row of them all."""
    n, halo = layout.block_len, layout.halo
    for block in range(part.first, part.end):
        lo = part.begin + block * n
        hi = min(lo + n, part.limit)
        if lo >= hi:
            continue
        a, b = max(lo - halo, part.begin), min(hi + halo, part.limit)
        frames = _read_frames(part.path, layout, a, b).astype(np.float64)
        wanted = [c for c in part.channels]
        cut = [frames[:, c - 1] for c in wanted]
        k = len(wanted)
        if layout.wide:
            entries = pa.StructArray.from_arrays([pa.array(wanted, pa.int32()), _lists(cut)], names=["channel", "samples"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part.name]),
                    pa.array([part.path]),
                    pa.array([block], pa.int64()),
                    pa.array([block * n + 1], pa.int64()),
                    pa.array([lo - a], pa.int32()),
                    pa.array([hi - lo], pa.int32()),
                    pa.ListArray.from_arrays(pa.array([0, k], pa.int32()), entries),
                ],
                schema=WIDE_ARROW,
            )
            continue
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([part.name] * k),
                pa.array([part.path] * k),
                pa.array(wanted, type=pa.int32()),
                pa.array([block] * k, type=pa.int64()),
                pa.array([block * n + 1] * k, type=pa.int64()),
                _lists([x[lo - a : hi - a] for x in cut]),
                _lists([x[: lo - a] for x in cut]),
                _lists([x[hi - a :] for x in cut]),
            ],
            schema=ARROW_SCHEMA,
        )


class WholeReader(DataSourceReader):
    """Reads all blocks and channels; Spark applies the filters."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".bin")
        self.layout = Layout.of(options)
        self.low, self.high = 1, None  # start_idx bounds from pushed filters
        self.channels = tuple(range(1, self.layout.channels + 1))

    def partitions(self) -> list[InputPartition]:
        n = self.layout.block_len
        out: list[InputPartition] = []
        for path, size in list_pcm(self.path, self.suffix):
            begin, limit = self.layout.frame_range(size)
            blocks = -(-(limit - begin) // n)
            first = max(0, -(-(self.low - 1) // n))
            end = blocks if self.high is None else min(blocks, (self.high - 1) // n + 1)
            for k in range(first, end, self.layout.task_blocks):
                stop = min(k + self.layout.task_blocks, end)
                out.append(Ranges(path=path, name=recording_name(path, self.path), begin=begin, limit=limit, first=k, end=stop, channels=self.channels))
        return out or [Ranges(path="", name="", begin=0, limit=0, first=0, end=0, channels=())]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_blocks(partition, self.layout)


class PcmReader(WholeReader):
    """Reads what pushed filters leave."""

    def pushFilters(self, filters) -> Iterable:
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name == "start_idx" and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + (1 if isinstance(f, GreaterThan) else 0))
            elif name == "start_idx" and isinstance(f, (LessThan, LessThanOrEqual)):
                top = f.value - (1 if isinstance(f, LessThan) else 0)
                self.high = top if self.high is None else min(self.high, top)
            elif name == "channel" and isinstance(f, (EqualTo, In)):
                values = f.value if isinstance(f, In) else [f.value]
                self.channels = tuple(c for c in self.channels if c in values)
            yield f  # Spark still applies every filter; these only narrow what is read


class PcmStreamReader(DataSourceStreamReader):
    """Follows the newest file of a folder and rolls over to the next one.

    The offset is a file name and the number of its blocks already read. Blocks of
    the newest file are taken once their right halo is there too; the rest of a
    file is taken when a newer file has appeared (names sort by time). A file is read by as many tasks as it has
    stretches of task_blocks.

    With max_blocks a batch takes no more than so many blocks, so that a long history arrives in bounded batches. Spark
    does not tell a source where it stands when it asks how far it may go, so this is kept in the file that `progress` names: it
    only bounds batches, and what they hold follows from Spark's own offsets.
    """

    def __init__(self, options: dict):
        self.path = options["path"]
        self.suffix = options.get("suffix", ".bin")
        self.layout = replace(Layout.of(options), skip_s=0.0, duration_s=None)
        self.most, self.progress = options.get("max_blocks"), options.get("progress")
        if self.most and not self.progress:
            raise ValueError("max_blocks needs the path of a file for its progress")

    def initialOffset(self) -> dict:
        return {"file": "", "blocks": 0}

    def _whole_blocks(self, size: int, newest: bool) -> int:
        frames, n = size // self.layout.frame_bytes, self.layout.block_len
        return max(0, (frames - self.layout.halo) // n) if newest else -(-frames // n)

    def latestOffset(self) -> dict:
        files = list_pcm(self.path, self.suffix)
        if not files:
            return self.initialOffset()
        path, size = files[-1]
        latest = {"file": path, "blocks": self._whole_blocks(size, True)}
        return self._limited(files, latest) if self.most else latest

    def _limited(self, files: list[tuple[str, int]], latest: dict) -> dict:
        """At most max_blocks beyond the last answer."""
        system, inner = opened(self.progress)
        at, left = self.initialOffset(), int(self.most)
        if system.get_file_info(inner).type == pafs.FileType.File:
            with system.open_input_stream(inner) as f:
                at = json.loads(f.read())
        for path, size in files:
            if path < at["file"]:
                continue
            blocks = latest["blocks"] if path == latest["file"] else self._whole_blocks(size, False)
            first = at["blocks"] if path == at["file"] else 0
            take = min(left, max(blocks - first, 0))
            at, left = {"file": path, "blocks": first + take}, left - take
            if not left:
                break
        with system.open_output_stream(inner) as f:
            f.write(json.dumps(at).encode())
        return at

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        n = self.layout.block_len
        channels = tuple(range(1, self.layout.channels + 1))
        out: list[InputPartition] = []
        for path, size in list_pcm(self.path, self.suffix):
            if path < start["file"] or path > end["file"]:
                continue
            frames = size // self.layout.frame_bytes
            first = start["blocks"] if path == start["file"] else 0
            newest = path == end["file"]
            last = end["blocks"] if newest else -(-frames // n)
            # a file still growing is read only as far as the offset says, so that a repeat reads the same
            limit = min(last * n + self.layout.halo, frames) if newest else frames
            for k in range(first, last, self.layout.task_blocks):
                stop = min(k + self.layout.task_blocks, last)
                out.append(Ranges(path=path, name=recording_name(path, self.path), begin=0, limit=limit, first=k, end=stop, channels=channels))
        return out

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        return read_blocks(partition, self.layout)


class PcmSource(DataSource):
    """Format "pcm". Options: path, channels, fs, dtype, block_len, halo, skip_s, duration_s, suffix, wide, pushdown; streams: max_blocks, progress."""

    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> StructType | str:
        return WIDE_SCHEMA if Layout.of(dict(self.options)).wide else SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (PcmReader if str(options.get("pushdown", "false")).lower() == "true" else WholeReader)(options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PcmStreamReader(dict(self.options))


def read_pcm(spark, path: str, **options):
    """Blocks of every PCM file below path."""
    spark.dataSource.register(PcmSource)
    options = {"pushdown": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")} | options
    return spark.read.format("pcm").options(**{k: str(v) for k, v in options.items()}).load(path)


def stream_pcm(spark, path: str, **options):
    """Blocks of a folder whose newest file is still growing."""
    spark.dataSource.register(PcmSource)
    return spark.readStream.format("pcm").options(**{k: str(v) for k, v in options.items()}).load(path)


DECODED = 1 << 20  # bytes decoded in one go, unless a single file has more


def decode_frames(df, content: str, channels: int, dtype: str = SAMPLE_TYPE):
    """Interleaved PCM in a binary column (small whole files) to blocks, one per channel.

    Samples take several times the bytes of a batch: they are given back a few files at a time.
    """
    sample = np.dtype(dtype).newbyteorder("<")
    kept = [c for c in df.columns if c != content]
    schema = StructType([df.schema[c] for c in kept]).add("channel", LongType()).add("samples", ArrayType(DoubleType()))

    def decoded(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for value in part.column(content):
            data = np.frombuffer(value.as_buffer() or b"", dtype=np.uint8)
            data = data[: len(data) // (sample.itemsize * channels) * sample.itemsize * channels].view(sample)
            rows += list(data.reshape(-1, channels).T.astype(np.float64))
        again = pa.array(np.repeat(np.arange(part.num_rows), channels))
        own = pa.array(np.tile(np.arange(channels) + 1, part.num_rows), pa.int64())
        return pa.RecordBatch.from_arrays([*(part.column(c).take(again) for c in kept), own, lists_from(rows)], [*kept, "channel", "samples"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(content)), 0).to_numpy(zero_copy_only=False)
            at, held = 0, 0
            for i, size in enumerate(sizes):
                if i > at and held + size > DECODED:
                    yield decoded(batch.slice(at, i - at))
                    at, held = i, 0
                held += size
            if at < batch.num_rows:
                yield decoded(batch.slice(at))

    return df.select(*kept, content).mapInArrow(run, schema).withColumn("start_idx", F.lit(1).cast("bigint"))


def byte_range(df, content: str, channels: int, skip_frames: int, n_frames: int, dtype: str = SAMPLE_TYPE):
    """The bytes of n_frames whole frames after the first skip_frames of a binary column."""
    width = np.dtype(dtype).itemsize * channels
    return df.withColumn(content, F.substring(content, skip_frames * width + 1, n_frames * width))
