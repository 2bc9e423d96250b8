"""Recordings as files of interleaved PCM, one for each."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brinewave.session import cut_lineage, opened

REC = "recording_id"


def write_pcm(wide: DataFrame, folder: str, dtype: str = "float64", suffix: str = ".bin") -> DataFrame:
    """Write rows of all channels (`schemas.WIDE_BLOCKS`) as files folder/<recording>.bin, and give recording_id, path,
    channels and n_samples of each.

    A file is written block by block in order, so a task holds one block; a recording is one file and thus one task. It
    appears under its name when it is whole, and a task that is repeated writes the same again. Blocks of a recording
    must follow each other without a gap and hold the same channels.
    """
    sample = np.dtype(dtype).newbyteorder("<")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, inner = opened(folder)
        out, name, done, names = None, None, 0, []

        def finish() -> pa.RecordBatch:
            out.close()
            final = f"{inner}/{quote(name, safe='')}{suffix}"
            system.move(hidden, final)
            columns = {REC: [name], "path": [f"{folder}/{quote(name, safe='')}{suffix}"], "channels": pa.array([len(names)], pa.int32()), "n_samples": [done]}
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for rec, start, before, size, channels in zip(*(batch.column(c) for c in (REC, "start_idx", "before", "size", "channels"))):
                if rec.as_py() != name:
                    if out is not None:
                        yield finish()
                    name, done = rec.as_py(), 0
                    hidden = f"{inner}/.{uuid.uuid4().hex}"
                    out = system.open_output_stream(hidden)
                if start.as_py() != done + 1:
                    raise ValueError(f"samples of {name} are missing after {done}")
                lo, n = before.as_py(), size.as_py()
                entries = sorted((c["channel"].as_py(), c["samples"].values.to_numpy(zero_copy_only=False)[lo : lo + n]) for c in channels)
                if done and names != [c for c, _ in entries]:
                    raise ValueError(f"channels of {name} change after {done}")
                names = [c for c, _ in entries]
                out.write(np.stack([x for _, x in entries], axis=1).astype(sample).tobytes())
                done += n
        if out is not None:
            yield finish()

    system, inner = opened(folder)
    system.create_dir(inner, recursive=True)
    named = wide.select(F.col(REC).cast("string").alias(REC), "start_idx", "before", "size", "channels")
    ordered = named.repartition(REC).sortWithinPartitions(REC, "start_idx")
    return cut_lineage(ordered.mapInArrow(run, "recording_id string, path string, channels int, n_samples bigint"))
