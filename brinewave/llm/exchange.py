"""Counts of keys that batches share, exchanged as packed arrays.

A batch is one row that holds many documents; it is written once, bucketed by its number, so
that what comes back to it is joined without moving its texts. It sends its distinct
64-bit keys, sorted, with its own counts, cut into parts by the key's range; each part is summed in a
task, and the totals return in the order they were sent. A key sends one entry from
each batch at most, however often it occurs. The number of parts follows the input, so a part's
size does not.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from brinewave.session import job_dir

SENT = "part int, batch long, keys binary, counts binary"
LONG, BIN = pa.int64(), pa.binary()
SENT_ARROW = pa.schema([("part", pa.int32()), ("batch", LONG), ("keys", BIN), ("counts", BIN)])
BACK = "batch long, part int, totals binary"
BACK_ARROW = pa.schema([("batch", LONG), ("part", pa.int32()), ("totals", BIN)])
#: Bytes of text for each part and each bucket.
PART_BYTES = 16 << 20


def staged(batches: DataFrame, buckets: int, by: str = "batch") -> DataFrame:
    """Batches written as a table bucketed by `by` in the shared folder."""
    spark = batches.sparkSession
    name = f"stage_{uuid.uuid4().hex}"
    write = batches.write.bucketBy(buckets, by).option("compression", "zstd").option("path", f"{job_dir(spark)}/{name}")
    write.saveAsTable(name)
    return spark.table(name)


def sizes(spark, total_bytes: int) -> tuple[int, int]:
    """Parts and buckets for so many bytes of text."""
    parts = max(16, -(-total_bytes // PART_BYTES))
    return parts, max(parts, int(spark.conf.get("spark.sql.shuffle.partitions")))


def sent(batch: int, kind: int, keys: np.ndarray, counts: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows for sorted distinct keys; kinds are counted apart."""
    place = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    cuts = np.searchsorted(place, np.arange(parts + 1))
    some = np.flatnonzero(np.diff(cuts))
    counts = counts.astype("<u4")
    return pa.RecordBatch.from_arrays(
        [
            pa.array(some + kind * parts, pa.int32()), pa.array(np.full(len(some), batch)),
            pa.array([keys[cuts[p] : cuts[p + 1]].tobytes() for p in some], BIN),
            pa.array([counts[cuts[p] : cuts[p + 1]].tobytes() for p in some], BIN),
        ],
        schema=SENT_ARROW,
    )


def totals(rows: DataFrame, most: int = 255) -> DataFrame:
    """batch, back: per batch the totals of the keys it sent (unsigned bytes, at most `most`), by part."""

    def add(table: pa.Table) -> pa.Table:
        keys = [np.frombuffer(x.as_py(), "<u8") for x in table.column("keys")]
        counts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("counts")])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ranked = every[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        sums = np.add.reduceat(counts[order].astype("i8"), np.flatnonzero(first))
        back = np.empty(len(every), "u1")
        back[order] = np.minimum(sums, most).astype("u1")[np.cumsum(first) - 1]
        ends = np.cumsum([len(k) for k in keys])
        packed = [back[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]
        return pa.Table.from_arrays([table.column("batch"), table.column("part"), pa.chunked_array([pa.array(packed, BIN)])], schema=BACK_ARROW)

    return gathered(rows.groupBy("part").applyInArrow(add, BACK))


def gathered(rows: DataFrame, name: str = "back") -> DataFrame:
    """batch and an array of (part, totals), in order: no more than the batch has sent."""
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("part", "totals"))).alias(name))


def received(back: list[dict] | None, kind: int, parts: int, dtype: str = "u1") -> np.ndarray:
    """The totals of one kind, aligned with the keys that were sent."""
    return np.frombuffer(b"".join(x["totals"] for x in back or [] if x["part"] // parts == kind), dtype)


def batches_of(batches: Iterator[pa.RecordBatch], first: int, most: int) -> Iterator[pa.RecordBatch]:
    """Rows (batch, keys, lengths, body) out of rows (key, text): documents' bytes, one after the other."""
    schema = pa.schema([("batch", LONG), ("keys", pa.list_(LONG)), ("lengths", pa.list_(LONG)), ("body", BIN)])
    keys: list[int | None] = []
    parts: list[bytes] = []
    held = made = 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([first + made]), pa.array([keys], pa.list_(LONG)), pa.array([[len(p) for p in parts]], pa.list_(LONG)), pa.array([b"".join(parts)], BIN)],
            schema=schema,
        )

    for batch in batches:
        for key, text in zip(batch.column("key"), batch.column("text")):
            body = (text.as_py() or "").encode()
            if keys and held + len(body) > most:
                yield row()
                keys, parts, held, made = [], [], 0, made + 1
            keys.append(key.as_py())
            parts.append(body)
            held += len(body)
    if keys:
        yield row()


def in_batches(docs: DataFrame, key: str, text: str, most: int) -> tuple[DataFrame, int]:
    """The documents in staged batches of about `most` bytes, and the number of parts for exchanges."""
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length(text))).first()[0] or 0
    parts, buckets = sizes(spark, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        return batches_of(batches, TaskContext.get().partitionId() << 32, most)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return staged(rows.mapInArrow(run, "batch long, keys array<long>, lengths array<long>, body binary"), buckets), parts


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one by one."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield {n: batch.column(i)[at].as_py() for i, n in enumerate(batch.schema.names)}
