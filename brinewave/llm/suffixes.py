"""Removal of byte strings that occur again, by counts of hashed window names.

The idea of buckets that are refined is from bucket-pointer refinement, but nothing is sorted across documents and no
bucket's number comes from another's update: names are hashes of contents, all made within a batch (see README).

A bucket of suffixes is named by what they share: the name at depth 2d is made of the names at
depth d here and d later, so every level reuses the one before (25, 50, 100, `LENGTH` = 200
bytes). Initial buckets are 50-grams. A suffix that is alone in its bucket is done; the
rest is refined:

0. Only one 50-gram of each 200-byte window is a bucket: the one with the smallest name, the
   leftmost if equal. Equal windows have it at the same place, so nothing is missed.
1. Windows next to each other that share this place are one stretch, named by its first
   and last window (they cover it). A stretch that occurs twice is repeated as a whole.
2. Where a 50-gram has further stretches, their windows themselves are buckets at depth 200.

Each level counts names over all documents (exchange.py): a name goes once from each
batch, so a passage or group of copies that a third of all documents share makes no
large group. Names have 64 bits.

Null texts count as empty; texts below 200 bytes have no windows and stay whole. Repeated rows
are copies of each other. Null keys are kept. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from brinewave.llm import exchange as ex

LENGTH = 200
GRAM = LENGTH // 4
BATCH_BYTES = 1 << 20
#: Windows handled at once.
STEP = 1 << 20
OUT = "key long, n_bytes long, starts array<long>, ends array<long>, kept binary"
U = np.uint64


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(31))) * U(0x7FB5D329728EA185)
    return (h ^ (h >> U(27))) * U(0x81DADEF4BC2DD44D)


def doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """Names at twice the depth, from the bucket here and the bucket `depth` later."""
    return mixed(names[:-depth] * U(0x9E3779B97F4A7C15) + names[depth:] + U(depth))


def first_names(raw: np.ndarray, depth: int) -> np.ndarray:
    """Names of the strings of `depth` bytes, byte by byte."""
    h = np.zeros(len(raw) - depth + 1, "u8")
    for i in range(depth):
        h = h * U(0x100000001B3) + raw[i : len(raw) - depth + 1 + i]
    return mixed(h)


class Windows:
    """The windows of a buffer of documents: their names, and their stretches."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        grams = doubled(first_names(raw, GRAM // 2), GRAM // 2)
        self.names = doubled(doubled(grams, GRAM), 2 * GRAM)
        n, span = len(self.names), LENGTH - GRAM + 1
        # minima of `span` names: of the rest of a block of that size, and of the start of the next
        key = (grams >> U(32) << U(32)) | np.arange(len(grams), dtype="u8")
        blocks = np.full(-(-len(key) // span) * span, np.iinfo("u8").max, "u8")
        blocks[: len(key)] = key
        blocks = blocks.reshape(-1, span)
        head = np.minimum.accumulate(blocks, axis=1).ravel()
        tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(tail[:n], head[span - 1 : span - 1 + n]) & U(0xFFFFFFFF)).astype("i8")
        # windows end within the document that they start in
        at = np.arange(n)
        valid = np.flatnonzero(ends[np.searchsorted(ends, at, "right")] >= at + LENGTH)
        place = place[valid]
        cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(valid) != 1)) + 1
        self.first = valid[np.concatenate([[0], cut])] if len(valid) else valid
        self.last = valid[np.concatenate([cut, [len(valid)]]) - 1] if len(valid) else valid
        anchor = place[np.concatenate([[0], cut])] if len(valid) else valid
        # smallest names lie close together: named anew, they are dealt evenly over the parts of an exchange
        self.grams = mixed(grams[anchor])
        shape = (anchor - self.first).astype("u8") << U(16) | (self.last - self.first).astype("u8")
        self.stretches = mixed(mixed(self.names[self.first] + shape) + self.names[self.last])


def buffers(body: bytes, lengths: list[int]) -> Iterator[tuple[int, Windows]]:
    """Windows of a batch, piece by piece, with the piece's offset."""
    raw, ends = np.frombuffer(body, "u1"), np.cumsum(lengths)
    for at in range(0, len(raw) - LENGTH + 1, STEP):
        part = raw[at : at + STEP + LENGTH - 1]
        yield at, Windows(part, np.append(ends[np.searchsorted(ends, at, "right") :] - at, 1 << 62))


def levels(row: dict) -> tuple[list[tuple[int, Windows]], list[np.ndarray], list[np.ndarray]]:
    """The windows of a batch, and its distinct names of 50-grams and of stretches with their counts."""
    found = list(buffers(row["body"], row["lengths"]))
    empty = np.empty(0, "u8")
    grams, stretches = (np.concatenate([empty, *(getattr(w, c) for _, w in found)]) for c in ("grams", "stretches"))
    return found, list(np.unique(grams, return_counts=True)), list(np.unique(stretches, return_counts=True))


def open_windows(row: dict, parts: int) -> tuple[list[tuple[int, Windows, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Per piece the stretches that are repeated and the places of windows still open; the open windows' distinct names and counts."""
    found, (grams, _), (stretches, _) = levels(row)
    in_grams, in_stretches = (ex.received(row["back"], kind, parts) for kind in (0, 1))
    out, names = [], [np.empty(0, "u8")]
    for at, w in found:
        n_g, n_s = in_grams[np.searchsorted(grams, w.grams)], in_stretches[np.searchsorted(stretches, w.stretches)]
        # totals stop at 255: two that stopped may differ
        more = (n_g > n_s) | (n_g == 255)
        size = (w.last - w.first + 1)[more]
        places = np.repeat(w.first[more], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        out.append((at, w, n_s >= 2, places))
        names.append(w.names[places])
    keys, counts = np.unique(np.concatenate(names), return_counts=True)
    return out, keys, counts


def repeated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, starts and ends of the removed runs, and the bytes kept, for every document."""
    batches, parts = ex.in_batches(docs, key, text, BATCH_BYTES)

    def send_levels(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in ex.each(rows):
            for kind, (keys, counts) in enumerate(levels(row)[1:]):
                yield ex.sent(row["batch"], kind, keys, counts, parts)

    def send_windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in ex.each(rows):
            yield ex.sent(row["batch"], 0, *open_windows(row, parts)[1:], parts)

    def remove(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in ex.each(rows):
            pieces, names, _ = open_windows(row, parts)
            total = ex.received(row["windows"], 0, parts)
            raw, ends = np.frombuffer(row["body"], "u1"), np.cumsum(row["lengths"], dtype="i8")
            cover = np.zeros(len(raw) + 1, "i4")
            for at, w, whole, places in pieces:
                again = places[total[np.searchsorted(names, w.names[places])] >= 2]
                np.add.at(cover, at + np.concatenate([w.first[whole], again]), 1)
                np.add.at(cover, at + LENGTH + np.concatenate([w.last[whole], again]), -1)
            gone = np.cumsum(cover[:-1]) > 0
            yield from _documents(row["keys"], raw, ends, gone)

    first = ex.totals(batches.select("batch", "lengths", "body").mapInArrow(send_levels, ex.SENT))
    known = batches.join(first, "batch", "left")
    second = ex.totals(known.select("batch", "lengths", "body", "back").mapInArrow(send_windows, ex.SENT))
    return known.join(second.withColumnRenamed("back", "windows"), "batch", "left").mapInArrow(remove, OUT)


def _documents(keys: list, raw: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> Iterator[pa.RecordBatch]:
    starts = np.concatenate([[0], ends[:-1]])
    for i in range(0, len(keys), 500):
        spans, kept = [], []
        for a, b in zip(starts[i : i + 500], ends[i : i + 500]):
            own = gone[a:b]
            edge = np.diff(np.concatenate([[0], own.view("i1"), [0]]))
            spans.append((np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)))
            kept.append(raw[a:b][~own].tobytes())
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(keys[i : i + 500], pa.int64()), pa.array((ends - starts)[i : i + 500]),
                pa.array([x for x, _ in spans], longs), pa.array([x for _, x in spans], longs), pa.array(kept, pa.binary()),
            ],
            ["key", "n_bytes", "starts", "ends", "kept"],
        )
