"""Interval histograms inside Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def interval_mode(positions: Column, counts: Column, bin_width: int, limit: int, span: int) -> Column:
    """Most frequent interval between any two clicks of a list, as struct<mode, weight>.

    `positions` holds distinct ascending places below `span`, `counts` the clicks
    at each. Intervals above zero fall into bins [k*bin_width, (k+1)*bin_width)
    below `limit`; the first bin wins ties. The pairs are counted by rank
    differences, never listed, and all lists of a batch share one search.
    """
    edges = np.arange(0, limit + 1, bin_width, dtype=np.int64)
    stride = int(span + limit + 1)

    @F.arrow_udf("struct<mode: bigint, weight: bigint>")
    def mode(pos: pa.Array, cnt: pa.Array) -> pa.Array:
        rows = len(pos)
        lengths = np.diff(pos.offsets.to_numpy())
        row = np.repeat(np.arange(rows, dtype=np.int64), lengths)
        place = pos.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + row * stride
        weight = cnt.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        before = np.concatenate(([0], np.cumsum(weight)))
        own_end = before[1:]
        below = np.zeros((len(edges), rows), dtype=np.int64)
        for k, edge in enumerate(edges[1:], start=1):
            later = before[np.searchsorted(place, place + edge, side="left")] - own_end
            pairs = weight * np.maximum(later, 0)
            below[k] = np.bincount(row, weights=pairs.astype(np.float64), minlength=rows).astype(np.int64)
        hist = np.diff(below, axis=0)
        best = hist.argmax(axis=0)
        return pa.StructArray.from_arrays(
            [pa.array(edges[best]), pa.array(hist[best, np.arange(rows)])], names=["mode", "weight"]
        )

    return mode(positions, counts)
