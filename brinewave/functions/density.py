"""Smoothed detection density inside a tile."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def gaussian_kernel(length: int, sigma: float) -> np.ndarray:
    middle = (length - 1) / 2
    return np.exp(-(((np.arange(length) - middle) / (sigma * middle)) ** 2) / 2)


def density_at(places: np.ndarray, first: int, last: int, kernel: np.ndarray) -> np.ndarray:
    """Density on first..last of clicks at `places` (1-based sample numbers)."""
    length = len(kernel)
    shift = length // 2
    out = np.zeros(last - first + 1)
    for place in places:
        # sample j sees kernel[j + shift - place]
        lo, hi = max(first, place - shift), min(last, place - shift + length - 1)
        if lo <= hi:
            out[lo - first : hi - first + 1] += kernel[lo + shift - place : hi + shift - place + 1]
    return out


def state_settings(
    places: Column, tile_no: Column, tile: int, last_idx: Column, kernel_len: int, sigma: float, above: float, below: float
) -> Column:
    """array<struct<pos, opens>>: where the state of a tile is set, open and close in turn; last_idx is the row's own."""
    kernel = gaussian_kernel(kernel_len, sigma)
    item = pa.struct([("pos", pa.int64()), ("opens", pa.bool_())])

    @F.arrow_udf("array<struct<pos: bigint, opens: boolean>>")
    def settings(lists: pa.Array, tiles: pa.Array, ends: pa.Array) -> pa.Array:
        out = []
        for clicks, k, end in zip(lists, tiles.to_pylist(), ends.to_pylist()):
            first, last = max(k * tile, 1), min((k + 1) * tile - 1, end)
            if first > last:
                out.append([])
                continue
            p = density_at(clicks.values.to_numpy(), first, last, kernel)
            state = np.where(p > above, 1, np.where(p < below, -1, 0))
            at = np.flatnonzero(state)
            kept = at[np.diff(state[at], prepend=0) != 0]
            out.append([{"pos": int(first + i), "opens": bool(state[i] > 0)} for i in kept])
        return pa.array(out, type=pa.list_(item))

    return settings(places, tile_no, last_idx)
