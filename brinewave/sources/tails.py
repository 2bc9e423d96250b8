"""The newest file of a folder and the end of a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brinewave.operators.groups import small_side
from brinewave.session import cut_lineage


def newest_file(files: DataFrame, keys: list[str]) -> DataFrame:
    """The file with the last name per folder (names sort by time)."""
    newest = files.groupBy(*keys).agg(F.max("path").alias("path"))
    return files.join(newest, [*keys, "path"])


def _lengths(blocks: DataFrame, keys: list[str], back: int) -> DataFrame:
    """Blocks with `_n`, the length of their recording and channel, without those that lie more than `back` before every end.

    One small row for each recording and channel is written; where these are few, the blocks stay where they are.
    """
    last = F.col("start_idx") + F.size("samples") - 1
    ends = blocks.groupBy(*keys).agg(F.max(last).alias("_n"), F.max(F.size("samples")).alias("_size"))
    ends = cut_lineage(ends)
    shortest, size = ends.agg(F.min("_n"), F.max("_size")).first()
    late = blocks.where(F.col("start_idx") > F.lit((shortest or 0) - back - (size or 0)))
    return late.join(small_side(ends.drop("_size"), ends), keys)


def _window(blocks: DataFrame, first, n: int) -> DataFrame:
    """Samples first .. first + n - 1 of each recording, one row each; other blocks are dropped before."""
    end = F.col("start_idx") + F.size("samples")
    low, high = F.greatest(first, F.col("start_idx")), F.least(first + n, end)
    kept = [c for c in blocks.columns if c not in ("samples", "start_idx", "left_halo", "right_halo", "block_id", "_n")]
    part = F.slice("samples", (low - F.col("start_idx") + 1).cast("int"), (high - low).cast("int"))
    rows = blocks.where(low < high).select(*kept, low.alias("_first"), F.posexplode(part).alias("_p", "x"))
    return rows.select(*kept, (F.col("_first") + F.col("_p")).cast("bigint").alias("idx"), "x")


def tail_samples(blocks: DataFrame, n: int, keys: list[str]) -> DataFrame:
    """The last n samples of each recording (all of them if there are fewer), over any number of blocks."""
    return _window(_lengths(blocks, keys, n), F.greatest(F.col("_n") - n + 1, F.lit(1)), n)


def aligned_tail(blocks: DataFrame, window: int, keys: list[str]) -> DataFrame:
    """The last window that begins on a whole multiple of its length, one window before the end."""
    start = F.col("_n") - window
    return _window(_lengths(blocks, keys, 2 * window), F.greatest(start - F.pmod(start, F.lit(window)), F.lit(0)) + 1, window)
