"""Time tiles: ordered work on a recording without one task per recording.

A recording may hold a third of all rows, so nothing here sorts a whole
recording in one place. Rows are keyed by (recording, tile of time) and ordered
inside tiles. What crosses tiles is carried by a summary of a few values per
tile (counts, sums, first and last rows), ordered per recording: that table has
at most duration / width rows per recording, however many rows a tile holds.
`fitting_width` makes tiles as narrow as the densest recording asks for.

Where an operator looks a fixed time ahead and behind, `add_tiles` can also send
the rows near a tile edge to the neighbour that needs to see them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

TILE = "tile"
CORE = "in_core"
TILE_ROWS = 500_000  # rows of a tile that one task sorts with ease


def tile_of(t: Column, width: int) -> Column:
    return F.floor(t / F.lit(width)).cast("bigint")


def add_tiles(df: DataFrame, t: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Tile k sees the rows with k*width - before <= t < (k+1)*width + after.

    `in_core` marks the copy in the row's own tile.
    """
    col = F.col(t)
    home = tile_of(col, width)
    if not before and not after:
        return df.withColumn(TILE, home).withColumn(CORE, F.lit(True))
    seen_by = F.sequence(tile_of(col - F.lit(after), width), tile_of(col + F.lit(before), width))
    return df.withColumn(TILE, F.explode(seen_by)).withColumn(CORE, F.col(TILE) == home)


def fitting_width(df: DataFrame, keys: Sequence[str], t: str, widest: int, rows: int = TILE_ROWS) -> int:
    """A tile width under which no tile has many more than `rows` rows.

    Counts rows per tile (combined before the shuffle) and narrows the width while
    the fullest tile has more than twice as many; a width of 1 ends it.
    """
    width = int(widest)
    while True:
        counted = df.groupBy(*keys, tile_of(F.col(t), width)).agg(F.count("*").alias("c"))
        most = counted.agg(F.max("c")).first()[0] or 0
        if most <= 2 * rows or width == 1:
            return width
        width = max(1, width * rows // most)


def tile_window(keys: Sequence[str], *order) -> Window:
    return Window.partitionBy(*keys, TILE).orderBy(*order)


def running_total(
    df: DataFrame,
    keys: Sequence[str],
    t: str,
    ties: Sequence[str],
    value: Column,
    width: int,
    out: str,
    inclusive: bool = True,
) -> DataFrame:
    """Sum of `value` over all earlier rows of the same keys in (t, ties) order."""
    tiled = add_tiles(df, t, width).withColumn("_v", value)
    upto = tile_window(keys, t, *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = tiled.withColumn("_run", F.sum("_v").over(upto))
    earlier = Window.partitionBy(*keys).orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        tiled.groupBy(*keys, TILE)
        .agg(F.sum("_v").alias("_sum"))
        .select(*keys, TILE, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carry"))
    )
    total = F.col("_run") + F.col("_carry")
    if not inclusive:
        total = total - F.col("_v")
    return rows.join(carry, [*keys, TILE]).withColumn(out, total).drop("_v", "_run", "_carry", TILE, CORE)


def number_rows(df: DataFrame, keys: Sequence[str], t: str, ties: Sequence[str], width: int, out: str) -> DataFrame:
    """1, 2, 3, ... per keys in (t, ties) order."""
    return running_total(df, keys, t, ties, F.lit(1).cast("bigint"), width, out)
