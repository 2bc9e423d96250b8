"""Runs of rows whose gaps stay small, over tiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brinewave.functions.density import state_settings
from brinewave.operators.groups import with_lengths
from brinewave.operators.tiles import TILE, add_tiles, tile_window
from brinewave.session import cut_lineage

REC = "recording_id"


def gap_sessions(dets: DataFrame, gap: int, tile: int) -> DataFrame:
    """Sessions split where two consecutive rows are more than `gap` samples apart.

    Runs are found inside tiles; only the first and last run of a tile can go on in
    another, so at most two rows per tile are ordered per recording.
    """
    order = tile_window([REC], "idx", "det_id")
    rows = add_tiles(dets, "idx", tile)
    step = F.col("idx") - F.lag("idx").over(order)
    rows = rows.withColumn("_new", F.when(step <= gap, 0).otherwise(1))
    rows = rows.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(REC, TILE, "_run").agg(
        F.min("idx").alias("start_idx"), F.max("idx").alias("last_idx"), F.count("*").alias("n_dets")
    )
    last_of_tile = F.col("_run") == F.max("_run").over(Window.partitionBy(REC, TILE))
    runs = cut_lineage(runs.withColumn("_last", last_of_tile))  # read twice below
    out = [REC, "start_idx", "last_idx", "n_dets"]
    inner = runs.where((F.col("_run") > 1) & ~F.col("_last")).select(*out)
    along = Window.partitionBy(REC).orderBy(TILE, "_run")
    edge = runs.where((F.col("_run") == 1) | F.col("_last"))
    # between the first and the last run of a tile there is always a gap
    goes_on = (F.col("_run") == 1) & (F.col("start_idx") - F.lag("last_idx").over(along) <= gap)
    edge = edge.withColumn("_fresh", F.when(goes_on, 0).otherwise(1))
    edge = edge.withColumn("_session", F.sum("_fresh").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = edge.groupBy(REC, "_session").agg(
        F.min("start_idx").alias("start_idx"),
        F.max("last_idx").alias("last_idx"),
        F.sum("n_dets").cast("bigint").alias("n_dets"),
    )
    return inner.unionByName(joined.select(*out))


# Kernel length is NFFT * FRAMES samples, its spread is SIGMA of half that length; a
# segment opens above OPEN_ABOVE and closes below CLOSE_BELOW.
NFFT, FRAMES, SIGMA = 1280, 30, 0.1
OPEN_ABOVE, CLOSE_BELOW = 0.01, 0.00001


def density_segments(
    dets: DataFrame,
    n_samples: DataFrame | int,
    tile: int,
    kernel_len: int = NFFT * FRAMES,
    sigma: float = SIGMA,
    open_above: float = OPEN_ABOVE,
    close_below: float = CLOSE_BELOW,
) -> DataFrame:
    """Segments of the smoothed detection density.

    A segment opens at the first sample whose density is above `open_above` and
    ends at the next one below `close_below`, or at n_samples (one for all, or a table
    recording_id, n_samples) when it stays open.
    Density is defined on 1 .. n_samples - kernel_len. Each tile evaluates it from
    the detections within half a kernel and reports where the state is set; only
    its first and last settings meet other tiles.
    """
    half = kernel_len // 2 + 1
    seen = add_tiles(dets.select(REC, "idx"), "idx", tile, before=half, after=half)
    lists = seen.groupBy(REC, TILE).agg(F.sort_array(F.collect_set("idx")).alias("places"))
    lists = with_lengths(lists, n_samples, "_length")
    settings = lists.select(
        REC,
        TILE,
        F.posexplode(
            state_settings(
                F.col("places"), F.col(TILE), tile, F.col("_length") - kernel_len, kernel_len, sigma, open_above, close_below
            )
        ).alias("seq", "s"),
    ).select(REC, TILE, "seq", "s.pos", "s.opens")
    return _paired_settings(settings, n_samples)


def _paired_settings(settings: DataFrame, n_samples: DataFrame | int) -> DataFrame:
    """Open and close points (alternating within a tile) to segments."""
    inside = Window.partitionBy(REC, TILE).orderBy("seq")
    rows = settings.withColumn("_close", F.lead("pos").over(inside)).withColumn(
        "_starts", F.first("opens").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    )
    whole = F.col("opens") & (F.col("seq") > 0) & F.col("_close").isNotNull()
    inner = rows.where(whole).select(REC, F.col("pos").alias("start_idx"), F.col("_close").alias("end_idx"))
    # up to three settings per tile: those up to its first close, and an open that lasts to its end
    closes_first = ~F.col("opens") & (F.col("seq") == F.when(F.col("_starts"), 1).otherwise(0))
    opens_edge = F.col("opens") & ((F.col("seq") == 0) | F.col("_close").isNull())
    along = Window.partitionBy(REC).orderBy(TILE, "seq")
    edge = rows.where(closes_first | opens_edge)
    edge = edge.withColumn("_prev", F.lag("opens").over(along)).where(
        F.col("_prev").isNull() | (F.col("_prev") != F.col("opens"))
    )
    edge = edge.withColumn("_end", F.lead("pos").over(along)).where("opens")
    closed = with_lengths(edge, n_samples, "_length")
    joined = closed.select(REC, F.col("pos").alias("start_idx"), F.coalesce("_end", "_length").alias("end_idx"))
    return inner.unionByName(joined)
