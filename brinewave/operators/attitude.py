"""Attitude compensation: the first log row at or after each detection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brinewave.operators.tiles import TILE, add_tiles, tile_window

REC = "recording_id"


def next_log_value(dets: DataFrame, log: DataFrame, value: str, tile: int) -> DataFrame:
    """Forward as-of join: adds `value` and `log_idx` of the first log row at or after idx.

    Both sides need recording_id and idx, detections det_id. Within a tile the next
    log row is found by a window; a detection with none left in its tile takes the
    first one of a later tile from the tile summary.
    """
    left = dets.select("*", F.lit(0).alias("_is_log"), F.lit(None).cast("struct<i:bigint,v:double>").alias("_log"))
    right = log.select(
        REC, "idx", F.lit(1).alias("_is_log"), F.struct(F.col("idx").alias("i"), F.col(value).cast("double").alias("v")).alias("_log")
    )
    both = add_tiles(left.unionByName(right, allowMissingColumns=True), "idx", tile)
    ahead = tile_window([REC], "idx", "_is_log", "det_id").rowsBetween(0, Window.unboundedFollowing)
    rows = both.withColumn("_near", F.first("_log", ignorenulls=True).over(ahead)).where(F.col("_is_log") == 0)
    later = Window.partitionBy(REC).orderBy(TILE).rowsBetween(1, Window.unboundedFollowing)
    carry = (
        both.groupBy(REC, TILE)
        .agg(F.min("_log").alias("_first"))
        .select(REC, TILE, F.first("_first", ignorenulls=True).over(later).alias("_far"))
    )
    found = rows.join(carry, [REC, TILE]).withColumn("_hit", F.coalesce("_near", "_far"))
    return found.select(*dets.columns, F.col("_hit.v").alias(value), F.col("_hit.i").alias("log_idx"))
