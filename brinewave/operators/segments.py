"""Tables of segments: levels from frames, members, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewave.operators.order_statistics import exact_quantile
from brinewave.operators.tiles import TILE, add_tiles, tile_of, tile_window
from brinewave.session import cut_lineage

REC = "recording_id"
FRAME_TILE = 32  # frames per tile when frames meet segments: few of the pairs that meet are dropped


def segment_levels(
    segments: DataFrame, frames: DataFrame, frame_len: int, n_frames: Column | DataFrame, first_at: int = 0
) -> DataFrame:
    """Median frame statistic over the frames that cover each segment.

    Frame k lies at sample k*frame_len + first_at. From the last frame before
    start_idx (or the first frame) to the first after end_idx (or the last frame).
    Segments are spread over tiles of frames and joined by tile. n_frames is a column, or a table (recording_id, n_frames).
    """
    if isinstance(n_frames, DataFrame):
        segments, n_frames = segments.join(n_frames.select(REC, F.col("n_frames").alias("_n")), REC), F.col("_n")
    begin, end = F.col("start_idx") - first_at, F.col("end_idx") - first_at
    first = F.greatest(F.ceil(begin / frame_len) - 1, F.lit(0).cast("bigint"))
    last = F.least(F.greatest(F.floor(end / frame_len) + 1, first), n_frames - 1)
    # neighbouring segments may share frames, so they meet by narrow tiles of frames
    spans = segments.select(REC, "start_idx", first.alias("_first"), last.alias("_last"))
    spans = spans.withColumn(
        TILE, F.explode(F.sequence(tile_of(F.col("_first"), FRAME_TILE), tile_of(F.col("_last"), FRAME_TILE)))
    )
    inside = (
        frames.withColumn(TILE, tile_of(F.col("frame"), FRAME_TILE))
        .join(spans, [REC, TILE])
        .where(F.col("frame").between(F.col("_first"), F.col("_last")))
    )
    covered = cut_lineage(inside.select(REC, "start_idx", "stat"))
    return exact_quantile(covered, [REC, "start_idx"], "stat", 0.5, "level")


def rows_in_segments(rows: DataFrame, segments: DataFrame, end: str, tile: int) -> DataFrame:
    """Rows whose idx lies within [start_idx, end], with the segment's columns.

    Segments of a recording must not overlap: a row can only lie in the last one
    that began, which a running window finds within a tile and the tile summary
    hands on to later tiles. No row meets more than one segment.
    """
    columns = ["start_idx", *[c for c in segments.columns if c not in (REC, "start_idx")]]
    begun = F.struct(*columns)
    starts = segments.select(REC, F.col("start_idx").alias("idx"), F.lit(False).alias("_is_row"), begun.alias("_segment"))
    both = add_tiles(rows.withColumn("_is_row", F.lit(True)).unionByName(starts, allowMissingColumns=True), "idx", tile)
    upto = tile_window([REC], "idx", "_is_row").rowsBetween(Window.unboundedPreceding, 0)
    met = both.withColumn("_near", F.last("_segment", ignorenulls=True).over(upto)).where("_is_row")
    earlier = Window.partitionBy(REC).orderBy(TILE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        both.groupBy(REC, TILE)
        .agg(F.max("_segment").alias("_last"))
        .select(REC, TILE, F.last("_last", ignorenulls=True).over(earlier).alias("_far"))
    )
    found = met.join(carry, [REC, TILE]).withColumn("_hit", F.coalesce("_near", "_far"))
    inside = found.where(F.col("idx") <= F.col("_hit").getField(end))
    return inside.select(*rows.columns, *[F.col("_hit").getField(c).alias(c) for c in columns])


def counts_table(
    impulses: DataFrame, trains: DataFrame, tonals: DataFrame, tonal_segments: DataFrame, noise: DataFrame, recordings: DataFrame | None = None
) -> DataFrame:
    """One row per recording with the number of each kind of result; zeros for those of `recordings` without any."""
    one = F.lit(1).cast("bigint")
    zero = F.lit(0).cast("bigint")

    def part(df, in_train=zero, **cols):
        names = ["num_impulse", "num_impulsetrain", "num_tonal", "num_tonalsegment", "num_noise"]
        return df.select(REC, *[cols.get(n, zero).alias(n) for n in names], in_train.alias("num_impulseINtrain"))

    together = (
        part(impulses, num_impulse=one)
        .unionByName(part(trains, F.col("n_dets"), num_impulsetrain=one))
        .unionByName(part(tonals, num_tonal=one))
        .unionByName(part(tonal_segments, num_tonalsegment=one))
        .unionByName(part(noise, num_noise=one))
    )
    if recordings is not None:
        together = together.unionByName(part(recordings))
    names = [c for c in together.columns if c != REC]
    return together.groupBy(REC).agg(*[F.sum(n).cast("bigint").alias(n) for n in names])
