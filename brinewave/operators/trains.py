"""Click trains: runs of clicks that follow each other fast enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewave.operators.groups import with_lengths
from brinewave.operators.tiles import CORE, TILE, add_tiles, tile_window
from brinewave.session import cut_lineage

REC = "recording_id"


def _edges(rows: DataFrame, n: int) -> DataFrame:
    """Per tile its first n and last n places and its number of clicks: at most 2 n clicks leave a tile."""
    outer = rows.where((F.col("_rn") <= n) | (F.col("_rn") > F.col("_cnt") - n))
    listed = outer.groupBy(REC, TILE).agg(
        F.max("_cnt").alias("_cnt"), F.sort_array(F.collect_list(F.struct("_rn", "idx"))).alias("_l")
    )
    places = F.col("_l.idx")
    take = F.least(F.lit(n), F.col("_cnt").cast("int"))
    return listed.select(
        REC, TILE, "_cnt", F.slice(places, F.lit(1), take).alias("_first"), F.slice(places, F.size(places) - take + 1, take).alias("_last")
    )


def _neighbours(edges: DataFrame, n: int, interval: int) -> DataFrame:
    """Per tile the next n clicks after it, and how many of its first clicks earlier ones make members.

    Every tile here has a click, so n tiles on either side hold the n nearest ones.
    """
    along = Window.partitionBy(REC).orderBy(TILE)
    none = F.array().cast("array<bigint>")
    earlier = F.flatten(F.array(*[F.coalesce(F.lag("_last", k).over(along), none) for k in range(n, 0, -1)]))
    later = F.flatten(F.array(*[F.coalesce(F.lead("_first", k).over(along), none) for k in range(1, n + 1)]))
    near = edges.select(REC, TILE, "_cnt", "_first", earlier.alias("_e"), F.slice(later, 1, n).alias("_after"))
    kept = F.least(F.size("_e"), F.lit(n))
    near = near.withColumn("_before", F.slice("_e", F.size("_e") - kept + 1, kept))
    line = F.concat("_before", "_first", F.when(F.col("_cnt") < n, F.col("_after")).otherwise(none))
    near = near.withColumn("_line", line)
    # the j-th of m earlier clicks that begins a group reaches n - (m - j) clicks into the tile
    reach = F.transform(
        F.col("_before"),
        lambda click, j: F.when(
            F.coalesce(F.get("_line", j + n) - click < interval, F.lit(False)), n - F.size("_before") + j + 1
        ).otherwise(0),
    )
    return near.select(REC, TILE, "_after", F.coalesce(F.array_max(reach), F.lit(0)).alias("_reach"))


def train_members(dets: DataFrame, min_len: int, interval: int, tile: int) -> DataFrame:
    """Mark the clicks that belong to a train.

    Any min_len + 1 consecutive clicks that span less than `interval` samples are
    all members. A tile needs to know only min_len clicks on either side, which it
    gets from the tile summary, so tiles may be as narrow as the density asks for.
    """
    n = min_len
    order = tile_window([REC], "idx", "det_id")
    whole = Window.partitionBy(REC, TILE)
    rows = add_tiles(dets, "idx", tile).drop(CORE)
    rows = (
        rows.withColumn("_rn", F.row_number().over(order))
        .withColumn("_ahead", F.lead("idx", n).over(order))
        .withColumn("_cnt", F.count("*").over(whole))
    )
    near = _neighbours(_edges(rows, n), n, interval)
    met = rows.join(near, [REC, TILE])
    left = F.col("_cnt") - F.col("_rn")  # clicks that follow in the tile
    ahead = F.coalesce("_ahead", F.get("_after", n - left - 1))
    met = met.withColumn("_starts", F.coalesce(ahead - F.col("idx") < interval, F.lit(False)))
    member = F.max("_starts").over(order.rowsBetween(-n, 0)) | (F.col("_rn") <= F.col("_reach"))
    return met.withColumn("is_member", member).drop("_rn", "_ahead", "_cnt", "_after", "_reach", "_starts")


def click_trains(
    dets: DataFrame,
    min_len: int,
    interval: int,
    tile: int,
    n_samples: DataFrame | Column | int,
) -> DataFrame:
    """One row per train: start_idx, end_idx, last_member_idx, n_dets, level.

    end_idx is the first click after the train that is no member, or the length
    of the recording where none follows (one for all, or a table recording_id, n_samples).
    level is the highest peak.
    """
    order = tile_window([REC], "idx", "det_id")
    rows = train_members(dets, min_len, interval, tile)
    same = F.lag("is_member").over(order) == F.col("is_member")
    rows = rows.withColumn("_break", F.when(same, 0).otherwise(1)).withColumn("_next", F.lead("idx").over(order))
    rows = rows.withColumn("_run", F.sum("_break").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # only the last row of a tile has no next one; plain values keep this a hash aggregation
    end = F.when(F.count("_next") == F.count("*"), F.max("_next"))
    runs = rows.groupBy(REC, TILE, "_run").agg(
        F.max("is_member").alias("is_member"),
        F.min("idx").alias("start_idx"),
        F.max("idx").alias("last_member_idx"),
        F.count("*").alias("n_dets"),
        F.max("peak").alias("level"),
        end.alias("end_idx"),
    )
    runs = cut_lineage(runs)  # read twice below
    opens = F.col("_run") == 1
    closes = F.col("end_idx").isNull()
    out = [REC, "start_idx", "end_idx", "last_member_idx", "n_dets", "level"]

    inner = runs.where(F.col("is_member") & ~opens & ~closes).select(*out)

    # a run that touches a tile edge may go on in the next tile: at most two per tile
    along = Window.partitionBy(REC).orderBy(TILE, "_run")
    edge = runs.where(opens | closes)
    goes_on = opens & F.col("is_member") & F.coalesce(F.lag("is_member").over(along), F.lit(False))
    edge = edge.withColumn("_new", F.when(goes_on, 0).otherwise(1)).withColumn(
        "_end", F.coalesce("end_idx", F.lead("start_idx").over(along))
    )
    edge = edge.withColumn("_train", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    joined = (
        edge.where("is_member")
        .groupBy(REC, "_train")
        .agg(
            F.min("start_idx").alias("start_idx"),
            F.max("last_member_idx").alias("last_member_idx"),
            F.sum("n_dets").alias("n_dets"),
            F.max("level").alias("level"),
            F.when(F.count("_end") == F.count("*"), F.max("_end")).alias("end_idx"),
        )
        .select(*out)
    )
    closed = with_lengths(inner.unionByName(joined), n_samples, "_length")
    return closed.withColumn("end_idx", F.coalesce("end_idx", "_length")).drop("_length")


def train_counts(trains: DataFrame) -> DataFrame:
    """Trains and clicks in trains per recording."""
    return trains.groupBy(REC).agg(
        F.count("*").alias("n_trains"), F.sum("n_dets").cast("bigint").alias("clicks_in_trains")
    )
