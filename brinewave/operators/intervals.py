"""Inter-click intervals: histograms per time slot and per recording."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from brinewave.functions.histograms import interval_mode
from brinewave.operators.tiles import TILE, add_tiles, tile_window

REC = "recording_id"
SLOT = "slot"


def slot_places(dets: DataFrame, slot_len: int) -> DataFrame:
    """Distinct click places inside each slot, with their counts.

    The place is the number of samples since the recording began, clicks exactly
    on a slot edge belong to no slot. A slot has at most slot_len - 1 places, so
    everything keyed by (recording, slot) is bounded from here on.
    """
    at = F.col("idx") - 1
    return (
        dets.select(REC, F.floor(at / slot_len).alias(SLOT), (at % slot_len).alias("place"))
        .where(F.col("place") > 0)
        .groupBy(REC, SLOT, "place")
        .agg(F.count("*").alias("clicks"))
    )


def slot_spine(dets: DataFrame, slot_len: int, fs: int) -> DataFrame:
    """Every whole slot up to the last click, rounded up to a second; its unfinished rest has none."""
    last = dets.groupBy(REC).agg(F.max("idx").alias("last"))
    n_slots = F.floor(F.ceil((F.col("last") - 1) / fs) * fs / slot_len)
    return last.withColumn("n_slots", n_slots).where(F.col("n_slots") > 0).select(
        REC, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_slots") - 1)).alias(SLOT)
    )


def slot_interval_modes(dets: DataFrame, slot_len: int, fs: int, bin_width: int, limit: int) -> DataFrame:
    """Per slot: clicks, the commonest interval between any two clicks and its count.

    Slots without clicks, or without intervals below the limit, give 0.
    """
    lists = (
        slot_places(dets, slot_len)
        .groupBy(REC, SLOT)
        .agg(
            F.sum("clicks").alias("n_clicks"),
            F.sort_array(F.collect_list(F.struct("place", "clicks"))).alias("l"),
        )
    )
    modes = lists.select(
        REC, SLOT, "n_clicks", interval_mode(F.col("l.place"), F.col("l.clicks"), bin_width, limit, slot_len).alias("m")
    )
    joined = slot_spine(dets, slot_len, fs).join(modes, [REC, SLOT], "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        REC,
        SLOT,
        F.coalesce("n_clicks", zero).alias("n_clicks"),
        F.coalesce("m.mode", zero).alias("mode"),
        F.coalesce("m.weight", zero).alias("weight"),
    )


def slot_direct_modes(dets: DataFrame, slot_len: int, fs: int, bin_width: int, limit: int) -> DataFrame:
    """The same with differences of consecutive clicks only."""
    within = Window.partitionBy(REC, SLOT).orderBy("place")
    steps = slot_places(dets, slot_len).withColumn("step", F.col("place") - F.lag("place").over(within))
    bins = (
        steps.where(F.col("step") < limit)
        .groupBy(REC, SLOT, F.floor(F.col("step") / bin_width).alias("bin"))
        .agg(F.count("*").alias("c"))
    )
    best = bins.groupBy(REC, SLOT).agg(F.max(F.struct("c", (-F.col("bin")).alias("neg"))).alias("m"))
    joined = slot_spine(dets, slot_len, fs).join(best, [REC, SLOT], "left")
    zero = F.lit(0).cast("bigint")
    return joined.select(
        REC,
        SLOT,
        F.coalesce(-F.col("m.neg") * bin_width, zero).alias("mode"),
        F.coalesce("m.c", zero).alias("weight"),
    )


def best_slot(modes: DataFrame, slot_len: int, fs: int) -> DataFrame:
    """The slot with the highest weight per recording, the first one on ties."""
    top = modes.groupBy(REC).agg(
        F.max_by(F.struct("mode", "weight", SLOT), F.struct(F.col("weight"), -F.col(SLOT))).alias("b")
    )
    return top.select(
        REC,
        F.col("b.mode").alias("ici_sample"),
        (F.col("b.mode") / fs).alias("ici_seconds"),
        F.col("b.weight").alias("weight"),
        (F.col("b.slot") * slot_len / fs).alias("time_s"),
    )


def raw_interval_mode(dets: DataFrame, bin_width: int, limit: int, tile: int) -> DataFrame:
    """Commonest difference of consecutive clicks below `limit` over the whole recording.

    Steps inside a tile and steps from one tile to the next are counted apart.
    """
    order = tile_window([REC], "idx", "det_id")
    tiled = add_tiles(dets, "idx", tile)
    inside = tiled.select(REC, (F.col("idx") - F.lag("idx").over(order)).alias("step"))
    along = Window.partitionBy(REC).orderBy(TILE)
    ends = tiled.groupBy(REC, TILE).agg(F.min("idx").alias("lo"), F.max("idx").alias("hi"))
    across = ends.select(REC, (F.col("lo") - F.lag("hi").over(along)).alias("step"))
    bins = (
        inside.unionByName(across)
        .where(F.col("step") < limit)
        .groupBy(REC, F.floor(F.col("step") / bin_width).alias("bin"))
        .agg(F.count("*").alias("c"))
    )
    best = bins.groupBy(REC).agg(F.max(F.struct("c", (-F.col("bin")).alias("neg"))).alias("m"))
    return best.select(
        REC,
        (-F.col("m.neg") * bin_width).alias("ici_direct_mode"),
        F.col("m.c").alias("ici_direct_weights"),
    )


def interval_table(
    dets: DataFrame, slot_len: int, fs: int, bin_width: int, limit: int, raw_bin: int, raw_limit: int, tile: int
) -> DataFrame:
    """One row per recording: its best slot and its commonest raw interval."""
    best = best_slot(slot_interval_modes(dets, slot_len, fs, bin_width, limit), slot_len, fs)
    raw = raw_interval_mode(dets, raw_bin, raw_limit, tile)
    zero = F.lit(0).cast("bigint")
    return best.join(raw, REC, "left").withColumns(
        {
            "ici_direct_mode": F.coalesce("ici_direct_mode", zero),
            "ici_direct_weights": F.coalesce("ici_direct_weights", zero),
        }
    )
