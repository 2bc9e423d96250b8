"""Sainte-Lague apportionment as DataFrame windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def sainte_lague(parties: DataFrame, group: list[str], tie: list[str], votes: str, seats: str, out: str) -> DataFrame:
    """Adds `out`: the seats of each party, by highest quotients votes / (2k - 1) within `group`.

    `seats` holds the same number for all parties of a group. With n parties the last
    quotient to win lies where votes/divisor sum to seats +- n/2, so only the seats
    between these two divisors are contested: about 3n candidates, whatever the number of
    seats. Equal quotients go to the smaller `tie`. Parties without votes get no seat.
    """
    names = parties.columns
    own = Window.partitionBy(*group)
    voting = parties.where(F.col(votes) > 0)
    v, half = F.col(votes).cast("double"), F.col("_n") / 2
    bounded = (
        voting.withColumn("_v", F.sum(v).over(own))
        .withColumn("_n", F.count(F.lit(1)).over(own))
        .withColumn("_sure", F.greatest(F.lit(0), F.floor(v * (F.col(seats) - half) / F.col("_v") + 0.5) - 1))
        .withColumn("_most", F.floor(v * (F.col(seats) + half) / F.col("_v") + 0.5) + 1)
        .withColumn("_open", F.col(seats) - F.sum("_sure").over(own))
    )
    contested = bounded.withColumn("_k", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))))
    order = [F.desc(F.col(votes) / (2 * F.col("_k") - 1)), *[F.asc_nulls_last(c) for c in tie], F.asc("_k")]
    ranked = contested.withColumn("_place", F.row_number().over(own.orderBy(*order)))
    won = F.sum((F.col("_place") <= F.col("_open")).cast("long"))
    counted = ranked.groupBy(*names, "_sure").agg((F.col("_sure") + won).alias(out)).select(*names, out)
    silent = parties.where(~(F.coalesce(F.col(votes), F.lit(0)) > 0)).withColumn(out, F.lit(0).cast("long"))
    return counted.unionByName(silent)


def filled_targets(sources: DataFrame, size: str, weight: str, most: int, order: Column) -> DataFrame:
    """Adds `target`: all sizes shared by weight, each at most `most` times its own size.

    What a full source leaves is shared by weight among the rest until none is above.
    Closed form: in ascending order of most * size / weight, sources are full as long as
    the level of the rest lies above that ratio. One row per source goes through one window.
    """
    ratio = most * F.col(size) / F.col(weight)
    line = Window.orderBy(ratio, order)
    before, everything = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    zero = F.lit(0.0)
    levels = (
        sources.withColumn("_full", F.coalesce(F.sum(most * F.col(size).cast("double")).over(before), zero))
        .withColumn("_used", F.coalesce(F.sum(F.col(weight).cast("double")).over(before), zero))
        .withColumn("_total", F.sum(F.col(size).cast("double")).over(everything))
        .withColumn("_weights", F.sum(F.col(weight).cast("double")).over(everything))
        .withColumn("_level", (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_used")))
        .withColumn("_at", F.row_number().over(line))
    )
    free = F.when(F.col("_level") <= ratio, F.struct("_at", "_level"))
    first = levels.withColumn("_first", F.min(free).over(everything))
    capped = F.col("_first").isNull() | (F.col("_at") < F.col("_first._at"))
    target = F.when(capped, most * F.col(size).cast("double")).otherwise(F.col(weight) * F.col("_first._level"))
    return first.withColumn("target", target).select(*sources.columns, "target")
