"""Value histograms, step and bias of quantized channels, and round trips."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewave.functions import kernels
from brinewave.operators.groups import per_group
from brinewave.session import cut_lineage

REC = "recording_id"
KEYS = [REC, "channel"]

# Step of a 16-bit converter over +-10 V, how far a found step may be from it, and the
# largest round-trip error that passes.
DEFAULT_STEP = 10 / 2**15
STEP_TOLERANCE = 0.11
ERROR_TOLERANCE = 1.4e-4
INT_LIMIT = 2**15
CHANNELS_PER_PACK = 8
PILE = 10_000  # distinct values of a channel in one list, on average


def value_counts(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Distinct values with counts; keys without channel pool the channels."""
    return samples.groupBy(*(keys or KEYS), "x").agg(F.count("*").alias("n"))


def nearest_to_zero(values: DataFrame) -> DataFrame:
    """Largest negative and smallest positive value."""
    return values.groupBy(*KEYS).agg(
        F.max(F.when(F.col("x") < 0, F.col("x"))).alias("max_negative"),
        F.min(F.when(F.col("x") > 0, F.col("x"))).alias("min_positive"),
    )


PART = "_part"


def _ordered(values: DataFrame) -> DataFrame:
    """Distinct values in ascending order, written: _part (a stretch of the order, cut where the values are dense), _place
    within a channel's stretch, and _gap to the value before it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), None
        for batch in batches:
            rows = batch.to_pandas()
            x = rows["x"].to_numpy()
            fresh = (rows[KEYS] != rows[KEYS].shift()).any(axis=1).to_numpy()
            place = np.arange(len(rows))
            start = np.maximum.accumulate(np.where(fresh, place, 0))
            gap = np.diff(x, prepend=np.nan)
            if before is not None and len(rows) and before[0] == tuple(rows.loc[0, KEYS]):
                fresh[0], gap[0] = False, x[0] - before[1]
                carried = int(np.argmax(fresh)) if fresh.any() else len(rows)
                place[:carried] += before[2] + 1
            else:
                carried = 0
            place[carried:] -= start[carried:]
            gaps = pa.array(gap, mask=fresh)
            if len(rows):
                before = (tuple(rows.loc[len(rows) - 1, KEYS]), x[-1], int(place[-1]))
            columns = [*(batch.column(c) for c in KEYS), batch.column("x"), pa.array(np.full(len(rows), part, "i4")), pa.array(place), gaps]
            yield pa.RecordBatch.from_arrays(columns, [*KEYS, "x", PART, "_place", "_gap"])

    keys = ", ".join(f"{c} {values.schema[c].dataType.simpleString()}" for c in KEYS)
    line = values.select(*KEYS, F.col("x").cast("double").alias("x")).distinct()
    ordered = line.repartitionByRange(*KEYS, "x").sortWithinPartitions(*KEYS, "x")
    return cut_lineage(ordered.mapInArrow(run, f"{keys}, x double, {PART} int, _place bigint, _gap double"))


def _stretches(ordered: DataFrame) -> DataFrame:
    """One row per channel and stretch: its values' number, ends, smallest gap (that to the stretch before included), and the
    number of values before it."""
    each = ordered.groupBy(*KEYS, PART).agg(
        F.count("*").alias("n"),
        F.min("x").alias("lo"),
        F.max("x").alias("hi"),
        F.min("_gap").alias("gap"),
        F.max(F.when(F.col("x") < 0, F.col("x"))).alias("neg"),
        F.min(F.when(F.col("x") > 0, F.col("x"))).alias("pos"),
    )
    along = Window.partitionBy(*KEYS).orderBy(PART)
    across = F.col("lo") - F.lag("hi").over(along)
    earlier = F.coalesce(F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return each.withColumn("gap", F.least("gap", across)).withColumn("before", earlier)


def smallest_gap(values: DataFrame) -> DataFrame:
    """Least difference of neighbouring distinct values.

    Values are ordered over range partitions, whose edges follow their density, so no channel is ordered in one
    place; what crosses an edge is one row per channel and partition.
    """
    return _stretches(_ordered(values)).groupBy(*KEYS).agg(F.min("gap").alias("min_gap"))


def corrections(values: DataFrame, int_limit: int = INT_LIMIT) -> DataFrame:
    """[step, bias] per channel from its distinct values.

    One value: step 1 and that value. Else the step is the gap across zero when it
    is near the converter's step, otherwise the smallest gap; the bias is the value
    nearest to zero, or the one nearest to mid-range when the scaled range does not
    fit. Channels on one side of zero take the smallest gap and the value in the
    middle of the ordered list. The values are ordered once; only channels that need the one nearest to mid-range, or
    the middle one, are looked at again, the latter in one stretch.
    """
    v = _ordered(values)
    parts = cut_lineage(_stretches(v))
    base = parts.groupBy(*KEYS).agg(
        F.sum("n").alias("n_values"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("gap").alias("min_gap"), F.max("neg").alias("neg"), F.min("pos").alias("pos")
    )
    zero_gap = F.col("pos") - F.col("neg")
    near = F.abs(zero_gap - DEFAULT_STEP) / DEFAULT_STEP < STEP_TOLERANCE
    step = F.when(F.col("n_values") == 1, F.lit(1.0)).otherwise(F.when(near, zero_gap).otherwise(F.col("min_gap")))
    bias = F.when(F.abs("neg") <= F.abs("pos"), F.col("neg")).otherwise(F.col("pos"))
    base = base.withColumn("_two_sided", F.col("neg").isNotNull() & F.col("pos").isNotNull())
    base = base.withColumn("step", step).withColumn("_bias", bias)
    too_wide = (F.greatest(F.abs("lo"), F.abs("hi")) - F.col("_bias")) / F.col("step") > int_limit
    mid = (F.col("lo") + F.col("hi")) / 2
    wide = base.where(F.col("_two_sided") & too_wide).select(*KEYS, mid.alias("_mid"))
    nearest = v.join(per_group(wide), KEYS).groupBy(*KEYS).agg(F.min_by("x", F.struct(F.abs(F.col("x") - F.col("_mid")), "x")).alias("_nearest"))
    rank = F.greatest(F.floor(F.col("n_values") / 2) - 1, F.lit(0).cast("bigint"))
    sided = base.where(~F.col("_two_sided")).select(*KEYS, rank.alias("_rank"))
    there = parts.join(per_group(sided), KEYS).where((F.col("_rank") >= F.col("before")) & (F.col("_rank") < F.col("before") + F.col("n")))
    places = per_group(there.select(*KEYS, PART, (F.col("_rank") - F.col("before")).alias("_place")))
    middle = v.join(places, [*KEYS, PART, "_place"]).select(*KEYS, F.col("x").alias("_middle"))
    out = base.join(nearest.hint("merge"), KEYS, "left").join(middle.hint("merge"), KEYS, "left")  # a row per channel each
    chosen = (
        F.when(F.col("n_values") == 1, F.col("lo"))
        .when(~F.col("_two_sided"), F.col("_middle"))
        .when(too_wide, F.col("_nearest"))
        .otherwise(F.col("_bias"))
    )
    return out.select(*KEYS, "step", chosen.alias("bias"), "n_values")


def to_counts(x: Column, step: Column, bias: Column) -> Column:
    """Nearest count, half to even; in ANSI mode a count beyond 16 bits raises."""
    return F.rint((x - bias) / step).cast("smallint")


def to_volts(counts: Column, step: Column, bias: Column) -> Column:
    return counts * step + bias


def round_trip_errors(samples: DataFrame, correction: DataFrame, tolerance: float = ERROR_TOLERANCE) -> DataFrame:
    """Extremes of the error after quantizing and restoring, and whether they pass."""
    rows = samples.join(per_group(correction), KEYS)
    step, bias = F.col("step"), F.col("bias")
    error = to_volts(to_counts(F.col("x"), step, bias), step, bias) - F.col("x")
    out = rows.groupBy(*KEYS).agg(F.min(error).alias("min_error"), F.max(error).alias("max_error"))
    worst = F.greatest(F.abs("min_error"), F.abs("max_error"))
    return out.withColumn("passed", worst < tolerance)


def scale_logic_channels(samples: DataFrame, logic: list[int]) -> DataFrame:
    """Logic channels divided by their maximum (0 stays 0), the others as they are."""
    tops = per_group(samples.where(F.col("channel").isin(logic)).groupBy(*KEYS).agg(F.max("x").alias("_top")))
    rows = samples.join(tops, KEYS, "left")
    scaled = F.when(F.col("_top").isNull() | (F.col("_top") == 0), F.col("x")).otherwise(F.col("x") / F.col("_top"))
    return rows.select(*KEYS, *[c for c in samples.columns if c not in (*KEYS, "x")], scaled.alias("x"))


def trial_fit(values: DataFrame, trials: list[tuple[float, float]], bits: int = 15) -> DataFrame:
    """The trial (range, offset) under which the distinct values lie nearest to integers, the first of equal ones.

    A batch gives one vector of costs for each channel, and these are added: no column or row is made for each trial and value.
    """
    width, offset = np.array(trials, dtype=float).T

    @F.arrow_udf("array<double>")
    def costs(lists: pa.Array) -> pa.Array:
        out = []
        for x in kernels.rows_of(lists):
            total = np.zeros(len(width))
            for part in np.array_split(x, len(x) * len(width) // 4_000_000 + 1):
                z = (part[:, None] - offset) / width * 2**bits
                total += np.abs(z - np.rint(z)).sum(axis=0)
            out.append(total)
        return kernels.lists_from(out)

    # lists of a channel's values: as many as keep them short
    most = values.groupBy(*KEYS).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    pile = F.pmod(F.xxhash64("x"), F.lit(most // PILE + 1))
    piles = values.groupBy(*KEYS, pile.alias("_pile")).agg(F.collect_list("x").alias("_x"))
    summed = piles.select(*KEYS, F.posexplode(costs("_x")).alias("trial", "c")).groupBy(*KEYS, "trial").agg(F.round(F.sum("c"), 6).alias("cost"))
    best = summed.groupBy(*KEYS).agg(F.min(F.struct("cost", "trial")).alias("b"))
    pick = [F.get(F.array(*map(F.lit, column.tolist())), F.col("b.trial")) for column in (width, offset)]
    return best.select(*KEYS, F.col("b.trial").alias("trial"), pick[0].alias("width"), pick[1].alias("offset"), F.col("b.cost").alias("cost"))


def channel_pack(channel: Column) -> Column:
    """Channels go in packs of eight, numbered from 1."""
    return F.ceil(channel / CHANNELS_PER_PACK).cast("bigint")
