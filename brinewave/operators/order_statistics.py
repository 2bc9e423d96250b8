"""Exact order statistics of very large groups.

A built-in exact percentile keeps every value of a group in one buffer. Here a
value is its 64-bit pattern, changed so that integers sort as the doubles do, and
a group is narrowed down 16 bits at a time: each pass is a histogram of at most 65,536 buckets for a
group, which partial counts merge into. As soon as the buckets that hold the
ranks have few rows, or all 64 bits are known, their values themselves are counted.
How wide the values spread, or how far they lie from zero, makes no difference.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewave.functions import kernels
from brinewave.operators.groups import small_side
from brinewave.session import cut_lineage

BITS = 16  # of a pattern that one pass decides
LEVELS = 64 // BITS
FEW = 1 << BITS  # rows of a bucket whose values are counted one by one
LARGEST = (1 << 63) - 1


def pattern(x: Column) -> Column:
    """The bits of a double as a bigint that sorts like it; -0.0 is 0.0, NaN comes last."""
    size = F.abs(x)
    near = F.floor(F.log2(size))
    # the logarithm may be off by one next to a power of two
    power = near + F.when(size >= F.pow(F.lit(2.0), near + 1), 1).when(size < F.pow(F.lit(2.0), near), -1).otherwise(0)
    exponent = F.greatest(power, F.lit(-1022)).cast("bigint")
    fraction = (size / F.pow(F.lit(2.0), exponent - 52)).cast("bigint")  # exact: a division by a power of two
    finite = F.shiftleft(exponent + 1022, 52) + fraction
    bits = F.when(size == 0, F.lit(0).cast("bigint")).when(size == float("inf"), F.lit(2047 << 52)).otherwise(finite)
    return F.when(F.isnan(x), F.lit(LARGEST)).when(x < 0, -bits - 1).otherwise(bits)


def patterns(x: np.ndarray) -> np.ndarray:
    """The same of an array."""
    bits = (np.asarray(x, dtype=np.float64) + 0.0).view(np.int64)
    return np.where(np.isnan(x), np.int64(LARGEST), bits ^ ((bits >> 63) & np.int64(LARGEST)))


def _shift(level: int) -> int:
    return 64 - BITS * level


def _holding(counts: DataFrame, keys: list[str], level: str, ranks: DataFrame | None, parent: str) -> DataFrame:
    """Buckets of `level` that hold one of the ranks, with their rows and the rank left inside them."""
    within = [*keys, parent] if ranks is not None else keys
    upto = Window.partitionBy(*within, "which").orderBy(level)
    hit = counts.join(ranks.select(*within, "which", "n", "rank"), within) if ranks is not None else counts
    cum = F.sum("c").over(upto.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (
        hit.withColumn("cum", cum)
        .where((F.col("rank") < F.col("cum")) & (F.col("rank") >= F.col("cum") - F.col("c")))
        .select(*keys, F.col(level).alias("_b"), "which", "n", "c", (F.col("rank") - F.col("cum") + F.col("c")).alias("rank"))
    )


def _select(keys: list[str], ranks: dict[str, Column], first: DataFrame, deeper: Callable[[DataFrame, int], DataFrame], values: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """Narrow down to the values at the ranks.

    `first` counts rows (`c`) per (keys, _b), the first 16 bits; `deeper(held, level)` counts per
    (keys, _b, _next) in the buckets held after `level` passes; `values(held, level)` per (keys, _b, _x).
    """
    wanted = F.array(*[F.struct(F.lit(k).alias("which"), v.cast("bigint").alias("rank")) for k, v in ranks.items()])
    total = F.sum("c").over(Window.partitionBy(*keys))
    counted = first.withColumn("n", total).select("*", F.inline(wanted))
    # a few rows per group: cut here, so that each pass reads the input once
    found = cut_lineage(_holding(counted, keys, "_b", None, "_b"))
    level = 1
    while level < LEVELS and (found.agg(F.max("c")).first()[0] or 0) > FEW:
        found = cut_lineage(_holding(deeper(found, level), keys, "_next", found, "_b"))
        level += 1
    found = _holding(values(found, level), keys, "_x", found, "_b")
    picks = []
    for name in ranks:
        picks.append(F.max(F.when(F.col("which") == name, F.col("_b"))).alias(name))
        picks.append(F.max(F.when(F.col("which") == name, F.col("rank"))).alias(name + "_rank"))
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *picks)


def select_ranks(df: DataFrame, keys: Sequence[str], x: str, ranks: dict[str, Column]) -> DataFrame:
    """The values at the given 0-based ranks, one column per entry of `ranks`.

    A rank is an expression over `n`, the number of rows of the group. One row per
    group with `n`, and for each entry `name` the value and `name_rank`,
    its rank among rows equal to it (rows before it with the same value).

    The input is read two to five times: cut its lineage first where it is costly.
    """
    keys = list(keys)
    rows = df.where(F.col(x).isNotNull()).select(*keys, F.col(x).cast("double").alias("_x"))
    rows = rows.withColumn("_p", pattern(F.col("_x")))

    def count(found: DataFrame, level: int, *by: Column) -> DataFrame:
        held = small_side(found.select(*keys, "_b").distinct(), found)
        inside = rows.withColumn("_b", F.shiftright("_p", _shift(level))).join(held, [*keys, "_b"])
        return inside.groupBy(*keys, "_b", *by).agg(F.count("*").alias("c"))

    first = rows.groupBy(*keys, F.shiftright("_p", _shift(1)).alias("_b")).agg(F.count("*").alias("c"))
    return _select(
        keys, ranks, first,
        lambda found, level: count(found, level, F.shiftright("_p", _shift(level + 1)).alias("_next")),
        lambda found, level: count(found, level, F.col("_x")),
    )


def select_ranks_in_blocks(
    blocks: DataFrame, keys: Sequence[str], column: str, ranks: dict[str, Column], first: DataFrame | None = None
) -> DataFrame:
    """The same over the elements of an array column, counted inside each block.

    Only bucket counts leave a block, never its samples; the blocks are not shuffled. `first` are counts by
    the first 16 bits (keys, _b, c) that an earlier pass has made.
    """
    keys = list(keys)
    rows = blocks.select(*keys, F.col(column).alias("_a"))

    def merged(listed: DataFrame, *by: str) -> DataFrame:
        return listed.groupBy(*keys, *by).agg(F.sum("c").alias("c"))

    def narrowed(found: DataFrame) -> DataFrame:
        held = found.groupBy(*keys).agg(F.collect_set("_b").alias("_held"))
        return rows.join(small_side(held, found), keys)

    def deeper(found: DataFrame, level: int) -> DataFrame:
        return merged(narrowed(found).select(*keys, F.inline(bucket_counts(level)("_a", "_held"))), "_b", "_next")

    def values(found: DataFrame, level: int) -> DataFrame:
        return merged(narrowed(found).select(*keys, F.inline(value_counts(level)("_a", "_held"))), "_b", "_x")

    if first is None:
        first = rows.select(*keys, F.inline(first_counts("_a")))
    return _select(keys, ranks, merged(first, "_b"), deeper, values)


COUNTS = "array<struct<_b: bigint, c: bigint>>"


def counted_by_pattern(arrays: list[np.ndarray]) -> pa.Array:
    """Counts of each array's values by the first 16 bits of their patterns."""
    found = [np.unique(patterns(x) >> _shift(1), return_counts=True) for x in arrays]
    return kernels.structs_from([len(b) for b, _ in found], _b=[b for b, _ in found], c=[c for _, c in found])


@kernels.arrow_function(COUNTS)
def first_counts(arrays: pa.Array) -> pa.Array:
    return counted_by_pattern(list(kernels.rows_of(arrays)))


def _held_values(arrays: pa.Array, held: pa.Array, level: int):
    for x, buckets in zip(kernels.rows_of(arrays), held.to_pylist()):
        p = patterns(x)
        keep = np.isin(p >> _shift(level), buckets)
        yield x[keep] + 0.0, p[keep]


def bucket_counts(level: int):
    """Counts of one block by the next 16 bits, within the buckets held after `level` passes."""

    @kernels.arrow_function("array<struct<_b: bigint, _next: bigint, c: bigint>>")
    def run(arrays: pa.Array, held: pa.Array) -> pa.Array:
        found = [np.unique(p >> _shift(level + 1), return_counts=True) for _, p in _held_values(arrays, held, level)]
        return kernels.structs_from([len(b) for b, _ in found], _b=[b >> BITS for b, _ in found], _next=[b for b, _ in found], c=[c for _, c in found])

    return run


def value_counts(level: int):
    """Counts of the single values in the buckets held."""

    @kernels.arrow_function("array<struct<_b: bigint, _x: double, c: bigint>>")
    def run(arrays: pa.Array, held: pa.Array) -> pa.Array:
        found = [np.unique(x, return_counts=True) for x, _ in _held_values(arrays, held, level)]
        return kernels.structs_from([len(v) for v, _ in found], _b=[patterns(v) >> _shift(level) for v, _ in found], _x=[v for v, _ in found], c=[c for _, c in found])

    return run


def interpolated(got: DataFrame, keys: list[str], q: float, out: str) -> DataFrame:
    place = (F.col("n") - 1) * F.lit(float(q))
    part = place - F.floor(place)
    between = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * part
    return got.select(*keys, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between).alias(out))


def _quantile_ranks(q: float) -> dict[str, Column]:
    place = (F.col("n") - 1) * F.lit(float(q))
    return {"_lo": F.floor(place), "_hi": F.ceil(place)}


def exact_quantile(df: DataFrame, keys: Sequence[str], x: str, q: float, out: str) -> DataFrame:
    """Quantile with linear interpolation between the two nearest ranks."""
    return interpolated(select_ranks(df, keys, x, _quantile_ranks(q)), list(keys), q, out)


def block_quantile(blocks: DataFrame, keys: Sequence[str], column: str, q: float, out: str, first: DataFrame | None = None) -> DataFrame:
    """The same over the elements of an array column."""
    return interpolated(select_ranks_in_blocks(blocks, keys, column, _quantile_ranks(q), first), list(keys), q, out)
