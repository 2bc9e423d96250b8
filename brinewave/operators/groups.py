"""Group values joined back to the rows.

A window over a whole group would send a hot group to one task. Here the group
is reduced first (map-side combined) and the small result joined back, so that
adaptive execution can split the hot side or broadcast the small one by size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from brinewave.session import cut_lineage

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 << 20  # of the rows as text


def with_group_values(df: DataFrame, keys: Sequence[str], how: str = "inner", **values: Column) -> DataFrame:
    reduced = df.groupBy(*keys).agg(*[v.alias(name) for name, v in values.items()])
    return df.join(reduced, list(keys), how)


def per_group(reduced: DataFrame) -> DataFrame:
    """A reduced table (a row or so per group) ready to join to blocks or samples.

    It is written once, and broadcast when it is small, so that the large side is
    neither read twice for it nor shuffled to meet it.
    """
    return small_side(cut_lineage(reduced))


def small_side(df: DataFrame, source: DataFrame | None = None) -> DataFrame:
    """Broadcast a side whose rows and bytes have been checked; larger ones are merged.

    Merged by a hint: the join planner takes a written table for as large as its compressed files, and would broadcast
    hundreds of thousands of rows through the driver.

    The rows of `source` (default df) are counted: a table of which df is a
    projection and whose lineage is short, as after a checkpoint.
    """
    return F.broadcast(df) if is_small(df if source is None else source) else df.hint("merge")


def is_small(table: DataFrame) -> bool:
    """True if rows and bytes of a written table allow to send it to every task; one job."""
    size = F.sum(F.octet_length(F.to_json(F.struct("*"))))
    rows, held = table.agg(F.count("*"), F.coalesce(size, F.lit(0))).first()
    return rows <= BROADCAST_ROWS and held <= BROADCAST_BYTES


def with_lengths(df: DataFrame, n_samples: DataFrame | Column | int, name: str) -> DataFrame:
    """df with its recording's length: one number, a column of df, or a table (recording_id, n_samples)."""
    if isinstance(n_samples, DataFrame):
        lengths = n_samples.select("recording_id", F.col("n_samples").cast("bigint").alias(name))
        return df.join(lengths, "recording_id", "left")
    return df.withColumn(name, n_samples if isinstance(n_samples, Column) else F.lit(n_samples).cast("bigint"))
