"""Vectors in packed blocks, and a query set met with every block."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewave.session import cut_lineage

BLOCK_ROWS = 8192
QUERY_ROWS = 512
#: Slots with about one block each, at most; beyond, a slot holds so many components, and a group of queries so many.
FEW_SLOTS = 64
SLOT_VALUES = 8 << 20
GROUP_VALUES = 4 << 20


def usable(vector: Column, nonzero: bool = False) -> Column:
    """True for vectors with components that are all there and finite (and not all zero)."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    good = vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))
    if nonzero:
        good &= F.exists(vector, lambda x: x != 0)
    return good


def vectors_of(df: DataFrame, key: str, vector: str, nonzero: bool = False) -> DataFrame:
    """id, dim and vector of the rows that take part: an id and a usable vector."""
    kept = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("vector"))
    return kept.where(F.col("id").isNotNull() & usable(F.col("vector"), nonzero)).withColumn("dim", F.size("vector"))


def matrices(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[np.ndarray]]]:
    """Per dimension: ids, vectors as doubles and further columns, at most `rows` at a time and few that are shorter."""
    held: dict[int, list[tuple]] = {}

    def flush(dim: int):
        ids, vecs, *more = (np.concatenate(x) for x in zip(*held.pop(dim)))
        for at in range(0, len(ids), rows):
            yield dim, ids[at : at + rows], vecs[at : at + rows], [m[at : at + rows] for m in more]

    for batch in batches:
        dims = batch.column("dim").to_numpy(zero_copy_only=False)
        extra = [n for n in batch.schema.names if n not in ("id", "dim", "vector")]
        for dim in np.unique(dims).tolist():
            part = batch.filter(pa.array(dims == dim))
            flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
            own = (part.column("id").to_numpy(zero_copy_only=False), flat)
            held.setdefault(dim, []).append(own + tuple(part.column(n).to_numpy(zero_copy_only=False) for n in extra))
            if sum(len(x[0]) for x in held[dim]) >= rows:
                yield from flush(dim)
    for dim in list(held):
        yield from flush(dim)


def packed(vectors: DataFrame, rows: int, pack: Callable[..., dict], schema: str) -> DataFrame:
    """One row for each block of vectors: dim, block (a number of its own) and what `pack(ids, vectors, *more)` gives."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 32
        for n, (dim, ids, vecs, more) in enumerate(matrices(batches, rows)):
            row = {"dim": dim, "block": first + n} | pack(ids, vecs, *more)
            yield pa.RecordBatch.from_pylist([row], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    full = f"dim int, block long, {schema}"
    arrow = to_arrow_schema(_parse_datatype_string(full))
    return vectors.mapInArrow(blocks, full)


def dealt(table: DataFrame, name: str, values: int, few: int = 1) -> tuple[DataFrame, int]:
    """Blocks of a written table dealt to numbered shares of about `values` components, and how many shares there are: one
    for each of the first `few` blocks at least."""
    n, held = table.agg(F.count("*"), F.coalesce(F.sum(F.col("dim") * F.octet_length("ids") / 8), F.lit(0.0))).first()
    shares = max(1, min(n, few), math.ceil(held / values))
    return table.withColumn(name, F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int")), shares


def with_slots(blocks: DataFrame) -> tuple[DataFrame, int]:
    """A written block table with a slot for each block, and the number of slots: about one block in each of a few, and
    SLOT_VALUES components in each of many, so that what is sent to all slots does not grow with the number of blocks."""
    return dealt(cut_lineage(blocks), "slot", SLOT_VALUES, FEW_SLOTS)


def to_all(blocks: DataFrame, name: str, shares: int) -> DataFrame:
    """Every block once for each share."""
    return blocks.select("*", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias(name))


def cogrouped(queries: DataFrame, groups: int, blocks: DataFrame, slots: int, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """`run` for each group of query blocks and each slot of blocks of their dimension.

    A task holds one group and one slot, bounded by GROUP_VALUES and SLOT_VALUES, and no side goes through the driver:
    queries are sent once for each slot, blocks once for each group.
    """
    keys = ["dim", "slot", "group"]
    left, right = to_all(queries, "slot", slots), to_all(blocks, "group", groups)
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, schema)


def met(queries: DataFrame, blocks: DataFrame, slots: int) -> DataFrame:
    """Every query block (dim, ids, data ...) beside every block of its dimension.

    Query blocks are sent to all slots: a stated query set against all rows, block by block, merged by a hint. The planner
    takes what is sent for as small as one copy of the queries, and would broadcast all copies.
    Columns of the query side get the prefix q_.
    """
    sent = queries.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot"),
        *[F.col(c).alias(f"q_{c}") for c in queries.columns if c != "dim"],
    )
    return sent.hint("merge").join(blocks, ["dim", "slot"])


def best(rows: DataFrame, k: int) -> DataFrame:
    """Per query_id the k largest scores, ties to the smaller vec_id, with rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], -scores[some]))[:k]]
