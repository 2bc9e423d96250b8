"""Exact top-k by integer inner product with a vector-approximation file.

The file holds, for each block, four bits per component (a cell of that block's own grid)
beside the exact integers. Pass 1 reads only the cells: a query's product with a cell's
middle, plus or minus one radius per query and block, bounds every score; the k-th largest
lower bound of a query over all blocks is a score that its k-th result reaches at least.
Pass 2 visits the exact vectors whose upper bounds reach the bound of pass 1 and the k-th
score found so far; where those are many, the ones with the largest upper bounds first.

Both passes meet a group of queries with a slot of blocks in a task, both of bounded size. What a
query has found in one block holds for the next of the slot, and k values a slot leave the task.

Vectors that are null, empty, or hold null or non-finite components take no part, nor do
rows without an id; vectors of different lengths never meet. A row with the query's id is
the query's own. Empty tables give no rows. Scores beyond 64 bits are clipped to them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from brinewave.llm import vector_blocks as vb
from brinewave.session import cut_lineage

CELLS = 16
#: Products below these are exact in doubles and floats; components below NARROW have products within a float's range.
EXACT, EXACT_NARROW, NARROW = 2.0**53, 2.0**24, 1e15
#: Rows of a block that are looked at first; share of a block's rows (one in so many) beyond which all are scored; pairs scored at once.
HEAD, DENSE, GATHERED = 32, 16, 16384


def scaled(vectors: DataFrame, factor: int) -> DataFrame:
    """floor(factor * x) of every component, in double."""
    return vectors.withColumn("vector", F.transform("vector", lambda x: F.floor(F.lit(float(factor)) * x.cast("double")).cast("double")))


def _stored(values: np.ndarray) -> dict:
    top = np.abs(values).max(initial=0)
    kind = "<i2" if top < 2**15 else "<i4" if top < 2**31 else "<f8"
    return {"kind": kind, "exact": values.astype(kind).tobytes()}


def _approximate(ids: np.ndarray, values: np.ndarray) -> dict:
    low = values.min(axis=0)
    width = np.ceil((values.max(axis=0) - low + 1) / CELLS)
    cells = np.minimum((values - low) // width, CELLS - 1).astype("u1")
    cells = np.pad(cells, ((0, 0), (0, cells.shape[1] % 2)))
    grid = {"low": low.astype("<f8").tobytes(), "width": width.astype("<f8").tobytes()}
    return {"ids": ids.astype("<i8").tobytes(), "cells": (cells[:, ::2] | cells[:, 1::2] << 4).tobytes()} | grid | _stored(values)


def build(vectors: DataFrame) -> tuple[DataFrame, int]:
    """The vector-approximation file, one row for each block, and its number of slots."""
    return vb.with_slots(vb.packed(vectors, vb.BLOCK_ROWS, _approximate, "ids binary, cells binary, low binary, width binary, kind string, exact binary"))


def _query_block(ids: np.ndarray, values: np.ndarray, floor: np.ndarray | None = None) -> dict:
    floor = np.full(len(ids), -np.inf) if floor is None else floor
    return {"ids": ids.astype("<i8").tobytes(), "floor": floor.astype("<f8").tobytes()} | _stored(values)


def _rows(table: pa.Table) -> Iterator[dict]:
    """The rows, one at a time."""
    for batch in table.to_batches(max_chunksize=1):
        yield from batch.to_pylist()


def _exact(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["exact"], row["kind"]).reshape(len(ids), -1).astype("f8")


class _Block:
    """The cells of a block: their middles, half a cell's width, and the largest middle of each component."""

    def __init__(self, row: dict):
        self.ids, dim = np.frombuffer(row["ids"], "<i8"), row["dim"]
        packed = np.frombuffer(row["cells"], "u1").reshape(len(self.ids), -1)
        cells = np.empty((len(self.ids), 2 * packed.shape[1]), "u1")
        cells[:, ::2], cells[:, 1::2] = packed & 15, packed >> 4
        low, width = np.frombuffer(row["low"], "<f8"), np.frombuffer(row["width"], "<f8")
        self.middle, self.half = low + (cells[:, :dim] + 0.5) * width, width / 2
        self.top = np.abs(self.middle).max(axis=0)
        self.narrow = self.middle.astype("f4") if self.top.max() < NARROW else None


class _Queries:
    """A block of queries, and the k best values that each has found, largest first, with the ids they are from."""

    def __init__(self, row: dict, k: int):
        self.ids, self.vectors = _exact(row)
        self.floor, self.k = np.frombuffer(row["floor"], "<f8"), k
        self.narrow = self.vectors.astype("f4") if np.abs(self.vectors).max() < NARROW else None
        self.best, self.found = np.full((len(self.ids), k), -np.inf), np.zeros((len(self.ids), k), "i8")
        self.begun = False

    def near(self, block: _Block) -> tuple[np.ndarray, np.ndarray]:
        """Products with the cells' middles, and the radius of each query around them."""
        small = self.narrow is not None and block.narrow is not None
        score = self.narrow @ block.narrow.T if small else self.vectors @ block.middle.T
        long = np.abs(self.vectors)
        # the slack covers the rounding of this product, and of its factors
        slack = (3e-7 if small else 1e-12) * (block.half.size + 4)
        return score, long @ block.half + slack * (long @ block.top)

    def others(self, reached: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and rows that are reached, a query's own rows left out."""
        n, row = np.divmod(np.flatnonzero(reached), reached.shape[1])  # several times faster than np.nonzero in two dimensions
        other = ids[row] != self.ids[n]
        return n[other], row[other]

    def reaching(self, score: np.ndarray, bar: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Queries and rows whose product is not below the query's bar."""
        low = np.nextafter(bar.astype(score.dtype), score.dtype.type(-np.inf))
        return self.others(score >= low[:, None], ids)

    def keep(self, n: np.ndarray, value: np.ndarray, ids: np.ndarray) -> None:
        """Take in values of queries n; ties go to the smaller id."""
        least = self.best[n, -1]
        good = (value > least) | (value == least) & (ids < self.found[n, -1])
        n, value, ids = n[good], value[good], ids[good]
        own = np.unique(n)
        held_n, held = np.repeat(own, self.k), self.best[own].ravel()
        there = held > -np.inf
        n = np.concatenate([n, held_n[there]])
        value, ids = np.concatenate([value, held[there]]), np.concatenate([ids, self.found[own].ravel()[there]])
        order = np.lexsort((ids, -value, n))
        n, value, ids = n[order], value[order], ids[order]
        place = np.arange(len(n)) - np.searchsorted(n, n)
        first = place < self.k
        self.best[n[first], place[first]], self.found[n[first], place[first]] = value[first], ids[first]


def _lower(k: int):
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        """The k largest lower bounds of each query in a slot."""
        held = [_Queries(r, k) for r in _rows(queries)]
        for row in _rows(blocks) if held else ():
            block = _Block(row)
            for q in held:
                score, radius = q.near(block)
                at, step = 0, HEAD
                while at < len(block.ids):  # a few rows first: they leave little of the others
                    part = slice(at, at + step)
                    # a bound that the rounding of the bar hides is not missed: the others hold without it
                    bar = (q.best[:, -1] + radius).astype(score.dtype)
                    n, found = q.others(score[:, part] > bar[:, None], block.ids[part])
                    q.keep(n, score[:, part][n, found] - radius[n], block.ids[part][found])
                    at, step = at + step, step * 8
        return _table(held, {"query_id": lambda q: np.repeat(q.ids, k), "low": lambda q: q.best.ravel()})

    return run


def _table(held: list[_Queries], columns: dict) -> pa.Table:
    """What the queries have found, a row for each."""
    at = [q.best.ravel() > -np.inf for q in held]
    return pa.table({c: np.concatenate([np.empty(0, "f8" if c == "low" else "i8"), *(of(q)[x] for q, x in zip(held, at))]) for c, of in columns.items()})


def _scored(q: _Queries, exact: np.ndarray, n: np.ndarray, row: np.ndarray, narrow: bool) -> np.ndarray:
    """Exact products of queries n and rows; where they are a good part of all, of all."""
    vectors = q.narrow if narrow else q.vectors
    if len(n) * DENSE > len(q.ids) * len(exact):
        return (vectors @ exact.T)[n, row].astype("f8")
    parts = [slice(at, at + GATHERED) for at in range(0, len(n), GATHERED)]
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", vectors[n[x]], exact[row[x]]) for x in parts)])


def _huge(q: _Queries, ids: np.ndarray, exact: np.ndarray, upper: np.ndarray) -> list[tuple[int, int, int]]:
    """The k best of a block for each query, by products too large for a double."""
    out = []
    for n in range(len(q.ids)):
        left = np.flatnonzero((ids != q.ids[n]) & (upper[n] >= max(q.floor[n], -1e308)))
        left = left[np.argsort(-upper[n][left], kind="stable")]
        got: list[tuple[int, int]] = []
        at, step = 0, HEAD
        while at < len(left) and not (len(got) == q.k and upper[n][left[at]] < -got[-1][0]):
            some = left[at : at + step]
            got += [(-sum(int(a) * int(b) for a, b in zip(exact[i], q.vectors[n])), int(ids[i])) for i in some]
            got = sorted(got)[: q.k]
            at, step = at + step, step * 2
        out += [(int(q.ids[n]), i, max(-(2**63), min(2**63 - 1, -s))) for s, i in got]
    return out


def _verified(k: int):
    def run(queries: pa.Table, blocks: pa.Table) -> pa.Table:
        """The k best rows of each query in a slot, as far as they reach its floor."""
        held, more = [_Queries(r, k) for r in _rows(queries)], []
        for row in _rows(blocks) if held else ():
            block, (ids, exact) = _Block(row), _exact(row)
            top, small = np.abs(exact).max(), exact.astype("f4")
            for q in held:
                score, radius = q.near(block)
                largest = top * np.abs(q.vectors).max() * row["dim"]
                if largest >= EXACT:
                    more += _huge(q, ids, exact, score + radius[:, None])
                    continue
                narrow = max(largest, top, np.abs(q.vectors).max()) < EXACT_NARROW
                rows = small if narrow else exact
                bar = np.maximum(q.floor, q.best[:, -1])
                n, found = q.reaching(score, bar - radius, ids)
                if not q.begun and len(n) * DENSE > score.size and len(ids) > HEAD:  # the largest upper bounds first: they leave little of the others
                    first = np.argpartition(-score, HEAD - 1, axis=1)[:, :HEAD]
                    bar = np.maximum(bar, _kth(q, rows, ids, first, narrow))
                    n, found = q.reaching(score, bar - radius, ids)
                value = _scored(q, rows, n, found, narrow)
                enough = value >= q.floor[n]
                q.keep(n[enough], value[enough], ids[found[enough]])
                q.begun = True
        best = _table(held, {"query_id": lambda q: np.repeat(q.ids, k), "vec_id": lambda q: q.found.ravel(), "score": lambda q: q.best.ravel()})
        extra = {c: np.array([x[i] for x in more], "i8") for i, c in enumerate(best.column_names)}
        return pa.table({c: np.concatenate([best.column(c).to_numpy().astype("i8"), extra[c]]) for c in best.column_names})

    return run


def _kth(q: _Queries, exact: np.ndarray, ids: np.ndarray, first: np.ndarray, narrow: bool) -> np.ndarray:
    """The k-th exact score of each query among its rows `first`, or -inf."""
    n = np.repeat(np.arange(len(q.ids)), first.shape[1])
    value = _scored(q, exact, n, first.ravel(), narrow).reshape(first.shape)
    value[ids[first] == q.ids[:, None]] = -np.inf
    return -np.sort(-value, axis=1)[:, q.k - 1] if first.shape[1] >= q.k else np.full(len(q.ids), -np.inf)


def search(vectors: DataFrame, is_query: Column, k: int, factor: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each query. `vectors` is from vectors_of()."""
    whole = scaled(vectors, factor)
    blocks, slots = build(whole)
    # a query id on several rows keeps one vector, the smallest
    queries = cut_lineage(whole.where(is_query).groupBy("id", "dim").agg(F.min("vector").alias("vector")))
    form = "ids binary, floor binary, kind string, exact binary"
    plain, groups = vb.dealt(cut_lineage(vb.packed(queries, vb.QUERY_ROWS, _query_block, form)), "group", vb.GROUP_VALUES)
    cells = blocks.select("dim", "slot", "ids", "cells", "low", "width")
    lows = vb.cogrouped(plain, groups, cells, slots, _lower(k), "query_id long, low double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low")))
    floors = lows.withColumn("_place", place).where(F.col("_place") == k).select(F.col("query_id").alias("id"), F.col("low").alias("floor"))
    # merged by a hint: what is written is taken for as large as its compressed files, and would be broadcast
    known = queries.join(floors.hint("merge"), "id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    sent = vb.packed(known.select("id", "dim", "vector", "floor"), vb.QUERY_ROWS, _query_block, form)
    sent = sent.withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)).cast("int"))
    rows = vb.cogrouped(sent, groups, blocks, slots, _verified(k), "query_id long, vec_id long, score long")
    return vb.best(rows, k).select("query_id", "rank", "vec_id", "score")
