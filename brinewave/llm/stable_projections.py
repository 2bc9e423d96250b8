"""Approximate nearest neighbours: stable projections in kd-trees, verified until a chi-square test stops.

Largest inner product becomes smallest distance by one more component,
sqrt(M^2 - |x|^2) for rows (M: the largest norm) and 0 for queries. A Gaussian projection to
`m` dimensions makes squared projected distance over squared distance chi-square with m
degrees of freedom. Rows are dealt to blocks by a kd-tree over the projections of SAMPLE rows, so that a block holds rows that
project near each other, and each block has a kd-tree of its own. A query takes the leaves whose
boxes are near enough, and scores their rows exactly in the order of their projected distance; it stops where
a closer row than the k-th found would project there with probability 1 - p at
most. So a neighbour is missed with probability 1 - p at most. The k-th score is known before the first block: that
among the sampled rows, which travels with the query.

The norm M is that of all rows, every row is indexed, and the sample (its SAMPLE smallest hashes of ids) bounds what goes through the
driver. Vectors that are null, empty, zero, or hold
null or non-finite components take no part, nor do rows without an id; vectors of
different lengths never meet. A row with the query's id is the query's own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from brinewave.llm import vector_blocks as vb

DIMENSIONS = 10
CONFIDENCE = 0.92
LEAF = 64
VERIFIED = 256  # rows scored between two tests
SAMPLE = 4096
DEEPEST = 10  # halvings that the sample is good for
#: Share by which a stored projection (four bytes a component) may be off.
ROUNDING = 1e-5


def chi_square_quantile(p: float, m: int) -> float:
    """The p-quantile of chi-square with an even number m of degrees of freedom, by bisection."""
    below = lambda x: 1 - math.exp(-x / 2) * sum((x / 2) ** j / math.factorial(j) for j in range(m // 2))
    low, high = 0.0, 100.0 * m
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) < p else (low, mid)
    return high


def projection(dim: int, m: int, seed: int) -> np.ndarray:
    """Gaussian, but that the added component's row has just its expected length: it is a part of every difference, so that
    a long one would hide all neighbours at once."""
    drawn = np.random.default_rng([seed, dim]).standard_normal((dim + 1, m))
    drawn[-1] *= (m / (drawn[-1] @ drawn[-1])) ** 0.5
    return drawn


def kd_order(points: np.ndarray, leaf: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of the points and the bounds of leaves in it: halved at the median of the widest dimension."""
    order, starts, todo = np.arange(len(points)), [], [(0, len(points))]
    while todo:
        a, b = todo.pop()
        if b - a <= leaf:
            starts.append(a)
            continue
        own = order[a:b]
        wide = np.argmax(np.ptp(points[own], axis=0))
        half = (b - a) // 2
        order[a:b] = own[np.argpartition(points[own, wide], half)]
        todo += [(a + half, b), (a, a + half)]
    return order, np.array(sorted(starts) + [len(points)])


class Top:
    """A kd-tree over sampled projections that tells rows which cell they are in."""

    def __init__(self, points: np.ndarray, depth: int):
        self.splits: list[tuple[int, float]] = []
        cells = [points]
        for _ in range(depth):
            halves = []
            for own in cells:
                wide = int(np.argmax(np.ptp(own, axis=0))) if len(own) else 0
                at = float(np.median(own[:, wide])) if len(own) else 0.0
                self.splits.append((wide, at))
                halves += [own[own[:, wide] < at], own[own[:, wide] >= at]]
            cells = halves

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), "i8")
        if not self.splits:
            return node
        wide, at = (np.array(x) for x in zip(*self.splits))
        for _ in range(len(self.splits).bit_length()):
            node = 2 * node + 1 + (points[np.arange(len(points)), wide[node]] >= at[node])
        return node - len(self.splits)


def _lifted(vecs: np.ndarray, norm2: float) -> np.ndarray:
    return np.column_stack([vecs, np.sqrt(np.maximum(0, norm2 - (vecs * vecs).sum(axis=1)))])


def _dealt(tops: dict[int, Top], m: int, seed: int, norm2: float):
    """Rows with the cell they are in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype("f8").reshape(-1, dim)
                cells = tops[dim].cell(_lifted(flat, norm2) @ projection(dim, m, seed)) if dim in tops else np.zeros(len(flat), "i8")
                yield part.append_column("cell", pa.array(cells))

    return run


def _indexed(m: int, seed: int, norm2: float):
    def pack(ids: np.ndarray, vecs: np.ndarray, *_) -> dict:
        points = _lifted(vecs, norm2) @ projection(vecs.shape[1], m, seed)
        order, starts = kd_order(points, LEAF)
        points = points[order].astype("<f4").astype("f8")
        low, high = (f.reduceat(points, starts[:-1], axis=0) for f in (np.minimum, np.maximum))
        narrow = vecs.astype("<f4")
        kind = "<f4" if np.array_equal(narrow, vecs) else "<f8"
        return {
            "ids": ids[order].astype("<i8").tobytes(), "kind": kind, "data": vecs[order].astype(kind).tobytes(), "points": points.astype("<f4").tobytes(),
            "starts": starts.astype("<i4").tobytes(), "low": low.astype("<f8").tobytes(), "high": high.astype("<f8").tobytes(),
        }

    return pack


def _queries(k: int, sample: dict[int, tuple[np.ndarray, np.ndarray]]):
    """A block of queries, each with the k-th score among the sampled rows but its own."""

    def pack(ids: np.ndarray, vecs: np.ndarray, *_) -> dict:
        floor = np.full(len(ids), -np.inf)
        known, rows = sample.get(vecs.shape[1], (np.empty(0, "i8"), None))
        if len(known) > k:
            scores = np.where(known == ids[:, None], -np.inf, vecs @ rows.T)
            floor = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        return {"ids": ids.astype("<i8").tobytes(), "data": vecs.astype("<f8").tobytes(), "floor": floor.astype("<f8").tobytes()}

    return pack


def _searched(k: int, m: int, seed: int, norm2: float, p: float):
    limit = chi_square_quantile(p, m) * (1 + ROUNDING)

    def one(row: dict, q: np.ndarray, qid: int, floor: float, point: np.ndarray, block: tuple) -> tuple[np.ndarray, np.ndarray, int]:
        """Ids and scores of the best rows of a block, and how many were scored."""
        ids, vecs, points, starts, low, high = block
        q2, seen, scores, got = q @ q, 0, np.empty(0), np.empty(0, "i8")

        def reach() -> float:
            least = max(floor, scores[-1]) if len(scores) == k else floor
            return limit * max(0.0, norm2 + q2 - 2 * least) if least > -np.inf else np.inf

        gap = np.maximum(0, np.maximum(low - point, point - high))
        near = np.flatnonzero((gap * gap).sum(axis=1) <= reach())
        if not len(near):
            return got, scores, seen
        where = np.concatenate([np.arange(starts[x], starts[x + 1]) for x in near])
        away = points[where] - point
        away = (away * away).sum(axis=1)
        kept = np.flatnonzero((away <= reach()) & (ids[where] != qid))
        kept = kept[np.argsort(away[kept], kind="stable")]
        where, away = where[kept], away[kept]
        for at in range(0, len(where), VERIFIED):  # the nearest projections first, until no closer row is likely
            if away[at] > reach():
                break
            some = where[at : at + VERIFIED]
            seen += len(some)
            scores, got = np.concatenate([scores, vecs[some] @ q]), np.concatenate([got, ids[some]])
            keep = vb.top_rows(scores, got, k)
            scores, got = scores[keep], got[keep]
        return got, scores, seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                qid, q = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_data"], "<f8").reshape(-1, dim)
                floors, seen_at = np.frombuffer(row["q_floor"], "<f8"), q @ projection(dim, m, seed)[:-1]
                ids, vecs = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], row["kind"]).reshape(-1, dim).astype("f8")
                points, low, high = np.frombuffer(row["points"], "<f4").reshape(-1, m).astype("f8"), *(np.frombuffer(row[c], "<f8").reshape(-1, m) for c in ("low", "high"))
                block = (ids, vecs, points, np.frombuffer(row["starts"], "<i4"), low, high)
                out = []
                for n in range(len(qid)):
                    got, scores, seen = one(row, q[n], qid[n], floors[n], seen_at[n], block)
                    # a first row without a neighbour tells how many rows were scored
                    out.append((np.full(len(got) + 1, qid[n]), np.concatenate([[0], got]), np.concatenate([[0.0], scores]), np.concatenate([[seen], np.full(len(got), -1)])))
                a, b, c, d = (np.concatenate(x) for x in zip(*out))
                yield pa.record_batch({"query_id": a, "vec_id": pa.array(b, pa.int64()), "score": c, "seen": pa.array(d, pa.int64())})

    return run


def found_rows(vectors: DataFrame, is_query: Column, k: int, m: int = DIMENSIONS, p: float = CONFIDENCE, seed: int = 11) -> DataFrame:
    """query_id, vec_id, score, seen: what each block gives for each query (seen is -1), and a row with the number it has scored."""
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    norm2, rows = vectors.select(F.max(squares), F.count(F.lit(1))).first()
    norm2 = (norm2 or 0.0) * (1 + 1e-12)
    drawn: dict[int, list] = {}
    for r in vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect():
        drawn.setdefault(r.dim, []).append((r.id, r.vector))
    sample = {d: (np.array([i for i, _ in x], "i8"), np.array([v for _, v in x], "f8")) for d, x in drawn.items()}
    depth = min((rows // vb.BLOCK_ROWS).bit_length(), DEEPEST)
    tops = {d: Top(_lifted(v, norm2) @ projection(d, m, seed), depth) for d, (_, v) in sample.items()}
    kind = vectors.schema["vector"].dataType.simpleString()
    cells = vectors.select("id", "dim", "vector").mapInArrow(_dealt(tops, m, seed, norm2), f"id long, dim int, vector {kind}, cell long")
    near = cells.repartition("dim", "cell").sortWithinPartitions("dim", "cell").drop("cell")
    form = "ids binary, kind string, data binary, points binary, starts binary, low binary, high binary"
    blocks, slots = vb.with_slots(vb.packed(near, vb.BLOCK_ROWS, _indexed(m, seed, norm2), form))
    queries = vectors.where(is_query).groupBy("id", "dim").agg(F.min("vector").alias("vector"))
    sent = vb.packed(queries, vb.QUERY_ROWS, _queries(k, sample), "ids binary, data binary, floor binary")
    return vb.met(sent.drop("block"), blocks.drop("block"), slots).mapInArrow(_searched(k, m, seed, norm2, p), "query_id long, vec_id long, score double, seen long")


def search(
    vectors: DataFrame, is_query: Column, k: int, m: int = DIMENSIONS, p: float = CONFIDENCE, seed: int = 11
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows found for each query. `vectors` is from vectors_of()."""
    found = found_rows(vectors, is_query, k, m, p, seed).where("seen < 0")
    return vb.best(found, k).select("query_id", "rank", "vec_id", "score")
