"""Vector search against brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.llm import stable_projections, va_file, vector_blocks as vb
from brinewave.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, score double, `id` int, dim string"


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    out = [(i, (centres[i % 12] + 0.4 * rng.normal(size=24)).astype("f4").tolist(), 0.0, 1, "d") for i in range(900)]
    out += [(i, out[0][1], 0.0, 1, "d") for i in range(900, 1000)]  # ties
    odd = [None, [], [None] * 24, [float("nan")] * 24, [float("inf")] + [0.0] * 23, [0.0] * 24, [1.0, 2.0, 3.0], [1e30] + [0.0] * 23]
    return out + [(1000 + 20 * i, v, 0.0, 1, "d") for i, v in enumerate(odd)] + [(None, out[1][1], 0.0, 1, "d")]


def brute(rows, modulus: int, k: int, value, zero: bool) -> dict[int, list[tuple]]:
    kept = [(i, value(v)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    out = {}
    for i, v in kept:
        if i % modulus == 0:
            near = [(-sum(a * b for a, b in zip(v, w)), j) for j, w in kept if j != i and len(w) == len(v)]
            out[i] = [(j, -s) for s, j in sorted(near)[:k]]
    return {i: x for i, x in out.items() if x}


def test_va_file(spark, rows, monkeypatch):
    monkeypatch.setattr(vb, "BLOCK_ROWS", 150)
    monkeypatch.setattr(vb, "QUERY_ROWS", 7)
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = va_file.search(vb.vectors_of(table, "vec_id", "embedding"), F.col("id") % 50 == 0, 5).collect()
    want = brute(rows, 50, 5, lambda v: [int(np.floor(256 * np.float64(np.float32(x)))) for x in v], True)
    found: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    big = 2**63 - 1
    assert found == {i: [(j, max(-big - 1, min(big, s))) for j, s in x] for i, x in want.items()}
    none = spark.createDataFrame([], SCHEMA)
    assert va_file.search(vb.vectors_of(none, "vec_id", "embedding"), F.col("id") % 50 == 0, 5).count() == 0


def found_ranks(frame) -> dict[int, list]:
    found: dict[int, list] = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return found


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_copies_of_the_queries_are_not_broadcast(spark, rows, monkeypatch):
    """A query set below the broadcast limit is above it once it has been sent to all slots."""
    monkeypatch.setattr(vb, "BLOCK_ROWS", 50)
    good = [r for r in rows if not (r[1] and r[1][0] == 1e30)]
    vectors = vb.vectors_of(spark.createDataFrame(good, SCHEMA).repartition(4), "vec_id", "embedding", nonzero=True)
    for found in (va_file.search(vectors, F.col("id") % 50 == 0, 5), stable_projections.search(vectors, F.col("id") % 20 == 0, 20)):
        assert found.collect() and "isFinalPlan=true" in plan(found) and "Broadcast" not in plan(found)


def test_slots_hold_more_blocks_where_there_are_many(spark, monkeypatch):
    monkeypatch.setattr(vb, "FEW_SLOTS", 4)
    monkeypatch.setattr(vb, "SLOT_VALUES", 64 * 8)
    blocks = spark.range(100).selectExpr("64 AS dim", "id AS block", "cast(repeat('12345678', 2) AS binary) AS ids")  # two vectors each
    for n, slots in ((0, 1), (3, 3), (16, 4), (100, 25)):
        table, found = vb.with_slots(blocks.where(F.col("block") < n))
        assert found == slots and table.count() == n
        assert {r.slot for r in table.collect()} <= set(range(slots))


@pytest.mark.parametrize("scale", [1.0, 1e4, 3e5])
def test_va_file_over_groups_and_slots(spark, monkeypatch, scale):
    """Products that are exact in floats, in doubles and in neither; vectors of two lengths, copies, repeated ids, too few rows."""
    for name, value in (("BLOCK_ROWS", 40), ("QUERY_ROWS", 3), ("FEW_SLOTS", 2), ("SLOT_VALUES", 100 * 16), ("GROUP_VALUES", 4 * 16)):
        monkeypatch.setattr(vb, name, value)
    rng = np.random.default_rng(4)
    made = [(i, (scale * rng.normal(size=16 if i % 3 else 5)).tolist()) for i in range(600)]
    made += [(i, made[4][1]) for i in range(600, 700)] + [(1, made[7][1]), (2, made[4][1])] + [(1000, [scale] * 3), (1050, [-scale] * 3)]
    table = spark.createDataFrame(made, "vec_id long, embedding array<double>").repartition(5)
    got = found_ranks(va_file.search(vb.vectors_of(table, "vec_id", "embedding"), F.col("id") % 25 == 0, 5))
    assert got == brute(made, 25, 5, lambda v: [int(np.floor(256 * x)) for x in v], True)


def test_stable_projections(spark, rows):
    rows = [r for r in rows if not (r[1] and r[1][0] == 1e30)]
    table = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = stable_projections.search(vb.vectors_of(table, "vec_id", "embedding", nonzero=True), F.col("id") % 20 == 0, 20).collect()
    want = brute(rows, 20, 20, lambda v: [float(np.float32(x)) for x in v], False)
    vectors = {r[0]: np.array(r[1], "f8") for r in rows if r[1] and None not in r[1]}
    found: dict[int, set] = {}
    for r in got:
        found.setdefault(r.query_id, set()).add(r.vec_id)
        assert r.score == pytest.approx(float(vectors[r.query_id] @ vectors[r.vec_id]), rel=1e-12)
    assert found.keys() == want.keys()
    hits = sum(len(found[i] & {j for j, _ in x}) for i, x in want.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    none = spark.createDataFrame([], SCHEMA)
    assert stable_projections.search(vb.vectors_of(none, "vec_id", "embedding"), F.col("id") % 20 == 0, 5).count() == 0


@pytest.mark.parametrize("spread,most", [(0.05, 0.25), (0.3, 0.4)])
def test_few_rows_are_verified_over_several_blocks(spark, monkeypatch, spread, most):
    """Clusters: of all rows a small share is scored for a query, and nine of ten neighbours are found."""
    monkeypatch.setattr(vb, "BLOCK_ROWS", 500)
    monkeypatch.setattr(vb, "QUERY_ROWS", 50)
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32)) / 32**0.5
    rows = centres[rng.integers(0, 40, 6000)] + spread * rng.standard_normal((6000, 32)) / 32**0.5
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rows)], "vec_id long, embedding array<double>").repartition(5)
    vectors = vb.vectors_of(table, "vec_id", "embedding", nonzero=True)
    found = stable_projections.found_rows(vectors, F.col("id") % 20 == 0, 20).collect()
    share = sum(r.seen for r in found if r.seen >= 0) / (300 * 6000)
    best: dict[int, list] = {}
    for r in found:
        if r.seen < 0:
            best.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    hits = 0
    for i in range(0, 6000, 20):
        scores = rows @ rows[i]
        scores[i] = -np.inf
        hits += len({j for _, j in sorted(best[i])[:20]} & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    assert hits >= 0.9 * 300 * 20 and share < most, (hits / 6000, share)


def test_cells_of_the_top_tree():
    rng = np.random.default_rng(1)
    points = rng.standard_normal((4096, 3))
    sizes = np.bincount(stable_projections.Top(points, 4).cell(points), minlength=16)
    assert len(sizes) == 16 and sizes.min() == sizes.max() == 256
    assert stable_projections.Top(points[:0], 2).cell(points).shape == (4096,)


def test_chi_square_quantile():
    rng = np.random.default_rng(2)
    sample = (rng.standard_normal((200_000, 10)) ** 2).sum(axis=1)
    assert (sample < stable_projections.chi_square_quantile(0.96, 10)).mean() == pytest.approx(0.96, abs=0.003)


def test_sql(spark):
    from oracle import compare, connect

    class Entry:
        pass

    for name, sql in SQL.items():
        entry = Entry()
        entry.run, entry.sql = QUERIES[name], sql
        assert compare(spark, connect("/root/testdata/sf0.001"), "/root/testdata/sf0.001", entry) == ""
