"""Trains, sessions, densities and intervals against direct renderings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.functions.density import density_at, gaussian_kernel
from brinewave.operators import attitude, intervals, segments, sessions, tiles, trains

SCHEMA = "recording_id long, det_id long, idx long, peak double"


def clicks(seed, recordings=12, hot=600, span=20_000):
    """Recordings of very different size: the first holds most of the rows."""
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for rec in range(recordings):
        size = hot if rec == 0 else int(rng.integers(1, 40))
        places = rng.integers(1, span, size)
        bursts = [p + rng.integers(0, 60, 6) for p in rng.integers(1, span, max(size // 20, 1))]
        for p in np.sort(np.concatenate([places, *bursts])):
            rows.append((rec, n, int(p), float(rng.random())))
            n += 1
    return rows


def direct_trains(rows, min_len, interval, n_samples):
    out = []
    for rec in sorted({r[0] for r in rows}):
        part = sorted((r[2], r[1], r[3]) for r in rows if r[0] == rec)
        idx = [p[0] for p in part]
        member = [False] * len(idx)
        for j in range(len(idx) - min_len):
            if idx[j + min_len] - idx[j] < interval:
                for k in range(j, j + min_len + 1):
                    member[k] = True
        i = 0
        while i < len(idx):
            if not member[i]:
                i += 1
                continue
            j = i
            while j < len(idx) and member[j]:
                j += 1
            end = idx[j] if j < len(idx) else n_samples
            out.append((rec, idx[i], end, idx[j - 1], j - i, max(p[2] for p in part[i:j])))
            i = j
    return sorted(out)


@pytest.mark.parametrize("tile", [150, 1000, 50_000])
@pytest.mark.parametrize("seed", [1, 2])
def test_trains_do_not_depend_on_tiles(spark, seed, tile):
    rows = clicks(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    got = trains.click_trains(df, 3, 120, tile, 99_999).select(
        "recording_id", "start_idx", "end_idx", "last_member_idx", "n_dets", "level"
    )
    assert sorted(tuple(r) for r in got.collect()) == direct_trains(rows, 3, 120, 99_999)


def test_one_train_over_many_tiles(spark):
    rows = [(7, i, 10 * i + 1, 1.0) for i in range(400)]
    got = trains.click_trains(spark.createDataFrame(rows, SCHEMA), 5, 100, 200, 5000).collect()
    assert [(r.start_idx, r.end_idx, r.n_dets) for r in got] == [(1, 5000, 400)]


@pytest.mark.parametrize("tile", [97, 2000])
def test_gap_sessions(spark, tile):
    rows = clicks(3)
    got = sessions.gap_sessions(spark.createDataFrame(rows, SCHEMA), 40, tile)
    want = []
    for rec in {r[0] for r in rows}:
        idx = sorted(r[2] for r in rows if r[0] == rec)
        start, last, n = idx[0], idx[0], 1
        for p in idx[1:]:
            if p - last <= 40:
                last, n = p, n + 1
            else:
                want.append((rec, start, last, n))
                start, last, n = p, p, 1
        want.append((rec, start, last, n))
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("tile", [500, 3000, 40_000])
def test_density_segments(spark, tile):
    rng = np.random.default_rng(5)
    n, length = 40_000, 1200
    places = np.sort(np.concatenate([rng.integers(1, n, 25), 12_000 + rng.integers(0, 3000, 60)]))
    df = spark.createDataFrame([(1, i, int(p), 1.0) for i, p in enumerate(places)], SCHEMA)
    got = sessions.density_segments(df, n, tile, length, 0.1)
    p = density_at(np.unique(places), 1, n - length, gaussian_kernel(length, 0.1))
    want, start = [], None
    for j, v in enumerate(p, start=1):
        if start is None and v > sessions.OPEN_ABOVE:
            start = j
        elif start is not None and v < sessions.CLOSE_BELOW:
            want.append((1, start, j))
            start = None
    if start is not None:
        want.append((1, start, n))
    assert sorted(tuple(r) for r in got.collect()) == want


def test_density_is_the_centred_part_of_a_convolution():
    n, length = 900, 100
    places = np.array([3, 200, 210, 640, 890])
    clicks_at = np.zeros(n)
    clicks_at[places - 1] = 1
    kernel = gaussian_kernel(length, 0.2)
    full = np.convolve(clicks_at, kernel)
    want = full[np.arange(length + 1, n + 1) - length // 2 - 1]
    assert np.allclose(density_at(places, 1, n - length, kernel), want)


def test_interval_modes_count_every_pair(spark):
    rng = np.random.default_rng(8)
    rows = [(int(r), i, int(p), 1.0) for i, (r, p) in enumerate(zip(rng.integers(0, 3, 900), rng.integers(1, 5000, 900)))]
    slot, width, limit = 1000, 50, 800
    got = {
        (r.recording_id, r.slot): (r.mode, r.weight)
        for r in intervals.slot_interval_modes(spark.createDataFrame(rows, SCHEMA), slot, 1, width, limit).collect()
    }
    for (rec, s), found in got.items():
        t = np.array([r[2] - 1 for r in rows if r[0] == rec])
        t = t[(t > s * slot) & (t < (s + 1) * slot)]
        d = (t[:, None] - t[None, :]).ravel()
        hist, edges = np.histogram(d[(d > 0) & (d < limit)], bins=np.arange(0, limit + 1, width))
        assert found == ((int(edges[hist.argmax()]), int(hist.max())) if hist.max() else (0, 0))
    assert len(got) > 10


def test_numbers_and_totals_over_tiles(spark):
    rows = clicks(9)
    df = spark.createDataFrame(rows, SCHEMA)
    got = tiles.number_rows(df, ["recording_id"], "idx", ["det_id"], 333, "n").collect()
    for rec in {r[0] for r in rows}:
        mine = sorted((r.idx, r.det_id, r.n) for r in got if r.recording_id == rec)
        assert [m[2] for m in mine] == list(range(1, len(mine) + 1))


def test_next_log_value_far_away(spark):
    dets = spark.createDataFrame([(1, 1, 5, 0.0), (1, 2, 950, 0.0), (1, 3, 20_000, 0.0), (2, 4, 7, 0.0)], SCHEMA)
    log = spark.createDataFrame([(1, 950, 1.5), (1, 9000, 2.5), (2, 6, 9.0)], "recording_id long, idx long, yaw double")
    got = attitude.next_log_value(dets, log, "yaw", 100).select("det_id", "yaw", "log_idx")
    assert sorted(tuple(r) for r in got.collect()) == [(1, 1.5, 950), (2, 1.5, 950), (3, None, None), (4, None, None)]


@pytest.mark.parametrize("tile", [60, 3000])
def test_rows_in_segments(spark, tile):
    rows = clicks(12)
    df = spark.createDataFrame(rows, SCHEMA)
    spans = trains.click_trains(df, 3, 120, 1000, 99_999)
    got = segments.rows_in_segments(df, spans, "last_member_idx", tile)
    want = [
        (r[0], r[1], s.start_idx)
        for s in spans.collect()
        for r in rows
        if r[0] == s.recording_id and s.start_idx <= r[2] <= s.last_member_idx
    ]
    assert sorted(tuple(r) for r in got.select("recording_id", "det_id", "start_idx").collect()) == sorted(want)


def test_width_follows_the_densest_recording(spark):
    df = spark.range(40_000).select((F.col("id") % 4 == 0).cast("int").alias("recording_id"), F.col("id").alias("idx"))
    width = tiles.fitting_width(df, ["recording_id"], "idx", 10**6, rows=1000)
    counted = df.groupBy("recording_id", tiles.tile_of(F.col("idx"), width)).count()
    assert counted.agg(F.max("count")).first()[0] <= 2000 and width >= 500
    assert tiles.fitting_width(df, ["recording_id"], "idx", 10**6) == 10**6
