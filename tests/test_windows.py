"""Windows without moving samples, one pass of the detector, settling lengths, correlation over blocks, recordings of many kinds."""

import contextlib
import io
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.functions import kernels
from brinewave.operators import blocks as blk, filters, groups, impulses, order_statistics as order, recordings, tdoa, windows
from brinewave.sources import devices, pcm
from test_signals import block_rows, clicks3, whole


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


def exchanged(df) -> list[str]:
    """The columns that each exchange of a plan moves."""
    return re.findall(r"^\(\d+\) (?:Broadcast)?Exchange\n(?:Input \[\d+\]: \[(.*)\]\n)", plan(df), re.M)


@pytest.fixture
def no_broadcast(spark, monkeypatch):
    monkeypatch.setattr(groups, "BROADCAST_ROWS", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def four():
    rng = np.random.default_rng(5)
    return {(rec, c): rng.normal(size=n) for rec, n in ((1, 30_000), (2, 9_500)) for c in (1, 2, 3, 4)}


def windows_of(signals, spans):
    """{(recording, det_id): [(channel, first_idx, samples)]} cut from whole recordings."""
    out = {}
    for rec, det, first, last in spans:
        n = len(signals[(rec, 1)])
        lo, hi = max(first, 1), min(last, n)
        if hi >= lo:
            out[(rec, det)] = [(c, lo, signals[(rec, c)][lo - 1 : hi]) for c in (1, 2, 3, 4)]
    return out


def same(got, want):
    found = {(r.recording_id, r.det_id): r for r in got}
    assert found.keys() == want.keys() and len(got) == len(want)
    for key, channels in want.items():
        assert [(c.channel, c.first_idx) for c in found[key].channels] == [(c, lo) for c, lo, _ in channels]
        assert all(np.array_equal(c.samples, x) for c, (_, _, x) in zip(found[key].channels, channels))


SPANS = "recording_id long, det_id long, idx long, first_idx long, last_idx long"


def some_spans(rng, n, longest):
    return [(rec, i, int(at), int(at) - 20, int(at) - 20 + int(rng.integers(1, longest))) for i, (rec, at) in enumerate(zip(rng.integers(1, 3, n).tolist(), rng.integers(-10, 31_000, n)))]


def test_dealt_spans_are_cut_as_joined_ones(spark, four, no_broadcast):
    rng = np.random.default_rng(1)
    spans = some_spans(rng, 800, 2500)
    cut = windows.cut_spans(block_rows(spark, four, 1000, 0), spark.createDataFrame(spans, SPANS), 1000)
    assert not [c for c in exchanged(cut) if "samples" in c]
    same(cut.collect(), windows_of(four, [(r, d, a, b) for r, d, _, a, b in spans]))


@pytest.mark.parametrize("block_len", [500, 1000, 40_000])
def test_windows_of_all_channels_are_cut_whole(spark, four, block_len):
    rng = np.random.default_rng(2)
    spans = some_spans(rng, 500, 280)
    wide = blk.wide(block_rows(spark, four, block_len, 300))
    cut = windows.cut_wide(wide, spark.createDataFrame(spans, SPANS), block_len, 300)
    same(cut.collect(), windows_of(four, [(r, d, a, b) for r, d, _, a, b in spans]))
    clipped = {(r.recording_id, r.det_id) for r in cut.where("clipped").collect()}
    assert clipped == {(r, d) for r, d, _, a, b in spans if (r, d) in windows_of(four, [(r, d, a, b)]) and (a < 1 or b > len(four[(r, 1)]))}


def test_windows_beyond_the_halo_fail(spark, four):
    wide = blk.wide(block_rows(spark, four, 1000, 100))
    long = spark.createDataFrame([(1, 1, 500, 500, 1101)], SPANS)
    assert windows.cut_wide(wide, spark.createDataFrame([(1, 1, 500, 500, 1100)], SPANS), 1000, 100).count() == 1
    with pytest.raises(Exception, match="reaches beyond a halo of 100"):
        windows.cut_wide(wide, long, 1000, 100).collect()


def test_three_hundred_thousand_windows(spark, four, tmp_path):
    """More spans than are broadcast: none of the plan's exchanges moves samples, and every window is right."""
    n = 300_000
    path = str(tmp_path / "wide")
    blk.wide(block_rows(spark, four, 1000, 50)).write.parquet(path)
    spans = spark.range(n).select(
        (F.col("id") % 2 + 1).alias("recording_id"), F.col("id").alias("det_id"), (F.col("id") * 7919 % 9000 + 10).alias("idx"),
    )
    spans = spans.select("*", (F.col("idx") - 5).alias("first_idx"), (F.col("idx") + 4).alias("last_idx"))
    cut = windows.cut_wide(spark.read.parquet(path), spans, 1000, 50)
    assert exchanged(cut) == []
    value = F.aggregate(F.flatten("channels.samples"), F.lit(0.0), lambda a, v: a + v)
    got = dict(cut.select("det_id", value.alias("v")).collect())
    assert len(got) == n
    for rec in (1, 2):
        total = np.cumsum(np.concatenate([[0], sum(four[(rec, c)] for c in (1, 2, 3, 4))]))
        ids = np.arange(rec - 1, n, 2)
        at = ids * 7919 % 9000 + 10
        assert np.allclose([got[i] for i in ids.tolist()], total[at + 4] - total[at - 6])


def test_narrow_and_wide_are_the_same(spark, four):
    ready = block_rows(spark, four, 1000, 70)
    back = blk.narrow(blk.wide(ready)).select(ready.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ready.collect()))


def test_detection_brings_its_windows(spark):
    signals, at = clicks3(n=30_000)
    halo = 3000
    narrow = block_rows(spark, signals, 7000, halo)
    wide = blk.wide(narrow)
    found = impulses.detected_windows(wide, 500_000.0, (5000, 180_000), -130, 130, halo, 0.2, 3, 200)
    assert not [c for c in exchanged(found) if "channels" in c and "collect_list" not in c and "samples" not in c]
    dets = impulses.detect_impulses(narrow, 500_000.0, (5000, 180_000), 3, 200, 0.2)
    kept = ["recording_id", "kind", "det_id", "idx", "t_s", "peak", "threshold"]
    assert sorted(map(tuple, found.select(kept).collect())) == sorted(map(tuple, dets.select(kept).collect()))
    assert found.count() == len(at)
    cut = windows.cut_windows(narrow, dets, -130, 130, 7000)
    pick = ["recording_id", "det_id", "idx", "clipped", "channels"]
    assert sorted(map(repr, found.select(pick).collect())) == sorted(map(repr, cut.select(pick).collect()))


def test_raw_samples_are_filtered_once(spark):
    signals, at = clicks3(n=30_000)
    b = block_rows(spark, signals, 7000, 3000)
    found = impulses.searched(b, 500_000.0, (5000, 180_000), 3, 200, keep=True)
    assert plan(found).count("ArrowEvalPython\n") == 1
    done = impulses.detect_impulses(b, 500_000.0, (5000, 180_000), 3, 200, None, 9.0)
    assert "left_halo" not in plan(done)  # what is left to do reads the written table, not the samples
    assert done.count() == len(at)


@pytest.mark.parametrize("offset,spread", [(1e6, 1e-3), (-1e12, 1e-2), (0.0, 1e-300), (0.0, 1.0)])
def test_quantiles_far_from_zero(spark, monkeypatch, offset, spread):
    """Every pass has at most 65,536 buckets, however close together the values lie."""
    rng = np.random.default_rng(8)
    values = offset + spread * rng.normal(size=20_000)
    monkeypatch.setattr(order, "FEW", 50)
    widths = []
    real = order._holding
    monkeypatch.setattr(order, "_holding", lambda counts, *a: (widths.append(counts.count()), real(counts, *a))[1])
    b = spark.createDataFrame([(1, c.tolist()) for c in np.array_split(values, 9)], "g int, a array<double>")
    got = order.block_quantile(b, ["g"], "a", 0.75, "v").first().v
    assert got == pytest.approx(np.quantile(values, 0.75), rel=1e-15, abs=0)
    rows = spark.createDataFrame([(1, float(v)) for v in values], "g int, x double")
    assert order.exact_quantile(rows, ["g"], "x", 0.75, "v").first().v == got
    assert max(widths) <= 1 << 16 and len(widths) > 4


def test_patterns_sort_as_doubles(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=500) * 10.0 ** rng.integers(-320, 308, 500), 2.0 ** np.arange(-1074, 1024), -(2.0 ** np.arange(-1074, 1024)), np.nextafter(2.0 ** np.arange(-1000, 1000), 0)])
    x = np.concatenate([x, [0.0, -0.0, np.inf, -np.inf, np.nan, np.finfo(float).max, 5e-324]])
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select("x", order.pattern(F.col("x")).alias("p")).collect()
    native = np.array([r.p for r in df])
    assert np.array_equal(native, order.patterns(np.array([r.x for r in df])))
    rank = np.argsort(native[~np.isnan(x)], kind="stable")
    assert (np.diff(x[~np.isnan(x)][rank]) >= 0).all()


# ---- settling


@pytest.mark.parametrize("block_len", [100, 1024, 7777])
@pytest.mark.parametrize("band,stops", [((50.0, 200.0), []), ((30.0, np.inf), [(90.0, 110.0)]), ((0.0, 40.0), [])])
def test_blocks_of_any_length_filter_alike(spark, block_len, band, stops):
    x = np.random.default_rng(2).normal(size=8000)
    need = kernels.settling_length(1000.0, band, stops)
    got = whole(filters.filter_blocks(block_rows(spark, {(1, 1): x}, block_len, need), 1000.0, band, stops))[(1, 1)]
    assert np.abs(got - kernels.zero_phase(x, 1000.0, band, stops)).max() < 1e-5


def test_a_halo_below_the_settling_length_fails(spark):
    x = np.random.default_rng(2).normal(size=4000)
    band = (50.0, 60.0)
    need = kernels.settling_length(1000.0, band)
    assert need > 400
    short = block_rows(spark, {(1, 1): x}, 1000, need - 1)
    for job in (
        filters.filter_blocks(short, 1000.0, band), filters.filter_blocks(short, 1000.0, band, envelope=True),
        filters.envelope_lowpassed(short, 1000.0, 40.0, band), impulses.detect_impulses(short, 1000.0, band, 1, 20, 0.5),
    ):
        with pytest.raises(Exception, match="needs a halo of"):
            job.collect()
    assert filters.filter_blocks(block_rows(spark, {(1, 1): x}, 1000, need), 1000.0, band).count() == 4
    with pytest.raises(Exception, match=f"needs a halo of {need + 20}"):
        impulses.detect_impulses(block_rows(spark, {(1, 1): x}, 1000, need + 19), 1000.0, band, 1, 20, 0.5).collect()


def test_settling_lengths_follow_the_poles():
    for fs, band, stops in ((500_000.0, (5000, 180_000), ()), (1000.0, (30, np.inf), [(90, 110)]), (1000.0, (0, 40), ()), (64.0, (5, 15), ())):
        n = 1 << 18
        response = np.abs(np.fft.irfft(kernels.band_gain(np.fft.rfftfreq(n, 1 / fs), fs, band, stops, 4), n))[: n // 2]
        assert response[kernels.settling_length(fs, band, stops) :].sum() < 1e-6 * response.sum()
    assert kernels.settling_length(1000.0, (0, np.inf)) == 0


# ---- correlation over blocks


@pytest.mark.parametrize("block_len", [700, 5000])
def test_segments_of_any_length(spark, block_len):
    rng = np.random.default_rng(7)
    base, lags = rng.normal(size=20_000), {1: 3, 2: -11, 3: 0, 4: 20}
    signals = {(1, c): np.roll(base, lag) + rng.normal(size=20_000) * 0.1 for c, lag in lags.items()}
    segments = [(1, 50, 60), (1, 400, 900), (1, 1000, 19_990), (1, 1, 20_000)]
    wide = blk.wide(block_rows(spark, signals, block_len, 40))
    got = tdoa.segment_delays(wide, spark.createDataFrame(segments, "recording_id long, start_idx long, end_idx long"), block_len, 3, 30)
    assert not [c for c in exchanged(got) if "channels" in c]
    found = {r.det_id: r.delays for r in got.collect()}
    for _, a, b in segments:
        cut = [signals[(1, c)][a - 1 : b] for c in (1, 2, 3, 4)]
        want = []
        for x in cut:
            c = np.abs(kernels.correlate(x, cut[2])).round(9)
            lag = np.arange(len(c)) - (len(x) - 1)
            near = np.abs(lag) <= 30
            want.append(int(max(zip(c[near], -np.abs(lag[near]), lag[near]))[2]))
        assert found[a] == [0 if i == 2 else w for i, w in enumerate(want)]
    assert found[1000] == [3, -11, 0, 20]
    with pytest.raises(Exception, match="needs a halo of 50"):
        tdoa.segment_delays(wide, spark.createDataFrame(segments, "recording_id long, start_idx long, end_idx long"), block_len, 3, 50).collect()


# ---- recordings of several kinds, from PCM files


def test_frame_lengths():
    assert [kernels.frame_length(0.01, fs) for fs in (500_000.0, 96_000.0, 44_100.0, 48_000.0)] == [5000, 960, 441, 480]
    assert [kernels.frame_length(1.0, n) for n in (11, 13, 121, 1030)] == [12, 14, 125, 1050]


def test_rates_lengths_and_clocks_of_their_own(spark, tmp_path):
    """Two rates, two arrays and a silent recording in one call; each as it comes out alone."""
    fast, at = clicks3(n=120_000, at=30_000 + 2500 * np.arange(12))
    slow, _ = clicks3(seed=3, n=90_000, fs=400_000.0, at=20_000 + 2500 * np.arange(15), az=-0.3)
    rng = np.random.default_rng(1)
    silent = {(1, c): rng.normal(size=50_000) * 1e-6 for c in (1, 2, 3)}
    for name, signals in (("fast", fast), ("slow", slow), ("silent", silent)):
        np.stack([signals[(1, c)] for c in (1, 2, 3)], axis=1).astype("<f8").tofile(tmp_path / f"{name}.bin")
    block_len, halo = 16_384, 5000
    options = dict(channels=3, dtype="float64", block_len=block_len, halo=halo)
    wide = pcm.read_pcm(spark, str(tmp_path), wide="true", **options)
    table = spark.createDataFrame(
        [("fast", 500_000.0, 120_000, "triangle_40cm", 0.5), ("slow", 400_000.0, 90_000, "triangle_40cm", -2.0), ("silent", 400_000.0, 50_000, "triangle_dash_names", 0.0)],
        "recording_id string, fs double, n_samples long, device string, sync_s double",
    )
    done = recordings.detect_recordings(wide, table, tile_s=0.2)
    counts = {r.recording_id: r for r in done.counts.collect()}
    assert counts["fast"].num_impulse == 12 and counts["slow"].num_impulse == 15 and counts["silent"].num_impulse == 0
    assert counts["fast"].num_impulsetrain == counts["slow"].num_impulsetrain == 1
    assert {r.num_noise for r in counts.values()} == {-1}
    tracks = recordings.localize_recordings(wide, done.impulses, table, block_len, halo, ["max_energy", "max_peak"], 25.0)
    got = {(r.recording_id, r.det_id, r.method): r for r in tracks.collect()}
    assert len(got) == 2 * 27
    for name, fs, n, sync, az in (("fast", 500_000.0, 120_000, 0.5, 0.4), ("slow", 400_000.0, 90_000, -2.0, -0.3)):
        alone = pcm.read_pcm(spark, str(tmp_path), fs=fs, **options).where(F.col("recording_id") == name)
        one = recordings.detect_all(alone, fs, n, devices.preset("triangle_40cm"), tile_s=0.2)
        mine = done.impulses.where(F.col("recording_id") == name)
        assert sorted(map(tuple, mine.collect())) == sorted(map(tuple, one.impulses.collect()))
        for part in ("trains", "tonals"):
            own, other = (getattr(d, part).where(F.col("recording_id") == name) for d in (done, one))
            assert sorted(map(repr, own.select(other.columns).collect())) == sorted(map(repr, other.collect())), part
        for r in recordings.localize(alone, mine, fs, block_len, "triangle_40cm", ["max_energy", "max_peak"], 25.0, sync).collect():
            found = got[(name, r.det_id, r.method)]
            assert (found.az, found.el, found.frame, found.px, found.py) == (r.az, r.el, r.frame, r.px, r.py)
            assert abs(r.az - az) < 0.03


# ---- arrivals


def plain_arrivals(x, ref, n, share):
    """The documented rule on a whole channel, by looking for each peak's higher ground."""
    r = tdoa.analytic(ref)
    z = np.correlate(np.concatenate([x, np.zeros(len(r) - 1)]).astype(complex), r, "valid") * 2 / (np.std(r, ddof=1) * len(r))
    m = np.abs(z)
    found = []
    for i in range(1, len(m) - 1):
        if m[i - 1] < m[i] >= m[i + 1]:
            left, right = np.flatnonzero(m[:i] > m[i]), np.flatnonzero(m[i + 1 :] > m[i])
            a, b = (left[-1] if len(left) else 0), (i + 1 + right[0] if len(right) else len(m) - 1)
            if m[i] - max(m[a:i].min(), m[i + 1 : b + 1].min()) >= share * m.max():
                found.append(i)
    best = sorted(found, key=lambda i: (-m[i], i))[:n] if len(found) <= len(x) / 10 else []
    return [(i + 1, m[i], z[i]) for i in sorted(best)]


@pytest.mark.parametrize("block_len", [150, 1000, 6000])
def test_arrivals_stand_out_over_block_edges(spark, block_len):
    rng = np.random.default_rng(4)
    ref = np.sin(2 * np.pi * np.cumsum(np.linspace(0.02, 0.4, 64)))
    signals = {}
    for c, noise in ((1, 0.05), (2, 0.6), (3, 3.0)):
        x = rng.normal(size=6000) * noise
        for p, a in ((700, 1.0), (2999, -0.8), (4100, 0.6), (5960, 2.0)):
            x[p : p + 64] += (a * ref)[: 6000 - p]
        signals[(1, c)] = x
    signals[(2, 1)] = np.zeros(6000)
    b = block_rows(spark, signals, block_len, 70)
    for n, share in ((3, 0.2), (40, 0.1), (5, 0.7)):
        got = {}
        for r in tdoa.arrivals(b, ref, n, share).collect():
            got.setdefault((r.recording_id, r.channel), []).append((r.idx, r.strength, complex(r.re, r.im)))
        for key, x in signals.items():
            want = plain_arrivals(x, ref, n, share) if x.any() else []
            assert [i for i, _, _ in got.get(key, [])] == [i for i, _, _ in want]
            assert np.allclose([v[1:] for v in got.get(key, [])], [v[1:] for v in want])
