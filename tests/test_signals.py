"""Blocks, filters, detectors and bearings on synthetic recordings with known content."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.functions import kernels
from brinewave.operators import blocks as blk, directions, filters, impulses, recordings, spectra, tdoa, tonal
from brinewave.sources import devices

SAMPLE = "recording_id long, channel long, idx long, x double"


def block_rows(spark, signals, block_len, halo):
    """{(recording, channel): array} to blocks with halos."""
    rows = []
    for (rec, channel), x in signals.items():
        for k in range(0, len(x), block_len):
            cut = [x[k : k + block_len], x[max(k - halo, 0) : k], x[k + block_len : k + block_len + halo]]
            rows.append((rec, channel, k // block_len, k + 1, *[[float(v) for v in c] for c in cut]))
    return spark.createDataFrame(
        rows,
        "recording_id long, channel long, block_id long, start_idx long, samples array<double>, "
        "left_halo array<double>, right_halo array<double>",
    )


def whole(df, column="samples"):
    """Blocks back to {(recording, channel): array}."""
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.recording_id, r.channel, r.start_idx)):
        out.setdefault((r.recording_id, r.channel), []).append(np.array(r[column]))
    return {k: np.concatenate(v) for k, v in out.items()}


@pytest.fixture(scope="module")
def noise():
    rng = np.random.default_rng(11)
    return {(1, 1): rng.normal(size=14_000), (1, 2): rng.normal(size=14_000)}


def test_halos_equal_the_neighbours(spark, noise):
    small = {k: v[:1000] for k, v in noise.items()}
    ready = block_rows(spark, small, 128, 40)
    made = blk.with_halos(ready.drop("left_halo", "right_halo"), 40)
    samples = spark.createDataFrame(
        [(r, c, i + 1, float(v)) for (r, c), x in small.items() for i, v in enumerate(x)], SAMPLE
    )
    from_rows = blk.from_samples(samples, 128, 40)
    columns = ["recording_id", "channel", "block_id", "start_idx", "samples", "left_halo", "right_halo"]
    want = sorted(tuple(r) for r in ready.select(columns).collect())
    assert sorted(tuple(r) for r in made.select(columns).collect()) == want
    assert sorted(tuple(r) for r in from_rows.select(columns).collect()) == want


@pytest.mark.parametrize("parts", [1, 2, 7])
@pytest.mark.parametrize("band,stops", [((5000, 180_000), []), ((2500, 24_000), []), ((1000, np.inf), [(40_000, 60_000)])])
def test_filters_do_not_depend_on_blocks(spark, noise, parts, band, stops):
    fs, halo = 500_000.0, 3000
    signals = {(1, 1): noise[(1, 1)]}
    whole_file = kernels.zero_phase(signals[(1, 1)], fs, band, stops)
    b = block_rows(spark, signals, 14_000 // parts, halo)
    got = whole(filters.filter_blocks(b, fs, band, stops))[(1, 1)]
    assert np.abs(got - whole_file).max() < 1e-5 * np.abs(whole_file).max()


def test_filter_gain_at_known_frequencies():
    fs, n = 96_000.0, 9600
    t = np.arange(n) / fs
    for f, low, high in ((1000, 0.0, 0.02), (10_000, 0.98, 1.02), (40_000, 0.0, 0.02)):
        y = kernels.zero_phase(np.sin(2 * np.pi * f * t), fs, (5000, 20_000))[2000:-2000]
        assert low <= np.abs(y).max() <= high
    edge = kernels.butterworth_gain(np.array([5000.0, 20_000.0]), fs, 5000, 20_000, 4)
    assert np.allclose(edge, 0.5)
    assert np.allclose(kernels.butterworth_gain(np.array([5000.0]), fs, 5000, 20_000, 4, stop=True), 0.5)
    assert np.allclose(kernels.butterworth_gain(np.array([1000.0]), fs, 0, 1000, 4), 0.5)


def test_envelope_of_a_burst():
    fs, n = 96_000.0, 4800
    t = np.arange(n) / fs
    shape = np.exp(-(((np.arange(n) - 2400) / 300) ** 2))
    found = kernels.zero_phase(shape * np.sin(2 * np.pi * 9000 * t), fs, (0, np.inf), envelope=True)
    assert np.abs(found - shape).max() < 1e-3
    assert np.abs(kernels.envelope(shape * np.sin(2 * np.pi * 9000 * t)) - shape).max() < 1e-3


@pytest.mark.parametrize("x,y,want", [([0, 0, 1, 2, 3], [1, 2, 3], 2), ([1, 2, 3], [0, 0, 1, 2, 3], -2)])
def test_delay_of_known_pairs(x, y, want):
    assert kernels.delay(np.array(x, float), np.array(y, float))[0] == want


def test_long_correlation_uses_the_same_lags():
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=700), rng.normal(size=300)
    assert np.allclose(kernels.correlate(x, y), np.correlate(x, y, "full"))


@pytest.mark.parametrize("dist", [1, 5, 40])
def test_peaks_with_ties(dist):
    rng = np.random.default_rng(dist)
    x = rng.integers(0, 15, 800).astype(float)
    want = [
        i
        for i in range(dist, len(x) - dist)
        if x[i] == x[i - dist : i + dist + 1].max() and (x[i - dist : i] < x[i]).all()
    ]
    assert kernels.local_peaks(x, dist).tolist() == want


def clicks3(seed=0, n=60_000, fs=500_000.0, az=0.4, el=-0.2, at=None):
    """Three channels of decaying clicks from one direction, with noise."""
    rng = np.random.default_rng(seed)
    at = at if at is not None else np.arange(5000, n - 5000, 2500)
    rx = np.array(devices.geometry("triangle_40cm"))
    toward = np.array([np.sin(az) * np.cos(el), np.sin(el), np.cos(az) * np.cos(el)])
    late = -(toward @ rx.T) / devices.SPEED_OF_SOUND * fs
    late -= late[2]
    t = np.arange(-60, 160)
    signals = {}
    for c in range(3):
        x = rng.normal(size=n) * 0.002
        for p in at:
            s = t - late[c]
            x[p + t] += np.where(s >= 0, np.exp(-np.maximum(s, 0) / 12) * np.sin(2 * np.pi * 60_000 * s / fs), 0)
        signals[(1, c + 1)] = x
    return signals, at


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_clicks_are_found_wherever_the_blocks_end(spark, parts):
    signals, at = clicks3()
    b = block_rows(spark, signals, -(-60_000 // parts), 4000)
    got = impulses.detect_impulses(b, 500_000.0, (5000, 180_000), 3, 200, None, 9.0)
    idx = sorted(r.idx for r in got.collect())
    assert len(idx) == len(at)
    assert np.abs(np.array(idx) - 1 - at).max() < 15


def test_bearings_of_clicks(spark):
    fs, az, el = 500_000.0, 0.4, -0.2
    signals, at = clicks3(az=az, el=el)
    block_len = 9000
    b = block_rows(spark, signals, block_len, 4000)
    dets = spark.createDataFrame([(1, int(p), int(p) + 1) for p in at], "recording_id long, det_id long, idx long")
    found = recordings.localize(
        filters.filter_blocks(b, fs, (5000, 180_000)), dets, fs, block_len, "triangle_40cm", ["max_energy", "max_peak", "raw"], 25.0
    )
    rows = found.collect()
    assert len(rows) == 3 * len(at)
    for r in rows:
        assert abs(r.az - az) < 0.03 and abs(r.el - el) < 0.03, (r.method, r.az, r.el)


def test_directions_are_the_best_of_a_fine_grid(spark):
    rng = np.random.default_rng(6)
    rx = devices.geometry("triangle_40cm")
    fs, c = 500_000.0, 1540.0
    delays = rng.integers(-160, 160, (60, 3)).tolist()
    df = spark.createDataFrame([(i, d) for i, d in enumerate(delays)], "det_id long, delays array<int>")
    az, el = np.meshgrid(np.linspace(-np.pi, np.pi, 1441), np.linspace(-np.pi / 2, np.pi / 2, 721))
    front = np.abs(az) <= np.pi / 2
    az, el = az[front], el[front]
    vectors = np.stack([np.sin(az) * np.cos(el), np.sin(el), np.cos(az) * np.cos(el)])
    model = -(np.array(rx) - np.array(rx)[2]) * fs / c @ vectors
    for r in directions.directions(df, rx, fs, c, 3).collect():
        d = np.array(r.delays) - r.delays[2]
        best = ((d[:, None] - model) ** 2).sum(axis=0).min()
        assert r.residual <= best + 1e-6
        v = np.array([np.sin(r.az) * np.cos(r.el), np.sin(r.el), np.cos(r.az) * np.cos(r.el)])
        own = ((d - (-(np.array(rx) - np.array(rx)[2]) * fs / c @ v)) ** 2).sum()
        assert own == pytest.approx(r.residual, rel=1e-6, abs=1e-6)


def test_arrays_out_of_plane(spark):
    rx = [(0.2, 0.0, 0.0), (-0.1, 0.17, 0.0), (-0.1, -0.17, 0.0), (0.0, 0.0, 0.25)]
    fs, c, az, el = 500_000.0, 1540.0, 2.4, 0.5
    v = np.array([np.sin(az) * np.cos(el), np.sin(el), np.cos(az) * np.cos(el)])
    late = -(np.array(rx) @ v) / c * fs
    df = spark.createDataFrame([(1, [int(round(d)) for d in late - late[2]])], "det_id long, delays array<int>")
    r = directions.directions(df, rx, fs, c, 3).collect()[0]
    assert abs(r.az - az) < 0.02 and abs(r.el - el) < 0.02


@pytest.mark.parametrize("method", ["trigger_denoised", "envelope_filtered", "envelope"])
def test_delays_of_shifted_channels(spark, method):
    fs, shift = 500_000.0, 9
    rng = np.random.default_rng(1)
    base = np.zeros(400)
    base[150:260] = np.exp(-np.arange(110) / 20) * np.sin(2 * np.pi * 50_000 * np.arange(110) / fs)
    signals = {(1, 1): np.roll(base, shift) + rng.normal(size=400) * 1e-4, (1, 2): base + rng.normal(size=400) * 1e-4}
    dets = spark.createDataFrame([(1, 1, 170)], "recording_id long, det_id long, idx long")
    got = tdoa.detection_delays(block_rows(spark, signals, 400, 0), dets, -130, 130, 400, [method], 2, fs).collect()[0]
    assert abs((got.delays[0] - got.delays[1]) - shift) <= 1


def test_haar_denoising_keeps_the_signal_and_lowers_the_noise():
    rng = np.random.default_rng(0)
    clean = np.repeat([0.0, 4.0, -2.0, 1.0], 64)
    noisy = clean + rng.normal(size=256) * 0.3
    assert ((kernels.haar_denoise(noisy) - clean) ** 2).mean() < 0.7 * ((noisy - clean) ** 2).mean()


def test_arrivals_of_a_reference(spark):
    rng = np.random.default_rng(4)
    ref = np.sin(2 * np.pi * np.cumsum(np.linspace(0.02, 0.4, 64)))
    x = rng.normal(size=6000) * 0.05
    for p, a in ((700, 1.0), (2999, -0.8), (4100, 0.6)):
        x[p : p + 64] += a * ref
    b = block_rows(spark, {(1, 1): x}, 1000, 100)
    got = sorted(r.idx for r in tdoa.arrivals(b, ref, 3, prominence=0.3, min_gap=20).collect())
    assert got == [701, 3000, 4101]


def test_tone_bursts_are_found(spark):
    fs, n, nfft = 96_000.0, 96_000, 960
    rng = np.random.default_rng(3)
    signals = {(1, c): rng.normal(size=n) * 0.01 for c in (1, 2, 3)}
    t = np.arange(n) / fs
    for c in signals:
        signals[c][19_200:28_800] += np.sin(2 * np.pi * 8000 * t[19_200:28_800])
        signals[c][57_600:60_480] += np.sin(2 * np.pi * 15_000 * t[57_600:60_480])
    s = tonal.TonalSettings(fs=fs, nfft=nfft, low=2500, high=24_000, ref_channel=3, percent_quiet=0.2, ref_compat=False)
    frames = tonal.tonal_frames(block_rows(spark, signals, 9600, 0), s).where("is_det").collect()
    found = {r.frame: r.peak_freq for r in frames}
    assert set(found) == set(range(20, 30)) | set(range(60, 63))
    assert {found[k] for k in range(20, 30)} == {8000.0} and {found[k] for k in range(60, 63)} == {15_000.0}


@pytest.mark.parametrize("block_len", [16, 50, 1000])
def test_frames_over_block_edges(spark, block_len):
    rng = np.random.default_rng(9)
    x = rng.normal(size=1000)
    got = spectra.frame_spectra(block_rows(spark, {(1, 1): x}, block_len, 15), 16, 64.0, hop=5).collect()
    want = kernels.frame_powers(x, 16, 5, 64.0)
    assert len(got) == len(want)
    for r in got:
        assert np.allclose(r.power, want[r.frame])


def test_hum_is_found_after_thinning(spark):
    fs, n = 100_000.0, 1_000_000
    rng = np.random.default_rng(5)
    x = rng.normal(size=n) * 0.01
    x[300_000:500_000] += np.sin(2 * np.pi * 100 * np.arange(200_000) / fs)
    b = block_rows(spark, {(1, 1): x}, 100_000, 20_000)
    hits = recordings.noise_hits(b, fs, 1, 0.01, 0.2, band=(1.0, 500.0))
    frames = sorted(r.frame for r in hits.collect())
    assert frames and min(frames) >= 29 and max(frames) <= 50 and len(frames) >= 18


def test_whole_job(spark):
    """One recording with click trains, a tone and nothing else."""
    fs, n = 500_000.0, 500_000
    at = np.concatenate([50_000 + 2500 * np.arange(12), 300_000 + 2500 * np.arange(9)])
    signals, _ = clicks3(n=n, at=at)
    b = block_rows(spark, signals, 100_000, 4000)
    device = {**devices.preset("triangle_40cm"), "percent_quiet": 0.2}
    done = recordings.detect_all(b, fs, n, device, tile_s=0.2)
    row = done.counts.collect()[0]
    assert row.num_impulse == 21 and row.num_impulsetrain == 1 and row.num_impulseINtrain == 21
    assert row.num_noise == -1
    spans = [(r.start_idx, r.end_idx) for r in done.trains.collect()]
    assert len(spans) == 1 and spans[0][1] == n


def test_lengths_of_their_own(spark):
    from brinewave.operators import sessions, trains

    clicks = [(rec, i, at, 1.0) for rec in (1, 2) for i, at in enumerate(range(100, 600, 50))]
    dets = spark.createDataFrame(clicks, "recording_id long, det_id long, idx long, peak double")
    lengths = spark.createDataFrame([(1, 700), (2, 5000)], "recording_id long, n_samples long")
    assert {r.recording_id: r.end_idx for r in trains.click_trains(dets, 3, 300, 256, lengths).collect()} == {1: 700, 2: 5000}
    for rec, n in ((1, 700), (2, 5000)):
        both = {
            (r.start_idx, r.end_idx)
            for r in sessions.density_segments(dets, lengths, 256, 200, 0.3).collect()
            if r.recording_id == rec
        }
        one = dets.where(f"recording_id = {rec}")
        assert both == {(r.start_idx, r.end_idx) for r in sessions.density_segments(one, n, 256, 200, 0.3).collect()} and both


def test_convert_and_verify(spark):
    rng = np.random.default_rng(7)
    counts = rng.integers(-2000, 2000, 4000)
    rows = [(1, c, i + 1, float(v * 10 / 2**15)) for c in (1, 2) for i, v in enumerate(counts)]
    stored, errors = recordings.convert(spark.createDataFrame(rows, SAMPLE))
    assert all(r.passed for r in errors.collect())
    back = stored.select((F.col("raw") * F.col("step") + F.col("bias")).alias("x")).agg(F.sum("x")).collect()[0][0]
    assert back == pytest.approx(sum(r[3] for r in rows))


def test_short_halos_fail(spark, noise):
    small = {k: v[:1000] for k, v in noise.items()}
    blocks = block_rows(spark, small, 128, 40)
    assert blk.peaks_in_blocks(blocks, 40).count() > 0
    with pytest.raises(Exception, match="needs a halo of 41"):
        blk.peaks_in_blocks(blocks, 41).count()
    with pytest.raises(Exception, match="needs a halo of 200"):
        blk.with_halos(blocks.drop("left_halo", "right_halo"), 200).collect()


def test_frames_over_edges(spark, noise):
    small = {(1, 1): noise[(1, 1)][:1030]}
    assert spectra.frame_spectra(block_rows(spark, small, 100, 0), 50, 1000.0).count() == 20
    assert len(spectra.frame_spectra(block_rows(spark, small, 128, 49), 50, 1000.0).collect()) == 20
    with pytest.raises(Exception, match="need a halo"):
        spectra.frame_spectra(block_rows(spark, small, 128, 10), 50, 1000.0).collect()


@pytest.mark.parametrize("block_len", [100, 128, 777])
def test_thinned_grid_is_the_recording_s(spark, noise, block_len):
    x = np.sin(np.arange(3000) / 400)
    blocks = block_rows(spark, {(1, 1): x}, block_len, 3000)
    thin = filters.decimated(blocks, 1000.0, 7)
    got = sorted((r.start_idx + i, v) for r in thin.collect() for i, v in enumerate(r.samples))
    assert [i for i, _ in got] == list(range(1, len(x[::7]) + 1))
    assert np.abs(np.array([v for _, v in got]) - x[::7])[40:-40].max() < 0.02


def test_added_signals_keep_recordings_apart(spark):
    one = block_rows(spark, {(1, 1): np.ones(8), (2, 1): np.full(8, 2.0)}, 4, 0)
    got = {(r.recording_id, r.block_id): r.samples for r in blk.add_signals(one, one).collect()}
    assert got == {(rec, b): [2.0 * rec] * 4 for rec in (1, 2) for b in (0, 1)}
    pairs = spark.createDataFrame([(1, 2), (2, 1)], "recording_id long, other_id long")
    assert {tuple(r.samples) for r in blk.add_signals(one, one, pairs).collect()} == {(3.0,) * 4}


def test_silent_frames(spark):
    from brinewave.operators import tonal

    rng = np.random.default_rng(4)
    x = rng.normal(size=6400)
    x[1600:3200] = 0
    x[4800:5600] += 20 * np.sin(2 * np.pi * 125 * np.arange(800) / 1000)
    blocks = block_rows(spark, {(1, 1): x, (2, 1): np.zeros(6400)}, 640, 200)
    s = tonal.TonalSettings(fs=1000.0, nfft=100, low=50.0, high=400.0, ref_channel=1, threshold=None, percent_quiet=0.5, freq_width_db=3.0, freq_maxbandwidth=1000.0)
    rows = tonal.tonal_frames(blocks, s).collect()
    assert len(rows) == 128
    assert not [r for r in rows if r.recording_id == 2 and r.is_det]
    assert [r.frame for r in rows if r.recording_id == 1 and r.is_det and 48 <= r.frame < 56]


def test_ranks_with_nan_and_infinities(spark):
    from brinewave.operators import order_statistics as order

    values = [float("nan"), float("-inf"), 3.0, -2.0, float("inf"), 0.0, float("nan"), 1e300]
    rows = spark.createDataFrame([(1, v) for v in values], "g int, x double")
    ranked = sorted(values, key=lambda v: (v != v, v))
    wanted = {f"r{i}": F.lit(i) for i in range(len(values))}
    for got in (
        order.select_ranks(rows, ["g"], "x", wanted).first(),
        order.select_ranks_in_blocks(rows.groupBy("g").agg(F.collect_list("x").alias("x")), ["g"], "x", wanted).first(),
    ):
        assert [str(got[f"r{i}"]) for i in range(len(values))] == [str(v) for v in ranked]
