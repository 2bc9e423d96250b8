"""Order statistics, quantization and matching against direct renderings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.operators import matching, order_statistics as stats, quantization as q


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(4)
    return {
        "normal": rng.normal(size=3000),
        "ties": rng.integers(-3, 4, 2001).astype(float),
        "tiny": rng.normal(size=50) * 1e-300,
        "wide": np.concatenate([rng.normal(size=100) * 10.0**k for k in range(-9, 10, 3)]),
        "one": np.array([2.5]),
        "ends": np.array([-np.inf, -1.0, 0.0, 3.0, np.inf]),
    }


def quantile(v, part):
    # five values have a rank of their own at each quarter; numpy gives nan next to an infinity
    return np.sort(v)[round(part * 4)] if len(v) == 5 else np.quantile(v, part)


@pytest.mark.parametrize("part", [0.0, 0.25, 0.5, 0.75, 1.0])
def test_exact_quantile(spark, values, part):
    rows = [(k, float(v)) for k, vs in values.items() for v in vs]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.v for r in stats.exact_quantile(df, ["g"], "x", part, "v").collect()}
    for name, v in values.items():
        assert got[name] == pytest.approx(quantile(v, part), rel=1e-12, abs=0), name


def test_block_quantile_equals_row_quantile(spark, values):
    rows = [(k, [float(x) for x in chunk]) for k, vs in values.items() for chunk in np.array_split(vs, 7)]
    df = spark.createDataFrame(rows, "g string, a array<double>")
    got = {r.g: r.v for r in stats.block_quantile(df, ["g"], "a", 0.75, "v").collect()}
    for name, v in values.items():
        assert got[name] == pytest.approx(quantile(v, 0.75), rel=1e-12, abs=0), name


def test_step_and_bias_are_found(spark):
    step, bias = q.DEFAULT_STEP * 1.03, 0.00011
    rng = np.random.default_rng(3)
    counts = rng.integers(-400, 400, 5000)
    rows = [(1, 1, float(c * step + bias)) for c in counts] + [(1, 2, 4.0)] * 3 + [(1, 3, float(v)) for v in (1, 2, 4, 7)]
    samples = spark.createDataFrame(rows, "recording_id long, channel long, x double")
    got = {r.channel: r for r in q.corrections(q.value_counts(samples)).collect()}
    assert got[1].step == pytest.approx(step, rel=1e-9)
    assert got[1].bias == pytest.approx(bias, abs=1e-12)
    assert (got[2].step, got[2].bias) == (1.0, 4.0)
    assert (got[3].step, got[3].bias) == (1.0, 2.0)
    errors = {r.channel: r.passed for r in q.round_trip_errors(samples, q.corrections(q.value_counts(samples))).collect()}
    assert errors == {1: True, 2: True, 3: True}


def test_counts_beyond_sixteen_bits_raise(spark):
    df = spark.createDataFrame([(1e6,)], "x double")
    with pytest.raises(Exception, match="CAST_OVERFLOW"):
        df.select(q.to_counts(F.col("x"), F.lit(1.0), F.lit(0.0))).collect()


def direct_match(videos, audios):
    left, out = list(audios), []
    for path, duration in videos:
        if duration < 3:
            continue
        for i, (name, other) in enumerate(left):
            if abs(duration - other) < 3:
                out.append((path, name))
                del left[i]
                break
    return out


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_greedy_matching(spark, seed):
    rng = np.random.default_rng(seed)
    v, a, want = [], [], []
    for folder in range(5):
        videos = [(f"{folder}/v{i:03}", float(d)) for i, d in enumerate(rng.uniform(0, 2000, 60).round(2))]
        audios = [(f"{folder}/a{i:03}", float(d)) for i, d in enumerate(rng.uniform(0, 2000, 80).round(2))]
        v += [(folder, p, i, d) for i, (p, d) in enumerate(videos)]
        a += [(folder, p, i, d) for i, (p, d) in enumerate(audios)]
        want += [(folder, *m) for m in direct_match(videos, audios)]
    schema = "folder long, path string, ord long, duration_s double"
    got = matching.match_recordings(spark.createDataFrame(v, schema), spark.createDataFrame(a, schema), 50)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_matching_across_tiles_takes_rounds(spark, monkeypatch):
    """Tiles of six seconds, equal durations and long chains of files that are fought for."""
    monkeypatch.setattr(matching, "FILES", 5)
    rng = np.random.default_rng(9)
    v, a, want = [], [], []
    for folder, durations in enumerate(([30.0] * 40, np.arange(40) * 1.7 + 4, rng.uniform(3, 60, 60).round(1), [2.0] * 5)):
        videos = [(f"{folder}/v{i:03}", float(d)) for i, d in enumerate(durations)]
        audios = [(f"{folder}/a{i:03}", float(d)) for i, d in enumerate(rng.permutation(durations)[: len(videos) - 3])]
        v += [(folder, p, i, d) for i, (p, d) in enumerate(videos)]
        a += [(folder, p, i, d) for i, (p, d) in enumerate(audios)]
        want += [(folder, *m) for m in direct_match(videos, audios)]
    schema = "folder long, path string, ord long, duration_s double"
    got = matching.match_recordings(spark.createDataFrame(v, schema), spark.createDataFrame(a, schema), 50)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_split_recordings_pair_by_place(spark):
    schema = "folder long, path string, ord long, duration_s double"
    v = spark.createDataFrame([(1, "v1", 1, 5.0), (1, "v2", 2, 6.0)], schema)
    a = spark.createDataFrame(
        [(1, "a_1.mat", 1, 50.0), (1, "a_2.mat", 2, 50.0), (1, "b_1.mat", 3, 50.0), (1, "c_1.mat", 4, 1.0)], schema
    )
    got = sorted(tuple(r) for r in matching.match_recordings(v, a, 10).collect())
    assert got == [(1, "v1", "a_1.mat"), (1, "v2", "b_1.mat")]
