"""PCM files in batch and as a stream, tables from files, writers and job control."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from brinewave.operators import trains
from brinewave.sinks import jobs, labels
from brinewave.sources import devices, pcm, tables
from brinewave.streaming import live


@pytest.fixture()
def recording(tmp_path):
    rng = np.random.default_rng(1)
    data = rng.integers(-2000, 2000, (5000, 4)).astype("<i2")
    data.tofile(tmp_path / "20240101_10.00.00_log.bin")
    (tmp_path / ".hidden.bin").write_bytes(b"12345678")
    return tmp_path, data


def collected(df, channel):
    rows = sorted((r for r in df.collect() if r.channel == channel), key=lambda r: r.start_idx)
    return np.concatenate([np.array(r.samples) for r in rows]), rows


@pytest.mark.parametrize("block_len", [5000, 2500, 733])
def test_pcm_blocks_and_halos(spark, recording, block_len):
    path, data = recording
    df = pcm.read_pcm(spark, str(path), channels=4, fs=1000, block_len=block_len, halo=50, task_blocks=2)
    for channel in (1, 4):
        x, rows = collected(df, channel)
        assert np.array_equal(x, data[:, channel - 1])
        for r in rows:
            lo, hi = r.start_idx - 1, r.start_idx - 1 + len(r.samples)
            assert np.array_equal(r.left_halo, data[max(lo - 50, 0) : lo, channel - 1])
            assert np.array_equal(r.right_halo, data[hi : hi + 50, channel - 1])
    assert {r.recording_id for r in df.select("recording_id").distinct().collect()} == {"20240101_10.00.00_log"}


def test_pcm_range_is_whole_frames(spark, recording):
    path, data = recording
    df = pcm.read_pcm(spark, str(path), channels=4, fs=1000, block_len=400, skip_s=1.0005, duration_s=2)
    x, _ = collected(df, 2)
    assert np.array_equal(x, data[1000:3000, 1])


def test_pcm_filters_narrow_the_read(recording):
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    path, _ = recording
    reader = pcm.PcmReader({"path": str(path), "channels": "4", "block_len": "500", "task_blocks": "1"})
    assert len(reader.partitions()) == 10
    list(reader.pushFilters([GreaterThanOrEqual(("start_idx",), 1001), LessThan(("start_idx",), 2501), EqualTo(("channel",), 3)]))
    parts = reader.partitions()
    assert [p.first for p in parts] == [2, 3, 4] and parts[0].channels == (3,)


def test_pcm_filtered_query(spark, recording):
    path, data = recording
    df = pcm.read_pcm(spark, str(path), channels=4, fs=1000, block_len=500)
    x, rows = collected(df.where("channel = 3 AND start_idx >= 1001 AND start_idx < 2501"), 3)
    assert np.array_equal(x, data[1000:2500, 2]) and len(rows) == 3


def test_growing_recording_rolls_over(spark, tmp_path):
    folder, done = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    rng = np.random.default_rng(2)
    first = rng.integers(-9, 9, (2300, 2)).astype("<i2")
    second = rng.integers(-9, 9, (1100, 2)).astype("<i2")
    stream = pcm.stream_pcm(spark, str(folder), channels=2, fs=1000, block_len=500, halo=20)

    def go():
        q = (
            stream.writeStream.format("parquet")
            .option("path", str(done / "data"))
            .option("checkpointLocation", str(done / "check"))
            .trigger(availableNow=True)
            .start()
        )
        q.awaitTermination(120)
        q.stop()

    first[:1200].tofile(folder / "a.bin")
    go()
    first.tofile(folder / "a.bin")
    second[:600].tofile(folder / "b.bin")
    go()
    second.tofile(folder / "b.bin")
    (folder / "c.bin").write_bytes(b"")
    go()
    got = spark.read.parquet(str(done / "data")).where("channel = 2")
    for name, data in (("a", first), ("b", second)):
        x, rows = collected(got.where(F.col("recording_id") == name), 2)
        assert np.array_equal(x, data[:, 1])
        assert len(rows) == -(-len(data) // 500)


def test_streamed_trains_equal_batch_trains(spark, tmp_path):
    rng = np.random.default_rng(3)
    fs, rows = 1000.0, []
    for rec in ("a", "b"):
        idx = np.unique(np.concatenate([rng.integers(1, 60_000, 80), *[p + np.arange(5) * 11 for p in rng.integers(1, 60_000, 12)]]))
        rows += [(rec, int(i), int(i), float(rng.random())) for i in idx]
    base = 1_704_067_200_000_000
    df = spark.createDataFrame(rows, "recording_id string, det_id long, idx long, peak double")
    df = df.withColumn("ts", F.timestamp_micros(F.lit(base) + F.col("idx") * 1000))
    for k in range(4):
        df.where(f"idx > {k * 16_000} AND idx <= {(k + 1) * 16_000}").coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    # a late tick moves the watermark past everything
    tick = spark.createDataFrame([("z", 0, 10**6, 0.0)], "recording_id string, det_id long, idx long, peak double")
    tick.withColumn("ts", F.timestamp_micros(F.lit(base + 10**10))).coalesce(1).write.parquet(str(tmp_path / "in"), mode="append")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = (
        live.live_trains(source, 3, 100, fs, "5 seconds")
        .writeStream.format("memory")
        .queryName("live_trains_out")
        .outputMode("append")
        .option("checkpointLocation", str(tmp_path / "check"))
        .start()
    )
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.table("live_trains_out").collect())
    batch = trains.click_trains(df, 3, 100, 5000, -1).where("end_idx > 0")
    columns = ["recording_id", "start_idx", "end_idx", "last_member_idx", "n_dets", "level"]
    assert got and got == sorted(tuple(r) for r in batch.select(columns).collect())


def test_streamed_counts(spark, tmp_path):
    df = spark.createDataFrame([("a", "click", f"2024-01-01 00:00:{s:02}") for s in range(0, 60, 2)], "recording_id string, kind string, t string")
    df.select("recording_id", "kind", F.to_timestamp("t").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("recording_id string, kind string, ts timestamp").parquet(str(tmp_path / "in"))
    q = live.live_counts(source, "1 second", "20 seconds").writeStream.format("memory").queryName("live_counts_out").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("live_counts_out").collect()) == [10, 10, 10]


def test_listing_and_priority(spark, tmp_path):
    for name in ("a.mkv", "b.mp4", "c.flac", ".d.wav", "e.txt", "f.mp3"):
        (tmp_path / name).write_bytes(b"x")
    files = tables.media_files(tables.list_files(spark, str(tmp_path)))
    assert sorted(os.path.basename(r.path) for r in files.collect()) == ["a.mkv", "b.mp4", "c.flac", "f.mp3"]
    best = tables.first_matching_extension(files.withColumn("folder", F.lit(1)), "folder")
    assert sorted(os.path.basename(r.path) for r in best.collect()) == ["a.mkv", "c.flac"]


def test_environment_and_counts_files(spark, tmp_path):
    (tmp_path / "env.csv").write_text("".join(f"20240101_0000{s:02},{s}.5,100,50\n" for s in range(40)))
    env = tables.last_rows(tables.read_environment(spark, str(tmp_path / "env.csv")), 3, "date").collect()
    assert [r.temperature for r in env] == [39.5, 38.5, 37.5]
    counts = spark.createDataFrame(
        [("2024-01-01T10:00:00.000-1000", 1, 2, 3, 4, 5, 6)],
        "datetime string, num_impulse long, num_impulseINtrain long, num_impulsetrain long, num_tonal long, num_tonalsegment long, num_noise long",
    )
    target = str(tmp_path / "counts")
    for _ in range(2):  # the second append finds the row already there
        labels.append_counts(counts, target, ["datetime"])
    got = tables.read_counts(spark, target).collect()
    assert len(got) == 1 and got[0].datetime.isoformat() == "2024-01-01T20:00:00"


def test_result_json_files(spark, tmp_path):
    (tmp_path / "r1.json").write_text('{"a": 1,\n "b": 2.5}')
    (tmp_path / "r2_error.json").write_text('{"a": 9, "b": 9.0}')
    got = tables.read_result_json(spark, str(tmp_path), "a bigint, b double", "error").collect()
    assert [(r.a, r.b) for r in got] == [(1, 2.5)]


def test_label_files_keep_their_order(spark, tmp_path):
    dets = spark.createDataFrame([(r, i, 100 * i + 1) for r in (1, 2) for i in range(50)], "recording_id long, det_id long, idx long")
    labels.write_labels(labels.point_labels(dets, 100.0, 700, "p"), str(tmp_path / "labels"))
    lines = []
    for part in sorted(glob.glob(str(tmp_path / "labels" / "recording_id=1" / "*.txt"))):
        lines += open(part).read().splitlines()
    assert lines[0] == "0.000000\t0.000000\tp1" and lines[-1] == "49.000000\t49.000000\tp50" and len(lines) == 50


def test_stored_results_prune_by_run(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "recording_id string, n long")
    for run in ("r1", "r2"):
        labels.write_results(rows, str(tmp_path / "res"), run, dist=200)
    got = spark.read.parquet(str(tmp_path / "res")).where("run_id = 'r2' AND recording_id = 'b'")
    assert [(r.n, r.dist) for r in got.collect()] == [(2, 200)]
    assert "PartitionFilters: [isnotnull(run_id" in got._jdf.queryExecution().toString()


def test_pixel_and_extrema_files(spark, tmp_path):
    px = spark.createDataFrame([("a", 3, 1.0, 2.0)], "recording_id string, frame long, px double, py double")
    labels.write_pixel_track(px, str(tmp_path / "px"))
    assert spark.read.option("header", True).csv(str(tmp_path / "px")).columns == ["p_pixel", "px", "py", "recording_id"]
    labels.write_extrema(px, str(tmp_path / "ex"))
    assert spark.read.json(str(tmp_path / "ex")).count() == 1


def test_failures_are_isolated(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(200)], "k long, x double")

    def inverse(batch):
        if (batch["x"] == 0).any() or (batch["x"] == 77).any():
            raise ValueError("bad row")
        return (1 / batch["x"]).to_frame("y")

    good, bad = jobs.split_quarantine(jobs.apply_isolated(df, inverse, "y: double"))
    assert sorted(r.k for r in bad.collect()) == [0, 77]
    assert good.count() == 198


def test_presets(spark):
    rows = {r.device: r for r in devices.devices(spark).collect()}
    assert len(rows) == 6 and rows["single_sensor"].ref_channel == 1 and len(rows["triangle_40cm"].rx) == 3
    r = rows["triangle_15cm"].rx
    side = np.hypot(r[0].x - r[1].x, r[0].y - r[1].y)
    assert side == pytest.approx(0.14722)


def test_pcm_by_uri_and_equal_names(spark, tmp_path):
    for folder, value in (("a", 1), ("b", 2)):
        (tmp_path / folder).mkdir()
        np.full((300, 2), value, "<i2").tofile(tmp_path / folder / "same.bin")
    for root in (str(tmp_path), tmp_path.as_uri()):
        rows = pcm.read_pcm(spark, root, channels=2, fs=1000, block_len=128).where("channel = 1").collect()
        found = {r.recording_id: set() for r in rows}
        for r in rows:
            found[r.recording_id] |= set(r.samples)
            assert r.path.startswith(root)
        assert found == {"a/same": {1.0}, "b/same": {2.0}}
    alone = pcm.read_pcm(spark, (tmp_path / "a" / "same.bin").as_uri(), channels=2, fs=1000).collect()
    assert {r.recording_id for r in alone} == {"same"}


def test_tables_end_with_the_job(spark):
    from brinewave import session

    kept = session.cut_lineage(spark.range(10))
    assert kept.count() == 10 and os.path.isdir(session.job_dir(spark))
    session.end_job(spark)
    assert not os.path.exists(session.job_dir(spark))
    session.end_job(spark)


def test_tails_over_many_blocks(spark):
    from brinewave.sources import tails

    lengths = {1: 1000, 2: 61}
    rows = [
        (rec, 1, at // 64, at + 1, [float(i) for i in range(at, min(at + 64, n))]) for rec, n in lengths.items() for at in range(0, n, 64)
    ]
    blocks = spark.createDataFrame(rows, "recording_id long, channel int, block_id long, start_idx long, samples array<double>")
    keys = ["recording_id", "channel"]
    for n in (24, 100):
        got = {rec: sorted((r.idx, r.x) for r in tails.tail_samples(blocks, n, keys).collect() if r.recording_id == rec) for rec in lengths}
        assert got == {rec: [(i + 1, float(i)) for i in range(max(0, m - n), m)] for rec, m in lengths.items()}
    got = {rec: sorted(r.idx for r in tails.aligned_tail(blocks, 24, keys).collect() if r.recording_id == rec) for rec in lengths}
    assert got == {rec: list(range((m - 24) // 24 * 24 + 1, (m - 24) // 24 * 24 + 25)) for rec, m in lengths.items()}


def test_streams_take_bounded_batches(spark, tmp_path):
    """A history of three files arrives eleven blocks at a time, in tasks of four, and goes on after a restart."""
    folder = tmp_path / "live"
    folder.mkdir()
    rng = np.random.default_rng(2)
    whole = {f"f{k}": rng.normal(size=(2000 + 100 * k, 2)) for k in range(3)}
    for name, x in whole.items():
        x.astype("<f8").tofile(folder / f"{name}.bin")
    options = dict(channels=2, dtype="float64", block_len=100, halo=20, task_blocks=4, max_blocks=11, progress=str(tmp_path / "progress.json"))
    seen, sizes = [], []

    def keep(batch, _):
        rows = batch.select("recording_id", "channel", "start_idx", "samples").collect()
        sizes.append(len(rows) // 2)
        seen.extend(rows)

    def run():
        query = pcm.stream_pcm(spark, str(folder), **options).writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check")).start()
        query.processAllAvailable()
        query.stop()

    run()
    assert max(sizes) <= 11 and len(sizes) > 5
    (folder / "f3.bin").write_bytes(b"")
    run()
    assert max(sizes) <= 11
    for (name, x) in whole.items():
        for channel in (1, 2):
            got = sorted((r.start_idx, r.samples) for r in seen if (r.recording_id, r.channel) == (name, channel))
            assert [i for i, _ in got] == list(range(1, len(x), 100))
            assert np.array_equal(np.concatenate([s for _, s in got]), x[:, channel - 1])
    with pytest.raises(Exception, match="max_blocks needs"):
        pcm.PcmStreamReader({"path": str(folder), "max_blocks": "3"})


def test_pcm_files_come_back(spark, tmp_path):
    from brinewave.operators import blocks
    from brinewave.sinks import pcm_files

    rng = np.random.default_rng(3)
    whole = {name: rng.normal(size=(n, 3)) for name, n in (("a/b c", 700), ("é", 64), ("z", 1))}
    rows = [(name, k // 64, k + 1, c + 1, x[k : k + 64, c].tolist(), [], []) for name, x in whole.items() for k in range(0, len(x), 64) for c in range(3)]
    schema = "recording_id string, block_id long, start_idx long, channel int, samples array<double>, left_halo array<double>, right_halo array<double>"
    wide = blocks.wide(spark.createDataFrame(rows, schema))
    made = {r.recording_id: r for r in pcm_files.write_pcm(wide, f"file://{tmp_path}/out").collect()}
    assert {k: (r.channels, r.n_samples) for k, r in made.items()} == {k: (3, len(x)) for k, x in whole.items()}
    for name, x in whole.items():
        back = np.fromfile(made[name].path.removeprefix("file://"), "<f8").reshape(-1, 3)
        assert np.array_equal(back, x)
    with pytest.raises(Exception, match="are missing after 64"):
        pcm_files.write_pcm(wide.where("start_idx <> 65"), f"{tmp_path}/gap")


def test_counts_are_appended_once_by_day(spark, tmp_path):
    schema = "datetime string, day string, n long"
    target = str(tmp_path / "counts")
    for rows in ([("t1", "d1", 1), ("t2", "d2", 2)], [("t2", "d2", 9), ("t3", "d2", 3)], [("t3", "d2", 3)]):
        labels.append_counts(spark.createDataFrame(rows, schema), target, ["datetime"], "day")
    got = spark.read.schema(schema).option("header", True).csv(target).collect()
    assert sorted((r.datetime, r.day, r.n) for r in got) == [("t1", "d1", 1), ("t2", "d2", 2), ("t3", "d2", 3)]
