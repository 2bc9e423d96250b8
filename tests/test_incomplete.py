"""Queries whose last recording lacks channels, and PCM without filter pushdown."""

import os

import duckdb
import numpy as np
import pytest
from oracle import compare, connect

from brinewave.plans.catalog import ENTRIES
from brinewave.sinks import pcm_files
from brinewave.sources import pcm

FOLDER = "/root/testdata/sf0.001"
NAMES = "tonal_frames tonal_frames_plain tonal_frames_amplitude delays_segments frame_audio pcm_stats pcm_range".split()


@pytest.fixture(scope="module", params=[97, 98])
def folder(request, tmp_path_factory):
    """The smallest tables with vectors in number no multiple of four: a recording without the reference channel."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    out = tmp_path_factory.mktemp("odd")
    for name in os.listdir(FOLDER):
        if name != "embeddings.parquet":
            os.symlink(f"{FOLDER}/{name}", out / name)
    duckdb.sql(f"COPY (SELECT * FROM '{FOLDER}/embeddings.parquet' WHERE vec_id < {request.param}) TO '{out}/embeddings.parquet'")
    return str(out)


@pytest.mark.parametrize("name", NAMES)
def test_recording_without_reference(spark, folder, name):
    assert compare(spark, connect(folder), folder, ENTRIES[name]) == ""


def test_pcm_without_pushdown(spark, tmp_path):
    key = "spark.sql.python.filterPushdown.enabled"
    data = np.arange(4000, dtype="<i2").reshape(-1, 4)
    data.tofile(tmp_path / "a.bin")
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "false")
        rows = pcm.read_pcm(spark, str(tmp_path), channels=4, fs=1000, block_len=100).where("channel = 3 AND start_idx > 500 AND start_idx <= 700").collect()
    finally:
        spark.conf.set(key, before)
    assert np.array_equal(np.concatenate([r.samples for r in sorted(rows, key=lambda r: r.start_idx)]), data[500:700, 2])


def test_pcm_files_hold_the_same_channels(spark, tmp_path):
    from brinewave import schemas

    rows = [("a", k, k * 2 + 1, 0, 2, [(c, [1.0, 2.0]) for c in range(1, 3 - k)]) for k in range(2)]
    wide = spark.createDataFrame(rows, schemas.WIDE_BLOCKS)
    with pytest.raises(Exception, match="channels of a change"):
        pcm_files.write_pcm(wide, str(tmp_path))
