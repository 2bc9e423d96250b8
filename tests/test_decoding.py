"""Frames of files in a binary column, a few files at a time."""

import os

import duckdb
import numpy as np
import pytest
from oracle import compare, connect
from pyspark.sql import functions as F

from brinewave.plans.catalog import ENTRIES
from brinewave.sources import pcm

FOLDER = "/root/testdata/sf0.001"


def test_texts_without_a_frame(spark, tmp_path):
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    for name in os.listdir(FOLDER):
        if name != "documents.parquet":
            os.symlink(f"{FOLDER}/{name}", tmp_path / name)
    rows = "(1::BIGINT, 'abc'), (2, ''), (3, NULL), (4, 'a'), (5, 'wxyz')"
    duckdb.sql(f"COPY (SELECT * FROM (VALUES {rows}) v(doc_id, text)) TO '{tmp_path}/documents.parquet'")
    assert compare(spark, connect(str(tmp_path)), str(tmp_path), ENTRIES["decoded_frames"]) == ""


def test_more_than_one_go(spark):
    sizes = [400_001, 3, 600_000, 0, 250_000, 1_500_000]
    data = {k: np.random.default_rng(k).integers(0, 256, n, dtype=np.uint8).tobytes() for k, n in enumerate(sizes)}
    df = spark.createDataFrame(list(data.items()), "k int, content binary").coalesce(1)
    rows = pcm.decode_frames(df, "content", 2).withColumn("n", F.size("samples")).collect()
    assert len(rows) == 2 * len(sizes)
    for r in rows:
        whole = np.frombuffer(data[r.k][: len(data[r.k]) // 4 * 4], "<i2").reshape(-1, 2)
        assert r.start_idx == 1 and np.array_equal(r.samples, whole[:, r.channel - 1])
