"""Label tracks, pixel tracks, counts and stored results."""

from __future__ import annotations

from pyarrow import fs
from pyspark.sql import Column, DataFrame, functions as F

from brinewave.operators.tiles import number_rows
from brinewave.session import opened

REC = "recording_id"


def _seconds(t: Column) -> Column:
    return F.format_string("%.6f", t)


def point_labels(dets: DataFrame, fs: float, tile: int, prefix: str = "") -> DataFrame:
    """One line per detection: time, time, prefix and running number."""
    t = _seconds((F.col("idx") - 1) / F.lit(float(fs)))
    numbered = number_rows(dets, [REC], "idx", ["det_id"], tile, "n")
    return numbered.select(REC, "n", F.concat_ws("\t", t, t, F.concat(F.lit(prefix), F.col("n"))).alias("line"))


def interval_labels(segments: DataFrame, fs: float, tile: int, prefix: str = "") -> DataFrame:
    """One line per segment: start, end, prefix and running number."""
    numbered = number_rows(segments, [REC], "start_idx", ["end_idx"], tile, "n")
    start, end = (_seconds(F.col(c) / F.lit(float(fs))) for c in ("start_idx", "end_idx"))
    return numbered.select(REC, "n", F.concat_ws("\t", start, end, F.concat(F.lit(prefix), F.col("n"))).alias("line"))


def write_labels(labels: DataFrame, path: str) -> None:
    """Text files below recording_id=..., lines of a recording in order across its files."""
    (
        labels.repartitionByRange(REC, "n")
        .sortWithinPartitions(REC, "n")
        .select(REC, "line")
        .write.mode("overwrite")
        .partitionBy(REC)
        .text(path)
    )


def pixel_track(pixels: DataFrame) -> DataFrame:
    """The columns of a pixel track file."""
    return pixels.select(REC, F.col("frame").alias("p_pixel"), "px", "py")


def write_pixel_track(pixels: DataFrame, path: str) -> None:
    pixel_track(pixels).write.mode("overwrite").partitionBy(REC).option("header", True).csv(path)


def merge_new_rows(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """existing plus the rows of new whose key it lacks: appending twice changes nothing."""
    return existing.unionByName(new.join(existing.select(*keys), keys, "left_anti"))


def append_counts(counts: DataFrame, path: str, keys: list[str], by: str | None = None) -> None:
    """Append the counts rows whose key the stored table lacks; the header is part of each file.

    With `by`, a column that groups the rows (a day), the table is partitioned by it, and only the parts that the new
    rows belong to are read.
    """
    system, inner = opened(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        stored = counts.sparkSession.read.schema(counts.schema).option("header", True).csv(path)
        if by:
            stored = stored.join(F.broadcast(counts.select(by).distinct()), by, "left_semi")
        counts = counts.join(stored.select(*keys).distinct(), keys, "left_anti")
    write = counts.write.mode("append").option("header", True)
    (write.partitionBy(by) if by else write).csv(path)


def write_results(results: DataFrame, path: str, run_id: str, by: str = REC, **parameters) -> None:
    """Parquet by run and `by`; the run's parameters are columns.

    With very many recordings give a column that groups them, so that folders and
    files keep a sensible number and size.
    """
    out = results.withColumn("run_id", F.lit(run_id))
    for name, value in parameters.items():
        out = out.withColumn(name, F.lit(value))
    out.write.mode("append").partitionBy("run_id", by).parquet(path)


def write_extrema(stats: DataFrame, path: str) -> None:
    """Energy and extrema per file and channel as JSON lines."""
    stats.write.mode("overwrite").json(path)
