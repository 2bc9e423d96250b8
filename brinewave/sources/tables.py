"""Environment logs, counts, result files, media tables and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from brinewave import schemas
from brinewave.functions import columns as fc
from brinewave.operators.tiles import running_total

# Fixed value: time pattern of the environment log.
ENVIRONMENT_TIME = "yyyyMMdd_HHmmss"


def read_environment(spark: SparkSession, path: str) -> DataFrame:
    """Header-less CSV: date, temperature, pressure, humidity."""
    return spark.read.schema(schemas.ENVIRONMENT).option("timestampFormat", ENVIRONMENT_TIME).csv(path)


def parse_environment(line: Column) -> Column:
    return F.from_csv(line, schemas.ENVIRONMENT, {"timestampFormat": ENVIRONMENT_TIME})


def last_rows(df: DataFrame, n: int, *order: str) -> DataFrame:
    """The n latest rows: a top-n per partition, then of those."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts CSV with zoned times, as UTC timestamps."""
    rows = spark.read.schema(schemas.COUNTS).option("header", True).csv(path)
    return rows.withColumn("datetime", fc.zoned_time(F.col("datetime")))


def read_result_json(spark: SparkSession, path: str, schema: str, skip: str) -> DataFrame:
    """Result files as one table, without those whose name contains `skip`."""
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.withColumn("path", F.col("_metadata.file_path")).where(~fc.base_name(F.col("path")).contains(skip))


def merge_keyed(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """Several keyed results in one: the last file wins for each key."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias(value))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, modificationTime below a folder; file contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", "modificationTime")


def media_files(paths: DataFrame) -> DataFrame:
    """Visible video and audio files with their kind."""
    kind = fc.media_kind(F.col("path"))
    return paths.where(~fc.is_hidden(F.col("path"))).withColumn("kind", kind).where(F.col("kind").isNotNull())


def first_matching_extension(files: DataFrame, folder: str) -> DataFrame:
    """Per folder and kind only the files of the first extension that occurs."""
    ranked = files.withColumn("_place", fc.extension_priority(F.col("path")))
    best = ranked.groupBy(folder, "kind").agg(F.min("_place").alias("_place"))
    return ranked.join(best, [folder, "kind", "_place"]).drop("_place")


def media_attributes(media: DataFrame) -> DataFrame:
    fps = fc.frame_rate(F.col("rate_text"))
    return media.withColumn("fps", fps).withColumn(
        "duration_s", fc.media_duration(F.col("kind"), F.col("duration"), F.col("frames"), F.col("fps"))
    )


def corrections(media: DataFrame) -> DataFrame:
    """Per-channel [step, bias] out of metadata JSON, format tags before stream tags."""
    text = F.coalesce("comment_format", "comment_stream")
    parsed = F.from_json(text, "correction array<array<double>>").getField("correction")
    rows = media.select("*", F.posexplode(parsed).alias("_p", "_c"))
    return rows.select(
        *media.columns,
        (F.col("_p") + 1).cast("bigint").alias("channel"),
        F.col("_c")[0].alias("step"),
        F.col("_c")[1].alias("bias"),
    )


def join_parts(parts: DataFrame, tile: int) -> DataFrame:
    """Parts of a recording in order: `offset` is the number of samples before each part.

    Needs recording_id, part and n_samples.
    """
    return running_total(
        parts, ["recording_id"], "part", [], F.col("n_samples"), tile, "offset", inclusive=False
    )
