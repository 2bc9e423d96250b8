"""Session settings the operators rely on."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a block row is about a megabyte: bound Arrow batches by size, not by rows
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
    "spark.sql.python.filterPushdown.enabled": "true",
}


def build_session(app: str = "brinewave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; `conf` keys use __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in CONF.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir).

    Only where the session names none, as in local tests, a scratch folder is
    made and recorded, so that later callers see the same one.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="brinewave-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def job_dir(spark: SparkSession) -> str:
    """The folder of this application's tables in the shared folder; end_job deletes it."""
    return f"{shared_dir(spark)}/brinewave/{spark.sparkContext.applicationId}"


@functools.lru_cache(maxsize=1024)
def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def end_job(spark: SparkSession) -> None:
    """Delete the tables that this application has written on the way; frames that read them are of no use after it."""
    system, path = opened(job_dir(spark))
    if system.get_file_info(path).type == fs.FileType.Directory:
        system.delete_dir(path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read that: it survives the loss of executors.

    Parquet rather than an RDD checkpoint: later steps read only the columns they
    need, and the planner knows the table's size.
    """
    spark = df.sparkSession
    path = f"{job_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
