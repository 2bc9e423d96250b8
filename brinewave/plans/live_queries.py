"""Streams over events, run to the end of what is there, and stored results."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brinewave.plans.recording_queries import BAND, BLOCK, DIST, HALO, PRESET, RATES, RAW, _found_sql, written
from brinewave.plans.registry import query
from brinewave.plans.standins import DET, EPOCH, detections
from brinewave.plans.train_queries import INTERVAL, MEMBERS_SQL, MIN_LEN, click_trains
from brinewave.session import shared_dir
from brinewave.sinks import labels
from brinewave.sources import pcm
from brinewave.streaming import live


def fresh_folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def streamed_detections(t):
    """events as a stream of detections with event time; closed files are the segments of the recording."""
    path = f"{t.folder}/events.parquet"
    source = t.spark.readStream.schema(t.spark.read.parquet(path).schema).option("pathGlobFilter", "events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    return source.parquet(t.folder).select(
        F.col("user_id").cast("string").alias("recording_id"),
        F.col("event_type").alias("kind"),
        (micros + 1).alias("idx"),
        F.col("value").alias("peak"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def run_to_end(stream, spark, name: str):
    """Let a stream take all that is there into a written table, and read that."""
    folder = fresh_folder(spark, name)
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{folder}/data")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


def run_all(stream, spark, name: str):
    """The same batch by batch, for sources that bound their batches."""
    folder = fresh_folder(spark, name)
    query = stream.writeStream.format("parquet").option("path", f"{folder}/data").option("checkpointLocation", f"{folder}/checkpoint").start()
    query.processAllAvailable()
    query.stop()
    return spark.read.schema(stream.schema).parquet(f"{folder}/data")


STREAMED = _found_sql(0).replace("WHERE rec % 2 = 0 AND", "WHERE")  # all recordings at one rate
LEVEL = 50.0


@query(
    "SRC-4", "D-4",
    sql=f"""WITH {RAW}, {STREAMED},
 loud AS (SELECT recording_id, idx FROM tops0 WHERE c = {2 * DIST + 1} AND x = m AND prev < x AND x > {LEVEL})
SELECT recording_id, idx, epoch_us(TIMESTAMP '{EPOCH}') + CAST(round_even((idx - 1) * 1000000.0::DOUBLE / {RATES[0]}, 0) AS BIGINT) AS at_us FROM loud""",
)
def streamed_pcm_impulses(t):
    """Impulses of PCM files that are followed as a stream, twenty blocks a batch; the newest file is the silent one."""
    _, folder = written(t)
    progress = f"{fresh_folder(t.spark, 'progress')}.json"
    blocks = pcm.stream_pcm(
        t.spark, folder, channels=4, dtype="float64", block_len=BLOCK, halo=HALO, task_blocks=4, max_blocks=20, progress=progress
    )
    found = live.live_impulses(blocks, RATES[0], BAND, PRESET["ref_channel"], DIST, LEVEL, F.lit(EPOCH).cast("timestamp"))
    rows = run_all(found.select("recording_id", "idx", "peak", "ts"), t.spark, "impulses")
    return rows.select("recording_id", "idx", F.unix_micros("ts").alias("at_us"))


@query(
    "SRC-4", "D-7",
    sql=MEMBERS_SQL
    + f""", w AS (SELECT max(epoch_us(ts) // 1000) AS ms FROM events)
SELECT recording_id::VARCHAR AS recording_id, start_idx, end_idx, last_member_idx, n_dets, level FROM trains, w
WHERE end_idx < 2592000000000 AND (end_idx - 1 + epoch_us(TIMESTAMP '{EPOCH}')) // 1000 + {INTERVAL // 1000} < w.ms""",
)
def streamed_trains(t):
    return run_to_end(live.live_trains(streamed_detections(t), MIN_LEN, INTERVAL, 1e6, "0 seconds"), t.spark, "trains")


@query(
    "SRC-4", "G-8",
    sql="""WITH w AS (SELECT max(epoch_us(ts) // 1000) AS ms FROM events),
 c AS (SELECT user_id::VARCHAR AS recording_id, event_type AS kind, epoch(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start_s, count(*) AS n
       FROM events GROUP BY ALL)
SELECT c.* FROM c, w WHERE (start_s + 86400) * 1000 <= ms - 3600000""",
)
def streamed_counts(t):
    out = run_to_end(live.live_counts(streamed_detections(t), "1 hour", "1 day"), t.spark, "counts")
    return out.select("recording_id", "kind", F.unix_seconds("start").alias("start_s"), "n")


@query(
    "SNK-4",
    sql=MEMBERS_SQL
    + f"SELECT recording_id, start_idx, end_idx, n_dets, {MIN_LEN}::BIGINT AS min_len FROM trains",
)
def stored_results(t):
    """Trains written by run and group of recordings, and the run read back."""
    folder = fresh_folder(t.spark, "results")
    trains = click_trains(t).withColumn("recording_group", F.col("recording_id") % 10)
    labels.write_results(trains, folder, "run-1", by="recording_group", min_len=MIN_LEN)
    stored = t.spark.read.parquet(folder).where("run_id = 'run-1'")
    return stored.select("recording_id", "start_idx", "end_idx", "n_dets", F.col("min_len").cast("bigint").alias("min_len"))
