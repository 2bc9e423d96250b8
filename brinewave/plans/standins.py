"""How the given tables play the part of recordings, detections and samples.

Each role has a DataFrame form and a SQL form (a common table expression) that
say the same thing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brinewave.operators.tiles import fitting_width
from brinewave.plans.registry import Tables

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 3600 * SECOND
DAY = 24 * HOUR
RECORDING_LENGTH = 30 * DAY  # the events cover 30 days from EPOCH
EPOCH = "2024-01-01 00:00:00"


def detections(t: Tables) -> DataFrame:
    """events as detections: one recording per user, sampled at 1 MHz from EPOCH."""
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit(EPOCH).cast("timestamp"))
    return t.events.select(
        F.col("user_id").alias("recording_id"),
        F.col("event_id").alias("det_id"),
        F.col("event_type").alias("kind"),
        (micros + 1).alias("idx"),
        F.col("value").alias("peak"),
    )


def tile(dets: DataFrame, widest: int = RECORDING_LENGTH) -> int:
    """Tile width for detections: the whole recording unless some of them are too dense for that."""
    return fitting_width(dets, ["recording_id"], "idx", widest)


DET = """det AS (
  SELECT user_id AS recording_id, event_id AS det_id, event_type AS kind,
         epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01 00:00:00') + 1 AS idx, value AS peak
  FROM events)"""


def embedding_blocks(t: Tables) -> DataFrame:
    """embeddings as blocks: four vectors in a row are the channels of a recording (fs = 64)."""
    return t.embeddings.select(
        F.floor(F.col("vec_id") / 4).alias("recording_id"),
        (F.col("vec_id") % 4 + 1).alias("channel"),
        F.lit(0).cast("bigint").alias("block_id"),
        F.lit(1).cast("bigint").alias("start_idx"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )


def embedding_samples(t: Tables) -> DataFrame:
    """The same, one row per sample, idx from 1."""
    return embedding_blocks(t).select(
        "recording_id", "channel", F.posexplode("samples").alias("_p", "x")
    ).select("recording_id", "channel", (F.col("_p") + 1).cast("bigint").alias("idx"), "x")


SMP = """smp AS (
  SELECT vec_id // 4 AS recording_id, vec_id % 4 + 1 AS channel,
         unnest(range(1, len(embedding) + 1)) AS idx, CAST(unnest(embedding) AS DOUBLE) AS x
  FROM embeddings)"""


def long_samples(t: Tables) -> DataFrame:
    """orders as one long recording: a sample per order key, two channels."""
    return t.orders.select(
        F.lit(0).cast("bigint").alias("recording_id"),
        F.explode(
            F.array(
                F.struct(F.lit(1).cast("bigint").alias("channel"), F.col("o_totalprice").alias("x")),
                F.struct(F.lit(2).cast("bigint").alias("channel"), F.col("o_custkey").cast("double").alias("x")),
            )
        ).alias("s"),
        (F.col("o_orderkey") + 1).alias("idx"),
    ).select("recording_id", "s.channel", "idx", "s.x")


LONG = """lng AS (
  SELECT CAST(0 AS BIGINT) AS recording_id, CAST(1 AS BIGINT) AS channel, o_orderkey + 1 AS idx, o_totalprice AS x
  FROM orders
  UNION ALL
  SELECT CAST(0 AS BIGINT), CAST(2 AS BIGINT), o_orderkey + 1, CAST(o_custkey AS DOUBLE) FROM orders)"""
