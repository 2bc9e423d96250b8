"""Click trains and inter-click intervals on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from brinewave.operators import intervals, segments, sessions, trains
from brinewave.plans.registry import query
from brinewave.plans.standins import DAY, DET, RECORDING_LENGTH, detections, tile

MIN_LEN = 3
INTERVAL = DAY

MEMBERS_SQL = f"""
WITH {DET},
 flagged AS (
  SELECT *, coalesce(lead(idx, {MIN_LEN}) OVER w - idx < {INTERVAL}, false) AS starts
  FROM det WINDOW w AS (PARTITION BY recording_id ORDER BY idx, det_id)),
 marked AS (
  SELECT *, bool_or(starts) OVER (PARTITION BY recording_id ORDER BY idx, det_id
                                  ROWS BETWEEN {MIN_LEN} PRECEDING AND CURRENT ROW) AS is_member
  FROM flagged),
 broken AS (
  SELECT *, CASE WHEN lag(is_member) OVER w = is_member THEN 0 ELSE 1 END AS brk, lead(idx) OVER w AS next_idx
  FROM marked WINDOW w AS (PARTITION BY recording_id ORDER BY idx, det_id)),
 numbered AS (
  SELECT *, sum(brk) OVER (PARTITION BY recording_id ORDER BY idx, det_id ROWS UNBOUNDED PRECEDING) AS run
  FROM broken),
 trains AS (
  SELECT recording_id, min(idx) AS start_idx, max(idx) AS last_member_idx, count(*) AS n_dets,
         max(peak) AS level, max(coalesce(next_idx, {RECORDING_LENGTH})) AS end_idx
  FROM numbered WHERE is_member GROUP BY recording_id, run)
"""


@query("D-6", sql=MEMBERS_SQL + "SELECT recording_id, det_id, idx, is_member FROM marked")
def train_membership(t):
    dets = detections(t)
    out = trains.train_members(dets, MIN_LEN, INTERVAL, tile(dets))
    return out.select("recording_id", "det_id", "idx", "is_member")


@query(
    "D-7",
    sql=MEMBERS_SQL + "SELECT recording_id, start_idx, end_idx, last_member_idx, n_dets, level FROM trains",
)
def click_trains(t):
    dets = detections(t)
    return trains.click_trains(dets, MIN_LEN, INTERVAL, tile(dets), RECORDING_LENGTH)


@query(
    "D-7",
    sql=MEMBERS_SQL
    + """SELECT recording_id, count(*) AS n_trains, CAST(sum(n_dets) AS BIGINT) AS clicks_in_trains
         FROM trains GROUP BY recording_id""",
)
def train_counts(t):
    return trains.train_counts(click_trains(t))


# one-second samples for the interval histograms: slots of a day, bins of an hour
SECONDS = f"""{DET},
 sec AS (SELECT recording_id, det_id, (idx - 1) // 1000000 + 1 AS idx, peak FROM det)"""
SLOT, BIN, LIMIT = 86400, 3600, 86400
RAW_BIN, RAW_LIMIT = 300, 180000

SPINE_SQL = f"""
 last AS (SELECT recording_id, max(idx) - 1 AS t FROM sec GROUP BY recording_id),
 spine AS (SELECT recording_id, unnest(range(t // {SLOT})) AS slot FROM last),
 inside AS (SELECT recording_id, (idx - 1) // {SLOT} AS slot, (idx - 1) % {SLOT} AS place, det_id
            FROM sec WHERE (idx - 1) % {SLOT} > 0)
"""

SLOT_SQL = f"""
WITH {SECONDS}, {SPINE_SQL},
 bins AS (SELECT a.recording_id, a.slot, (b.place - a.place) // {BIN} AS bin, count(*) AS c
          FROM inside a JOIN inside b ON a.recording_id = b.recording_id AND a.slot = b.slot
               AND b.place > a.place AND b.place - a.place < {LIMIT}
          GROUP BY ALL),
 top AS (SELECT recording_id, slot, max(c) AS weight, arg_max(bin, (c, -bin)) * {BIN} AS mode
         FROM bins GROUP BY recording_id, slot),
 n AS (SELECT recording_id, slot, count(*) AS n_clicks FROM inside GROUP BY recording_id, slot),
 modes AS (SELECT s.recording_id, s.slot, coalesce(n.n_clicks, 0) AS n_clicks,
                  coalesce(top.mode, 0) AS mode, coalesce(top.weight, 0) AS weight
           FROM spine s LEFT JOIN n USING (recording_id, slot) LEFT JOIN top USING (recording_id, slot)),
 best AS (SELECT recording_id, arg_max(mode, (weight, -slot)) AS ici_sample, max(weight) AS weight,
                 arg_max(slot, (weight, -slot)) * {SLOT}.0 AS time_s
          FROM modes GROUP BY recording_id)
"""

RAW_SQL = f"""
 steps AS (SELECT recording_id, idx - lag(idx) OVER (PARTITION BY recording_id ORDER BY idx, det_id) AS step FROM sec),
 rawbins AS (SELECT recording_id, step // {RAW_BIN} AS bin, count(*) AS c
             FROM steps WHERE step < {RAW_LIMIT} GROUP BY ALL),
 raw AS (SELECT recording_id, arg_max(bin, (c, -bin)) * {RAW_BIN} AS ici_direct_mode, max(c) AS ici_direct_weights
         FROM rawbins GROUP BY recording_id)
"""


def second_detections(t):
    seconds = F.floor((F.col("idx") - 1) / 1_000_000) + 1
    return detections(t).withColumn("idx", seconds)


@query("D-8", sql=SLOT_SQL + "SELECT recording_id, slot, n_clicks, mode, weight FROM modes")
def slot_interval_modes(t):
    return intervals.slot_interval_modes(second_detections(t), SLOT, 1, BIN, LIMIT)


@query(
    "D-9",
    sql=f"""
WITH {SECONDS}, {SPINE_SQL},
 steps AS (SELECT recording_id, slot, place - lag(place) OVER (PARTITION BY recording_id, slot ORDER BY place) AS step
           FROM inside),
 bins AS (SELECT recording_id, slot, step // {BIN} AS bin, count(*) AS c
          FROM steps WHERE step > 0 AND step < {LIMIT} GROUP BY ALL),
 top AS (SELECT recording_id, slot, max(c) AS weight, arg_max(bin, (c, -bin)) * {BIN} AS mode
         FROM bins GROUP BY recording_id, slot)
SELECT s.recording_id, s.slot, coalesce(top.mode, 0) AS mode, coalesce(top.weight, 0) AS weight
FROM spine s LEFT JOIN top USING (recording_id, slot)""",
)
def slot_direct_modes(t):
    return intervals.slot_direct_modes(second_detections(t), SLOT, 1, BIN, LIMIT)


@query(
    "D-10",
    sql=SLOT_SQL
    + """SELECT recording_id, ici_sample, CAST(ici_sample AS DOUBLE) AS ici_seconds, weight,
                CAST(time_s AS DOUBLE) AS time_s FROM best""",
)
def best_interval_slot(t):
    return intervals.best_slot(slot_interval_modes(t), SLOT, 1)


@query(
    "D-11",
    sql=SLOT_SQL.rstrip()
    + ","
    + RAW_SQL
    + """SELECT recording_id, ici_sample, CAST(ici_sample AS DOUBLE) AS ici_seconds, weight,
                CAST(time_s AS DOUBLE) AS time_s, coalesce(ici_direct_mode, 0) AS ici_direct_mode,
                coalesce(ici_direct_weights, 0) AS ici_direct_weights
         FROM best LEFT JOIN raw USING (recording_id)""",
)
def interval_table(t):
    dets = second_detections(t)
    return intervals.interval_table(dets, SLOT, 1, BIN, LIMIT, RAW_BIN, RAW_LIMIT, tile(dets, 30 * SLOT))


GAP = 12 * 3600 * 1_000_000
SESSIONS_SQL = f"""
 stepped AS (SELECT *, CASE WHEN idx - lag(idx) OVER w <= {GAP} THEN 0 ELSE 1 END AS fresh
             FROM tonal WINDOW w AS (PARTITION BY recording_id ORDER BY idx, det_id)),
 grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY recording_id ORDER BY idx, det_id ROWS UNBOUNDED PRECEDING) AS g
             FROM stepped),
 sessions AS (SELECT recording_id, min(idx) AS start_idx, max(idx) AS last_idx, count(*) AS n_dets
              FROM grouped GROUP BY recording_id, g)
"""


@query(
    "D-15",
    sql=f"WITH {DET}, tonal AS (SELECT * FROM det), {SESSIONS_SQL} SELECT recording_id, start_idx, last_idx, n_dets FROM sessions",
)
def gap_sessions(t):
    dets = detections(t)
    return sessions.gap_sessions(dets, GAP, tile(dets))


# a recording ends with the day of its last event
DAYS_SQL = f"len AS (SELECT recording_id, (max(idx) - 1) // {DAY} + 1 AS days FROM det GROUP BY recording_id)"


def days(dets):
    return dets.groupBy("recording_id").agg((F.floor((F.max("idx") - 1) / DAY) + 1).alias("days"))


# hour samples for the density: a kernel of 24 hours over the hours of a recording
KERNEL, SIGMA_H = 24, 0.3


@query(
    "D-15",
    sql=f"""
WITH {DET}, {DAYS_SQL},
 hrs AS (SELECT DISTINCT recording_id, (idx - 1) // 3600000000 + 1 AS idx FROM det),
 grid AS (SELECT recording_id, unnest(range(1, 24 * days - {KERNEL} + 1)) AS j FROM len),
 dens AS (
  SELECT g.recording_id, g.j,
         coalesce(sum(exp(-pow((g.j + {KERNEL // 2} - h.idx - {(KERNEL - 1) / 2}) / ({SIGMA_H} * {(KERNEL - 1) / 2}), 2) / 2)), 0) AS p
  FROM grid g LEFT JOIN hrs h ON g.recording_id = h.recording_id AND g.j + {KERNEL // 2} - h.idx BETWEEN 0 AND {KERNEL - 1}
  GROUP BY g.recording_id, g.j),
 state AS (
  SELECT *, coalesce(last_value(CASE WHEN p > 0.5 THEN 1 WHEN p < 0.05 THEN 0 END IGNORE NULLS)
            OVER (PARTITION BY recording_id ORDER BY j ROWS UNBOUNDED PRECEDING), 0) AS s FROM dens),
 turned AS (SELECT *, s - coalesce(lag(s) OVER (PARTITION BY recording_id ORDER BY j), 0) AS d FROM state),
 edges AS (SELECT recording_id, j, d, lead(j) OVER (PARTITION BY recording_id ORDER BY j) AS nxt FROM turned WHERE d <> 0)
SELECT recording_id, j AS start_idx, coalesce(nxt, 24 * days) AS end_idx FROM edges JOIN len USING (recording_id) WHERE d = 1""",
)
def density_segments(t):
    dets = detections(t)
    hourly = dets.withColumn("idx", F.floor((F.col("idx") - 1) / 3_600_000_000) + 1)
    lengths = days(dets).select("recording_id", (F.col("days") * 24).alias("n_samples"))
    return sessions.density_segments(hourly, lengths, 100, KERNEL, SIGMA_H, 0.5, 0.05)


FRAMES_SQL = f"""{DAYS_SQL},
 peaks AS (SELECT recording_id, (idx - 1) // {DAY} AS frame, max(peak) AS m FROM det GROUP BY ALL),
 frames AS (
  SELECT f.recording_id, f.days, f.frame, coalesce(p.m, 0.0) AS stat
  FROM (SELECT recording_id, days, unnest(range(days)) AS frame FROM len) f
  LEFT JOIN peaks p ON p.recording_id = f.recording_id AND p.frame = f.frame)"""


def day_frames(t):
    """Highest peak of each day of a recording, 0 on days without clicks."""
    dets = detections(t)
    peaks = dets.groupBy("recording_id", F.floor((F.col("idx") - 1) / DAY).alias("frame")).agg(F.max("peak").alias("m"))
    spine = days(dets).select("recording_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("days") - 1)).alias("frame"))
    return spine.join(peaks, ["recording_id", "frame"], "left").select(
        "recording_id", "frame", F.coalesce("m", F.lit(0.0)).alias("stat")
    )


@query(
    "D-16",
    sql=MEMBERS_SQL
    + f""", {FRAMES_SQL},
 spread AS (SELECT recording_id, start_idx,
            unnest(range(greatest(CAST(ceil(start_idx / {DAY}.0) AS BIGINT) - 1, 0), least(end_idx // {DAY} + 1, days - 1) + 1)) AS frame
            FROM trains JOIN len USING (recording_id))
SELECT recording_id, start_idx, median(stat) AS level
FROM spread JOIN frames USING (recording_id, frame) GROUP BY recording_id, start_idx""",
)
def segment_levels(t):
    ends = days(detections(t)).withColumnRenamed("days", "n_frames")
    return segments.segment_levels(click_trains(t), day_frames(t), DAY, ends)


@query(
    "D-18",
    sql=MEMBERS_SQL.replace("FROM det WINDOW", "FROM det WHERE kind = 'click' WINDOW")
    + f""", tonal AS (SELECT * FROM det WHERE kind = 'view'), {SESSIONS_SQL},
 parts AS (
  SELECT recording_id, 'num_impulse' AS what, 1 AS v FROM det WHERE kind = 'click'
  UNION ALL SELECT recording_id, 'num_impulseINtrain', n_dets FROM trains
  UNION ALL SELECT recording_id, 'num_impulsetrain', 1 FROM trains
  UNION ALL SELECT recording_id, 'num_tonal', 1 FROM tonal
  UNION ALL SELECT recording_id, 'num_tonalsegment', 1 FROM sessions
  UNION ALL SELECT recording_id, 'num_noise', 1 FROM det WHERE kind = 'error')
SELECT recording_id,
       CAST(coalesce(sum(v) FILTER (what = 'num_impulse'), 0) AS BIGINT) AS num_impulse,
       CAST(coalesce(sum(v) FILTER (what = 'num_impulseINtrain'), 0) AS BIGINT) AS "num_impulseINtrain",
       CAST(coalesce(sum(v) FILTER (what = 'num_impulsetrain'), 0) AS BIGINT) AS num_impulsetrain,
       CAST(coalesce(sum(v) FILTER (what = 'num_tonal'), 0) AS BIGINT) AS num_tonal,
       CAST(coalesce(sum(v) FILTER (what = 'num_tonalsegment'), 0) AS BIGINT) AS num_tonalsegment,
       CAST(coalesce(sum(v) FILTER (what = 'num_noise'), 0) AS BIGINT) AS num_noise
FROM parts GROUP BY recording_id""",
)
def detector_counts(t):
    dets = detections(t)
    width = tile(dets)
    clicks, tonals = dets.where("kind = 'click'"), dets.where("kind = 'view'")
    return segments.counts_table(
        clicks,
        trains.click_trains(clicks, MIN_LEN, INTERVAL, width, RECORDING_LENGTH),
        tonals,
        sessions.gap_sessions(tonals, GAP, width),
        dets.where("kind = 'error'"),
    )


@query(
    "D-19",
    sql="""SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour_s, date_trunc('day', ts)::DATE::VARCHAR AS day,
           count(*) FILTER (event_type = 'view') AS num_tonal, count(*) FILTER (event_type = 'error') AS num_noise
           FROM events GROUP BY ALL""",
)
def counts_per_hour(t):
    ts = F.col("ts").cast("timestamp")
    return (
        t.events.groupBy(F.date_trunc("hour", ts).alias("hour"))
        .agg(
            F.count_if(F.col("event_type") == "view").alias("num_tonal"),
            F.count_if(F.col("event_type") == "error").alias("num_noise"),
        )
        .select(
            F.unix_seconds("hour").alias("hour_s"),
            F.date_format("hour", "yyyy-MM-dd").alias("day"),
            "num_tonal",
            "num_noise",
        )
    )
