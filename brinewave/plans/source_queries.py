"""File names, listings, logs, metadata and presets on orders, lineitem, events and others."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from brinewave.functions import columns as fc
from brinewave.operators import matching
from brinewave.operators.tiles import fitting_width
from brinewave.plans.registry import query
from brinewave.plans.standins import SMP, embedding_blocks, embedding_samples
from brinewave.session import job_dir
from brinewave.sinks import jobs
from brinewave.sources import attitude, devices, tables, tails

MICROPASCAL = fc.MICROPASCAL_PER_COUNT


@query(
    "SRC-3",
    sql="""WITH f AS (SELECT label, 'rec_' || lpad(vec_id::VARCHAR, 8, '0') || '.bin' AS path, embedding FROM embeddings),
 newest AS (SELECT label, max(path) AS path, arg_max(embedding, path) AS e FROM f GROUP BY label),
 s AS (SELECT label, path, unnest(range(1, len(e) + 1)) AS idx, CAST(unnest(e) AS DOUBLE) AS x FROM newest)
SELECT label, path, idx, x FROM s WHERE idx > 64 - 24""",
)
def newest_file_tail(t):
    files = t.embeddings.select(
        "label",
        F.concat(F.lit("rec_"), F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".bin")).alias("path"),
        F.col("embedding").cast("array<double>").alias("samples"),
    )
    newest = tails.newest_file(files, ["label"])
    whole = newest.withColumn("start_idx", F.lit(1).cast("bigint"))
    return tails.tail_samples(whole, 24, ["label", "path"]).select("label", "path", "idx", "x")


@query("SRC-3", sql=f"WITH {SMP} SELECT recording_id, channel, idx, x FROM smp WHERE idx > 24 AND idx <= 48")
def aligned_window(t):
    return tails.aligned_tail(embedding_blocks(t), 24, ["recording_id", "channel"]).select("recording_id", "channel", "idx", "x")


@query(
    "SRC-5",
    sql=f"""WITH {SMP} SELECT recording_id, channel, idx, x * (10 / 32768.0::DOUBLE) AS volts,
            x * {MICROPASCAL} AS micropascal FROM smp""",
)
def scaled_units(t):
    b = embedding_blocks(t)
    volts, pascal = (fc.scale_samples(F.col("samples"), k) for k in (fc.VOLTS_PER_COUNT, MICROPASCAL))
    rows = b.select("recording_id", "channel", F.posexplode(F.arrays_zip(volts.alias("v"), pascal.alias("p"))).alias("i", "s"))
    return rows.select(
        "recording_id",
        "channel",
        (F.col("i") + 1).cast("bigint").alias("idx"),
        F.col("s.v").alias("volts"),
        F.col("s.p").alias("micropascal"),
    )


@query(
    "SRC-6",
    sql="""WITH f AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(0, 5)) AS frame FROM embeddings)
SELECT vec_id, frame, e[frame * 12 + 1] AS yaw, e[frame * 12 + 2] AS roll, e[frame * 12 + 3] AS pitch,
  e[frame * 12 + 10] AS temperature, e[frame * 12 + 11] AS time_sensor, e[frame * 12 + 12] + 28800 AS time_comp FROM f""",
)
def attitude_log(t):
    every = F.sequence(F.lit(0).cast("bigint"), F.lit(4).cast("bigint"))
    frames = t.embeddings.select("vec_id", F.explode(every).alias("frame"), F.col("embedding").cast("array<double>").alias("e"))
    frames = frames.select("vec_id", "frame", F.slice("e", (F.col("frame") * 12 + 1).cast("int"), 12).alias("values"))
    return attitude.attitude_rows(frames, "values").select(
        "vec_id", "frame", "yaw", "roll", "pitch", "temperature", "time_sensor", "time_comp"
    )


@query(
    "SRC-7",
    sql="""SELECT epoch(date_trunc('second', ts))::BIGINT AS date_s, value AS temperature,
           CAST(user_id AS DOUBLE) AS pressure, CAST(event_id AS DOUBLE) AS humidity
           FROM events ORDER BY date_trunc('second', ts) DESC, event_id DESC LIMIT 20""",
)
def environment_tail(t):
    line = F.concat_ws(",", F.date_format("ts", tables.ENVIRONMENT_TIME), "value", "user_id", "event_id")
    rows = t.events.select(tables.parse_environment(line).alias("r")).select("r.*")
    return tables.last_rows(rows, 20, "date", "humidity").select(
        F.unix_seconds("date").alias("date_s"), "temperature", "pressure", "humidity"
    )


FILE_NAMES = """names AS (
 SELECT o_orderkey, o_orderkey % 3 AS layout,
  CASE WHEN o_orderkey % 7 = 0 THEN 'noname_' || o_orderkey || '_zzzzzzzzzzzz.wav'
       WHEN o_orderkey % 3 = 0 THEN strftime(tm, '%Y%m%d_%H.%M.%S') || '_log.wav'
       WHEN o_orderkey % 3 = 1 THEN strftime(tm, '%Y-%m-%d_%H.%M.%S') || '_' || o_orderkey || '.wav'
       ELSE strftime(tm, '%Y%m%d_%H%M%S') || '_x.wav' END AS name
 FROM (SELECT o_orderkey, o_orderdate + to_seconds(o_orderkey % 86400) AS tm FROM orders))"""


def file_names(t):
    key = F.col("o_orderkey")
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(secs=key % 86400)
    n = F.when(key % 7 == 0, F.concat(F.lit("noname_"), key, F.lit("_zzzzzzzzzzzz.wav")))
    n = n.when(key % 3 == 0, F.concat(F.date_format(at, "yyyyMMdd_HH.mm.ss"), F.lit("_log.wav")))
    n = n.when(key % 3 == 1, F.concat(F.date_format(at, "yyyy-MM-dd_HH.mm.ss"), F.lit("_"), key, F.lit(".wav")))
    n = n.otherwise(F.concat(F.date_format(at, "yyyyMMdd_HHmmss"), F.lit("_x.wav")))
    return t.orders.select("o_orderkey", (key % 3).alias("layout"), n.alias("name"))


@query(
    "SRC-8",
    sql=f"""WITH {FILE_NAMES} SELECT o_orderkey,
  CAST(epoch(CASE layout WHEN 0 THEN try_strptime(name[1:17], '%Y%m%d_%H.%M.%S')
       WHEN 1 THEN try_strptime(name[1:19], '%Y-%m-%d_%H.%M.%S')
       ELSE try_strptime(name[1:15], '%Y%m%d_%H%M%S') END) AS BIGINT) AS start_s FROM names""",
)
def start_times(t):
    path = F.concat(F.lit("/data/"), "name")
    parsed = (
        F.when(F.col("layout") == 0, fc.start_time(path, "dots"))
        .when(F.col("layout") == 1, fc.start_time(path, "dash_dots"))
        .otherwise(fc.start_time(path, "compact"))
    )
    return file_names(t).select("o_orderkey", F.unix_seconds(parsed).alias("start_s"))


@query(
    "SRC-9",
    sql="""SELECT conv_id AS recording_id, turn AS part, length(text) AS n_samples,
  CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset"
  FROM conversations""",
)
def joined_parts(t):
    parts = t.conversations.select(
        F.col("conv_id").alias("recording_id"),
        F.col("turn").alias("part"),
        F.length("text").cast("bigint").alias("n_samples"),
    )
    return tables.join_parts(parts, fitting_width(parts, ["recording_id"], "part", 1_000_000))


EXTENSIONS = ["mkv", "MP4", "avi", "mp4", "wav", "mat", "flac", "mp3", "txt"]
LISTING = f"""listing AS (
 SELECT o_custkey AS folder, '/data/' || o_custkey || '/' || CASE WHEN o_orderkey % 11 = 0 THEN '.' ELSE '' END ||
  'f' || o_orderkey || '.' || ({EXTENSIONS!r})[o_orderkey % 9 + 1] AS path FROM orders),
 visible AS (SELECT *, regexp_extract(path, '\\.([^.]*)$', 1) AS ext FROM listing WHERE NOT regexp_matches(path, '/\\.[^/]*$')),
 media AS (SELECT *, CASE WHEN ext IN ('mkv', 'MP4', 'avi', 'mp4') THEN 'video' ELSE 'audio' END AS kind,
   CASE WHEN ext IN ('mkv', 'wav') THEN 1 WHEN ext IN ('MP4', 'mat') THEN 2 WHEN ext IN ('avi', 'flac') THEN 3 ELSE 4 END AS place
   FROM visible WHERE ext <> 'txt')"""


def listing(t):
    key = F.col("o_orderkey")
    ext = F.element_at(F.array(*map(F.lit, EXTENSIONS)), (key % 9 + 1).cast("int"))
    dot = F.when(key % 11 == 0, ".").otherwise("")
    path = F.concat(F.lit("/data/"), F.col("o_custkey"), F.lit("/"), dot, F.lit("f"), key, F.lit("."), ext)
    return t.orders.select(F.col("o_custkey").alias("folder"), path.alias("path"))


@query("SRC-10", sql=f"WITH {LISTING} SELECT folder, path, kind FROM media")
def media_listing(t):
    return tables.media_files(listing(t))


@query(
    "SRC-11",
    sql=f"""WITH {LISTING} SELECT folder, path, kind FROM media
            QUALIFY rank() OVER (PARTITION BY folder, kind ORDER BY place) = 1""",
)
def first_extension(t):
    return tables.first_matching_extension(media_listing(t), "folder").select("folder", "path", "kind")


@query(
    "SRC-12",
    sql="""WITH m AS (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'video' ELSE 'audio' END AS kind,
  ['30000/1001', '25/1', '0/0', 'N/A'][o_orderkey % 4 + 1] AS rate_text, o_orderkey % 10000 AS frames,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_totalprice / 1000 END AS duration,
  CASE o_orderkey % 4 WHEN 0 THEN 30000 / 1001.0::DOUBLE WHEN 1 THEN 25.0::DOUBLE END AS fps FROM orders)
SELECT o_orderkey, fps, CASE WHEN kind = 'video' THEN frames / fps ELSE coalesce(duration, frames / fps) END AS duration_s FROM m""",
)
def media_attributes(t):
    key = F.col("o_orderkey")
    rates = F.array(*map(F.lit, ["30000/1001", "25/1", "0/0", "N/A"]))
    media = t.orders.select(
        "o_orderkey",
        F.when(key % 2 == 0, "video").otherwise("audio").alias("kind"),
        F.element_at(rates, (key % 4 + 1).cast("int")).alias("rate_text"),
        (key % 10000).alias("frames"),
        F.when(key % 5 != 0, F.col("o_totalprice") / 1000).alias("duration"),
    )
    return tables.media_attributes(media).select("o_orderkey", "fps", "duration_s")


@query(
    "SRC-13",
    sql="""WITH c AS (SELECT s_suppkey, 1::BIGINT AS channel, 0.01::DOUBLE AS step, s_acctbal AS bias FROM supplier
 UNION ALL SELECT s_suppkey, 2, 0.5, s_suppkey::DOUBLE FROM supplier)
SELECT s_suppkey, channel, step, bias, 100 * step + bias AS volts FROM c""",
)
def metadata_corrections(t):
    text = F.format_string(
        '{"correction": [[0.01, %s], [0.5, %s]]}', F.col("s_acctbal").cast("string"), F.col("s_suppkey").cast("string")
    )
    in_format = F.col("s_suppkey") % 2 == 0
    media = t.supplier.select(
        "s_suppkey", F.when(in_format, text).alias("comment_format"), F.when(~in_format, text).alias("comment_stream")
    )
    rows = tables.corrections(media)
    return rows.select("s_suppkey", "channel", "step", "bias", (F.lit(100) * F.col("step") + F.col("bias")).alias("volts"))


RESULTS = 500  # of one file


@query(
    "SRC-14",
    sql="""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 'res_' || event_type || '_' || (event_id // 500) || '.json' AS name
           FROM events WHERE event_type <> 'error'""",
)
def result_files(t):
    """Result files, written first: a file for each kind and stretch of events, those of errors named so."""
    name = F.concat(F.lit("res_"), "event_type", F.lit("_"), F.floor(F.col("event_id") / RESULTS), F.lit(".json"))
    result = F.struct("event_id", F.from_json("props", "k bigint")["k"].alias("k"))
    files = t.events.groupBy(name.alias("name")).agg(F.to_json(F.collect_list(result)).alias("text"))
    folder = f"{job_dir(t.spark)}/results-{uuid.uuid4().hex}"
    jobs.write_texts(files, folder)
    rows = tables.read_result_json(t.spark, folder, "event_id bigint, k bigint", "error")
    return rows.select("event_id", "k", fc.base_name(F.col("path")).alias("name"))


@query(
    "SRC-15",
    sql="""SELECT event_id, epoch_us(ts) // 1000 - [0, -36000000, 28800000][event_id % 3 + 1] AS at_ms FROM events""",
)
def zoned_times(t):
    zones = F.array(F.lit("+0000"), F.lit("-1000"), F.lit("+0800"))
    zone = F.element_at(zones, (F.col("event_id") % 3 + 1).cast("int"))
    text = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), zone)
    return t.events.select("event_id", F.unix_millis(fc.zoned_time(text)).alias("at_ms"))


@query(
    "SRC-16",
    sql="""SELECT l_partkey, arg_max(l_extendedprice, (l_orderkey, l_linenumber, l_extendedprice)) AS l_extendedprice
           FROM lineitem GROUP BY l_partkey""",
)
def merged_results(t):
    order = ("l_orderkey", "l_linenumber", "l_extendedprice")
    return tables.merge_keyed(t.lineitem, ["l_partkey"], "l_extendedprice", *order)


@query(
    "SRC-17",
    sql="""WITH d(device, ref_channel, impulsive_lo, impulsive_hi, ratio, dist, train_min, train_interval, n_rx, x1) AS (VALUES
  ('clicker', 3, 1000.0, NULL, 12.0, 15000, 2, 8.0, 3, 0.4 / sqrt(3) * cos(radians(150))),
  ('triangle_40cm', 3, 5000.0, 180000.0, 9.0, 200, 5, 0.1, 3, 0.4 / sqrt(3) * cos(radians(150))),
  ('triangle_15cm', 3, 5000.0, 24000.0, 4.0, 800, 5, 0.1, 3, 0.14722 / sqrt(3) * cos(radians(-30))),
  ('triangle_dash_names', 3, 1000.0, NULL, 4.0, 800, 5, 0.1, 3, 0.4 / sqrt(3) * cos(radians(150))),
  ('single_sensor', 1, 5000.0, NULL, 4.0, 800, 5, 0.1, 1, 0.0),
  ('triangle_50cm', 3, 1000.0, NULL, 4.0, 800, 7, 1.0, 3, 0.5 / sqrt(3) * cos(radians(90))))
SELECT c_custkey, d.device, ref_channel, impulsive_lo::DOUBLE AS impulsive_lo, impulsive_hi::DOUBLE AS impulsive_hi,
  ratio::DOUBLE AS ratio, dist, train_min, train_interval::DOUBLE AS train_interval, NULL::DOUBLE AS threshold_noise,
  1.0::DOUBLE AS noise_lo, 500.0::DOUBLE AS noise_hi, n_rx, round(x1::DOUBLE, 9) AS x1
FROM customer JOIN d ON d.device = ['clicker', 'triangle_40cm', 'triangle_15cm', 'triangle_dash_names', 'single_sensor', 'triangle_50cm'][c_custkey % 6 + 1]""",
)
def device_presets(t):
    names = F.array(*map(F.lit, devices.PRESETS))
    rows = t.customer.select("c_custkey", F.element_at(names, (F.col("c_custkey") % 6 + 1).cast("int")).alias("device"))
    return devices.with_device(rows).select(
        "c_custkey",
        "device",
        "ref_channel",
        "impulsive_lo",
        "impulsive_hi",
        "ratio",
        "dist",
        "train_min",
        "train_interval",
        "threshold_noise",
        "noise_lo",
        "noise_hi",
        F.size("rx").alias("n_rx"),
        F.round(F.col("rx")[0]["x"], 9).alias("x1"),
    )


# two cameras and one sound file per order: each has a trigger time
TRIGGERS = """v1 AS (SELECT o_custkey AS folder, o_orderkey, '/v1/' || o_orderkey || '_topview.mkv' AS path, o_totalprice / 1000 AS trig FROM orders),
 v2 AS (SELECT o_orderkey, '/v2/' || o_orderkey || '_uw1.mkv' AS path, o_totalprice / 2000 AS trig FROM orders),
 au AS (SELECT o_custkey AS folder, o_orderkey, '/au/' || o_orderkey || '.ogg' AS path, o_orderkey / 100.0::DOUBLE AS trig FROM orders)"""


def triggers(t):
    key = F.col("o_orderkey")
    v1 = t.orders.select(
        F.col("o_custkey").alias("folder"),
        F.concat(F.lit("/v1/"), key, F.lit("_topview.mkv")).alias("path"),
        (F.col("o_totalprice") / 1000).alias("trigger_s"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("start_s"),
    )
    v2 = t.orders.select(
        F.concat(F.lit("/v2/"), key, F.lit("_uw1.mkv")).alias("path"), (F.col("o_totalprice") / 2000).alias("trigger_s")
    )
    au = t.orders.select(
        F.col("o_custkey").alias("folder"),
        F.concat(F.lit("/au/"), key, F.lit(".ogg")).alias("path"),
        (key / F.lit(100.0)).alias("trigger_s"),
        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("start_s"),
    )
    return v1, v2, au


@query(
    "Y-4",
    sql=f"""WITH {TRIGGERS} SELECT o_orderkey::VARCHAR AS base, v1.trig - au.trig AS offset_1, v2.trig - au.trig AS offset_2
            FROM v1 JOIN v2 USING (o_orderkey) JOIN au USING (o_orderkey)""",
)
def clock_offsets(t):
    v1, v2, au = triggers(t)
    return matching.clock_offsets(v1, v2, au, "_topview", "_uw1")


@query(
    "Y-6",
    sql=f"""WITH {TRIGGERS} SELECT v2.path AS video, au.path AS audio FROM v2 JOIN au USING (o_orderkey)""",
)
def pairs_by_name(t):
    _, v2, au = triggers(t)
    return matching.pair_by_name(v2, au, "_uw1")


@query(
    "Y-3",
    sql="""WITH v AS (SELECT o_custkey AS folder, o_orderkey, o_totalprice / 1000 AS trig,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, '/v1/' || o_orderkey || '_topview.mkv') AS n FROM orders),
 a AS (SELECT o_custkey AS folder, o_orderkey, o_orderkey / 100.0::DOUBLE AS trig,
   row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, '/au/' || o_orderkey || '.ogg') AS n FROM orders)
SELECT folder, n, v.trig AS video_trigger_s, a.trig AS audio_trigger_s FROM v JOIN a USING (folder, n)""",
)
def trigger_table(t):
    v1, _, au = triggers(t)
    width = fitting_width(v1, ["folder"], "start_s", 86400 * 3650)
    return matching.trigger_table(v1, au, width).select("folder", "n", "video_trigger_s", "audio_trigger_s")


@query(
    "Y-5",
    sql="""WITH RECURSIVE f AS (SELECT o_custkey % 100 AS folder, o_orderkey AS k, '/r/' || o_orderkey AS path, o_totalprice / 1000 AS dur FROM orders),
 v AS (SELECT *, row_number() OVER (PARTITION BY folder ORDER BY k) AS n FROM f WHERE k % 2 = 0 AND dur >= 3),
 a AS (SELECT * FROM f WHERE k % 2 = 1),
 near AS (SELECT v.folder, v.n, list(a.k ORDER BY a.k) AS ks FROM v JOIN a ON a.folder = v.folder AND abs(v.dur - a.dur) < 3 GROUP BY ALL),
 g AS (SELECT folder, 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS pick FROM (SELECT DISTINCT folder FROM v)
   UNION ALL
   SELECT folder, n, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick) END, pick
   FROM (SELECT g.folder, v.n, g.used, list_filter(near.ks, lambda x: NOT list_contains(g.used, x))[1] AS pick
         FROM g JOIN v ON v.folder = g.folder AND v.n = g.n + 1 LEFT JOIN near ON near.folder = v.folder AND near.n = v.n))
SELECT g.folder, v.path AS video, '/r/' || g.pick AS audio FROM g JOIN v ON v.folder = g.folder AND v.n = g.n WHERE g.pick IS NOT NULL""",
)
def matched_recordings(t):
    key = F.col("o_orderkey")
    files = t.orders.select(
        (F.col("o_custkey") % 100).alias("folder"),
        F.concat(F.lit("/r/"), key).alias("path"),
        key.alias("ord"),
        (F.col("o_totalprice") / 1000).alias("duration_s"),
    )
    return matching.match_recordings(files.where("ord % 2 = 0"), files.where("ord % 2 = 1"), 4096)
