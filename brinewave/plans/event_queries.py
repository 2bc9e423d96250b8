"""Labels, pixels, frames, attitude and positions on events and small tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brinewave.functions import columns as fc, geo
from brinewave.operators import attitude, overlay, positions, segments
from brinewave.operators.groups import with_group_values
from brinewave.plans.registry import query
from brinewave.plans.standins import DET, HOUR, detections, tile
from brinewave.plans.train_queries import MEMBERS_SQL, click_trains
from brinewave.sinks import jobs, labels

FPS = 30000 / 1001
N_FRAMES = 77_682_318  # of a video as long as the recordings, 30 days
FOV_X, FOV_Y, WIDTH, HEIGHT = 54, 34, 3840, 2160

# angles of a detection from its number, within +-3.14 and +-0.78 rad
ANG = f"""{DET},
 ang AS (SELECT *, (det_id % 629) / 100.0::DOUBLE - 3.14 AS az, (det_id % 157) / 100.0::DOUBLE - 0.78 AS el FROM det)"""


def angles(t):
    n = F.col("det_id")
    return (
        detections(t)
        .withColumn("az", (n % 629) / F.lit(100.0) - 3.14)
        .withColumn("el", (n % 157) / F.lit(100.0) - 0.78)
    )


@query(
    "SNK-1",
    sql=f"""WITH {DET}, n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY idx, det_id) AS n FROM det)
SELECT recording_id, n, concat(printf('%.6f', (idx - 1) / 1000000.0::DOUBLE), chr(9),
       printf('%.6f', (idx - 1) / 1000000.0::DOUBLE), chr(9), 'c', n) AS line FROM n""",
)
def point_labels(t):
    dets = detections(t)
    return labels.point_labels(dets, 1e6, tile(dets), "c")


@query(
    "SNK-1",
    sql=MEMBERS_SQL
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_idx) AS n FROM trains)
SELECT recording_id, n, concat(printf('%.6f', start_idx / 1000000.0::DOUBLE), chr(9),
       printf('%.6f', end_idx / 1000000.0::DOUBLE), chr(9), n) AS line FROM n""",
)
def interval_labels(t):
    return labels.interval_labels(click_trains(t), 1e6, tile(detections(t)))


@query(
    "SNK-2",
    sql="""WITH c AS (SELECT user_id, count(*) AS num_impulse FROM events GROUP BY user_id),
 old AS (SELECT user_id, count(*) AS num_impulse FROM events WHERE event_type = 'view' GROUP BY user_id)
SELECT * FROM old UNION ALL SELECT * FROM c WHERE user_id NOT IN (SELECT user_id FROM old)""",
)
def merged_counts(t):
    stored = t.events.where("event_type = 'view'").groupBy("user_id").agg(F.count("*").alias("num_impulse"))
    fresh = t.events.groupBy("user_id").agg(F.count("*").alias("num_impulse"))
    return labels.merge_new_rows(stored, fresh, ["user_id"])


@query(
    "SNK-6",
    sql="""SELECT o_orderkey, o_custkey FROM orders
           WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)""",
)
def inputs_not_done(t):
    inputs = t.orders.select("o_orderkey", "o_custkey")
    done = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"))
    return jobs.not_done(inputs, done, ["o_orderkey"])


@query(
    "SNK-7",
    sql="""WITH p AS (SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, value FROM events)
SELECT event_id, CASE WHEN k <> 0 THEN value / k END AS per_unit, coalesce(k <> 0, false) AS ok,
       CASE WHEN k <> 0 THEN NULL ELSE 'ZeroDivisionError: k is zero' END AS error FROM p""",
)
def isolated_failures(t):
    rows = t.events.select("event_id", "value", F.from_json("props", "k bigint").getField("k").alias("k"))

    def per_unit(batch):
        if not batch["k"].all():
            raise ZeroDivisionError("k is zero")
        return (batch["value"] / batch["k"]).to_frame("per_unit")

    checked = jobs.apply_isolated(rows, per_unit, "per_unit: double")
    return checked.select("event_id", F.col("result.per_unit").alias("per_unit"), "ok", "error")


@query("L-15", sql="""SELECT event_id, round(sign(value - 100) * (abs(value - 100) % (2 * pi())), 6) AS wrapped FROM events""")
def signed_remainder(t):
    return t.events.select("event_id", F.round(fc.mod_sign(F.col("value") - 100, 2 * math.pi), 6).alias("wrapped"))


PIXELS_SQL = f"""WITH {ANG},
 px AS (SELECT recording_id, det_id, kind, idx,
         degrees(az) / ({FOV_X} / 2.0::DOUBLE) * ({WIDTH} / 2) + {WIDTH} / 2 AS px,
         degrees(el) / (-{FOV_Y} / 2.0::DOUBLE) * ({HEIGHT} / 2) + {HEIGHT} / 2 AS py,
         CAST(round_even((idx - 1) / 1000000.0::DOUBLE * (30000.0::DOUBLE / 1001.0::DOUBLE), 0) AS BIGINT) + 1 AS frame FROM ang)
"""


def pixels(t):
    return angles(t).select(
        "recording_id",
        "det_id",
        "kind",
        "idx",
        fc.pixel_x(F.col("az"), FOV_X, WIDTH).alias("px"),
        fc.pixel_y(F.col("el"), FOV_Y, HEIGHT).alias("py"),
        fc.video_frame((F.col("idx") - 1) / F.lit(1e6), FPS).alias("frame"),
    )


@query("L-17", sql=PIXELS_SQL + "SELECT det_id, round(px, 6) AS px, round(py, 6) AS py FROM px")
def angle_to_pixel(t):
    return pixels(t).select("det_id", F.round("px", 6).alias("px"), F.round("py", 6).alias("py"))


@query("L-18", sql=PIXELS_SQL + "SELECT det_id, frame FROM px")
def video_frames(t):
    return pixels(t).select("det_id", "frame")


@query("SNK-3", sql=PIXELS_SQL + "SELECT recording_id, frame AS p_pixel, round(px, 4) AS px, round(py, 4) AS py FROM px")
def pixel_track(t):
    rounded = pixels(t).withColumns({"px": F.round("px", 4), "py": F.round("py", 4)})
    return labels.pixel_track(rounded)


@query(
    "L-20",
    sql=f"""WITH {ANG}, clicks AS (SELECT * FROM ang WHERE kind = 'click'),
 log AS (SELECT recording_id, idx, peak AS yaw FROM det WHERE kind = 'view'),
 hit AS (SELECT c.recording_id, c.det_id, c.az, l.idx AS log_idx, l.yaw
         FROM clicks c ASOF LEFT JOIN log l ON c.recording_id = l.recording_id AND c.idx <= l.idx)
SELECT recording_id, det_id, log_idx, yaw,
       round(CASE WHEN az - radians(yaw) > -7 * pi() / 4 THEN az - radians(yaw) ELSE az - radians(yaw) + 2 * pi() END, 6) AS bearing
FROM hit""",
)
def attitude_compensation(t):
    rows = angles(t)
    log = rows.where("kind = 'view'").withColumnRenamed("peak", "yaw")
    found = attitude.next_log_value(rows.where("kind = 'click'"), log, "yaw", tile(rows))
    bearing = fc.wrap_bearing(F.col("az") - F.radians("yaw"))
    return found.select("recording_id", "det_id", "log_idx", "yaw", F.round(bearing, 6).alias("bearing"))


@query(
    "L-21",
    sql=f"""WITH {ANG} SELECT det_id, round(sin(az) * cos(el), 6) AS x, round(sin(el), 6) AS y,
            round(cos(az) * cos(el), 6) AS z FROM ang""",
)
def direction_vectors(t):
    x, y, z = fc.direction_vector(F.col("az"), F.col("el"))
    return angles(t).select("det_id", F.round(x, 6).alias("x"), F.round(y, 6).alias("y"), F.round(z, 6).alias("z"))


KINDS = ["click", "view", "purchase", "signup", "error"]


@query(
    "V-1",
    sql=PIXELS_SQL
    + """, styles(method_no, red, green, blue, dot_size) AS (VALUES
  (1, 1, 0, 0, 63), (2, 1, 1, 0, 58), (3, 0, 1, 0, 53), (4, 1, 0, 1, 48), (5, 1, 1, 1, 33))
SELECT recording_id, frame, det_id, s.method_no, red, green, blue, dot_size, round(px, 4) AS px
FROM px JOIN styles s ON s.method_no = list_position(['click', 'view', 'purchase', 'signup', 'error'], kind)
WHERE frame BETWEEN 1 AND 77682318""",
)
def frame_marks(t):
    marks = pixels(t).withColumn("method_no", F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int"))
    return overlay.frame_marks(marks, N_FRAMES).select(
        "recording_id", "frame", "det_id", "method_no", "red", "green", "blue", "dot_size", F.round("px", 4).alias("px")
    )


@query(
    "G-7",
    sql=MEMBERS_SQL
    + """, hit AS (SELECT m.recording_id, m.det_id, t.start_idx, (m.det_id % 629) / 100.0::DOUBLE - 3.14 AS az
      FROM marked m JOIN trains t ON m.recording_id = t.recording_id AND m.idx BETWEEN t.start_idx AND t.last_member_idx)
SELECT recording_id, det_id, start_idx, round(sin(az) * 1000, 4) AS east, round(cos(az) * 1000, 4) AS north FROM hit""",
)
def train_bearing_lines(t):
    joined = segments.rows_in_segments(angles(t), click_trains(t), "last_member_idx", tile(detections(t)))
    east, north = fc.bearing_offset(F.col("az"), 1000.0)
    return joined.select(
        "recording_id", "det_id", "start_idx", F.round(east, 4).alias("east"), F.round(north, 4).alias("north")
    )


@query(
    "G-8",
    sql=f"""WITH {DET}, k AS (SELECT *, unnest(range((idx - 1) // {HOUR}, (idx - 1) // {HOUR} + 1)) AS frame FROM det
      WHERE (idx - 1) % {HOUR} > 0)
SELECT recording_id, frame, count(*) AS n, max(peak) AS top FROM k GROUP BY ALL""",
)
def frame_detections(t):
    shown = overlay.animation_frames(detections(t), HOUR)
    return shown.groupBy("recording_id", "frame").agg(F.count("*").alias("n"), F.max("peak").alias("top"))


@query(
    "G-8",
    sql=f"""WITH {DET}, f AS (SELECT unnest(range(0, 800)) AS frame)
SELECT recording_id, frame, count(*) AS n, max(peak) AS top FROM det
JOIN f ON idx - 1 > frame * {HOUR} - {2 * HOUR + HOUR // 2} AND idx - 1 < (frame + 1) * {HOUR} GROUP BY ALL""",
)
def frame_detections_fading(t):
    shown = overlay.animation_frames(detections(t), HOUR, lag=2 * HOUR + HOUR // 2)
    return shown.where("frame >= 0").groupBy("recording_id", "frame").agg(
        F.count("*").alias("n"), F.max("peak").alias("top")
    )


@query(
    "G-9",
    sql=f"""WITH {DET}, m AS (SELECT recording_id, max(peak) AS top, min(idx) AS lo, max(idx) AS hi FROM det GROUP BY recording_id)
SELECT det_id, round(peak / top, 6) AS alpha, round((peak / top) * (peak / top), 6) AS alpha_sq,
       CASE WHEN hi > lo THEN round((idx - lo) / (hi - lo)::DOUBLE, 6) END AS time_scale
FROM det JOIN m USING (recording_id) WHERE top <> 0""",
)
def display_weights(t):
    rows = with_group_values(
        detections(t), ["recording_id"], top=F.max("peak"), lo=F.min("idx"), hi=F.max("idx")
    ).where("top <> 0")
    alpha = F.col("peak") / F.col("top")
    scale = F.when(F.col("hi") > F.col("lo"), (F.col("idx") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return rows.select(
        "det_id",
        F.round(alpha, 6).alias("alpha"),
        F.round(alpha * alpha, 6).alias("alpha_sq"),
        F.round(scale, 6).alias("time_scale"),
    )


# positions of customers around their nation from key arithmetic
NODES = """nodes AS (SELECT c_nationkey AS site, c_custkey AS node_id,
   20.0::DOUBLE + c_nationkey + (c_custkey % 100) / 1000.0::DOUBLE AS lat,
   -156.0::DOUBLE + c_nationkey * 2 + (c_custkey % 77) / 1000.0::DOUBLE AS lon,
   (c_custkey % 30)::DOUBLE AS alt FROM customer),
 o AS (SELECT n_nationkey AS site, 20.0::DOUBLE + n_nationkey AS olat, -156.0::DOUBLE + n_nationkey * 2 AS olon FROM nation)"""
_A, _E2 = geo.A, geo.E2


def _ecef_sql(lat, lon, alt):
    n = f"({_A} / sqrt(1 - {_E2} * pow(sin(radians({lat})), 2)))"
    return (
        f"(({n} + {alt}) * cos(radians({lat})) * cos(radians({lon})))",
        f"(({n} + {alt}) * cos(radians({lat})) * sin(radians({lon})))",
        f"(({n} * (1 - {_E2}) + {alt}) * sin(radians({lat})))",
    )


_P, _O = _ecef_sql("lat", "lon", "alt"), _ecef_sql("olat", "olon", "0")
ENU = f"""WITH {NODES},
 d AS (SELECT *, {_P[0]} - {_O[0]} AS dx, {_P[1]} - {_O[1]} AS dy, {_P[2]} - {_O[2]} AS dz,
        radians(olat) AS phi, radians(olon) AS lam FROM nodes JOIN o USING (site)),
 enu AS (SELECT *, -sin(lam) * dx + cos(lam) * dy AS east,
        -sin(phi) * cos(lam) * dx - sin(phi) * sin(lam) * dy + cos(phi) * dz AS north,
        cos(phi) * cos(lam) * dx + cos(phi) * sin(lam) * dy + sin(phi) * dz AS up FROM d)
"""


def nodes(t):
    k, site = F.col("c_custkey"), F.col("c_nationkey")
    return t.customer.select(
        site.alias("site"),
        k.alias("node_id"),
        (F.lit(20.0) + site + (k % 100) / F.lit(1000.0)).alias("lat"),
        (F.lit(-156.0) + site * 2 + (k % 77) / F.lit(1000.0)).alias("lon"),
        (k % 30).cast("double").alias("alt"),
    )


def node_offsets(t):
    site = F.col("n_nationkey")
    origins = t.nation.select(
        site.alias("site"), (F.lit(20.0) + site).alias("olat"), (F.lit(-156.0) + site * 2).alias("olon")
    )
    rows = nodes(t).join(origins, "site")
    point = (F.col("lat"), F.col("lon"), F.col("alt"))
    origin = (F.col("olat"), F.col("olon"), F.lit(0.0))
    east, north, up = geo.east_north_up(point, origin)
    return rows.select(
        "site", "node_id", east.alias("east"), north.alias("north"), up.alias("up"), geo.distance(point, origin).alias("d")
    )


@query("G-2", sql=ENU + "SELECT node_id, round(east, 3) AS east, round(north, 3) AS north, round(up, 3) AS up FROM enu")
def local_offsets(t):
    return node_offsets(t).select("node_id", *[F.round(c, 3).alias(c) for c in ("east", "north", "up")])


@query("G-6", sql=ENU + "SELECT node_id, round(sqrt(dx * dx + dy * dy + dz * dz), 3) AS distance FROM enu")
def node_distance(t):
    return node_offsets(t).select("node_id", F.round("d", 3).alias("distance"))


def _centroid_sql():
    px, py, pz = _ecef_sql("lat", "lon", "alt")
    ox, oy, oz = _ecef_sql("olat", "olon", "oalt")
    b = _A * (1 - geo.FLAT)
    ep2 = (_A * _A - b * b) / (b * b)
    return f"""WITH {NODES},
 f AS (SELECT site, arg_min(lat, node_id) AS olat, arg_min(lon, node_id) AS olon, arg_min(alt, node_id) AS oalt FROM nodes GROUP BY site),
 d AS (SELECT site, olat, olon, oalt, radians(olat) AS phi, radians(olon) AS lam, {px} - {ox} AS dx, {py} - {oy} AS dy, {pz} - {oz} AS dz FROM nodes JOIN f USING (site)),
 m AS (SELECT site, olat, olon, oalt, phi, lam, avg(-sin(lam) * dx + cos(lam) * dy) AS e,
   avg(-sin(phi) * cos(lam) * dx - sin(phi) * sin(lam) * dy + cos(phi) * dz) AS n,
   avg(cos(phi) * cos(lam) * dx + cos(phi) * sin(lam) * dy + sin(phi) * dz) AS u FROM d GROUP BY ALL),
 c AS (SELECT site, {ox} - sin(lam) * e - sin(phi) * cos(lam) * n + cos(phi) * cos(lam) * u AS x,
   {oy} + cos(lam) * e - sin(phi) * sin(lam) * n + cos(phi) * sin(lam) * u AS y, {oz} + cos(phi) * n + sin(phi) * u AS z FROM m),
 t AS (SELECT *, sqrt(x * x + y * y) AS p, atan2(z * {_A}, sqrt(x * x + y * y) * {b!r}) AS theta FROM c),
 g AS (SELECT *, atan2(z + {ep2!r} * {b!r} * pow(sin(theta), 3), p - {_E2!r} * {_A} * pow(cos(theta), 3)) AS la FROM t)
SELECT site, round(degrees(la), 9) AS lat, round(degrees(atan2(y, x)), 9) AS lon,
  round(p / cos(la) - {_A} / sqrt(1 - {_E2!r} * pow(sin(la), 2)), 4) AS alt FROM g"""


@query("G-1", sql=_centroid_sql())
def site_centroids(t):
    out = positions.centroid(nodes(t), ["site"])
    return out.select("site", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.round("alt", 4).alias("alt"))


@query(
    "G-3",
    sql="""SELECT event_id, round(sin(value) * 600, 4) AS east, round(cos(value) * 600, 4) AS north FROM events""",
)
def points_at_bearing(t):
    east, north = fc.bearing_offset(F.col("value"), 600.0)
    return t.events.select("event_id", F.round(east, 4).alias("east"), F.round(north, 4).alias("north"))


@query(
    "G-4",
    sql=f"""WITH {NODES} SELECT node_id, round(lat + 1000.0::DOUBLE / 1852 / 60, 9) AS top, round(lon - 1000.0::DOUBLE / 1852 / 60, 9) AS "left",
  round(lat - 1000.0::DOUBLE / 1852 / 60, 9) AS bottom, round(lon + 1000.0::DOUBLE / 1852 / 60, 9) AS "right" FROM nodes""",
)
def bounding_boxes(t):
    box = geo.bounding_box(F.col("lat"), F.col("lon"), 1000.0)
    return nodes(t).select("node_id", *[F.round(v, 9).alias(k) for k, v in box.items()])


@query(
    "G-5",
    sql="""SELECT event_id, user_id, value FROM events
           WHERE ts > TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:00:00'""",
)
def track_between(t):
    track = t.events.withColumnRenamed("ts", "time")
    start, end = (F.lit(s).cast("timestamp_ntz") for s in ("2024-01-10 00:00:00", "2024-01-12 12:00:00"))
    return positions.within_times(track, start, end).select("event_id", "user_id", "value")
