"""Windows, delays, directions and beams on embeddings and events."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from brinewave.functions import columns as fc
from brinewave.operators import blocks, directions, overlay, synchronization, tdoa, tonal, windows
from brinewave.plans.registry import query
from brinewave.plans.standins import SMP, embedding_blocks
from brinewave.sources.devices import geometry

BLOCK, LO, HI, REF = 64, -10, 20, 3
FS = 64.0

# the detection of a recording is the maximum of its reference channel
WIN = f"""{SMP},
 det AS (SELECT recording_id, arg_min(idx, (-x, idx)) AS idx FROM smp WHERE channel = {REF} GROUP BY recording_id),
 win AS (SELECT s.recording_id, s.channel, s.idx, s.x, d.idx AS det_idx,
         s.idx - greatest(d.idx + ({LO}), 1) AS pos FROM smp s JOIN det d USING (recording_id)
         WHERE s.idx BETWEEN d.idx + ({LO}) AND d.idx + {HI})"""


def detections(t):
    stats = blocks.channel_stats(embedding_blocks(t).where(F.col("channel") == REF))
    return stats.select("recording_id", F.col("max_idx").alias("det_id"), F.col("max_idx").alias("idx"))


def cut(t):
    return windows.cut_windows(embedding_blocks(t), detections(t), LO, HI, BLOCK)


@query("S-8", sql=f"WITH {WIN} SELECT recording_id, det_idx AS det_id, channel, idx, x FROM win")
def window_samples(t):
    return windows.window_rows(cut(t))


@query("S-9", sql=f"WITH {WIN} SELECT recording_id, det_idx AS det_id, channel, max(abs(x)) AS top FROM win GROUP BY ALL")
def window_maxima(t):
    return windows.window_values(cut(t), windows.largest, "top")


@query("S-9", sql=f"WITH {WIN} SELECT recording_id, det_idx AS det_id, channel, round(sum(x * x), 6) AS energy FROM win GROUP BY ALL")
def window_energies(t):
    def energy(frame):
        sums = [float(np.dot(s, s)) for s in frame["samples"]]
        return frame[["recording_id", "det_id", "channel"]].assign(energy=sums)

    out = windows.window_function(cut(t), energy, "recording_id bigint, det_id bigint, channel bigint, energy double")
    return out.withColumn("energy", F.round("energy", 6))


def _delay_sql(a: str, b: str) -> str:
    """Delay of a's signal after b's; both have recording_id, channel, pos, x."""
    return f"""cor AS (SELECT a.recording_id, a.channel, a.pos - b.pos AS lag, round(abs(sum(a.x * b.x)), 9) AS c
   FROM {a} a JOIN {b} b ON a.recording_id = b.recording_id GROUP BY a.recording_id, a.channel, a.pos - b.pos),
 dly AS (SELECT recording_id, channel, arg_max(lag, (c, -abs(lag), lag)) AS delay, max(c) AS peak FROM cor GROUP BY ALL)"""


@query(
    "S-13",
    sql=f"""WITH {SMP}, a AS (SELECT recording_id, channel, idx AS pos, x FROM smp WHERE channel = 1),
 b AS (SELECT recording_id, idx AS pos, x FROM smp WHERE channel = 2), {_delay_sql('a', 'b')}
SELECT recording_id, CAST(0 AS BIGINT) AS block_id, delay, round(peak, 6) AS peak FROM dly""",
)
def pair_delays(t):
    return tdoa.pair_delays(embedding_blocks(t), 1, 2).withColumn("peak", F.round("peak", 6))


def method_delays(t, *methods: str):
    found = tdoa.delays(cut(t), list(methods), REF, FS)
    rows = tdoa.per_channel(found)
    return rows.select("recording_id", "method", F.col("channel").cast("bigint").alias("channel"), F.col("delay").cast("bigint").alias("delay"))


_ZERO_REF = "CASE WHEN channel = ref THEN 0 ELSE delay END"
_ENERGY_REF = "ref AS (SELECT recording_id, arg_min(channel, (-e, channel)) AS ref FROM (SELECT recording_id, channel, sum(x * x) AS e FROM win GROUP BY ALL) GROUP BY recording_id)"
_PEAK_REF = "ref AS (SELECT recording_id, arg_min(channel, (-e, channel)) AS ref FROM (SELECT recording_id, channel, max(abs(x)) AS e FROM win GROUP BY ALL) GROUP BY recording_id)"

RAW_SQL = f"""{WIN}, r AS (SELECT * FROM win WHERE channel = {REF}), {_delay_sql('win', 'r')},
 del AS (SELECT recording_id, 'raw' AS method, channel, CASE WHEN channel = {REF} THEN 0 ELSE delay END AS delay FROM dly)"""
ENERGY_SQL = f"""{WIN}, {_ENERGY_REF}, r AS (SELECT w.* FROM win w JOIN ref ON w.recording_id = ref.recording_id AND channel = ref.ref),
 {_delay_sql('win', 'r')},
 del AS (SELECT recording_id, 'max_energy' AS method, channel, {_ZERO_REF} AS delay FROM dly JOIN ref USING (recording_id))"""
PEAK_SQL = f"""{WIN}, {_PEAK_REF},
 r AS (SELECT w.recording_id, w.idx - greatest(w.det_idx + ({tdoa.REF_LO}), min(w.idx) OVER (PARTITION BY w.recording_id)) AS pos, w.x
       FROM win w JOIN ref ON w.recording_id = ref.recording_id AND channel = ref.ref
       WHERE w.idx BETWEEN w.det_idx + ({tdoa.REF_LO}) AND w.det_idx + {tdoa.REF_HI}), {_delay_sql('win', 'r')},
 del AS (SELECT recording_id, 'max_peak' AS method, channel, delay FROM dly)"""
MINMAX_SQL = f"""{WIN}, pl AS (SELECT recording_id, channel, arg_min(pos, (-x, pos)) + 1 AS hi, arg_min(pos, (x, pos)) + 1 AS lo,
   max(x) > min(x) AS up, abs(max(x)) > abs(min(x)) AS up_abs FROM win GROUP BY ALL),
 vt AS (SELECT recording_id, count(*) FILTER (up) > count(*) / 2.0 AS up, count(*) FILTER (up_abs) > count(*) / 2.0 AS up_abs FROM pl GROUP BY recording_id),
 del AS (SELECT recording_id, 'minmax' AS method, channel, CASE WHEN vt.up THEN hi ELSE lo END AS delay FROM pl JOIN vt USING (recording_id)
   UNION ALL SELECT recording_id, 'minmax_abs', channel, CASE WHEN vt.up_abs THEN hi ELSE lo END FROM pl JOIN vt USING (recording_id))"""


@query("L-1", sql=f"WITH {RAW_SQL} SELECT * FROM del")
def delays_raw(t):
    return method_delays(t, "raw")


@query("L-2", sql=f"WITH {ENERGY_SQL} SELECT * FROM del")
def delays_max_energy(t):
    return method_delays(t, "max_energy")


@query("L-3", sql=f"WITH {PEAK_SQL} SELECT * FROM del")
def delays_max_peak(t):
    return method_delays(t, "max_peak")


SEG = f"""{SMP}, pk AS (SELECT recording_id, channel, arg_min(idx, (-x, idx)) AS peak_idx FROM smp WHERE channel IN (1, {REF}) GROUP BY ALL),
 seg AS (SELECT recording_id, min(peak_idx) AS s, max(peak_idx) + 5 AS e FROM pk GROUP BY recording_id),
 win AS (SELECT s.recording_id, s.channel, s.idx, s.x, seg.s AS det_idx, s.idx - seg.s AS pos FROM smp s JOIN seg USING (recording_id)
         WHERE s.idx BETWEEN seg.s AND seg.e)"""


@query(
    "L-4",
    sql=f"""WITH {SEG}, r AS (SELECT * FROM win WHERE channel = {REF}), {_delay_sql('win', 'r')}
SELECT recording_id, 'segment' AS method, channel, CASE WHEN channel = {REF} THEN 0 ELSE delay END AS delay FROM dly""",
)
def delays_segments(t):
    b = embedding_blocks(t)
    stats = blocks.channel_stats(b.where(F.col("channel").isin(1, REF)))
    segments = stats.groupBy("recording_id").agg(
        F.min("max_idx").alias("start_idx"), (F.max("max_idx") + 5).alias("end_idx")
    )
    empty = F.array().cast("array<double>")
    whole = blocks.wide(b.withColumns({"left_halo": empty, "right_halo": empty}))
    rows = tdoa.per_channel(tdoa.segment_delays(whole, segments, BLOCK, REF, BLOCK - 1))
    return rows.select("recording_id", "method", F.col("channel").cast("bigint").alias("channel"), F.col("delay").cast("bigint").alias("delay"))


_TAU = repr(2 * math.pi)
ENV = f"""len AS (SELECT recording_id, max(pos) + 1 AS n FROM win GROUP BY recording_id),
 ft AS (SELECT w.recording_id, w.channel, k.pos AS k, len.n, sum(w.x * cos({_TAU} * k.pos * w.pos / len.n)) AS re,
        -sum(w.x * sin({_TAU} * k.pos * w.pos / len.n)) AS im
        FROM win w JOIN len USING (recording_id) JOIN (SELECT DISTINCT recording_id, pos FROM win) k ON k.recording_id = w.recording_id GROUP BY ALL),
 an AS (SELECT *, CASE WHEN k = 0 OR 2 * k = n THEN 1 WHEN 2 * k < n THEN 2 ELSE 0 END AS g FROM ft),
 env AS (SELECT f.recording_id, f.channel, p.pos,
   sqrt(pow(sum(g * (re * cos({_TAU} * k * p.pos / n) - im * sin({_TAU} * k * p.pos / n))) / n, 2)
      + pow(sum(g * (re * sin({_TAU} * k * p.pos / n) + im * cos({_TAU} * k * p.pos / n))) / n, 2)) AS x
   FROM an f JOIN (SELECT DISTINCT recording_id, pos FROM win) p USING (recording_id) GROUP BY f.recording_id, f.channel, p.pos, n)"""


@query(
    "L-5",
    sql=f"""WITH {WIN}, {ENV}, r AS (SELECT * FROM env WHERE channel = {REF}), {_delay_sql('env', 'r')}
SELECT recording_id, 'envelope' AS method, channel, CASE WHEN channel = {REF} THEN 0 ELSE delay END AS delay FROM dly""",
)
def delays_envelope(t):
    return method_delays(t, "envelope")


@query(
    "D-20",
    sql=f"""WITH {WIN}, {ENV} SELECT recording_id, det.idx AS det_id, channel,
 coalesce(min(pos) FILTER (x > 0.3) + 1, min(pos) FILTER (x > 0.15) + 1, -99999999) AS place
FROM env JOIN det USING (recording_id) GROUP BY ALL""",
)
def window_crossings(t):
    return synchronization.window_crossings(cut(t), 0.3)


# low-pass of the envelope: padded to the next 5-smooth length at 64 kHz
_SMOOTH = [v for v in range(1, 65) if v in {2**a * 3**b * 5**c for a in range(7) for b in range(4) for c in range(3)}]
_LP = f"1 / (1 + pow(tan(pi() * k / size) / {math.tan(math.pi * 10_000 / 64_000)!r}, 8))"
LOW = f"""sz AS (SELECT recording_id, n, (SELECT min(v) FROM (SELECT unnest({_SMOOTH}) AS v) WHERE v >= 2 * n) AS size FROM len),
 kk AS (SELECT recording_id, size, unnest(range(0, size // 2 + 1)) AS k FROM sz),
 lf AS (SELECT e.recording_id, e.channel, k, size, sum(x * cos({_TAU} * k * pos / size)) AS re, -sum(x * sin({_TAU} * k * pos / size)) AS im
        FROM env e JOIN kk USING (recording_id) GROUP BY ALL),
 lg AS (SELECT *, CASE WHEN 2 * k = size THEN 0 WHEN k = 0 THEN 1 ELSE 2 * ({_LP}) END AS h FROM lf),
 low AS (SELECT g.recording_id, g.channel, p.pos, sum(h * (re * cos({_TAU} * k * p.pos / size) - im * sin({_TAU} * k * p.pos / size))) / size AS x
         FROM lg g JOIN (SELECT DISTINCT recording_id, pos FROM win) p USING (recording_id) GROUP BY g.recording_id, g.channel, p.pos, size)"""


@query(
    "L-6",
    sql=f"""WITH {WIN}, {ENV}, {LOW}, r AS (SELECT * FROM low WHERE channel = {REF}), {_delay_sql('low', 'r')}
SELECT recording_id, 'envelope_filtered' AS method, channel, CASE WHEN channel = {REF} THEN 0 ELSE delay END AS delay FROM dly""",
)
def delays_envelope_filtered(t):
    found = tdoa.delays(cut(t), ["envelope_filtered"], REF, 64_000.0)
    rows = tdoa.per_channel(found)
    return rows.select("recording_id", "method", F.col("channel").cast("bigint").alias("channel"), F.col("delay").cast("bigint").alias("delay"))


@query(
    "L-7",
    sql=f"""WITH {WIN}, pl AS (SELECT recording_id, channel, arg_min(pos, (-x, pos)) AS hi, arg_min(pos, (x, pos)) AS lo FROM win GROUP BY ALL),
 rf AS (SELECT recording_id, hi AS rhi, lo AS rlo FROM pl WHERE channel = {REF})
SELECT recording_id, 'max' AS method, channel, hi - rhi AS delay FROM pl JOIN rf USING (recording_id)
UNION ALL SELECT recording_id, 'min', channel, lo - rlo FROM pl JOIN rf USING (recording_id)""",
)
def delays_extremes(t):
    return method_delays(t, "max", "min")


@query("L-8", sql=f"WITH {MINMAX_SQL} SELECT * FROM del")
def delays_minmax(t):
    return method_delays(t, "minmax", "minmax_abs")


@query(
    "L-10",
    sql=f"""WITH {WIN}, m AS (SELECT recording_id, channel, max(x) AS top FROM win GROUP BY ALL)
SELECT recording_id, 'trigger' AS method, channel, coalesce(min(pos) FILTER (abs(x) > top * 0.75), -1) + 1 AS delay
FROM win JOIN m USING (recording_id, channel) GROUP BY recording_id, channel""",
)
def delays_trigger(t):
    return method_delays(t, "trigger")


# one Haar level at both shifts: samples in pairs, differences shrunk by the universal threshold
HAAR = f"""len AS (SELECT recording_id, max(pos) + 1 AS n FROM win GROUP BY recording_id),
 sh AS (SELECT w.recording_id, w.channel, s.s, (w.pos - s.s + len.n) % len.n AS q, w.x, len.n
        FROM win w JOIN len USING (recording_id) CROSS JOIN (VALUES (0), (1)) s(s)),
 pr AS (SELECT recording_id, channel, s, n, q // 2 AS pair, max(x) FILTER (q % 2 = 0) AS a, max(x) FILTER (q % 2 = 1) AS b
        FROM sh GROUP BY ALL),
 df AS (SELECT *, (a + b) / sqrt(2) AS mean, (a - b) / sqrt(2) AS diff FROM pr WHERE b IS NOT NULL),
 lm AS (SELECT recording_id, channel, s, median(abs(diff)) / 0.6745 * sqrt(2 * ln(max(n))) AS lim FROM df GROUP BY ALL),
 sf AS (SELECT d.*, sign(diff) * greatest(abs(diff) - lim, 0) AS soft FROM df d JOIN lm USING (recording_id, channel, s)),
 bk AS (SELECT h.recording_id, h.channel, (h.q + h.s) % h.n AS pos,
        CASE WHEN sf.pair IS NULL THEN h.x WHEN h.q % 2 = 0 THEN (mean + soft) / sqrt(2) ELSE (mean - soft) / sqrt(2) END AS x
        FROM sh h LEFT JOIN sf ON sf.recording_id = h.recording_id AND sf.channel = h.channel AND sf.s = h.s AND sf.pair = h.q // 2),
 dn AS (SELECT recording_id, channel, pos, sum(x) / 2 AS x FROM bk GROUP BY ALL)"""


@query(
    "L-11",
    sql=f"""WITH {WIN}, {HAAR}, m AS (SELECT recording_id, channel, max(x) AS top FROM dn GROUP BY ALL)
SELECT recording_id, 'trigger_denoised' AS method, channel, coalesce(min(pos) FILTER (abs(x) > top * 0.75), -1) + 1 AS delay
FROM dn JOIN m USING (recording_id, channel) GROUP BY recording_id, channel""",
)
def delays_trigger_denoised(t):
    return method_delays(t, "trigger_denoised")


# directions: sensors of the four-sided preset, 500 kHz
RX = geometry("triangle_40cm")
RATE, C = 500_000.0, 1540.0
# the same with a fourth sensor ahead of them: every channel of a recording has its sensor
RX4 = [*RX, (0.0, 0.31, 0.0)]


def _direction_sql(source: str, cost: str, sensors=RX, rate: float = RATE) -> str:
    """Directions of a table `source` with id, d1, d2, ... (one per sensor) by eigenvectors and bisection."""
    rx = np.array(sensors)
    sign = -1.0 if cost == "azimuth_elevation" else 1.0
    model = sign * (rx[:, :2] - rx[REF - 1, :2]) * rate / C
    values, vec = np.linalg.eigh(model.T @ model)
    text = np.vectorize(lambda v: f"({float(v)!r}::DOUBLE)")
    rows = {f"e{m}": ab for m, ab in enumerate(text(model).tolist(), 1) if m != REF}
    errors = ", ".join(f"d{e[1:]} - d{REF} AS {e}" for e in rows)
    along = [" + ".join(f"{e} * {ab[k]}" for e, ab in rows.items()) for k in (0, 1)]
    missed = " + ".join(f"pow({e} - ({a} * u + {b} * v), 2)" for e, (a, b) in rows.items())
    each = ", ".join(rows)
    (v11, v12), (v21, v22) = text(vec).tolist()
    m1, m2 = text(values).tolist()
    circle = cost == "azimuth"
    low = "0.0" if circle else m1
    gap = f"({m2} - {m1})"
    inside = "false" if circle else "pow(f1, 2) + pow(f2, 2) <= 1"
    rest = "CASE WHEN rim THEN 0 ELSE sqrt(greatest(1 - u * u - v * v, 0)) END"
    angles = {
        "azimuth_elevation": (f"atan2(u, {rest})", "asin(greatest(least(v, 1.0), -1.0))"),
        "azimuth": ("atan2(u, v)", "0.0::DOUBLE"),
        "plan": ("atan2(u, v)", f"asin({rest})"),
    }[cost]
    return f"""
 src AS (SELECT id, {errors} FROM {source}),
 rot AS (SELECT *, ({along[0]}) * {v11} + ({along[1]}) * {v21} AS g1,
                   ({along[0]}) * {v12} + ({along[1]}) * {v22} AS g2 FROM src),
 fre AS (SELECT *, g1 / {m1} AS f1, g2 / {m2} AS f2 FROM rot),
 bis AS (SELECT id, g1, g2, {low}::DOUBLE AS lo, sqrt(g1 * g1 + g2 * g2) + {m2} AS hi, 0 AS step FROM fre WHERE NOT ({inside})
   UNION ALL
   SELECT id, g1, g2, CASE WHEN far THEN mid ELSE lo END, CASE WHEN far THEN hi ELSE mid END, step + 1
   FROM (SELECT *, (lo + hi) / 2 AS mid, pow(g1 / ((lo + hi) / 2), 2) + pow(g2 / ((lo + hi) / 2 + {gap}), 2) > 1 AS far FROM bis)
   WHERE step < 100),
 edg AS (SELECT id, CASE WHEN g1 = 0 THEN sqrt(greatest(1 - pow(g2 / (hi + {gap}), 2), 0)) ELSE g1 / hi END AS q1, g2 / (hi + {gap}) AS q2
         FROM bis WHERE step = 100),
 sol AS (SELECT f.id, {each}, q1 IS NOT NULL AS rim,
         coalesce(q1 / sqrt(q1 * q1 + q2 * q2), f1) AS s1, coalesce(q2 / sqrt(q1 * q1 + q2 * q2), f2) AS s2
         FROM fre f LEFT JOIN edg USING (id)),
 uv0 AS (SELECT id, {each}, rim, s1 * {v11} + s2 * {v12} AS u, s1 * {v21} + s2 * {v22} AS v FROM sol),
 uv AS (SELECT id, {each}, rim, CASE WHEN abs(u) < 1e-12 THEN 0 ELSE u END AS u, CASE WHEN abs(v) < 1e-12 THEN 0 ELSE v END AS v FROM uv0),
 dir AS (SELECT id, {angles[0]} AS az, {angles[1]} AS el,
         {missed} AS residual FROM uv)"""


EVENT_DELAYS = """dl AS (SELECT event_id AS id, (event_id * 37) % 301 - 150 AS d1, (event_id * 91 + user_id) % 283 - 141 AS d2,
   user_id % 7 AS d3 FROM events)"""


def event_delays(t):
    e, u = F.col("event_id"), F.col("user_id")
    parts = [(e * 37) % 301 - 150, (e * 91 + u) % 283 - 141, u % 7]
    return t.events.select(e.alias("det_id"), F.array(*[p.cast("int") for p in parts]).alias("delays"))


def _event_directions(t, cost):
    found = directions.directions(event_delays(t), RX, RATE, C, REF, cost)
    return found.select(
        "det_id", F.round("az", 6).alias("az"), F.round("el", 6).alias("el"), F.round("residual", 4).alias("residual")
    )


def _event_sql(cost):
    return f"""WITH RECURSIVE {EVENT_DELAYS}, {_direction_sql('dl', cost)}
SELECT id AS det_id, round(az, 6) AS az, round(el, 6) AS el, round(residual, 4) AS residual FROM dir"""


@query("L-12", "L-14", sql=_event_sql("azimuth_elevation"))
def directions_far_field(t):
    return _event_directions(t, "azimuth_elevation")


@query("L-13", sql=_event_sql("azimuth"))
def directions_azimuth(t):
    return _event_directions(t, "azimuth")


@query("L-13", sql=_event_sql("plan"))
def directions_plan(t):
    return _event_directions(t, "plan")


_PIVOT = """dl AS (SELECT recording_id AS id, max(delay) FILTER (channel = 1) AS d1, max(delay) FILTER (channel = 2) AS d2,
   max(delay) FILTER (channel = 3) AS d3, max(delay) FILTER (channel = 4) AS d4 FROM del WHERE method = '{method}' GROUP BY recording_id)"""


@query(
    "L-16", "D-5",
    sql=f"""WITH RECURSIVE {MINMAX_SQL}, {_PIVOT.format(method='minmax')}, {_direction_sql('dl', 'azimuth_elevation', RX4)}
SELECT id AS recording_id, round(az, 6) AS az, round(el, 6) AS el, round(residual, 4) AS residual FROM dir""",
)
def detection_bearings(t):
    found = tdoa.detection_delays(embedding_blocks(t), detections(t), LO, HI, BLOCK, [tdoa.DEFAULT_METHOD], REF, RATE)
    out = directions.directions(found, RX4, RATE, C, REF)
    return out.select("recording_id", F.round("az", 6).alias("az"), F.round("el", 6).alias("el"), F.round("residual", 4).alias("residual"))


TIMED = f"""{SMP}, det AS (SELECT recording_id, arg_min(idx, (-x, idx)) AS idx FROM smp WHERE channel = {REF} GROUP BY recording_id),
 win AS (SELECT s.recording_id, s.channel, s.idx, s.x, d.idx AS det_idx, s.idx - d.idx AS pos FROM smp s JOIN det d USING (recording_id)
         WHERE s.idx BETWEEN d.idx AND d.idx + 16)"""


@query(
    "L-9",
    sql=f"""WITH RECURSIVE {TIMED}, r AS (SELECT * FROM win WHERE channel = {REF}), {_delay_sql('win', 'r')},
 del AS (SELECT recording_id, 'raw' AS method, channel, CASE WHEN channel = {REF} THEN 0 ELSE delay END AS delay FROM dly),
 {_PIVOT.format(method='raw')}, {_direction_sql('dl', 'azimuth_elevation', RX4)}
SELECT id AS recording_id, round(az, 6) AS az, round(el, 6) AS el FROM dir""",
)
def timed_bearings(t):
    found = tdoa.timed_delays(embedding_blocks(t), detections(t), 0.25, BLOCK, REF, FS)
    out = directions.directions(found, RX4, RATE, C, REF)
    return out.select("recording_id", F.round("az", 6).alias("az"), F.round("el", 6).alias("el"))


FOV_X, FOV_Y, WIDTH, HEIGHT, FPS = 54, 34, 3840, 2160, 8


def _method_track(name: str, sql: str, method: str) -> str:
    """CTEs of one method under a prefix of their own, ending in the table `name`."""
    return f"""{name} AS (WITH RECURSIVE {sql}, {_PIVOT.format(method=method)}, {_direction_sql('dl', 'azimuth_elevation')}
 SELECT d.id AS recording_id, '{method}' AS method, az, el, det.idx FROM dir d JOIN det ON det.recording_id = d.id)"""


@query(
    "L-19",
    sql=f"""WITH {_method_track('t1', ENERGY_SQL, 'max_energy')}, {_method_track('t2', PEAK_SQL, 'max_peak')}, {_method_track('t3', MINMAX_SQL, 'minmax')},
 every AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3)
SELECT recording_id, method, CAST(round_even((idx - 1) / {FS}::DOUBLE * {FPS}, 0) AS BIGINT) + 1 AS frame,
 round(degrees(az) / ({FOV_X} / 2.0::DOUBLE) * ({WIDTH} / 2) + {WIDTH} / 2, 4) AS px,
 round(degrees(el) / (-{FOV_Y} / 2.0::DOUBLE) * ({HEIGHT} / 2) + {HEIGHT} / 2, 4) AS py FROM every""",
)
def method_tracks(t):
    # energy and peak references are chosen over all four channels, directions from the first three
    found = tdoa.delays(cut(t), ["max_energy", "max_peak", "minmax"], REF, RATE)
    out = directions.directions(found, RX, RATE, C, REF)
    return out.select(
        "recording_id",
        "method",
        fc.video_frame((F.col("idx") - 1) / F.lit(FS), FPS).alias("frame"),
        F.round(fc.pixel_x(F.col("az"), FOV_X, WIDTH), 4).alias("px"),
        F.round(fc.pixel_y(F.col("el"), FOV_Y, HEIGHT), 4).alias("py"),
    )


STEER = [[0.0, 2 / FS, -3 / FS, 5 / FS], [0.0, -1 / FS, 2 / FS, -4 / FS], [0.0, 0.0, 1 / FS, 3 / FS], [0.0, 4 / FS, -2 / FS, 0.0]]


@query(
    "L-22",
    sql=f"""WITH {WIN}, st(channel, direction, shift) AS (VALUES {", ".join(f"({j + 1}, {k + 1}, {int(np.rint(-STEER[j][k] * FS))})" for j in range(4) for k in range(4))}),
 grid AS (SELECT DISTINCT recording_id, pos FROM win),
 bf AS (SELECT g.recording_id, d.direction, g.pos, coalesce(sum(w.x), 0) AS y FROM grid g CROSS JOIN (SELECT DISTINCT direction FROM st) d
        JOIN st ON st.direction = d.direction
        LEFT JOIN win w ON w.recording_id = g.recording_id AND w.channel = st.channel AND w.pos = g.pos - st.shift
        GROUP BY g.recording_id, d.direction, g.pos),
 lv AS (SELECT recording_id, direction, round(20 * log10(max(y) - min(y)), 6) AS level_db FROM bf GROUP BY ALL)
SELECT recording_id, arg_min(direction, (-level_db, direction))::BIGINT AS direction, max(level_db) AS level_db FROM lv GROUP BY recording_id""",
)
def best_beams(t):
    best = directions.beam_levels(cut(t), np.array(STEER), FS)
    return best.select("recording_id", "direction", F.round("level_db", 6).alias("level_db"))


CANDIDATES = [[(x * k, y * k, z) for x, y, z in RX] for k in (0.8, 0.9, 1.0, 1.1, 1.25)]


def _calibration_sql():
    parts = []
    for k, rx in enumerate(CANDIDATES):
        for m, s in enumerate(rx):
            dx, dy, dz = (repr((p - q) / 1500.0 * 400_000.0) for p, q in zip(s, rx[REF - 1]))
            parts.append(f"({k}, {m + 1}, {dx}::DOUBLE, {dy}::DOUBLE, {dz}::DOUBLE)")
    return f"""WITH {EVENT_DELAYS}, g(candidate, m, dx, dy, dz) AS (VALUES {", ".join(parts)}),
 a AS (SELECT id, d1, d2, d3, (id % 629) / 100.0::DOUBLE - 3.14 AS az, (id % 157) / 100.0::DOUBLE - 0.78 AS el FROM dl),
 e AS (SELECT candidate, pow([d1, d2, d3][m] - d3 - (dx * sin(az) * cos(el) + dy * sin(el) + dz * cos(az) * cos(el)), 2) AS err FROM a CROSS JOIN g)
SELECT candidate, round(sum(err) / 1e6, 6) AS cost FROM e GROUP BY candidate"""


@query("L-23", sql=_calibration_sql())
def geometry_costs(t):
    n = F.col("det_id")
    pings = event_delays(t).withColumns({"az": (n % 629) / F.lit(100.0) - 3.14, "el": (n % 157) / F.lit(100.0) - 0.78})
    out = directions.geometry_cost(pings, CANDIDATES, 400_000.0, 1500.0, REF)
    return out.select("candidate", F.round(F.col("cost") / 1e6, 6).alias("cost"))


@query(
    "V-2",
    sql=f"""WITH {SMP}, fr AS (SELECT recording_id, unnest(range(1, 11)) AS frame FROM (SELECT DISTINCT recording_id FROM smp)),
 b AS (SELECT *, CAST(round_even(((frame - 1) / 8.0::DOUBLE - (recording_id % 5) / 10.0::DOUBLE) * {FS} + 1, 0) AS BIGINT) AS begin_idx FROM fr),
 p AS (SELECT recording_id, frame, begin_idx, unnest(range(1, 17)) AS pos FROM b)
SELECT p.recording_id, frame, pos, coalesce(s.x, 0) AS x FROM p LEFT JOIN smp s ON s.recording_id = p.recording_id AND s.channel = {REF} AND s.idx = begin_idx + pos""",
)
def frame_audio(t):
    one = embedding_blocks(t).where(F.col("channel") == REF)
    frames = embedding_blocks(t).select("recording_id").distinct().select(  # of recordings without that channel too
        "recording_id",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(10).cast("bigint"))).alias("frame"),
        F.lit(8.0).alias("fps"),
        ((F.col("recording_id") % 5) / F.lit(10.0)).alias("sync_s"),
    )
    out = overlay.frame_audio(one, frames, FS, 16, BLOCK)
    return out.select("recording_id", "frame", F.posexplode("samples").alias("_p", "x")).select(
        "recording_id", "frame", (F.col("_p") + 1).cast("bigint").alias("pos"), "x"
    )


CHIRP = np.sin(2 * np.pi * np.cumsum(np.linspace(0.05, 0.3, 12)))


_REFERENCE = tdoa.analytic(CHIRP) * 2 / (np.std(tdoa.analytic(CHIRP), ddof=1) * 12)


@query(
    "S-14",
    sql=f"""WITH {SMP}, ref AS (SELECT unnest({_REFERENCE.real.tolist()!r}::DOUBLE[]) AS a, unnest({_REFERENCE.imag.tolist()!r}::DOUBLE[]) AS b, unnest(range(0, 12)) AS j),
 cr AS (SELECT s.recording_id, s.channel, s.idx - j AS idx, sum(s.x * a) AS re, -sum(s.x * b) AS im FROM smp s CROSS JOIN ref WHERE s.idx - j >= 1 GROUP BY ALL),
 mf AS (SELECT *, sqrt(re * re + im * im) AS m FROM cr),
 pk AS (SELECT *, lag(m) OVER w < m AND lead(m) OVER w <= m AS peak FROM mf WINDOW w AS (PARTITION BY recording_id, channel ORDER BY idx)),
 bd AS (SELECT p.recording_id, p.channel, p.idx, p.m, p.re, p.im, coalesce(max(q.idx) FILTER (q.idx < p.idx AND q.m > p.m), 0) AS lo,
   coalesce(min(q.idx) FILTER (q.idx > p.idx AND q.m > p.m), 65) AS hi, max(q.m) AS best
   FROM pk p JOIN mf q USING (recording_id, channel) WHERE p.peak GROUP BY ALL),
 vl AS (SELECT b.recording_id, b.channel, b.idx, b.m, b.re, b.im, b.best, min(q.m) FILTER (q.idx < b.idx) AS lv, min(q.m) FILTER (q.idx > b.idx) AS rv
   FROM bd b JOIN mf q ON q.recording_id = b.recording_id AND q.channel = b.channel AND q.idx > b.lo AND q.idx < b.hi GROUP BY ALL),
 pr AS (SELECT *, m - greatest(lv, rv) AS rise FROM vl),
 ok AS (SELECT *, count(*) OVER (PARTITION BY recording_id, channel) AS c FROM pr WHERE rise >= best * 0.2)
SELECT recording_id, channel, idx, round(m, 7) AS strength, round(re, 7) + 0.0 AS re, round(im, 7) + 0.0 AS im FROM ok WHERE c <= 64 / 10.0
QUALIFY row_number() OVER (PARTITION BY recording_id, channel ORDER BY m DESC, idx) <= 3""",
)
def arrivals(t):
    empty = F.array().cast("array<double>")
    whole = embedding_blocks(t).withColumns({"left_halo": empty, "right_halo": empty})
    return tdoa.arrivals(whole, CHIRP, 3, prominence=0.2).withColumns({c: F.round(c, 7) + 0.0 for c in ("strength", "re", "im")})


TONAL_HITS = f"""{SMP}, bins AS (SELECT unnest(range(1, 7)) AS bin),
 ft AS (SELECT recording_id, (idx - 1) // 16 AS frame, bin, sum(x * cos({_TAU} * bin * ((idx - 1) % 16) / 16)) AS re,
        sum(x * sin({_TAU} * bin * ((idx - 1) % 16) / 16)) AS im FROM smp CROSS JOIN bins WHERE channel = {REF} GROUP BY ALL),
 st AS (SELECT recording_id, frame, max(10 * log10((re * re + im * im) / ({FS} * 16) * 2)) AS stat FROM ft GROUP BY ALL),
 det AS (SELECT recording_id * 10 + frame AS recording_id, recording_id AS rec, frame, frame * 16 + 8 AS idx FROM st WHERE stat > -30
         QUALIFY frame < max(frame) OVER (PARTITION BY rec)),
 win AS (SELECT d.recording_id, s.channel, s.idx, s.x, d.idx AS det_idx, s.idx - d.idx AS pos FROM smp s JOIN det d ON d.rec = s.recording_id
         WHERE s.idx BETWEEN d.idx AND d.idx + 16)"""


@query(
    "D-14",
    sql=f"""WITH RECURSIVE {TONAL_HITS}, r AS (SELECT * FROM win WHERE channel = {REF}), {_delay_sql('win', 'r')},
 del AS (SELECT recording_id, 'raw' AS method, channel, CASE WHEN channel = {REF} THEN 0 ELSE delay END AS delay FROM dly),
 {_PIVOT.format(method='raw')}, {_direction_sql('dl', 'azimuth_elevation', RX4)}
SELECT id // 10 AS recording_id, id % 10 AS det_id, round(az, 6) AS az, round(el, 6) AS el FROM dir""",
)
def tonal_bearings(t):
    """Simple tonal hits, each with the direction of the quarter second after it."""
    b = embedding_blocks(t)
    settings = tonal.TonalSettings(fs=FS, nfft=16, low=8.0, high=28.0, ref_channel=REF, threshold=-30.0)
    hits = tonal.tonal_detections(tonal.simple_tonal_frames(b, settings), FS)
    found = tdoa.timed_delays(b, hits, 0.25, BLOCK, REF, FS)
    out = directions.directions(found, RX4, RATE, C, REF)
    return out.select("recording_id", "det_id", F.round("az", 6).alias("az"), F.round("el", 6).alias("el"))
