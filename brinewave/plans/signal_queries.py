"""Filters, envelopes, impulses and PCM frames on orders, embeddings and documents."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from brinewave.functions import kernels
from brinewave.operators import blocks, filters, impulses, order_statistics, recordings, synchronization, trains
from brinewave.plans.registry import query
from brinewave.plans.sample_queries import BLOCK, _trigger_sql, long_blocks
from brinewave.plans.standins import LONG, SMP, embedding_blocks, long_samples
from brinewave.session import cut_lineage
from brinewave.sources import pcm

FS = 1000.0
HALO, LONG_HALO = 512, 2048  # some three times the settling lengths of the bands below
BAND, LOW = (50.0, 200.0), (0.0, 40.0)
STOPS = [(90.0, 110.0), (190.0, 210.0)]


def _taps(band, stops=(), quadrature: bool = False, half: int = HALO, fs: float = FS) -> str:
    """The response to one impulse of a filter (or of its quarter-turned form) from -half to half, as an SQL list."""
    size = 1 << 17
    spectrum = kernels.band_gain(np.fft.rfftfreq(size, 1 / fs), fs, band, stops, 4)
    full = np.zeros(size, dtype=complex)
    full[: len(spectrum)] = spectrum
    full[1 : size // 2] *= 2
    response = np.fft.ifft(full)
    response = response.imag if quadrature else response.real
    # the list meets samples in ascending order: reversed
    return "[" + ", ".join(f"{v:.17g}" for v in np.concatenate([response[-half:], response[: half + 1]])[::-1]) + "]::DOUBLE[]"


TILE = 1024  # samples of a list in SQL


def _padded_sql(name: str, source: str, half: int = HALO) -> str:
    """Lists of TILE samples of each channel of `source`, with as many on either side as taps reach; zeros beyond its ends."""
    return f"""{name}_n AS (SELECT recording_id, channel, max(idx) AS n FROM {source} GROUP BY ALL),
 {name}_z AS (SELECT recording_id, channel, idx, x FROM {source}
   UNION ALL SELECT recording_id, channel, unnest(range(1 - {half}, 1)), 0.0::DOUBLE FROM {name}_n
   UNION ALL SELECT recording_id, channel, unnest(range(n + 1, n + {half + TILE})), 0.0::DOUBLE FROM {name}_n),
 {name}_t AS (SELECT *, unnest(range((idx + {TILE * 8} - 1 - {half}) // {TILE} - 8, (idx + {TILE * 8} - 1 + {half}) // {TILE} - 7)) AS tile FROM {name}_z),
 {name} AS (SELECT recording_id, channel, tile, any_value(n) AS n, list(x ORDER BY idx) AS xs FROM {name}_t JOIN {name}_n USING (recording_id, channel)
            WHERE tile >= 0 AND tile * {TILE} < n GROUP BY recording_id, channel, tile)"""


def _filtered_sql(name: str, source: str, value: str, half: int = HALO) -> str:
    """`value` of every sample, where s(taps) is the sum of the samples around it times the taps."""
    value = re.sub(r"s\((\w+)\)", rf"list_dot_product(xs[place : place + {2 * half}], \1)", value)
    return f"""{name} AS (SELECT recording_id, channel, tile * {TILE} + place AS idx, {value} AS x
   FROM (SELECT *, unnest(range(1, {TILE + 1})) AS place FROM {source}), taps WHERE tile * {TILE} + place <= n)"""


def rounded(df):
    return blocks.to_samples(df).withColumn("x", F.round("x", 4) + 0.0)


_ROUNDED = "SELECT recording_id, channel, idx, round(x, 4) + 0.0 AS x"


@query("F-1", sql=f"WITH {LONG}, taps AS (SELECT {_taps(BAND)} AS h), {_padded_sql('p', 'lng')}, {_filtered_sql('y', 'p', 's(h)')} {_ROUNDED} FROM y")
def band_passed(t):
    return rounded(filters.filter_blocks(long_blocks(t, HALO), FS, BAND))


@query(
    "F-2",
    sql=f"""WITH {LONG}, taps AS (SELECT {_taps((30.0, np.inf), STOPS, half=LONG_HALO)} AS h), {_padded_sql('p', 'lng', LONG_HALO)},
 {_filtered_sql('y', 'p', 's(h)', LONG_HALO)} {_ROUNDED} FROM y""",
)
def band_stopped(t):
    return rounded(filters.filter_blocks(long_blocks(t, LONG_HALO), FS, (30.0, np.inf), STOPS))


LONG_ENVELOPE = f"""{LONG}, taps AS (SELECT {_taps(BAND)} AS h, {_taps(BAND, quadrature=True)} AS q, {_taps(LOW)} AS l), {_padded_sql('p', 'lng')},
 {_filtered_sql('e', 'p', 'sqrt(pow(s(h), 2) + pow(s(q), 2))')}"""


@query("F-3", sql=f"WITH {LONG_ENVELOPE} {_ROUNDED} FROM e")
def envelopes(t):
    return rounded(filters.filter_blocks(long_blocks(t, HALO), FS, BAND, envelope=True))


@query("F-4", sql=f"WITH {LONG_ENVELOPE}, {_padded_sql('ep', 'e')}, {_filtered_sql('y', 'ep', 's(l)')} {_ROUNDED} FROM y")
def smooth_envelopes(t):
    return rounded(filters.envelope_lowpassed(long_blocks(t, 2 * HALO), FS, LOW[1], BAND))


@query(
    "D-3",
    sql=f"WITH {LONG} SELECT recording_id, channel, round(quantile_cont(x, 0.75) * 4, 6) AS threshold FROM lng GROUP BY ALL",
)
def block_threshold(t):
    got = order_statistics.block_quantile(long_blocks(t), ["recording_id", "channel"], "samples", 0.75, "q")
    return got.select("recording_id", "channel", F.round(F.col("q") * 4, 6).alias("threshold"))


def _impulses_sql(dist: int, ratio: float) -> str:
    return f"""{LONG_ENVELOPE},
 th AS (SELECT recording_id, quantile_cont(x, 0.75) * {ratio} AS threshold FROM e WHERE channel = 1 GROUP BY recording_id),
 tops AS (SELECT *, max(x) OVER w AS m, count(*) OVER w AS c, max(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN {dist} PRECEDING AND 1 PRECEDING) AS prev
   FROM e WHERE channel = 1 WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN {dist} PRECEDING AND {dist} FOLLOWING)),
 hits AS (SELECT recording_id, idx, x AS peak, threshold FROM tops JOIN th USING (recording_id)
          WHERE c = {2 * dist + 1} AND x = m AND prev < x AND x > threshold)"""


def long_impulses(t, dist: int, ratio: float):
    return impulses.detect_impulses(long_blocks(t, HALO), FS, BAND, ref_channel=1, dist=dist, ratio=ratio)


@query(
    "D-4",
    sql=f"""WITH {_impulses_sql(20, 1.2)} SELECT recording_id, 'impulse' AS kind, idx AS det_id, idx, (idx - 1) / {FS}::DOUBLE AS t_s,
            round(peak, 4) AS peak, round(threshold, 4) AS threshold FROM hits""",
)
def impulse_detections(t):
    return long_impulses(t, 20, 1.2).withColumns({c: F.round(c, 4) for c in ("peak", "threshold")})


# many short trains: three clicks within 22 samples
TRAIN, WITHIN = 2, 22


@query(
    "D-4", "D-7",
    sql=f"""WITH {_impulses_sql(3, 0.9)},
 flagged AS (SELECT *, coalesce(lead(idx, {TRAIN}) OVER w - idx < {WITHIN}, false) AS starts FROM hits WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
 marked AS (SELECT *, bool_or(starts) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN {TRAIN} PRECEDING AND CURRENT ROW) AS is_member FROM flagged),
 broken AS (SELECT *, CASE WHEN lag(is_member) OVER w = is_member THEN 0 ELSE 1 END AS brk, lead(idx) OVER w AS next_idx
            FROM marked WINDOW w AS (PARTITION BY recording_id ORDER BY idx)),
 numbered AS (SELECT *, sum(brk) OVER (PARTITION BY recording_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS run FROM broken),
 len AS (SELECT recording_id, max(idx) AS n FROM lng GROUP BY recording_id)
SELECT recording_id, min(idx) AS start_idx, max(coalesce(next_idx, n)) AS end_idx, max(idx) AS last_member_idx, count(*) AS n_dets, round(max(peak), 4) AS level
FROM numbered JOIN len USING (recording_id) WHERE is_member GROUP BY recording_id, run""",
)
def impulse_trains(t):
    lengths = long_samples(t).groupBy("recording_id").agg(F.max("idx").alias("n_samples"))
    runs = trains.click_trains(cut_lineage(long_impulses(t, 3, 0.9)), TRAIN, WITHIN, BLOCK * 4, lengths)
    return runs.withColumn("level", F.round("level", 4))


# noise of a narrow band: thinned to a tenth, then band-passed at the slow rate
THIN, NOISE, NOISE_FRAME, LOUD = 10, (1.0, 30.0), 20, 2e8


@query(
    "D-17",
    sql=f"""WITH {LONG}, one AS (SELECT * FROM lng WHERE channel = 1), taps AS (SELECT {_taps((0.0, 0.4 * FS / THIN))} AS l, {_taps(NOISE, half=LONG_HALO, fs=FS / THIN)} AS b),
 {_padded_sql('p', 'one')}, {_filtered_sql('y', 'p', 's(l)')},
 thin AS (SELECT recording_id, channel, (idx - 1) // {THIN} + 1 AS idx, x FROM y WHERE (idx - 1) % {THIN} = 0),
 {_padded_sql('tp', 'thin', LONG_HALO)}, {_filtered_sql('z', 'tp', 's(b)', LONG_HALO)},
 f AS (SELECT recording_id, (idx - 1) // {NOISE_FRAME} AS frame, sum(x * x) / {NOISE_FRAME} AS energy FROM z GROUP BY ALL HAVING count(*) = {NOISE_FRAME}),
 hits AS (SELECT * FROM f WHERE energy > {LOUD})
SELECT recording_id, frame, round(energy / 1e6, 4) AS energy FROM hits WHERE frame < (SELECT max(frame) FROM hits)""",
)
def band_noise_frames(t):
    """The whole operator: samples low-passed and thinned in their blocks, band-passed, framed, the last hit dropped."""
    seconds = NOISE_FRAME / (FS / THIN) / recordings.NOISE_FRAMES
    hits = recordings.noise_hits(long_blocks(t, HALO), FS, 1, seconds, LOUD, NOISE, THIN)
    return hits.select("recording_id", "frame", F.round(F.col("energy") / 1e6, 4).alias("energy"))


# the text of a document as two-channel 16-bit frames: its UTF-16 code units are the samples
PCM = """pcm AS (SELECT doc_id, unnest(range(0, length(text))) AS p, unnest(string_split(text, '')) AS ch FROM documents),
 frames AS (SELECT doc_id, p // 2 + 1 AS idx, p % 2 + 1 AS channel, unicode(ch) AS u FROM pcm JOIN
   (SELECT doc_id, length(text) // 2 * 2 AS whole FROM documents) USING (doc_id) WHERE p < whole)"""


@query(
    "SRC-1",
    sql=f"WITH {PCM} SELECT doc_id, channel, count(*) AS n, min(u)::DOUBLE AS min_val, max(u)::DOUBLE AS max_val, sum(u * u)::DOUBLE AS energy FROM frames GROUP BY ALL",
)
def decoded_frames(t):
    raw = t.documents.select("doc_id", F.encode("text", "UTF-16LE").alias("content"))
    frames = pcm.decode_frames(raw, "content", 2).where(F.size("samples") > 0)  # texts of a letter or none have no frame
    stats = blocks.channel_stats(frames, "doc_id", "channel")
    return stats.select("doc_id", "channel", "n", "min_val", "max_val", "energy")


@query(
    "SRC-2",
    sql=f"WITH {PCM} SELECT doc_id, channel, idx, u::DOUBLE AS x FROM frames WHERE idx > 100 AND idx <= 200",
)
def decoded_range(t):
    raw = t.documents.select("doc_id", F.encode("text", "UTF-16LE").alias("content"))
    cut = pcm.decode_frames(pcm.byte_range(raw, "content", 2, 100, 100), "content", 2)
    rows = cut.select("doc_id", "channel", F.posexplode("samples").alias("_p", "x"))
    return rows.select("doc_id", "channel", (F.col("_p") + 101).cast("bigint").alias("idx"), "x")


# The same operators on embeddings, where the transforms can be written out: 64 samples at 64 Hz, padded to 128.
RATE, N, SIZE = 64.0, 64, 128
TAU = repr(2 * np.pi)


def _gain_sql(band, stops=(), order: int = 4) -> str:
    """Squared magnitude of the filters at frequency f, as SQL text."""

    def one(low, high, stop=False):
        w = f"tan(pi() * f / {RATE})"
        w1, w2 = (float(np.tan(np.pi * v / RATE)) for v in (low, min(high, RATE / 2)))
        if low <= 0:
            ratio, at_zero, at_top = f"{w} / {w2!r}", "1", "0"
        elif np.isinf(high):
            ratio, at_zero, at_top = f"{w1!r} / {w}", "0", "1"
        else:
            ratio, at_zero, at_top = f"({w} * {w} - {w1 * w2!r}) / ({w2 - w1!r} * {w})", "0", "0"
            if stop:
                ratio, at_zero, at_top = f"({w2 - w1!r} * {w}) / ({w} * {w} - {w1 * w2!r})", "1", "1"
        return f"CASE WHEN f = 0 THEN {at_zero} WHEN f = {RATE / 2} THEN {at_top} ELSE 1 / (1 + pow(abs({ratio}), {2 * order})) END"

    parts = [one(*band)] if band[0] > 0 or not np.isinf(band[1]) else []
    return " * ".join(f"({p})" for p in parts + [one(*s, stop=True) for s in stops]) or "1"


def _stage(name: str, source: str, gain: str, envelope: bool = False) -> str:
    """A filter stage: `name`(recording_id, channel, idx, x) of `source` with the same columns."""
    ks = f"(SELECT unnest(range(0, {SIZE // 2} + 1)) AS k)"
    wave = f"{TAU} * k * (p.idx - 1) / {SIZE}"
    real = f"sum(h * (re * cos({wave}) - im * sin({wave}))) / {SIZE}"
    imag = f"sum(h * (re * sin({wave}) + im * cos({wave}))) / {SIZE}"
    value = f"sqrt(pow({real}, 2) + pow({imag}, 2))" if envelope else real
    return f"""{name}_ft AS (SELECT recording_id, channel, k, k * {RATE / SIZE} AS f,
   sum(x * cos({TAU} * k * (idx - 1) / {SIZE})) AS re, -sum(x * sin({TAU} * k * (idx - 1) / {SIZE})) AS im FROM {source} CROSS JOIN {ks} GROUP BY ALL),
 {name}_g AS (SELECT recording_id, channel, k, re, im, ({gain}) * CASE WHEN k IN (0, {SIZE // 2}) THEN 1 ELSE 2 END AS h FROM {name}_ft),
 {name} AS (SELECT recording_id, channel, p.idx, {value} AS x FROM {name}_g CROSS JOIN (SELECT unnest(range(1, {N} + 1)) AS idx) p
            GROUP BY recording_id, channel, p.idx)"""


def whole_blocks(t):
    empty = F.array().cast("array<double>")
    return embedding_blocks(t).withColumns({"left_halo": empty, "right_halo": empty})


OUT = "SELECT recording_id, channel, idx, round(x, 7) + 0.0 AS x"


def rounded_7(df):
    return blocks.to_samples(df).withColumn("x", F.round("x", 7) + 0.0)


@query("F-1", sql=f"WITH {SMP}, {_stage('y', 'smp', _gain_sql((5.0, 15.0)))} {OUT} FROM y")
def channel_band_pass(t):
    return rounded_7(filters.filter_blocks(whole_blocks(t), RATE, (5.0, 15.0)))


@query("F-1", sql=f"WITH {SMP}, {_stage('y', 'smp', _gain_sql((0.0, 9.0)))} {OUT} FROM y")
def channel_low_pass(t):
    return rounded_7(filters.filter_blocks(whole_blocks(t), RATE, (0.0, 9.0)))


@query("F-2", sql=f"WITH {SMP}, {_stage('y', 'smp', _gain_sql((4.0, np.inf), [(9.0, 11.0), (18.0, 23.0)]))} {OUT} FROM y")
def channel_band_stop(t):
    return rounded_7(filters.filter_blocks(whole_blocks(t), RATE, (4.0, np.inf), [(9.0, 11.0), (18.0, 23.0)]))


@query("F-3", sql=f"WITH {SMP}, {_stage('y', 'smp', _gain_sql((5.0, 15.0)), True)} {OUT} FROM y")
def channel_envelope(t):
    return rounded_7(filters.filter_blocks(whole_blocks(t), RATE, (5.0, 15.0), envelope=True))


@query("F-4", sql=f"WITH {SMP}, {_stage('e', 'smp', '1', True)}, {_stage('y', 'e', _gain_sql((0.0, 6.0)))} {OUT} FROM y")
def channel_smooth_envelope(t):
    return rounded_7(filters.envelope_lowpassed(whole_blocks(t), RATE, 6.0))


IMPULSES = f"""ref AS (SELECT * FROM smp WHERE channel = 3), {_stage('e', 'ref', _gain_sql((5.0, 15.0)), True)},
 th AS (SELECT recording_id, quantile_cont(x, 0.75) * 1.1 AS threshold FROM e GROUP BY recording_id),
 tops AS (SELECT *, max(x) OVER w AS m, count(*) OVER w AS c, max(x) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS prev
   FROM e WINDOW w AS (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
 hits AS (SELECT recording_id, idx, x AS peak, threshold FROM tops JOIN th USING (recording_id)
          WHERE c = 7 AND x = m AND prev < x AND x > threshold)"""


def impulses_of(t):
    return impulses.detect_impulses(whole_blocks(t), RATE, (5.0, 15.0), ref_channel=3, dist=3, ratio=1.1)


@query(
    "D-4",
    sql=f"""WITH {SMP}, {IMPULSES} SELECT recording_id, 'impulse' AS kind, idx AS det_id, idx, (idx - 1) / {RATE}::DOUBLE AS t_s,
            round(peak, 7) AS peak, round(threshold, 7) AS threshold FROM hits""",
)
def channel_impulses(t):
    return impulses_of(t).withColumns({c: F.round(c, 7) for c in ("peak", "threshold")})


@query(
    "D-4", "D-6",
    sql=f"""WITH {SMP}, {IMPULSES},
 flagged AS (SELECT *, coalesce(lead(idx, 2) OVER (PARTITION BY recording_id ORDER BY idx) - idx < 20, false) AS starts FROM hits)
SELECT recording_id, idx, bool_or(starts) OVER (PARTITION BY recording_id ORDER BY idx ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS is_member FROM flagged""",
)
def channel_impulse_members(t):
    return trains.train_members(impulses_of(t), 2, 20, 8).select("recording_id", "idx", "is_member")


@query(
    "Y-2",
    sql=f"""WITH {SMP}, two AS (SELECT * FROM smp WHERE channel IN (1, 4)), {_stage('y', 'two', _gain_sql((5.0, 15.0)))},
 v AS (SELECT * FROM y WHERE channel = 1), a AS (SELECT * FROM y WHERE channel = 4), {_trigger_sql(0.60, 32, 'v')}, {_trigger_sql(0.81, 32, 'a', 'tr2')},
 r AS (SELECT DISTINCT recording_id FROM smp)
SELECT r.recording_id, (tr.idx - 1) / {RATE}::DOUBLE AS video_s, (tr2.idx - 1) / {RATE}::DOUBLE AS audio_s, (tr.idx - tr2.idx) / {RATE}::DOUBLE AS sync_s
FROM r LEFT JOIN tr USING (recording_id) LEFT JOIN tr2 USING (recording_id)""",
)
def band_clock_offsets(t):
    b = whole_blocks(t)
    return synchronization.clock_offsets(b.where("channel = 1"), b.where("channel = 4"), int(RATE), (5.0, 15.0))
