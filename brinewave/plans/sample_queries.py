"""Quantization on lineitem; statistics, transforms and peaks on embeddings and orders."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from brinewave.functions.columns import amplitude_db, power_db
from brinewave.operators import blocks, order_statistics, quantization as q, synchronization, windows
from brinewave.operators.groups import per_group
from brinewave.plans.registry import query
from brinewave.plans.standins import LONG, SMP, embedding_blocks, embedding_samples, long_samples
from brinewave.sinks import labels

BLOCK = 1024

# lineitem as sampled channels: quantity around zero on channels 1-4, discount on the others
QNT = """qnt AS (SELECT l_suppkey AS recording_id, CAST(l_linenumber AS BIGINT) AS channel,
   CASE WHEN l_linenumber <= 4 THEN l_quantity - 25 ELSE l_discount END AS x FROM lineitem),
 vals AS (SELECT DISTINCT recording_id, channel, x FROM qnt)"""


def quantized(t):
    x = F.when(F.col("l_linenumber") <= 4, F.col("l_quantity") - 25).otherwise(F.col("l_discount"))
    return t.lineitem.select(
        F.col("l_suppkey").alias("recording_id"), F.col("l_linenumber").cast("bigint").alias("channel"), x.alias("x")
    )


@query("Q-1", sql=f"WITH {QNT} SELECT recording_id, x, count(*) AS n FROM qnt GROUP BY recording_id, x")
def pooled_value_counts(t):
    return q.value_counts(quantized(t), ["recording_id"])


@query("Q-2", sql=f"WITH {QNT} SELECT recording_id, channel, x, count(*) AS n FROM qnt GROUP BY ALL")
def value_counts(t):
    return q.value_counts(quantized(t))


NEAR = """near AS (SELECT recording_id, channel, max(x) FILTER (x < 0) AS max_negative, min(x) FILTER (x > 0) AS min_positive,
   count(*) AS n_values, min(x) AS lo, max(x) AS hi FROM vals GROUP BY recording_id, channel)"""
GAPS = """steps AS (SELECT recording_id, channel, x - lag(x) OVER (PARTITION BY recording_id, channel ORDER BY x) AS g FROM vals),
 gaps AS (SELECT recording_id, channel, min(g) AS min_gap FROM steps GROUP BY recording_id, channel)"""


@query("Q-3", sql=f"WITH {QNT}, {NEAR} SELECT recording_id, channel, max_negative, min_positive FROM near")
def nearest_to_zero(t):
    return q.nearest_to_zero(q.value_counts(quantized(t)))


@query("Q-4", sql=f"WITH {QNT}, {GAPS} SELECT recording_id, channel, min_gap FROM gaps")
def smallest_gaps(t):
    return q.smallest_gap(q.value_counts(quantized(t)))


CORR = f"""{QNT}, {NEAR}, {GAPS},
 base AS (SELECT *, min_positive - max_negative AS dif,
    CASE WHEN abs(max_negative) <= abs(min_positive) THEN max_negative ELSE min_positive END AS b0 FROM near JOIN gaps USING (recording_id, channel)),
 stepped AS (SELECT *, CASE WHEN n_values = 1 THEN 1.0::DOUBLE
    WHEN abs(dif - 10 / 32768.0::DOUBLE) / (10 / 32768.0::DOUBLE) < 0.11 THEN dif ELSE min_gap END AS step FROM base),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY recording_id, channel ORDER BY x) AS rn FROM vals),
 picks AS (SELECT r.recording_id, r.channel, arg_min(r.x, (abs(r.x - (s.lo + s.hi) / 2), r.x)) AS nearest,
    max(r.x) FILTER (r.rn = greatest(s.n_values // 2, 1)) AS middle
    FROM ranked r JOIN stepped s USING (recording_id, channel) GROUP BY r.recording_id, r.channel),
 corr AS (SELECT recording_id, channel, step, n_values,
    CASE WHEN n_values = 1 THEN lo WHEN max_negative IS NULL OR min_positive IS NULL THEN middle
         WHEN (greatest(abs(lo), abs(hi)) - b0) / step > 32768 THEN nearest ELSE b0 END AS bias
    FROM stepped JOIN picks USING (recording_id, channel))"""


@query("Q-5", sql=f"WITH {CORR} SELECT recording_id, channel, step, bias, n_values FROM corr")
def step_and_bias(t):
    return q.corrections(q.value_counts(quantized(t)))


@query(
    "Q-6",
    sql=f"""WITH {CORR}, r AS (SELECT recording_id, channel, x, CAST(round_even((x - bias) / step, 0) AS SMALLINT) AS raw, step, bias
   FROM qnt JOIN corr USING (recording_id, channel))
SELECT recording_id, channel, x, raw, round(raw * step + bias, 9) AS restored, count(*) AS n FROM r GROUP BY ALL""",
)
def quantized_round_trip(t):
    counts = q.value_counts(quantized(t))  # equal samples have equal results
    joined = counts.join(per_group(q.corrections(counts)), ["recording_id", "channel"])
    joined = joined.withColumn("raw", q.to_counts(F.col("x"), F.col("step"), F.col("bias")))
    restored = q.to_volts(F.col("raw"), F.col("step"), F.col("bias"))
    return joined.select("recording_id", "channel", "x", "raw", F.round(restored, 9).alias("restored"), "n")


@query(
    "Q-7",
    sql=f"""WITH {CORR}, e AS (SELECT recording_id, channel,
   CAST(round_even((x - bias) / step, 0) AS SMALLINT) * step + bias - x AS err FROM qnt JOIN corr USING (recording_id, channel))
SELECT recording_id, channel, round(min(err), 9) AS min_error, round(max(err), 9) AS max_error,
  greatest(abs(min(err)), abs(max(err))) < 1.4e-4 AS passed FROM e GROUP BY recording_id, channel""",
)
def round_trip_errors(t):
    out = q.round_trip_errors(quantized(t), step_and_bias(t))
    return out.withColumns({c: F.round(c, 9) for c in ("min_error", "max_error")})


@query(
    "Q-8",
    sql=f"""WITH {QNT}, top AS (SELECT recording_id, channel, max(x) AS top FROM qnt GROUP BY ALL)
SELECT recording_id, channel, CASE WHEN channel IN (6, 7) AND top <> 0 THEN x / top ELSE x END AS x, count(*) AS n
FROM qnt JOIN top USING (recording_id, channel) GROUP BY ALL""",
)
def logic_channels(t):
    return q.value_counts(q.scale_logic_channels(quantized(t), [6, 7]))


TRIALS = [(10.0, 0.0), (10.0, 0.1), (20.0, 0.0), (5.0, 0.01), (9.5, -0.1), (10.24, 0.05)]


@query(
    "Q-9",
    sql=f"""WITH {QNT}, trials(trial, width, "offset") AS (VALUES {", ".join(f"({n}, {w}::DOUBLE, {o}::DOUBLE)" for n, (w, o) in enumerate(TRIALS))}),
 z AS (SELECT recording_id, channel, trial, width, "offset", (x - "offset") / width * 32768 AS z FROM vals CROSS JOIN trials),
 cost AS (SELECT recording_id, channel, trial, width, "offset", round(sum(abs(z - round_even(z, 0))), 6) AS cost FROM z GROUP BY ALL)
SELECT * FROM cost QUALIFY row_number() OVER (PARTITION BY recording_id, channel ORDER BY cost, trial) = 1""",
)
def trial_fit(t):
    return q.trial_fit(q.value_counts(quantized(t)), TRIALS)


@query(
    "Q-10",
    sql="""SELECT l_suppkey AS recording_id, CAST(ceil(l_partkey % 20 / 8.0::DOUBLE) AS BIGINT) AS pack, count(*) AS n,
           count(DISTINCT l_partkey % 20) AS n_channels FROM lineitem GROUP BY ALL""",
)
def channel_packs(t):
    channel = F.col("l_partkey") % 20
    return t.lineitem.groupBy(F.col("l_suppkey").alias("recording_id"), q.channel_pack(channel).alias("pack")).agg(
        F.count("*").alias("n"), F.countDistinct(channel).alias("n_channels")
    )


def long_blocks(t, halo: int = 0):
    return blocks.from_samples(long_samples(t), BLOCK, halo)


STAT_COLS = """count(*) AS n, min(x) AS min_val, max(x) AS max_val, arg_min(idx, (x, idx)) AS min_idx,
  arg_min(idx, (-x, idx)) AS max_idx, round(sum(x * x), 4) AS energy, max(abs(x)) AS max_abs,
  round(20 * log10(max(x) - min(x)), 6) AS level_db, round(stddev_samp(x), 6) AS deviation"""


def rounded_stats(df):
    return df.withColumns(
        {"energy": F.round("energy", 4), "level_db": F.round("level_db", 6), "deviation": F.round("deviation", 6)}
    )


@query("S-1", "S-2", "S-3", "S-4", "SNK-5", sql=f"WITH {SMP} SELECT recording_id, channel, {STAT_COLS} FROM smp GROUP BY ALL")
def channel_stats(t):
    return rounded_stats(blocks.channel_stats(embedding_blocks(t)))


@query(
    "S-1", "S-2", "S-3", "S-4",
    sql=f"WITH {LONG} SELECT recording_id, channel, {STAT_COLS.replace('sum(x * x), 4', 'sum(x * x) / 1e9, 4')} FROM lng GROUP BY ALL",
)
def long_channel_stats(t):
    stats = blocks.channel_stats(long_blocks(t)).withColumn("energy", F.col("energy") / 1e9)
    return rounded_stats(stats)


@query(
    "S-5",
    sql=f"""WITH {SMP}, m AS (SELECT recording_id, channel, max(abs(x)) AS top FROM smp GROUP BY ALL)
SELECT recording_id, channel, idx, x / top AS x FROM smp JOIN m USING (recording_id, channel)""",
)
def normalized_samples(t):
    return blocks.to_samples(blocks.normalized(embedding_blocks(t)))


@query(
    "S-6",
    sql=f"""WITH {SMP}, d AS (SELECT 'rec' || lpad(recording_id::VARCHAR, 8, '0') AS path, channel, stddev_samp(x) AS sd FROM smp GROUP BY ALL),
 f AS (SELECT channel, arg_min(sd, path) AS first_sd FROM d GROUP BY channel)
SELECT path, channel, round(sd, 6) AS deviation, round(sd / first_sd, 6) AS ratio FROM d JOIN f USING (channel)""",
)
def ambient_levels(t):
    path = F.concat(F.lit("rec"), F.lpad(F.col("recording_id").cast("string"), 8, "0"))
    out = blocks.ambient_levels(embedding_blocks(t).withColumn("path", path))
    return out.withColumns({c: F.round(c, 6) for c in ("deviation", "ratio")})


@query(
    "S-7",
    sql="""SELECT o_orderkey + 1 AS idx, o_totalprice + c_acctbal AS x FROM orders JOIN customer ON o_orderkey = c_custkey""",
)
def added_signals(t):
    a = long_samples(t).where("channel = 1")
    b = t.customer.select(
        F.lit(0).cast("bigint").alias("recording_id"),
        F.lit(1).cast("bigint").alias("channel"),
        (F.col("c_custkey") + 1).alias("idx"),
        F.col("c_acctbal").alias("x"),
    )
    pairs = a.select("recording_id").distinct().withColumn("other_id", F.lit(0).cast("bigint"))
    total = blocks.add_signals(blocks.from_samples(a, BLOCK), blocks.from_samples(b, BLOCK), pairs)
    return blocks.to_samples(total).select("idx", "x")


@query(
    "S-10",
    sql=f"""WITH {LONG} SELECT recording_id, channel, idx, x * x - coalesce(lag(x) OVER w * lead(x) OVER w, 0) AS x
            FROM lng WINDOW w AS (PARTITION BY recording_id, channel ORDER BY idx)""",
)
def teager_energy(t):
    b = long_blocks(t, 1).withColumn("samples", blocks.teager_energy("left_halo", "samples", "right_halo"))
    return blocks.to_samples(b)


@query(
    "S-11",
    sql=f"""WITH {LONG}, w AS (SELECT *, sum(x) OVER f AS s, count(*) OVER f AS c FROM lng
   WINDOW f AS (PARTITION BY recording_id, channel ORDER BY idx ROWS BETWEEN CURRENT ROW AND 29 FOLLOWING))
SELECT recording_id, channel, idx, round(s, 4) AS x FROM w WHERE c = 30""",
)
def sliding_sums(t):
    b = long_blocks(t, 29).withColumn("samples", blocks.sliding_sum(30))
    return blocks.to_samples(b).withColumn("x", F.round("x", 4))


@query(
    "S-11",
    sql=f"""WITH {LONG}, n AS (SELECT max(idx) AS n FROM lng), k AS (SELECT unnest(range(0, 8)) AS k)
SELECT l.recording_id, l.channel, l.idx, round(sum((k.k + 1) * s.x), 4) AS x
FROM lng l CROSS JOIN n CROSS JOIN k JOIN lng s ON s.channel = l.channel AND s.idx = l.idx + 4 - k.k
WHERE l.idx <= n.n - 8 GROUP BY l.recording_id, l.channel, l.idx""",
)
def centred_sums(t):
    kernel = np.arange(1.0, 9.0)
    b = long_blocks(t, 8).withColumn("samples", blocks.centred_kernel(kernel))
    n = blocks.channel_stats(long_blocks(t)).select("recording_id", "channel", "n")
    rows = blocks.to_samples(b).join(n, ["recording_id", "channel"])
    return rows.where(F.col("idx") <= F.col("n") - 8).select("recording_id", "channel", "idx", F.round("x", 4).alias("x"))


@query(
    "S-12",
    sql=f"WITH {SMP} SELECT recording_id, channel, idx, round(20 * log10(abs(x)), 6) AS amplitude_db, round(10 * log10(x * x), 6) AS power_db FROM smp WHERE x <> 0",
)
def decibels(t):
    rows = embedding_samples(t).where("x <> 0")
    return rows.select(
        "recording_id",
        "channel",
        "idx",
        F.round(amplitude_db(F.col("x")), 6).alias("amplitude_db"),
        F.round(power_db(F.col("x") * F.col("x")), 6).alias("power_db"),
    )


def _peaks_sql(dist: int) -> str:
    return f"""tops AS (SELECT *, max(x) OVER w AS m, count(*) OVER w AS c,
    max(x) OVER (PARTITION BY recording_id, channel ORDER BY idx ROWS BETWEEN {dist} PRECEDING AND 1 PRECEDING) AS prev FROM lng
  WINDOW w AS (PARTITION BY recording_id, channel ORDER BY idx ROWS BETWEEN {dist} PRECEDING AND {dist} FOLLOWING)),
 peaks AS (SELECT recording_id, channel, idx, x AS peak FROM tops WHERE c = {2 * dist + 1} AND x = m AND prev < x)"""


@query("D-1", sql=f"WITH {LONG}, {_peaks_sql(50)} SELECT * FROM peaks")
def local_peaks(t):
    return blocks.peaks_in_blocks(long_blocks(t, 50), 50)


@query(
    "D-2",
    sql=f"""WITH {LONG}, {_peaks_sql(90)}, n AS (SELECT *, row_number() OVER (ORDER BY idx) AS n FROM peaks WHERE channel = 1)
SELECT recording_id, n, concat(printf('%.6f', (idx - 1) / 100.0::DOUBLE), chr(9), printf('%.6f', (idx - 1) / 100.0::DOUBLE), chr(9), n) AS line FROM n""",
)
def pinger_labels(t):
    fs = 100
    one = long_blocks(t, 90).where("channel = 1")
    found = blocks.peaks_in_blocks(one, int(0.9 * fs)).withColumn("det_id", F.col("idx"))
    return labels.point_labels(found, fs, 50_000)


@query(
    "D-3",
    sql=f"WITH {LONG} SELECT recording_id, channel, round(quantile_cont(x, 0.75) * 4, 6) AS threshold FROM lng GROUP BY ALL",
)
def auto_threshold(t):
    got = order_statistics.exact_quantile(long_samples(t), ["recording_id", "channel"], "x", 0.75, "p75")
    return got.select("recording_id", "channel", F.round(F.col("p75") * 4, 6).alias("threshold"))


@query(
    "F-5",
    sql=f"""WITH {LONG} SELECT recording_id, channel, (idx - 1) // 100 AS frame, round(sum(x * x) / 100 / 1e6, 6) AS energy
            FROM lng GROUP BY ALL HAVING count(*) = 100""",
)
def frame_energies(t):
    out = blocks.frame_energy(long_blocks(t), 100)
    return out.withColumn("energy", F.round(F.col("energy") / 1e6, 6))


@query(
    "D-17",
    sql=f"""WITH {LONG}, f AS (SELECT recording_id, (idx - 1) // 100 AS frame, sum(x * x) / 100 AS energy
            FROM lng WHERE channel = 1 GROUP BY ALL HAVING count(*) = 100),
 hits AS (SELECT * FROM f WHERE energy > 8.5e10)
SELECT recording_id, frame, round(energy / 1e6, 6) AS energy FROM hits WHERE frame < (SELECT max(frame) FROM hits)""",
)
def noise_frames(t):
    frames = blocks.frame_energy(long_blocks(t).where("channel = 1"), 100)
    hits = blocks.noise_frames(frames, 8.5e10)
    return hits.select("recording_id", "frame", F.round(F.col("energy") / 1e6, 6).alias("energy"))


@query(
    "D-20",
    sql=f"""WITH {SMP} SELECT recording_id, channel,
  coalesce(min(idx) FILTER (x > 0.25), min(idx) FILTER (x > 0.125), -99999999) AS first_idx FROM smp GROUP BY ALL""",
)
def first_crossing(t):
    return synchronization.first_crossing(embedding_blocks(t), 0.25)


def _trigger_sql(share: float, span: int, source: str, name: str = "tr") -> str:
    return f"""{name}_m AS (SELECT recording_id, channel, max(x) AS top FROM {source} GROUP BY ALL),
 {name}_f AS (SELECT s.recording_id, s.channel, min(s.idx) AS first_idx FROM {source} s JOIN {name}_m m USING (recording_id, channel)
       WHERE abs(s.x) > m.top * {share} GROUP BY ALL),
 {name} AS (SELECT s.recording_id, s.channel, arg_min(s.idx, (-s.x, s.idx)) AS idx FROM {source} s JOIN {name}_f f USING (recording_id, channel)
       WHERE s.idx BETWEEN f.first_idx AND f.first_idx + {span} GROUP BY ALL)"""


@query("Y-1", sql=f"WITH {SMP}, {_trigger_sql(0.75, 32, 'smp')} SELECT recording_id, channel, idx FROM tr")
def triggers(t):
    return synchronization.triggers(embedding_blocks(t), 64, 0.75)


@query("Y-1", sql=f"WITH {LONG}, {_trigger_sql(0.75, 2000, 'lng')} SELECT recording_id, channel, idx FROM tr")
def long_triggers(t):
    return synchronization.triggers(long_blocks(t), 4000, 0.75)


@query(
    "Y-2",
    sql=f"""WITH {SMP}, v AS (SELECT * FROM smp WHERE channel = 1), a AS (SELECT * FROM smp WHERE channel = 4 AND idx <= 4 * 8),
 {_trigger_sql(0.60, 4, 'v')}, {_trigger_sql(0.81, 4, 'a', 'tr2')},
 r AS (SELECT DISTINCT recording_id FROM smp)
SELECT r.recording_id, (tr.idx - 1) / 8.0::DOUBLE AS video_s, (tr2.idx - 1) / 8.0::DOUBLE AS audio_s
FROM r LEFT JOIN tr USING (recording_id) LEFT JOIN tr2 USING (recording_id)""",
)
def trigger_times(t):
    fs = 8
    b = embedding_blocks(t)
    return synchronization.trigger_times(b.where("channel = 1"), b.where("channel = 4"), fs)
