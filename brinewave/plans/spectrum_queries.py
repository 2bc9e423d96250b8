"""Spectra and tonal frames on embeddings: 64 samples at 64 Hz, frames of 16."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from brinewave.operators import spectra, tonal
from brinewave.operators.blocks import from_samples
from brinewave.plans.registry import query
from brinewave.plans.standins import LONG, SMP, embedding_blocks, long_samples

FS, NFFT = 64.0, 16
TWO_PI = 2 * math.pi

# discrete transform of every frame by definition
DFT = f"""{SMP},
 frames AS (SELECT recording_id, channel, (idx - 1) // {NFFT} AS frame, (idx - 1) % {NFFT} AS n, x FROM smp),
 bins AS (SELECT unnest(range(0, {NFFT // 2} + 1)) AS bin),
 ft AS (SELECT recording_id, channel, frame, bin, sum(x * cos({TWO_PI!r} * bin * n / {NFFT})) AS re,
               -sum(x * sin({TWO_PI!r} * bin * n / {NFFT})) AS im
        FROM frames CROSS JOIN bins GROUP BY ALL),
 pw AS (SELECT *, (re * re + im * im) / ({FS} * {NFFT}) * CASE WHEN bin IN (0, {NFFT // 2}) THEN 1 ELSE 2 END AS power FROM ft)"""


@query("F-6", sql=f"WITH {DFT} SELECT recording_id, channel, frame, bin, round(power, 8) AS power FROM pw")
def spectrogram(t):
    rows = spectra.frame_spectra(embedding_blocks(t), NFFT, FS)
    return rows.select("recording_id", "channel", "frame", F.posexplode("power").alias("_b", "power")).select(
        "recording_id", "channel", "frame", F.col("_b").cast("bigint").alias("bin"), F.round("power", 8).alias("power")
    )


@query(
    "F-7",
    sql=f"""WITH {DFT} SELECT recording_id, channel, frame, bin, round(re / {NFFT} * 2, 7) + 0.0 AS re, round(im / {NFFT} * 2, 7) + 0.0 AS im,
            frame * ({NFFT} / {FS}) AS t_s, bin * ({FS} / {NFFT}) AS freq FROM ft""",
)
def short_time_spectrum(t):
    rows = spectra.frame_spectra(embedding_blocks(t), NFFT, FS, amplitude=True)
    rows = rows.select("recording_id", "channel", "frame", F.posexplode(F.arrays_zip("re", "im")).alias("_b", "z"))
    return rows.select(
        "recording_id",
        "channel",
        "frame",
        F.col("_b").cast("bigint").alias("bin"),
        (F.round("z.re", 7) + 0.0).alias("re"),
        (F.round("z.im", 7) + 0.0).alias("im"),
        spectra.frame_start(F.col("frame"), FS, NFFT).alias("t_s"),
        spectra.bin_frequency(F.col("_b"), FS, NFFT).alias("freq"),
    )


@query(
    "F-9",
    sql=f"WITH {DFT} SELECT recording_id, channel, bin, round(max(sqrt(re * re + im * im)) / {NFFT} * 2, 7) AS amplitude FROM ft GROUP BY ALL",
)
def max_spectrum(t):
    out = spectra.max_spectrum(embedding_blocks(t), NFFT)
    return out.select("recording_id", "channel", F.col("bin").cast("bigint").alias("bin"), F.round("amplitude", 7).alias("amplitude"))


@query("F-10", sql=f"WITH {DFT} SELECT recording_id, channel, frame, bin, round(power, 8) AS power FROM pw WHERE bin BETWEEN 2 AND 5")
def band_bins(t):
    first, last = spectra.band_bins(8.0, 20.0, FS, NFFT)
    rows = spectra.select_band(spectra.frame_spectra(embedding_blocks(t), NFFT, FS), "power", first, last)
    return rows.select("recording_id", "channel", "frame", F.posexplode("power").alias("_b", "power")).select(
        "recording_id",
        "channel",
        "frame",
        (F.col("_b") + first).cast("bigint").alias("bin"),
        F.round("power", 8).alias("power"),
    )


HOP = NFFT // 2
_HAMMING = f"(0.54 - 0.46 * cos({TWO_PI!r} * n / {NFFT - 1}))"
WELCH_SQL = """WITH {source},
 starts AS (SELECT DISTINCT recording_id, channel, idx AS s FROM {name} WHERE (idx - 1) % {hop} = 0),
 bins AS (SELECT unnest(range(0, {half} + 1)) AS bin),
 fr AS (SELECT s.recording_id, s.channel, s.s, l.idx - s.s AS n, l.x, count(*) OVER (PARTITION BY s.recording_id, s.channel, s.s) AS c
        FROM starts s JOIN {name} l ON l.recording_id = s.recording_id AND l.channel = s.channel AND l.idx BETWEEN s.s AND s.s + {nfft} - 1),
 ft AS (SELECT recording_id, channel, s, bin, sum(x * {w} * cos({tau} * bin * n / {nfft})) AS re,
               sum(x * {w} * sin({tau} * bin * n / {nfft})) AS im, sum({w} * {w}) AS ww
        FROM fr CROSS JOIN bins WHERE c = {nfft} GROUP BY ALL)
SELECT recording_id, channel, bin, bin * ({fs} / {nfft}) AS freq,
  round(10 * log10(avg((re * re + im * im) / ({fs} * ww) * CASE WHEN bin IN (0, {half}) THEN 1 ELSE 2 END)), 6) AS level_db
FROM ft GROUP BY recording_id, channel, bin"""


def _welch(source, name, fs=FS):
    return WELCH_SQL.format(source=source, name=name, hop=HOP, half=NFFT // 2, nfft=NFFT, w=_HAMMING, tau=repr(TWO_PI), fs=fs)


@query("F-8", sql=_welch(SMP, "smp"))
def averaged_density(t):
    out = spectra.averaged_density(embedding_blocks(t), FS, NFFT)
    return out.withColumns({"bin": F.col("bin").cast("bigint"), "level_db": F.round("level_db", 6)})


@query("F-8", sql=_welch(LONG, "lng"))
def long_averaged_density(t):
    out = spectra.averaged_density(from_samples(long_samples(t), 1000, NFFT - 1), FS, NFFT)
    return out.withColumns({"bin": F.col("bin").cast("bigint"), "level_db": F.round("level_db", 6)})


# band 8 - 28 Hz: the reference behaviour takes bins 1 .. 6 and 8 Hz as the bin scale
SETTINGS = tonal.TonalSettings(
    fs=FS, nfft=NFFT, low=8.0, high=28.0, ref_channel=3, percent_quiet=0.5, freq_maxbandwidth=20.0
)
PLAIN = tonal.TonalSettings(
    fs=FS, nfft=NFFT, low=8.0, high=28.0, ref_channel=3, percent_quiet=0.5, freq_maxbandwidth=20.0,
    threshold=6.0, ref_compat=False,
)


def _tonal_sql(first: int, last: int, scale: float, threshold: str, drop_last: bool, amplitude: bool = False) -> str:
    level = "sqrt(power)" if amplitude else "10 * log10(power)"
    over = "20 * log10(greatest(m.mag - f.floor, 0))" if amplitude else "m.mag - f.floor"
    over = f"CASE WHEN m.mag - f.floor <= 0 THEN '-inf'::DOUBLE ELSE 20 * log10(m.mag - f.floor) END" if amplitude else over
    floor = (
        "flo AS (SELECT recording_id, bin, min(mag) AS floor FROM mag GROUP BY ALL)"
        if amplitude
        else """sums AS (SELECT recording_id, frame, sum(mag) AS s FROM mag GROUP BY ALL),
 quiet AS (SELECT recording_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY s, frame) AS rn,
             count(*) OVER (PARTITION BY recording_id) AS n FROM sums)
           WHERE rn <= CASE WHEN round_even(n * 0.5, 0) >= 1 THEN round_even(n * 0.5, 0) ELSE n END),
 flo AS (SELECT recording_id, bin, max(mag) AS floor FROM mag JOIN quiet USING (recording_id, frame) GROUP BY ALL)"""
    )
    ref = f"20 * log10(lv)" if amplitude else "lv"
    last_rule = "coalesce(frame < max(frame) FILTER (hit) OVER (PARTITION BY recording_id), false)" if drop_last else "true"
    return f"""WITH {DFT},
 lev AS (SELECT recording_id, channel, frame, bin, {level} AS lv FROM pw WHERE bin BETWEEN {first} AND {last}),
 mag AS (SELECT recording_id, frame, bin, max(lv) AS mag FROM lev GROUP BY ALL),
 {floor},
 ov AS (SELECT m.recording_id, m.frame, m.bin, {over} AS over FROM mag m JOIN flo f USING (recording_id, bin)),
 st AS (SELECT recording_id, frame, max(over) AS stat_db, arg_max(bin, (over, -bin)) * {FS / NFFT}::DOUBLE AS peak_freq FROM ov GROUP BY ALL),
 rf AS (SELECT recording_id, frame, bin, {ref} AS v, max({ref}) OVER (PARTITION BY recording_id, frame) AS top FROM lev WHERE channel = 3),
 nb AS (SELECT recording_id, frame, count(*) FILTER (top - v < 3.0) * {scale} < 20.0 AS is_narrow FROM rf GROUP BY ALL),
 th AS (SELECT recording_id, {threshold} AS threshold FROM st GROUP BY recording_id),
 al AS (SELECT *, is_narrow AND stat_db > threshold AS hit FROM st JOIN nb USING (recording_id, frame) JOIN th USING (recording_id))
SELECT recording_id, frame, (frame * {NFFT} + {NFFT // 2}) / {FS}::DOUBLE AS t_s, round(stat_db, 6) AS stat_db, peak_freq, is_narrow,
       round(threshold, 6) AS threshold, hit AND {last_rule} AS is_det FROM al"""


def _rounded(frames):
    return frames.withColumns({"stat_db": F.round("stat_db", 6), "threshold": F.round("threshold", 6)})


@query("D-12", "D-12a", "D-12b", "D-12c", "D-12d", "D-12e", "D-12f", "D-12g", sql=_tonal_sql(1, 6, 8.0, "median(stat_db) + 8", True))
def tonal_frames(t):
    return _rounded(tonal.tonal_frames(embedding_blocks(t), SETTINGS))


@query("D-12", sql=_tonal_sql(2, 7, 4.0, "6.0::DOUBLE", False))
def tonal_frames_plain(t):
    return _rounded(tonal.tonal_frames(embedding_blocks(t), PLAIN))


@query("D-13", sql=_tonal_sql(1, 6, 8.0, "median(stat_db) + 8", True, amplitude=True))
def tonal_frames_amplitude(t):
    settings = tonal.TonalSettings(**{**SETTINGS.__dict__, "variant": "amplitude"})
    return _rounded(tonal.tonal_frames(embedding_blocks(t), settings))


@query(
    "D-14",
    sql=f"""WITH {DFT}, st AS (SELECT recording_id, frame, max(10 * log10(power)) AS stat_db FROM pw WHERE channel = 3 AND bin BETWEEN 1 AND 6 GROUP BY ALL),
 al AS (SELECT *, stat_db > -30 AS hit FROM st)
SELECT recording_id, frame, (frame * {NFFT} + {NFFT // 2}) / {FS}::DOUBLE AS t_s, round(stat_db, 6) AS stat_db,
  hit AND coalesce(frame < max(frame) FILTER (hit) OVER (PARTITION BY recording_id), false) AS is_det FROM al""",
)
def simple_tonal_frames(t):
    settings = tonal.TonalSettings(**{**SETTINGS.__dict__, "threshold": -30.0})
    return tonal.simple_tonal_frames(embedding_blocks(t), settings).withColumn("stat_db", F.round("stat_db", 6))
