"""Column expressions: levels, angles, frames, names and times."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Recorder full scale and hydrophone calibration, in volts and micropascal per count.
VOLTS_PER_COUNT = 10 / 32768
MICROPASCAL_PER_COUNT = 3383.7641642911535
# Fixed value: the attitude logger's clock offset in seconds.
ATTITUDE_CLOCK_SHIFT = 28800

# Length of the leading part of a file name that holds the start time, and its pattern.
NAME_LAYOUTS = {
    "dots": (17, "yyyyMMdd_HH.mm.ss"),
    "dash_dots": (19, "yyyy-MM-dd_HH.mm.ss"),
    "compact": (15, "yyyyMMdd_HHmmss"),
}
# Extensions that count as video and as audio, first preference first.
VIDEO_EXTENSIONS = ["mkv", "MP4", "avi", "mp4"]
AUDIO_EXTENSIONS = ["wav", "mat", "flac", "mp3"]


def amplitude_db(a: Column) -> Column:
    return F.lit(20.0) * F.log10(F.abs(a))


def power_db(p: Column) -> Column:
    return F.lit(10.0) * F.log10(p)


def scale_samples(samples: Column, factor) -> Column:
    return F.transform(samples, lambda v: v * factor)


def mod_sign(a: Column, b: float) -> Column:
    """Remainder of |a| by b with the sign of a."""
    return F.signum(a) * F.pmod(F.abs(a), F.lit(b))


def direction_vector(az: Column, el: Column) -> tuple[Column, Column, Column]:
    """Unit vector (x, y, z) with z ahead of the array, x to its right and y up."""
    return F.sin(az) * F.cos(el), F.sin(el), F.cos(az) * F.cos(el)


def pixel_x(az: Column, fov_x: Column | float, width: Column | float) -> Column:
    half = F.lit(width) / 2
    return F.degrees(az) / (F.lit(fov_x) / 2) * half + half


def pixel_y(el: Column, fov_y: Column | float, height: Column | float) -> Column:
    half = F.lit(height) / 2
    return F.degrees(el) / (-F.lit(fov_y) / 2) * half + half


def video_frame(t_s: Column, fps: Column | float) -> Column:
    """Frame number from 1, half to even."""
    return F.rint(t_s * F.lit(fps)).cast("bigint") + 1


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def extension(path: Column) -> Column:
    return F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)


def start_time(path: Column, layout: str) -> Column:
    """Start time from the file name, NULL when the name does not fit."""
    length, pattern = NAME_LAYOUTS[layout]
    return F.try_to_timestamp(F.substring(base_name(path), 1, length), F.lit(pattern))


def zoned_time(text: Column) -> Column:
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSZ"))


def is_hidden(path: Column) -> Column:
    return base_name(path).startswith(".")


def media_kind(path: Column) -> Column:
    """'video', 'audio' or NULL by extension."""
    ext = extension(path)
    return F.when(ext.isin(VIDEO_EXTENSIONS), "video").when(ext.isin(AUDIO_EXTENSIONS), "audio")


def extension_priority(path: Column) -> Column:
    """Place of the extension in its preference list, from 1; NULL when in none."""
    ext = extension(path)
    out = F.lit(None).cast("int")
    for names in (VIDEO_EXTENSIONS, AUDIO_EXTENSIONS):
        for place, name in enumerate(names, start=1):
            out = F.when(ext == name, F.lit(place)).otherwise(out)
    return out


def frame_rate(text: Column) -> Column:
    """'30000/1001' as a number, NULL for anything else."""
    parts = F.split(text, "/")
    num, den = F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2))
    den = F.coalesce(den.try_cast("double"), F.lit(1.0))
    return F.when(den != 0, num.try_cast("double") / den)


def media_duration(kind: Column, duration: Column, frames: Column, fps: Column) -> Column:
    """Video: frames by rate. Audio: the stored duration, frames by rate where it is missing."""
    by_frames = frames / fps
    return F.when(kind == "video", by_frames).otherwise(F.coalesce(duration, by_frames))


def bearing_offset(bearing: Column, length: Column | float) -> tuple[Column, Column]:
    """East and north metres of a point at a bearing (0 = north, clockwise) and range."""
    return F.sin(bearing) * F.lit(length), F.cos(bearing) * F.lit(length)


def wrap_bearing(angle: Column) -> Column:
    """Add a full turn to angles at or below -7/4 pi."""
    return F.when(angle > -2 * math.pi + math.pi / 4, angle).otherwise(angle + 2 * math.pi)
