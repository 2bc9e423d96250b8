"""Pairing videos with sound files and their clocks."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from brinewave.functions.columns import stem
from brinewave.operators.tiles import CORE, TILE, add_tiles, fitting_width, number_rows, tile_of
from brinewave.session import cut_lineage


def _base(postfix: str = ""):
    name = stem(F.col("path"))
    return F.regexp_replace(name, postfix + "$", "") if postfix else name


def pair_by_name(videos: DataFrame, audios: DataFrame, postfix: str = "") -> DataFrame:
    """Video and sound files that share a base name, the video's postfix left out."""
    v = videos.select(_base(postfix).alias("base"), F.col("path").alias("video"))
    a = audios.select(_base().alias("base"), F.col("path").alias("audio"))
    return v.join(a, "base").select("video", "audio")


def clock_offsets(first: DataFrame, second: DataFrame, audios: DataFrame, postfix_1: str, postfix_2: str) -> DataFrame:
    """Offsets of two cameras to one sound file: trigger time less the sound's trigger time."""
    v1 = first.select(_base(postfix_1).alias("base"), F.col("trigger_s").alias("_v1"))
    v2 = second.select(_base(postfix_2).alias("base"), F.col("trigger_s").alias("_v2"))
    au = audios.select(_base().alias("base"), F.col("trigger_s").alias("_au"))
    joined = v1.join(v2, "base").join(au, "base")
    return joined.select(
        "base", (F.col("_v1") - F.col("_au")).alias("offset_1"), (F.col("_v2") - F.col("_au")).alias("offset_2")
    )


def trigger_table(videos: DataFrame, audios: DataFrame, tile_s: int) -> DataFrame:
    """Video and sound triggers of a folder side by side in listing order (start time, then path)."""
    v = number_rows(videos, ["folder"], "start_s", ["path"], tile_s, "n")
    a = number_rows(audios, ["folder"], "start_s", ["path"], tile_s, "n")
    v = v.select("folder", "n", F.col("path").alias("video"), F.col("trigger_s").alias("video_trigger_s"))
    a = a.select("folder", "n", F.col("path").alias("audio"), F.col("trigger_s").alias("audio_trigger_s"))
    return v.join(a, ["folder", "n"])


# Largest difference of matching durations, shortest video that is matched, both in seconds, and
# the mark of first parts of split sound files.
TOLERANCE_S, SHORTEST_S = 3.0, 3.0
FIRST_PART = "_1.mat"


def match_recordings(videos: DataFrame, audios: DataFrame, tile: int) -> DataFrame:
    """One-to-one pairs of videos and sound files of a folder: folder, video, audio.

    Both need folder, path, ord (place in the listing) and duration_s. Each video in
    listing order takes the first sound file left whose duration differs by less
    than three seconds. Folders whose first sound file is a first part pair their
    first parts with the videos by place.
    """
    split = audios.groupBy("folder").agg(F.min_by("path", "ord").contains(FIRST_PART).alias("_split"))
    v = videos.join(split, "folder")
    a = audios.join(split, "folder")
    by_place = _by_place(v.where("_split"), a.where(F.col("_split") & F.col("path").contains(FIRST_PART)), tile)
    return by_place.unionByName(_by_duration(v.where(~F.col("_split")), a.where(~F.col("_split"))))


def _by_place(v: DataFrame, a: DataFrame, tile: int) -> DataFrame:
    v = number_rows(v, ["folder"], "ord", ["path"], tile, "_n").select("folder", "_n", F.col("path").alias("video"))
    a = number_rows(a, ["folder"], "ord", ["path"], tile, "_n").select("folder", "_n", F.col("path").alias("audio"))
    return v.join(a, ["folder", "_n"]).select("folder", "video", "audio")


WIDEST_S, NARROWEST_S = 600, 2 * int(TOLERANCE_S)  # durations of a tile
FILES = 100_000  # of a folder in one tile, about: one task holds them


def _by_duration(v: DataFrame, a: DataFrame) -> DataFrame:
    """The listing-order choice, in rounds of proposals.

    A video proposes to its first sound file that no earlier video holds, a file keeps the earliest video that
    proposed, and who has lost a file proposes again, until nobody proposes. As every file prefers earlier videos, that ends in the
    choices made one after the other. A round is worked out by tiles of durations, each with the files that its videos may
    reach, so that only what crosses a tile's edge takes further rounds; a folder of any size is many tasks.
    """
    usable = v.where(F.col("duration_s") >= SHORTEST_S).select("folder", "path", "ord", "duration_s")
    known = a.where(F.col("duration_s").isNotNull()).select("folder", "path", "ord", "duration_s")
    videos, files = cut_lineage(usable), cut_lineage(known)
    width = max(NARROWEST_S, fitting_width(videos.unionByName(files), ["folder"], "duration_s", WIDEST_S, FILES))
    near = add_tiles(files, "duration_s", width, before=int(TOLERANCE_S), after=int(TOLERANCE_S)).drop(CORE)
    homes = videos.withColumn(TILE, tile_of(F.col("duration_s"), width))
    # a recording file is named by its place in the listing of its folder
    by = ["folder", "file_ord", "file"]
    held = videos.select("folder", F.col("ord").alias("file_ord"), F.col("path").alias("file"), "ord", F.col("path").alias("video")).where("false")
    kinds = {c: videos.schema[c].dataType.simpleString() for c in ("folder", "ord", "path")}
    schema = f"folder {kinds['folder']}, file_ord {kinds['ord']}, file {kinds['path']}, ord {kinds['ord']}, video {kinds['path']}"
    while True:
        taken = held.select("folder", "ord", F.col("video").alias("path"))
        free = homes.join(taken, ["folder", "ord", "path"], "left_anti")
        holders = held.select("folder", F.col("file_ord").alias("ord"), F.col("file").alias("path"), F.col("ord").alias("holder_ord"), F.col("video").alias("holder"))
        seen = near.join(holders, ["folder", "ord", "path"], "left").withColumn("is_video", F.lit(False))
        both = seen.unionByName(free.withColumn("is_video", F.lit(True)), allowMissingColumns=True)
        both = both.withColumn("holder_ord", F.coalesce("holder_ord", "ord"))  # no null, which would make floats of whole numbers
        offers = cut_lineage(both.groupBy("folder", TILE).applyInPandas(_proposals, schema))
        if offers.isEmpty():
            return held.select("folder", "video", F.col("file").alias("audio"))
        kept = held.unionByName(offers).groupBy(*by).agg(F.min(F.struct("ord", "video")).alias("k"))
        held = cut_lineage(kept.select(*by, "k.ord", "k.video"))


class _Earliest:
    """The earliest place among those left in a range of positions."""

    def __init__(self, places: np.ndarray):
        self.size = 1 << max(len(places) - 1, 1).bit_length()
        self.tree = np.full(2 * self.size, np.iinfo(np.int64).max)
        self.tree[self.size : self.size + len(places)] = places
        for i in range(self.size.bit_length() - 2, -1, -1):
            lo, hi = 1 << i, 2 << i
            self.tree[lo:hi] = self.tree[2 * lo : 2 * hi].reshape(-1, 2).min(axis=1)
        self.tree = self.tree.tolist()

    def remove(self, at: int) -> None:
        i = at + self.size
        self.tree[i] = np.iinfo(np.int64).max
        while i > 1:
            i //= 2
            self.tree[i] = min(self.tree[2 * i], self.tree[2 * i + 1])

    def first(self, lo: int, hi: int) -> int | None:
        best, lo, hi = np.iinfo(np.int64).max, lo + self.size, hi + self.size
        while lo < hi:
            if lo & 1:
                best, lo = min(best, self.tree[lo]), lo + 1
            if hi & 1:
                hi -= 1
                best = min(best, self.tree[hi])
            lo, hi = lo // 2, hi // 2
        return None if best == np.iinfo(np.int64).max else best


def _proposals(files: pd.DataFrame) -> pd.DataFrame:
    """What the free videos of a tile propose, each to the first file that no earlier video holds."""
    v = files[files["is_video"]].sort_values(["ord", "path"])
    a = files[~files["is_video"]].sort_values(["duration_s", "ord", "path"]).reset_index(drop=True)
    durations, names = a["duration_s"].to_numpy(), list(zip(a["ord"], a["path"]))
    place = np.empty(len(a), dtype=np.int64)
    place[a.sort_values(["ord", "path"]).index] = np.arange(len(a))
    where = np.argsort(place)
    left, pairs = _Earliest(place), {}
    held = sorted((o, h, i) for i, (o, h) in enumerate(zip(a["holder_ord"], a["holder"])) if h is not None and h == h)
    at_home = {(o, p): d for o, p, d in zip(v["ord"], v["path"], v["duration_s"])}
    waiting, done = list(at_home), 0
    heapq.heapify(waiting)
    while waiting:
        me = heapq.heappop(waiting)
        while done < len(held) and held[done][:2] < me:
            if (i := held[done][2]) not in pairs:
                left.remove(i)
            done += 1
        duration = at_home[me]
        lo = int(np.searchsorted(durations, duration - TOLERANCE_S, side="left"))
        hi = int(np.searchsorted(durations, duration + TOLERANCE_S, side="right"))
        # the searches are on sums; the rule is on the difference
        while lo < hi and not abs(duration - durations[lo]) < TOLERANCE_S:
            lo += 1
        while lo < hi and not abs(duration - durations[hi - 1]) < TOLERANCE_S:
            hi -= 1
        if (found := left.first(lo, hi)) is not None:
            i = int(where[found])
            pairs[i] = me
            left.remove(i)
    folder = files["folder"].iloc[0]
    rows = [(folder, *names[i], *me) for i, me in pairs.items()]
    return pd.DataFrame(rows, columns=["folder", "file_ord", "file", "ord", "video"])
