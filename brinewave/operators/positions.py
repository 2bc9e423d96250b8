"""Groups of positions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from brinewave.functions import geo


def centroid(positions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean position per group through the local frame of its first node (by node_id)."""
    first = positions.groupBy(*keys).agg(F.min_by(F.struct("lat", "lon", "alt"), "node_id").alias("o"))
    rows = positions.join(first, keys)
    origin = (F.col("o.lat"), F.col("o.lon"), F.col("o.alt"))
    east, north, up = geo.east_north_up((F.col("lat"), F.col("lon"), F.col("alt")), origin)
    mean = (
        rows.select(*keys, "o", east.alias("e"), north.alias("n"), up.alias("u"))
        .groupBy(*keys)
        .agg(F.first("o").alias("o"), F.avg("e").alias("e"), F.avg("n").alias("n"), F.avg("u").alias("u"))
    )
    lat, lon, alt = geo.from_east_north_up((F.col("e"), F.col("n"), F.col("u")), origin)
    return mean.select(*keys, lat.alias("lat"), lon.alias("lon"), alt.alias("alt"))


def within_times(track: DataFrame, start, end) -> DataFrame:
    """Track rows strictly between two times; the bounds reach the scan."""
    return track.where((F.col("time") > start) & (F.col("time") < end))
