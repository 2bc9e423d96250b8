"""Positions on the WGS84 ellipsoid as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# WGS84 semi-major axis (m) and flattening; metres per minute of latitude.
A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
METRES_PER_MINUTE = 1852


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(phi) * F.sin(phi))
    flat = (n + alt) * F.cos(phi)
    return flat * F.cos(lam), flat * F.sin(lam), (n * (1 - E2) + alt) * F.sin(phi)


def east_north_up(point, origin) -> tuple[Column, Column, Column]:
    """Metres from origin to point; both are (lat, lon, alt) columns."""
    px, py, pz = ecef(*point)
    ox, oy, oz = ecef(*origin)
    dx, dy, dz = px - ox, py - oy, pz - oz
    phi, lam = F.radians(origin[0]), F.radians(origin[1])
    east = -F.sin(lam) * dx + F.cos(lam) * dy
    north = -F.sin(phi) * F.cos(lam) * dx - F.sin(phi) * F.sin(lam) * dy + F.cos(phi) * dz
    up = F.cos(phi) * F.cos(lam) * dx + F.cos(phi) * F.sin(lam) * dy + F.sin(phi) * dz
    return east, north, up


def from_east_north_up(enu, origin) -> tuple[Column, Column, Column]:
    """(lat, lon, alt) of a point given in metres from origin."""
    east, north, up = enu
    ox, oy, oz = ecef(*origin)
    phi, lam = F.radians(origin[0]), F.radians(origin[1])
    x = ox - F.sin(lam) * east - F.sin(phi) * F.cos(lam) * north + F.cos(phi) * F.cos(lam) * up
    y = oy + F.cos(lam) * east - F.sin(phi) * F.sin(lam) * north + F.cos(phi) * F.sin(lam) * up
    z = oz + F.cos(phi) * north + F.sin(phi) * up
    return from_ecef(x, y, z)


def from_ecef(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
    """Bowring's closed form: better than a micrometre near the surface."""
    b = A * (1 - FLAT)
    p = F.sqrt(x * x + y * y)
    theta = F.atan2(z * A, p * b)
    ep2 = (A * A - b * b) / (b * b)
    lat = F.atan2(z + ep2 * b * F.pow(F.sin(theta), 3), p - E2 * A * F.pow(F.cos(theta), 3))
    n = F.lit(A) / F.sqrt(1 - E2 * F.sin(lat) * F.sin(lat))
    alt = p / F.cos(lat) - n
    return F.degrees(lat), F.degrees(F.atan2(y, x)), alt


def distance(a, b) -> Column:
    east, north, up = east_north_up(a, b)
    return F.sqrt(east * east + north * north + up * up)


def bounding_box(lat: Column, lon: Column, radius_m: Column | float) -> dict[str, Column]:
    degrees = F.lit(radius_m) / METRES_PER_MINUTE / 60
    return {"top": lat + degrees, "left": lon - degrees, "bottom": lat - degrees, "right": lon + degrees}
