"""Sphere geometry as column expressions; angles in degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAS_IN_RADIANS = 4.84813681109536e-09  # pi / (180 * 3,600,000)


def turn(angle: Column) -> Column:
    """Angle in [0, 360)."""
    t = F.pmod(angle, F.lit(360.0))
    return F.when(t >= 360.0, F.lit(0.0)).otherwise(t)


def separation(ra1: Column, dec1: Column, ra2: Column, dec2: Column) -> Column:
    """Great-circle distance by the haversine, exact for small angles."""
    s = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2.0), F.lit(2.0))
    h = s(dec1, dec2) + F.cos(F.radians(dec1)) * F.cos(F.radians(dec2)) * s(ra1, ra2)
    return 2.0 * F.degrees(F.asin(F.least(F.lit(1.0), F.sqrt(h))))


def to_plane(ra: Column, dec: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Gnomonic projection about (ra0, dec0); null on or behind the horizon."""
    d, d0, dr = F.radians(dec), F.radians(dec0), F.radians(ra) - F.radians(ra0)
    depth = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(dr)
    east = F.cos(d) * F.sin(dr)
    north = F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(dr)
    seen = depth > 1e-12
    return F.when(seen, F.degrees(east / depth)), F.when(seen, F.degrees(north / depth))


def from_plane(xi: Column, eta: Column, ra0: Column, dec0: Column) -> tuple[Column, Column]:
    """Inverse gnomonic projection; ra in [0, 360)."""
    x, y, d0 = F.radians(xi), F.radians(eta), F.radians(dec0)
    # the plane point as a vector: one along the axis, x east, y north
    along = F.cos(d0) - y * F.sin(d0)
    up = F.sin(d0) + y * F.cos(d0)
    ra = ra0 + F.degrees(F.atan2(x, along))
    dec = F.degrees(F.atan2(up, F.sqrt(x * x + along * along)))
    return turn(ra), dec


def moved(ra: Column, dec: Column, pmra: Column, pmdec: Column, years: Column) -> tuple[Column, Column]:
    """Position after proper motion (mas per year, ra already times cos dec); safe at the poles."""
    r, d = F.radians(ra), F.radians(dec)
    east, north = pmra * years * MAS_IN_RADIANS, pmdec * years * MAS_IN_RADIANS
    x = F.cos(d) * F.cos(r) - east * F.sin(r) - north * F.sin(d) * F.cos(r)
    y = F.cos(d) * F.sin(r) + east * F.cos(r) - north * F.sin(d) * F.sin(r)
    z = F.sin(d) + north * F.cos(d)
    still = (years == 0.0) | ((pmra == 0.0) & (pmdec == 0.0))
    size = F.sqrt(x * x + y * y + z * z)
    return F.when(still, ra).otherwise(turn(F.degrees(F.atan2(y, x)))), F.when(still, dec).otherwise(F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z / size)))))


def micro(angle: Column, digits: int = 6) -> Column:
    """Angle as a whole number of 10^-digits, to compare results across engines."""
    return F.round(angle * float(10**digits)).cast("long")
