"""Tangent-plane solutions (crval, crpix, cd) as column expressions; pixels from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import sphere


def determinant(cd: list[Column]) -> Column:
    return cd[0] * cd[3] - cd[1] * cd[2]


def pixel_to_sky(x: Column, y: Column, crval: list[Column], crpix: list[Column], cd: list[Column]) -> tuple[Column, Column]:
    dx, dy = x - crpix[0], y - crpix[1]
    return sphere.from_plane(cd[0] * dx + cd[1] * dy, cd[2] * dx + cd[3] * dy, *crval)


def sky_to_pixel(ra: Column, dec: Column, crval: list[Column], crpix: list[Column], cd: list[Column]) -> tuple[Column, Column]:
    """Null behind the plane or for a singular matrix."""
    xi, eta = sphere.to_plane(ra, dec, *crval)
    det = determinant(cd)
    usable = F.abs(det) >= 1e-30
    return F.when(usable, crpix[0] + (cd[3] * xi - cd[1] * eta) / det), F.when(usable, crpix[1] + (cd[0] * eta - cd[2] * xi) / det)


def scale_arcsec(cd: list[Column]) -> Column:
    return F.sqrt(F.abs(determinant(cd))) * 3600.0


def orientation(cd: list[Column]) -> Column:
    return sphere.turn(F.degrees(F.atan2(cd[1], cd[3])))


def parity(cd: list[Column]) -> Column:
    return F.when(determinant(cd) < 0, "normal").otherwise("mirrored")


def steps_by_row(cd: list[Column]) -> tuple[Column, Column, Column, Column]:
    """Pixel steps and rotations as the text sidecar writes them: norms of the matrix rows."""
    return F.hypot(cd[0], cd[1]), F.hypot(cd[2], cd[3]), F.degrees(F.atan2(-cd[1], cd[0])), F.degrees(F.atan2(cd[2], cd[3]))


def steps_by_column(cd: list[Column]) -> tuple[Column, Column]:
    """Pixel steps as the result record writes them: norms of the matrix columns, the first negative."""
    return -F.hypot(cd[0], cd[2]), F.hypot(cd[1], cd[3])


def unbinned(crpix: list[Column], cd: list[Column], factor: Column) -> tuple[list[Column], list[Column]]:
    """A solution of a frame binned by ``factor`` in the pixels of the full frame."""
    return [c * factor + (factor - 1.0) / 2.0 for c in crpix], [c / factor for c in cd]
