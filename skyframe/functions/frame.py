"""Frame headers: scale, field, pointing, epoch and search radius as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arcseconds per radian over a thousand (micrometres and millimetres), and rules.
MICRON_PER_MM = 206.265
RADIUS_MARGIN = 1.10
DEFAULT_RADIUS = 2.5
MONTH_DAYS = 30.4375
#: No frame's catalogue has more stars.
MOST_STARS = 5000

#: Reasons of a failed attempt (fixed values).
REASONS = """
CANNOT_READ UNSUPPORTED_FORMAT NO_STARS TOO_FEW_STARS EXTENDED_ONLY NO_QUAD_MATCH LOW_CONFIDENCE FOV_MISMATCH
NO_HINT INDEX_TOO_SHALLOW TIME_BUDGET_EXCEEDED
""".split()
#: Reasons after which another extraction of the frame is worth a try.
RETRIED = ["NO_QUAD_MATCH", "TOO_FEW_STARS"]


def reason_of(error: Column) -> Column:
    """Reason under which a read error is reported: only the pixel format has one of its own."""
    return F.when(error == "UnsupportedBitpix", "UNSUPPORTED_FORMAT").when(error.isNotNull(), "CANNOT_READ")


def pixel_scale(pixel_um: Column, binning: Column, focal_mm: Column) -> Column:
    """Arcseconds per pixel; null unless all are positive."""
    return F.when((pixel_um > 0) & (focal_mm > 0), MICRON_PER_MM * pixel_um * F.coalesce(binning, F.lit(1)) / focal_mm)


def field_size(pixels: Column, scale: Column) -> Column:
    return pixels * scale / 3600.0


def mosaic_factor(pattern: Column) -> Column:
    """2 for a colour-filter mosaic, whose 2x2 cells are averaged, else 1."""
    return F.when(pattern.isNotNull(), F.lit(2)).otherwise(F.lit(1))


def search_radius(width: Column, height: Column) -> Column:
    """Half the diagonal and a margin; a missing width counts as the height; else the default."""
    w = F.coalesce(width, height)
    return F.coalesce(F.sqrt(w * w + height * height) / 2.0 * RADIUS_MARGIN, F.lit(DEFAULT_RADIUS))


def radius_of_height(height_deg: Column, nx: Column, ny: Column) -> Column:
    """Search radius of a frame whose field has this height; without dimensions it counts as square."""
    aspect = F.coalesce(F.when((nx > 0) & (ny > 0), nx / ny), F.lit(1.0))
    return F.when(height_deg > 0, height_deg / 2.0 * F.sqrt(1.0 + aspect * aspect) * RADIUS_MARGIN)


def radius_to_use(from_header: Column, from_height: Column, most: Column) -> Column:
    """The header's radius, else that of a given field height, else and at most the one asked for."""
    return F.least(F.coalesce(from_header, from_height, most), most)


def radius_mismatch(from_header: Column, from_height: Column) -> Column:
    """Percent by which a given field height disagrees with the header; null within a quarter or if either is missing."""
    ratio = from_height / from_header
    return F.when(~ratio.between(0.75, 1.25), (ratio - 1.0) * 100.0)


def catalogue_limit(usable: Column) -> Column:
    return F.greatest(F.lit(300), F.least(F.lit(MOST_STARS), usable * 3))


def sexagesimal(text: Column) -> Column:
    """``[+-]a b c`` or ``a:b:c`` as a number; the sign is that of the text, so -00 30 is negative."""
    parts = F.split(F.regexp_replace(F.trim(text), "^[+-]", ""), r"[:\s]+")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    sign = F.when(F.trim(text).startswith("-"), F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.when(F.size(parts) == 3, sign * (number(0) + number(1) / 60.0 + number(2) / 3600.0))


def pointing(ra: Column, dec: Column) -> tuple[Column, Column]:
    """Usable pointing: within range, and not the -90 that marks a missing declination."""
    ok = ra.between(0, 360) & dec.between(-90, 90) & (dec != -90.0)
    return F.when(ok, ra), F.when(ok, dec)


def mount_hint(ra_hours: Column, south_polar_distance: Column) -> tuple[Column, Column]:
    """Degrees from hours and south polar distance."""
    return ra_hours * 15.0, south_polar_distance - 90.0


def epoch_years(iso: Column) -> Column:
    """Decimal year of ``YYYY-MM-DD...`` by months of equal length.

    A missing or unreadable month or day counts as the first; null outside 1900..2200.
    """
    parts = F.split(F.get(F.split(iso, "T"), F.lit(0)), "-")
    n = lambda i: F.get(parts, F.lit(i)).try_cast("double")
    day = (F.coalesce(n(1), F.lit(1.0)) - 1.0) * MONTH_DAYS + (F.coalesce(n(2), F.lit(1.0)) - 1.0)
    return F.when(n(0).between(1900, 2200), n(0) + day / 365.25)


def is_mosaic(flag: Column, filt: Column) -> Column:
    """Mosaic flag of the header, else by the name of the filter."""
    return F.coalesce(flag, filt == "OSC", F.lit(False))
