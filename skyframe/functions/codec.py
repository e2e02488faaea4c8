"""Fixed-point codecs of stars and pattern codes, and the two binary index headers."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RA_SCALE = 4294967296.0 / 360.0
DEC_SCALE = 2147483647.0 / 90.0
CODE_LOW, CODE_SPAN, CODE_TOP = -1.0, 3.0, 65535.0


def _within(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def pack_star(df: DataFrame) -> DataFrame:
    """Add ``ra_scaled, dec_scaled, mag_milli, pmra_mas, pmdec_mas, clamped`` to a catalogue.

    Right ascension wraps, everything else is clamped and flagged, never overflows. Missing
    or NaN proper motion packs as zero. Magnitudes are rounded in single precision. A position
    that is not finite packs as null.
    """
    known = lambda n: F.when(F.abs(F.col(n).cast("double")) < float("inf"), F.col(n))
    mag = F.round(F.col("mag").cast("float") * F.lit(1000.0).cast("float")).cast("double")
    motion = {k: F.round(F.coalesce(F.nanvl(F.col(k).cast("double"), F.lit(0.0)), F.lit(0.0))) for k in ("pmra", "pmdec")}
    dec = F.round(known("dec") * DEC_SCALE)
    out = (mag < -32768) | (mag > 32767) | (F.abs(F.col("dec")) > 90)
    for m in motion.values():
        out = out | (m < -32768) | (m > 32767)
    return df.withColumns({
        "ra_scaled": F.round(F.pmod(known("ra"), F.lit(360.0)) * RA_SCALE).cast("long").bitwiseAND(F.lit(4294967295)),
        "dec_scaled": _within(dec, -2147483647.0, 2147483647.0).cast("int"),
        "mag_milli": _within(mag, -32768.0, 32767.0).cast("short"),
        "pmra_mas": _within(motion["pmra"], -32768.0, 32767.0).cast("short"),
        "pmdec_mas": _within(motion["pmdec"], -32768.0, 32767.0).cast("short"),
        "clamped": out,
    })


def unpack_star(df: DataFrame) -> DataFrame:
    """Add ``ra, dec, mag, pmra, pmdec`` to packed stars."""
    return df.withColumns({
        "ra": F.col("ra_scaled").cast("double") / RA_SCALE,
        "dec": F.col("dec_scaled").cast("double") / DEC_SCALE,
        "mag": F.col("mag_milli").cast("double") / 1000.0,
        "pmra": F.col("pmra_mas").cast("double"),
        "pmdec": F.col("pmdec_mas").cast("double"),
    })


def pack_code(code: Column) -> Column:
    """Pattern code as 16-bit numbers over [-1, 2], clamped."""
    return F.transform(code, lambda c: F.round(_within((c - CODE_LOW) / CODE_SPAN, 0.0, 1.0) * CODE_TOP).cast("int"))


def code_clamped(code: Column) -> Column:
    return F.exists(code, lambda c: (c < CODE_LOW) | (c > CODE_LOW + CODE_SPAN))


def unpack_code(code: Column) -> Column:
    return F.transform(code, lambda c: c.cast("double") / CODE_TOP * CODE_SPAN + CODE_LOW)


#: 16-byte little-endian star: ra, dec, magnitude, two motions, padding.
STAR = struct.Struct("<IihhhH")
#: The same as a numpy record.
STAR_RECORD = np.dtype([("ra", "<u4"), ("dec", "<i4"), ("mag", "<i2"), ("pmra", "<i2"), ("pmdec", "<i2"), ("pad", "<u2")])
#: Header of a star index: magic, version, nside, stars, epoch, name, digest of the records, padding.
STAR_HEAD = struct.Struct("<8sIIQd32s32s32x")
STAR_MAGIC = b"SKYFSTAR"
#: 24-byte quad: four code values, four star numbers.
QUAD = struct.Struct("<4H4I")


def pack_star_head(nside: int, n: int, epoch: float, name: str, digest: bytes) -> bytes:
    return STAR_HEAD.pack(STAR_MAGIC, 1, nside, n, epoch, name.encode("ascii", "replace")[:32], digest)


def read_star_head(data: bytes) -> dict | None:
    """Fields of a header; None if it is cut off or of another kind or version."""
    if len(data) < STAR_HEAD.size:
        return None
    magic, version, nside, n, epoch, name, digest = STAR_HEAD.unpack(data[: STAR_HEAD.size])
    if magic != STAR_MAGIC or version != 1:
        return None
    return {"nside": nside, "n_stars": n, "epoch": epoch, "name": name.rstrip(b"\0").decode(), "digest": digest.hex()}
