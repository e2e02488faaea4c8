"""Text results: cone rows, solve records, and the INI and card sidecars of a solution."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sphere, wcs

#: Keys of the INI sidecar in their fixed order.
INI_KEYS = "CRPIX1 CRPIX2 CRVAL1 CRVAL2 CDELT1 CDELT2 CROTA1 CROTA2 CD1_1 CD1_2 CD2_1 CD2_2".split()


def scientific(x: float) -> str:
    """Seventeen digits, a blank for plus, and an exponent of three digits."""
    mantissa, exponent = f"{x: .16E}".split("E")
    return f"{mantissa}E{exponent[0]}{int(exponent[1:]):03d}"


def solution_values(crval, crpix, cd) -> dict[str, float]:
    """Values of the sidecar keys; pixels count from 1 there. Steps are row norms."""
    a, b, c, d = cd
    return dict(zip(INI_KEYS, [crpix[0] + 1, crpix[1] + 1, crval[0], crval[1], math.hypot(a, b), math.hypot(c, d), math.degrees(math.atan2(-b, a)), math.degrees(math.atan2(c, d)), a, b, c, d]))


def ini(crval, crpix, cd, command: str) -> str:
    lines = ["PLTSOLVD=T", *[f"{k}={scientific(v)}" for k, v in solution_values(crval, crpix, cd).items()], f"CMDLINE={command}"]
    return "\n".join(lines) + "\n"


def ini_failure(command: str, error: str) -> str:
    return f"PLTSOLVD=F\nCMDLINE={command}\nERROR={error}\n"


def card(name: str, value) -> str:
    """One 80-byte card."""
    if name in ("COMMENT", "HISTORY", ""):
        return f"{name:<8}{value}"[:80].ljust(80)
    shown = "T" if value is True else "F" if value is False else "'" + str(value).replace("'", "''").ljust(8) + "'" if isinstance(value, str) else f"{value!r}".upper()
    return (f"{name:<8}= {shown:<20}" if isinstance(value, str) else f"{name:<8}= {shown:>20}")[:80].ljust(80)


def merged_cards(header: list[tuple[str, object]], crval, crpix, cd) -> list[tuple[str, object]]:
    """Header cards with those of the solution in place of their names, new ones at the end; comments stay."""
    new: dict[str, object] = {"CTYPE1": "RA---TAN", "CTYPE2": "DEC--TAN", "CUNIT1": "deg", "CUNIT2": "deg", "EQUINOX": 2000.0, **solution_values(crval, crpix, cd), "PLTSOLVD": True}
    out, seen = [], set()
    for name, value in header:
        if name in new and name not in seen:
            out.append((name, new[name]))
            seen.add(name)
        elif name not in new:
            out.append((name, value))
    return out + [(k, v) for k, v in new.items() if k not in seen]


def card_block(cards: list[tuple[str, object]]) -> bytes:
    """Cards and END, padded to whole 2880-byte blocks."""
    blob = ("".join(card(n, v) for n, v in cards) + "END".ljust(80)).encode("ascii", "replace")
    return blob.ljust(-(-len(blob) // 2880) * 2880)


def card_text(cards: list[tuple[str, object]]) -> str:
    return "".join(card(n, v).rstrip() + "\n" for n, v in cards) + "END\n"


def finite_or_null(c: Column) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None)).otherwise(c)


def cone_csv(cone: DataFrame) -> DataFrame:
    """``ra_deg,dec_deg,phot_g_mean_mag,pmra_mas_yr,pmdec_mas_yr`` as one text column ``value``."""
    return cone.select(F.format_string("%.9f,%.9f,%.4f,%.3f,%.3f", "ra", "dec", "mag", F.coalesce("pmra", F.lit(0.0)), F.coalesce("pmdec", F.lit(0.0))).alias("value"))


def cone_json(cone: DataFrame) -> DataFrame:
    """One object per line in the same precision."""
    text = '{"ra_deg":%.9f,"dec_deg":%.9f,"phot_g_mean_mag":%.4f,"pmra_mas_yr":%.3f,"pmdec_mas_yr":%.3f}'
    return cone.select(F.format_string(text, "ra", "dec", "mag", F.coalesce("pmra", F.lit(0.0)), F.coalesce("pmdec", F.lit(0.0))).alias("value"))


def solve_record(outcomes: DataFrame, index: str = "", build: str = "") -> DataFrame:
    """``path, record``: the nested record of each outcome (``plans.solve``).

    A solved frame has ``confidence, wcs, field, stars, fit, quality``; a failed one its reason
    and what was found in it, and nulls there. Numbers that are not finite are null.
    """
    c = lambda n: F.col(n)
    num = lambda x: finite_or_null(x.cast("double"))
    named = lambda **cells: F.struct(*[v.alias(k) for k, v in cells.items()])
    cd = [F.col("cd")[i] for i in range(4)]
    x, y = (c("nx") - 1) / 2 - F.col("crpix")[0], (c("ny") - 1) / 2 - F.col("crpix")[1]
    ra, dec = sphere.from_plane(cd[0] * x + cd[1] * y, cd[2] * x + cd[3] * y, F.col("crval")[0], F.col("crval")[1])
    scale = wcs.scale_arcsec(cd)
    steps = [F.sqrt(cd[0] * cd[0] + cd[1] * cd[1]), F.sqrt(cd[2] * cd[2] + cd[3] * cd[3])]
    solved = lambda s: F.when(c("solved"), s)
    record = named(
        build=F.lit(build), solved=c("solved"), reason=c("reason"),
        confidence=solved(named(log_odds=num(c("log_odds")), chance_matches=num(c("chance")))),
        wcs=solved(named(
            crval=c("crval"), crpix=c("crpix"), cd=F.array(F.array(cd[0], cd[1]), F.array(cd[2], cd[3])), cdelt=F.array(*steps),
            pc=F.array(F.array(cd[0] / steps[0], cd[1] / steps[0]), F.array(cd[2] / steps[1], cd[3] / steps[1])), parity=wcs.parity(cd))),
        field=solved(named(center=named(ra=num(ra), dec=num(dec)), fov_deg=F.array(c("nx") * scale / 3600.0, c("ny") * scale / 3600.0), scale_arcsec=num(scale), orientation_pa=num(wcs.orientation(cd)))),
        stars=named(detected=c("detected"), used=c("stars_used"), matched=c("matched"), matcher=c("matcher"), quad_budget=c("quad_budget"), pair=c("pair"), rejected=c("rejected")),
        fit=solved(named(rms_arcsec=num(c("rms_deg") * 3600.0), max_residual_arcsec=num(c("worst_deg") * 3600.0), radial_trend=num(c("trend")))),
        quality=solved(named(fwhm_px=num(c("fwhm_px")), ellipticity=num(c("ellipticity")), ellipticity_pa=num(c("theta_deg")))),
        index=named(name=F.lit(index)),
    )
    return outcomes.select("path", record.alias("record"))


def solve_json(outcomes: DataFrame, index: str = "", build: str = "") -> DataFrame:
    """Nested records as JSON text, one object per frame, nulls kept."""
    return solve_record(outcomes, index, build).select("path", F.to_json("record", {"ignoreNullFields": "false"}).alias("value"))
