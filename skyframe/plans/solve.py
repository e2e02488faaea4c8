"""Solving many frames: preparation, catalogue selection, retry ladder, blind fallback."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frame, sphere
from ..operators import catalog, plate, quads
from ..session import cut
from ..sources import fits

STAR = "array<struct<x:double,y:double,flux:double,peak:double,npix:long,fwhm:double,ellipticity:double,theta:double>>"
REJECTED = "too_small:int,extended:int,saturated:int,elongated:int,edge:int"
PAIR = "struct<inliers:int,runner_up:int,image_stars:int,cat_stars:int,agreements:long,hypotheses:long,mirrored:boolean,truncated:boolean,hypotheses_to_promise:long,aborted:boolean>"
PREPARED = f"path string, nx int, ny int, binned int, xbinning double, scale double, ra0 double, dec0 double, date_obs string, reason string, detected int, rejected struct<{REJECTED}>, stars {STAR}"
OUTCOME = (
    "path string, solved boolean, reason string, detected int, matched int, log_odds double, used int, rms_deg double, trend double, crval array<double>, crpix array<double>, cd array<double>, "
    f"worst_deg double, chance double, stars_used int, matcher string, quad_budget int, pair {PAIR}, rejected struct<{REJECTED}>, nx int, ny int, fwhm_px double, ellipticity double, theta_deg double"
)
FIELDS = ("x", "y", "flux", "peak", "npix", "fwhm", "ellipticity", "theta")


def _angle(cards, names: tuple[str, str], hours: bool) -> float | None:
    text = fits.text(cards, names[0])
    if text:
        parts = text.lstrip("+-").replace(":", " ").split()
        try:
            value = sum(float(p) / 60**i for i, p in enumerate(parts))
            return (-value if text.strip().startswith("-") else value) * (15 if hours else 1)
        except ValueError:
            pass
    return fits.number(cards, names[1])


def read_frame(content: bytes, params: plate.ExtractParams) -> dict:
    """Header facts and stars of one file, or the reason why it has none."""
    try:
        cards, px, binned = fits.read_image(content)
    except fits.FrameError as e:
        return {"reason": e.reason}
    size, focal = fits.number(cards, "XPIXSZ") or fits.number(cards, "YPIXSZ"), fits.number(cards, "FOCALLEN")
    xbin = fits.number(cards, "XBINNING") or 1.0
    scale = frame.MICRON_PER_MM * size * xbin / focal * binned if size and focal and size > 0 and focal > 0 else None
    ra, dec = _angle(cards, ("OBJCTRA", "RA"), True), _angle(cards, ("OBJCTDEC", "DEC"), False)
    if ra is None or dec is None or not (0 <= ra <= 360 and -90 < dec <= 90):
        ra = dec = None
    got = plate.extract(px, params)
    return {
        "nx": px.shape[1], "ny": px.shape[0], "binned": binned, "xbinning": xbin, "scale": scale, "ra0": ra, "dec0": dec, "date_obs": fits.text(cards, "DATE-OBS"),
        "reason": None, "detected": got.detected, "rejected": got.rejected, "stars": [dict(zip(FIELDS, v)) for v in zip(*(getattr(got, f).tolist() for f in FIELDS))],
    }


def prepare(files: DataFrame, params: plate.ExtractParams | None = None) -> DataFrame:
    """Frames with their stars from ``path, content``; one file at a time, so memory is that of one image."""
    params = params or plate.ExtractParams()

    def run(batches):
        for pdf in batches:
            for p, data in zip(pdf.path, pdf.content):
                row = {k: None for k in ("nx", "ny", "binned", "xbinning", "scale", "ra0", "dec0", "date_obs", "reason", "detected", "rejected", "stars")}
                yield pd.DataFrame([{"path": p} | row | read_frame(bytes(data), params)]).astype(object)

    return files.select("path", "content").mapInPandas(run, PREPARED)


def _radius(df: DataFrame, factor: float, scale: str) -> DataFrame:
    w, h = F.col("nx") * F.col(scale) / 3600, F.col("ny") * F.col(scale) / 3600
    return df.withColumn("radius", F.coalesce(F.sqrt(w * w + h * h) / 2 * factor, F.lit(frame.DEFAULT_RADIUS)))


def catalogue_for(frames: DataFrame, stars: DataFrame, nside: int, epoch: float = 2016.0) -> DataFrame:
    """Catalogue stars for each frame (``path, ra0, dec0, radius, lim``), moved to its epoch, brightest first."""
    discs = frames.select(F.col("path").alias("disc_id"), "ra0", "dec0", "radius")
    cone = catalog.cone_search(stars, discs, nside).join(frames.select(F.col("path").alias("disc_id"), "lim", "date_obs"), "disc_id")
    got = catalog.select_catalogue(cone, F.col("lim"), nside, bound=frame.MOST_STARS)
    got = got.withColumns({"years": F.coalesce(frame.epoch_years(F.col("date_obs")) - epoch, F.lit(0.0)), "pmra": F.coalesce("pmra", F.lit(0.0)), "pmdec": F.coalesce("pmdec", F.lit(0.0))})
    ra, dec = sphere.moved(*map(F.col, ("ra", "dec", "pmra", "pmdec", "years")))
    return got.select("disc_id", "rank", ra.alias("cra"), dec.alias("cdec"))


def _stars_of(row) -> plate.Stars:
    return plate.Stars(*[np.array([s[f] for s in row["stars"]], float) for f in FIELDS], dict(row["rejected"] or {}), row["detected"] or 0)


def _outcome(row, stars: plate.Stars, o: dict) -> dict:
    binned, pair, fit = int(row["binned"]), o.get("pair"), o.get("fit")
    middle = lambda v: float(np.sort(v)[len(v) // 2]) if len(v) else None
    out = {k: o.get(k) for k in ("solved", "reason", "matched", "log_odds", "chance", "matcher")} | {"path": row["path"], "detected": stars.detected, "stars_used": len(stars), "quad_budget": o.get("budget")}
    out |= {"rejected": {k: int(stars.rejected.get(k) or 0) for k in ("too_small", "extended", "saturated", "elongated", "edge")}, "nx": int(row["nx"]) * binned, "ny": int(row["ny"]) * binned}
    out |= {"fwhm_px": middle(stars.fwhm * binned), "ellipticity": middle(stars.ellipticity), "theta_deg": middle(stars.theta)}
    out["pair"] = pair and {k: getattr(pair, k) for k in ("inliers", "runner_up", "image_stars", "cat_stars", "agreements", "hypotheses", "mirrored", "truncated", "aborted")} | {"hypotheses_to_promise": pair.to_promise}
    if fit is None:
        return out | {k: None for k in ("used", "rms_deg", "trend", "crval", "crpix", "cd", "worst_deg")}
    full = fit.wcs.full_frame(binned)
    return out | {"used": fit.used, "rms_deg": fit.rms_deg, "trend": fit.trend, "worst_deg": fit.worst_deg, "crval": full.crval.tolist(), "crpix": full.crpix.tolist(), "cd": full.cd.ravel().tolist()}


def solve_rung(frames: DataFrame, stars: DataFrame, nside: int, scale: str = "scale", pairs: bool = False, radius_factor: float = frame.RADIUS_MARGIN, blind: bool = False) -> DataFrame:
    """One attempt at each prepared frame with a pointing; a group is one frame and its bounded catalogue."""
    ready = _radius(frames.where("reason is null and ra0 is not null"), radius_factor, scale).withColumn("lim", frame.catalogue_limit(F.size("stars"))).withColumn("scale", F.col(scale))
    cat = catalogue_for(ready, stars, nside)
    columns = [c.split()[0] for c in OUTCOME.split(", ")]

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame(columns=columns)
        row, right = left.iloc[0], right.sort_values("rank")
        known = row["scale"] if row["scale"] is not None and np.isfinite(row["scale"]) else None
        need = 12.0 + (max(0.0, math.log10(row["offered"])) if blind else 0.0)
        stars = _stars_of(row)
        o = plate.solve(stars, int(row["nx"]), int(row["ny"]), right["cra"].to_numpy(), right["cdec"].to_numpy(), row["ra0"], row["dec0"], known, pairs, need, blind)
        return pd.DataFrame([_outcome(row, stars, o)], columns=columns).astype(object)

    return ready.groupBy("path").cogroup(cat.groupBy("disc_id")).applyInPandas(run, OUTCOME)


def solve_frames(files: DataFrame, stars: DataFrame, nside: int = 64, params: plate.ExtractParams | None = None, quad_index: DataFrame | None = None) -> DataFrame:
    """Outcome of every file: the retry ladder, then a blind search where a pattern index is given.

    Rungs: the header's scale; the scale without binning, with the catalogue fetched again;
    matched-filter extraction; pair matching; half the radius. Each rung runs over the frames that
    are still unsolved; of several failures a refusal by the gate is kept. Files that cannot be read and
    frames without a pointing come out with their reason.
    """
    params = params or plate.ExtractParams()
    prepared = cut(prepare(files, params))
    soft = plate.ExtractParams(**{**params.__dict__, "filter_sigma": 1.5})
    outcomes: list[tuple[int, DataFrame]] = []

    def left(frames: DataFrame) -> DataFrame:
        for _, o in outcomes:
            frames = frames.join(o.where("solved").select("path"), "path", "left_anti")
        return frames

    def attempt(rung: int, frames: DataFrame, **how) -> None:
        if rung == 1 or not frames.isEmpty():  # most frames are solved at once
            outcomes.append((rung, cut(solve_rung(frames, stars, nside, **how))))

    attempt(1, prepared)
    attempt(2, left(prepared).where("xbinning > 1").withColumn("alt", F.col("scale") / F.col("xbinning")), scale="alt")
    again = outcomes[0][1].where(F.col("reason").isin(frame.RETRIED)).select("path")
    again = cut(left(again))
    if not again.isEmpty():
        attempt(3, cut(prepare(files.join(again, "path", "left_semi"), soft)))
    attempt(4, left(prepared), pairs=True)
    attempt(5, left(prepared), pairs=True, radius_factor=0.5)
    if quad_index is not None and not left(prepared).isEmpty():
        outcomes.append((6, cut(solve_blind(left(prepared), stars, quad_index, nside))))
    every = outcomes[0][1].withColumn("rung", F.lit(1))
    for k, o in outcomes[1:]:
        every = every.unionByName(o.withColumn("rung", F.lit(k)))
    unread = prepared.where("reason is not null or ra0 is null").select("path", F.coalesce("reason", F.lit("NO_HINT")).alias("reason"))
    names = [c for c in every.columns if c not in ("path", "reason", "solved", "rung")]
    types = dict(every.dtypes)
    unread = unread.select("path", F.lit(False).alias("solved"), "reason", F.lit(0).alias("rung"), *[F.lit(None).cast(types[c]).alias(c) for c in names])
    rank = F.when(F.col("solved"), 2).when(F.col("reason") == "LOW_CONFIDENCE", 1).otherwise(0)
    best = every.unionByName(unread).groupBy("path").agg(F.max_by(F.struct("*"), F.struct(rank, "rung")).alias("o"))
    return best.select("o.*")


def solve_blind(frames: DataFrame, stars: DataFrame, quad_index: DataFrame, nside: int = 64, tol: float = 0.02) -> DataFrame:
    """Solve frames without a usable pointing through their patterns' codes.

    Image patterns meet the index, as it is and mirrored, by the binned code join; candidates whose
    four stars fit give centres, which are all ranked by how many others lie near and then by
    the fit's rms, thinned out, and each is solved against its own catalogue. The gate rises with the number of candidates offered, and the
    four stars of the fit are no evidence.
    """
    shape = "path string, iq int, code array<double>, diag double, px array<double>, py array<double>"

    def image(batches):
        for pdf in batches:
            rows = []
            for p, s in zip(pdf.path, pdf.stars):
                x, y = np.array([v["x"] for v in s]), np.array([v["y"] for v in s])
                # the index holds patterns of bright stars, so brighter subsets of the frame are tried too
                for m in sorted({min(len(x), n) for n in (12, 24, 48, len(x))}):
                    q = plate.build_quads(x[:m], y[:m], 6, 600)
                    rows += [(p, m * 1000 + k, c.tolist(), float(g), x[i].tolist(), y[i].tolist()) for k, (i, c, g) in enumerate(zip(q.idx, q.code, q.diag))]
            yield pd.DataFrame(rows, columns=["path", "iq", "code", "diag", "px", "py"])

    usable = frames.where("reason is null and size(stars) >= 4")
    codes = usable.select("path", "stars").mapInPandas(image, shape)

    def parities(batches):
        for pdf in batches:
            mirrored = quads.mirrored_codes(np.array(pdf.rcode.tolist()).reshape(-1, 4))
            yield pd.concat([pdf, pdf.assign(rcode=list(mirrored))[np.isfinite(mirrored[:, 0])]])

    index = quad_index.select(F.col("code").alias("rcode"), "stars", F.monotonically_increasing_id().alias("cand"))
    index = index.mapInPandas(parities, index.schema)
    # a pattern near its mirror image may agree in both parities, but is offered once
    offered = cut(quads.code_join(codes, index, tol).select("path", "iq", "diag", "px", "py", "stars", "cand").dropDuplicates(["path", "iq", "cand"]))
    total = offered.groupBy("path").agg(F.count(F.lit(1)).alias("offered"))
    at = offered.select("path", "iq", "cand", F.posexplode("stars").alias("k", "star_id")).join(stars.select("star_id", "ra", "dec"), "star_id")
    placed = at.groupBy("path", "iq", "cand").agg(F.array_sort(F.collect_list(F.struct("k", "ra", "dec"))).alias("sky")).where(F.size("sky") == 4)
    tested = offered.join(placed, ["path", "iq", "cand"]).join(usable.select("path", "nx", "ny"), "path")

    def fit(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                ra, dec = np.array([s["ra"] for s in r.sky]), np.array([s["dec"] for s in r.sky])
                f = plate.candidate_fit(np.array(r.px), np.array(r.py), r.diag, ra, dec)
                if f is not None:
                    a, b = f.wcs.to_sky((r.nx - 1) / 2, (r.ny - 1) / 2)
                    rows.append((r.path, float(a), float(b), f.wcs.scale, f.rms_deg))
            yield pd.DataFrame(rows, columns=["path", "ra0", "dec0", "found_scale", "rms"])

    centres = tested.select("path", "diag", "px", "py", "sky", "nx", "ny").mapInPandas(fit, "path string, ra0 double, dec0 double, found_scale double, rms double")

    def thin(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ra, dec = pdf.ra0.to_numpy(), pdf.dec0.to_numpy()
        order = plate.by_neighbours(ra, dec, pdf.rms.to_numpy(), 0.2)
        keep = order[plate.spaced(ra[order], dec[order], 0.2)]
        return pd.DataFrame({"path": key[0], "k": range(len(keep)), "ra0": ra[keep], "dec0": dec[keep], "found_scale": pdf.found_scale.to_numpy()[keep]})

    spots = centres.groupBy("path").applyInPandas(thin, "path string, k int, ra0 double, dec0 double, found_scale double")
    tries = usable.drop("ra0", "dec0", "scale").join(spots, "path").join(total, "path").withColumnRenamed("found_scale", "scale")
    named = tries.withColumn("path", F.concat_ws("\x1f", "path", F.col("k").cast("string")))
    got = cut(solve_rung(named, stars, nside, blind=True)).withColumn("path", F.split("path", "\x1f")[0])
    best = F.max_by(F.struct("*"), F.struct(F.col("solved"), F.coalesce("log_odds", F.lit(0.0))))
    tried = got.groupBy("path").agg(best.alias("o")).select("o.*")
    none = usable.select("path", F.size("stars").alias("found")).join(tried.select("path"), "path", "left_anti")
    kinds = dict(tried.dtypes)
    rest = {c: F.lit(None).cast(kinds[c]) for c in tried.columns} | {"path": F.col("path"), "solved": F.lit(False), "reason": F.lit("NO_QUAD_MATCH"), "detected": F.col("found")}
    return tried.unionByName(none.select(*[v.alias(c) for c, v in rest.items()]))
