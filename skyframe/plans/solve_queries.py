"""Queries without SQL: image extraction, solving and the blind search, on derived or synthetic frames."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import healpix, sphere, wcs
from ..operators import geometry, image, plate, quads
from ..session import cut, table
from ..sources import fits, sidecar
from . import frame_queries, solve
from .catalog_queries import micro
from .frame_queries import ONSKY, PTS, PX, WIDTH

SCALE = 4.0
NSIDE = 64


def extract_components(spark, d):
    """Components above the upper median of every embedding read as an 8 x 8 image: pixels and light."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, e in zip(pdf.vec_id, pdf.embedding):
                px = np.asarray(e, float).reshape(WIDTH, WIDTH)
                mid = np.sort(px, axis=None)[px.size // 2]
                ys, xs, label = geometry.components(px > mid)
                for k, n in enumerate(np.bincount(label)):
                    at = label == k
                    rows.append((i, int(ys[at][0]), int(xs[at][0]), int(n)))
            yield pd.DataFrame(rows, columns=["vec_id", "y", "x", "npix"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, y int, x int, npix int")


def matched_filter(spark, d):
    """Every embedding image smoothed by the matched filter: its brightest pixel."""

    def run(batches):
        for pdf in batches:
            rows = []
            for i, e in zip(pdf.vec_id, pdf.embedding):
                soft, _ = plate.smooth(np.asarray(e, float).reshape(WIDTH, WIDTH), 1.5)
                y, x = np.unravel_index(soft.argmax(), soft.shape)
                rows.append((i, int(y), int(x)))
            yield pd.DataFrame(rows, columns=["vec_id", "y", "x"])

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, y int, x int")


def _fields(spark, d):
    """A synthetic frame and its catalogue for each cone of the sky fields below 80 degrees."""
    f = table(spark, d, "sky_fields").where("shape = 'cone' and abs(dec_deg) < 80").dropDuplicates(["field_id"]).select("field_id", "ra_deg", "dec_deg")

    def images(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                px, _, _ = fits.synthetic_field(r.ra_deg, r.dec_deg, SCALE, rotation=r.field_id * 17.0, mirrored=bool(r.field_id % 2), seed=int(r.field_id))
                head = [("RA", float(r.ra_deg)), ("DEC", float(r.dec_deg)), ("XPIXSZ", 3.8), ("FOCALLEN", 206.265 * 3.8 / SCALE)]
                yield pd.DataFrame({"path": [f"field-{r.field_id}"], "content": [fits.write_image(px, head)]})

    def catalogue(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                _, cat, _ = fits.synthetic_field(r.ra_deg, r.dec_deg, SCALE, rotation=r.field_id * 17.0, mirrored=bool(r.field_id % 2), seed=int(r.field_id))
                yield cat.assign(star_id=np.arange(len(cat)) + r.field_id * 1000, mag_milli=(cat.mag * 1000).astype(int), pmra=0.0, pmdec=0.0)[["star_id", "ra", "dec", "mag_milli", "pmra", "pmdec"]]

    stars = f.mapInPandas(catalogue, "star_id long, ra double, dec double, mag_milli int, pmra double, pmdec double")
    return cut(f.repartition(8).mapInPandas(images, "path string, content binary")), cut(healpix.with_cell(stars, NSIDE))


def solve_synthetic(spark, d):
    """Synthetic frames solved through the whole ladder."""
    files, stars = _fields(spark, d)
    return solve.solve_frames(files, stars, NSIDE).select("path", "solved", "reason", "rung", "matched", F.round("log_odds", 2).alias("log_odds"))


def solve_records(spark, d):
    """The outcomes of the whole ladder as nested result records."""
    files, stars = _fields(spark, d)
    return sidecar.solve_json(solve.solve_frames(files, stars, NSIDE), "synthetic")


def _blind(spark, d):
    files, stars = _fields(spark, d)
    frames = solve.prepare(files).withColumn("ra0", F.lit(None).cast("double")).withColumn("dec0", F.lit(None).cast("double"))
    index = quads.build_quad_index(stars, budget=28, cap=200)
    return solve.solve_blind(cut(frames), stars, cut(index), NSIDE)


def blind_solve(spark, d):
    """The frames again without their pointing, through a pattern index of their stars swept over all scales."""
    return _blind(spark, d).select("path", "solved", "reason", "matched", F.round("log_odds", 2).alias("log_odds"))


def _against_truth(spark, d, outcomes):
    """Whether each synthetic frame was solved to the solution that it was made with."""
    field = F.split("path", "-")[1].cast("long")
    truth = table(spark, d, "sky_fields").dropDuplicates(["field_id"]).select("field_id", "ra_deg", "dec_deg")
    cd = [F.col("cd")[i] for i in range(4)]
    x, y = (F.col("nx") - 1) / 2 - F.col("crpix")[0], (F.col("ny") - 1) / 2 - F.col("crpix")[1]
    ra, dec = sphere.from_plane(cd[0] * x + cd[1] * y, cd[2] * x + cd[3] * y, F.col("crval")[0], F.col("crval")[1])
    got = outcomes.withColumn("field_id", field).join(truth, "field_id")
    near = sphere.separation(ra, dec, F.col("ra_deg"), F.col("dec_deg")) * 3600.0 <= SCALE
    return got.select(
        "field_id", "solved", F.coalesce(near, F.lit(False)).alias("centre"), F.coalesce(F.abs(wcs.scale_arcsec(cd) - SCALE) < 0.02, F.lit(False)).alias("scale"), wcs.parity(cd).alias("parity"),
        (F.coalesce("log_odds", F.lit(0.0)) > 12).alias("sure"), (F.coalesce("matched", F.lit(0)) >= 10).alias("enough"),
    )


def solve_truth(spark, d):
    """The ladder's solutions against those that the frames were made with: centre within a pixel, scale, parity, gate."""
    files, stars = _fields(spark, d)
    return _against_truth(spark, d, solve.solve_frames(files, stars, NSIDE))


def blind_truth(spark, d):
    """The blind solutions against those that the frames were made with."""
    return _against_truth(spark, d, _blind(spark, d))


def tan_fit(spark, d):
    """A tangent-plane fit to the strongest detections of every solved frame, one position of each falsified: scale and stars kept."""

    def run(key, pdf):
        p = pdf.sort_values("i")
        ra, dec = p["ra"].to_numpy(), p["dec"].to_numpy().copy()
        dec[0] += 0.2  # the fit must clip this one
        fit = plate.fit_tan(p["x"].to_numpy(), p["y"].to_numpy(), ra, dec, float(p["ra_deg"].iloc[0]), float(p["dec_deg"].iloc[0]))
        return pd.DataFrame({"frame_id": [key[0]], "used": [fit.used], "scale": [fit.wcs.scale], "parity": [fit.wcs.parity], "rms": [fit.rms_deg]})

    sky = frame_queries._on_sky(spark, d).where(F.abs("dec") < 85)
    top = image.top_by_flux(sky, ["frame_id"], frame_queries.POINTS).withColumn("i", F.col("rank"))
    n = top.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 40")
    got = top.join(n, "frame_id").select("frame_id", "i", "x", "y", "ra", "dec", "ra_deg", "dec_deg").groupBy("frame_id").applyInPandas(run, "frame_id long, used int, scale double, parity string, rms double")
    return got.select("frame_id", F.col("used").cast("long").alias("used"), sphere.micro(F.col("scale"), 4).alias("scale_e4"), "parity", (F.col("rms") < 1e-8).alias("exact"))


def match_truth(spark, d):
    """The strongest detections of every frame against a turned, scaled and shifted copy: found by patterns and by pairs."""

    def run(key, pdf):
        p = pdf.sort_values("i")
        x, y = p["x"].to_numpy(), p["y"].to_numpy()
        z = (x + 1j * y) * np.exp(1j * np.radians(key[0] * 17 % 360)) * 0.001 + (0.1 - 0.2j)
        m = 1.0 if key[0] % 2 else -1.0
        q = plate.match_quads(x, y, plate.build_quads(x, y), m * z.real, z.imag, plate.build_quads(m * z.real, z.imag), expected=0.001)
        pair = plate.match_pairs(x, y, m * z.real, z.imag, 0.001)
        return pd.DataFrame({"frame_id": [key[0]], "n": [len(x)], "patterns": [q is not None and bool((q[:, 0] == q[:, 1]).mean() > 0.9)], "pairs": [pair.sufficient and bool((pair.pairs[:, 0] == pair.pairs[:, 1]).mean() > 0.8)], "mirrored": [pair.mirrored]})

    pts = frame_queries.points(spark, d, frame_queries.PAIR_POINTS)
    n = pts.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")
    return pts.join(n, "frame_id").select("frame_id", "i", "x", "y").groupBy("frame_id").applyInPandas(run, "frame_id long, n long, patterns boolean, pairs boolean, mirrored boolean")


QUERIES = [extract_components, matched_filter, solve_synthetic, solve_records, blind_solve, solve_truth, blind_truth, tan_fit, match_truth]


def queries():
    return {q.__name__: q for q in QUERIES}


def oracle_sql():
    reach = math.ceil(3 * 1.5)
    weight = [math.exp(-k * k / (2 * 1.5 * 1.5)) for k in range(-reach, reach + 1)]
    kernel = ", ".join(f"({k}, {w / sum(weight)!r}e0)".replace("e-05e0", "e-05").replace("e-06e0", "e-06") for k, w in zip(range(-reach, reach + 1), weight))
    fields = "select distinct field_id, true solved, true centre, true as scale, case when field_id % 2 = 1 then 'mirrored' else 'normal' end parity, true sure, true enough from sky_fields where shape = 'cone' and abs(dec_deg) < 80"
    return {
        # the truth that the frames were made with
        "solve_truth": fields,
        "blind_truth": fields,
        "tan_fit": f"""with {ONSKY}, k as (select onsky.frame_id, row_number() over (partition by frame_id order by dt.flux desc, onsky.det_id) r from onsky join dt using (det_id, frame_id) where abs(dec) < 85),
n as (select frame_id, least(500, count(*)) - 1 used from k group by 1 having count(*) >= 40) select frame_id, used, {micro('s*3600', 4)} scale_e4, case when m > 0 then 'normal' else 'mirrored' end parity, true exact from n join sol using (frame_id)""",
        "match_truth": f"with {PTS(80)}, n as (select frame_id, count(*) n from pts group by 1 having count(*) >= 20) select frame_id, n, true patterns, true pairs, frame_id % 2 = 0 mirrored from n",
        "extract_components": f"""with recursive {PX}, md as (select vec_id, list_sort(list(v))[33] mid from px group by vec_id), mk as (select vec_id, y, x from px join md using (vec_id) where v > mid),
rc as (select vec_id, y*8+x p, y*8+x r from mk union select mk.vec_id, mk.y*8+mk.x, rc.r from rc join mk on mk.vec_id = rc.vec_id and abs(mk.y - rc.p//8) <= 1 and abs(mk.x - rc.p%8) <= 1),
lb as (select vec_id, p, min(r) r from rc group by all) select vec_id, cast(r//8 as int) y, cast(r%8 as int) x, cast(count(*) as int) npix from lb group by vec_id, r""",
        "matched_filter": f"""with {PX}, k(o, w) as (values {kernel}), hx as (select vec_id, y, t.x, sum(w*v) v from px, k, (select unnest(range(8)) x) t where px.x = greatest(0, least(7, t.x + o)) group by all),
hy as (select vec_id, t.y, x, sum(w*v) v from hx, k, (select unnest(range(8)) y) t where hx.y = greatest(0, least(7, t.y + o)) group by all)
select vec_id, cast(y as int) y, cast(x as int) x from hy qualify row_number() over (partition by vec_id order by round(v, 12) desc, y, x) = 1""",
    }
