"""Frame, detection and image queries with the SQL that checks them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import frame, sphere, wcs
from ..operators import catalog, image, joins, spatial_join
from ..session import table
from .catalog_queries import BRIGHT, LIMIT, LINES_TO_PLANE, MOD, POINTED, micro, pointings, stars

TILE, WIDTH, K_SIGMA = 4, 8, 1.5
KEEP = 100
#: Strongest detections of a frame that are matched by patterns and by pairs.
POINTS, PAIR_POINTS = 500, 80
TOL = 2.5


def frames(spark, d):
    """Distinct frames with their pixel scale in arcsec."""
    f = table(spark, d, "frames").dropDuplicates(["frame_id"])
    return f.withColumn("scale", frame.pixel_scale(F.col("xpixsz"), F.col("binning"), F.col("focallen")))


def detections(spark, d):
    """Distinct detections with a finite flux."""
    return table(spark, d, "detections").where(catalog.finite("flux")).dropDuplicates(["det_id"])


def frame_geometry(spark, d):
    f = frames(spark, d)
    w, h = frame.field_size(F.col("naxis1"), F.col("scale")), frame.field_size(F.col("naxis2"), F.col("scale"))
    radius = frame.search_radius(w, h)
    return f.select("frame_id", sphere.micro(F.col("scale")).alias("scale_e6"), sphere.micro(w).alias("width_udeg"), sphere.micro(h).alias("height_udeg"), sphere.micro(radius).alias("radius_udeg"), frame.mosaic_factor(F.col("bayerpat")).alias("factor"))


def radius_rules(spark, d):
    """The radius to search where a field height is given as well, and how far the two disagree."""
    f = frames(spark, d)
    w, h = frame.field_size(F.col("naxis1"), F.col("scale")), frame.field_size(F.col("naxis2"), F.col("scale"))
    header = F.when(h.isNotNull(), frame.search_radius(w, h))
    given = frame.radius_of_height((F.col("frame_id") % 5).cast("double"), F.col("naxis1"), F.col("naxis2"))
    return f.select("frame_id", sphere.micro(frame.radius_to_use(header, given, F.lit(2.5))).alias("radius_udeg"), sphere.micro(frame.radius_mismatch(header, given), 3).alias("mismatch_e3"))


def catalogue_limit(spark, d):
    n = detections(spark, d).groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("frame_id", frame.catalogue_limit(F.col("n")).alias("lim"))


def pointing_hint(spark, d):
    f = frames(spark, d)
    ra, dec = frame.pointing(F.col("ra_deg"), F.col("dec_deg"))
    hours, spd = frame.mount_hint(F.col("ra_deg") / 15.0, F.col("dec_deg") + 90.0)
    return f.select("frame_id", sphere.micro(ra).alias("ra_udeg"), sphere.micro(dec).alias("dec_udeg"), sphere.micro(hours, 7).alias("hint_ra_e7"), sphere.micro(spd, 7).alias("hint_dec_e7"))


def sexagesimal(spark, d):
    i = F.col("frame_id")
    sign = F.when(i % 3 == 0, F.lit("-")).otherwise(F.lit(""))
    text = F.concat(sign, F.format_string("%02d", i % 24), F.when(i % 2 == 0, F.lit(":")).otherwise(F.lit(" ")), F.format_string("%02d", i % 60), F.when(i % 2 == 0, F.lit(":")).otherwise(F.lit(" ")), F.format_string("%02d.5", (i * 7) % 60))
    return frames(spark, d).select("frame_id", text.alias("text"), sphere.micro(frame.sexagesimal(text)).alias("value_e6"))


def epoch_years(spark, d):
    return frames(spark, d).select("frame_id", sphere.micro(frame.epoch_years(F.date_format("date_obs", "yyyy-MM-dd'T'HH:mm:ss"))).alias("epoch_e6"))


def mosaic_class(spark, d):
    s = table(spark, d, "solve_log").dropDuplicates(["log_id"])
    return s.select("log_id", frame.is_mosaic(F.col("header.is_cfa"), F.col("filt_eff")).alias("mosaic"))


def _solutions(spark, d):
    """A known solution for each pointed frame: rotation by its number, parity by its parity."""
    f = frames(spark, d).where(catalog.finite("ra_deg", "dec_deg"))
    s, t = F.coalesce("scale", F.lit(2.0)) / 3600.0, F.radians((F.col("frame_id") * 37) % 360)
    m = F.when(F.col("frame_id") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    cd = (-s * F.cos(t) * m, s * F.sin(t), s * F.sin(t) * m, s * F.cos(t))
    named = [c.alias(n) for c, n in zip(cd, ("cd0", "cd1", "cd2", "cd3"))]
    return f.select("frame_id", "ra_deg", "dec_deg", "naxis1", "naxis2", ((F.col("naxis1") - 1) / 2).alias("cx"), ((F.col("naxis2") - 1) / 2).alias("cy"), *named)


def _c(*names):
    return [F.col(n) for n in names]


def _on_sky(spark, d):
    got = detections(spark, d).select("det_id", "frame_id", "x", "y", "flux").join(_solutions(spark, d), "frame_id")
    ra, dec = wcs.pixel_to_sky(F.col("x"), F.col("y"), _c("ra_deg", "dec_deg"), _c("cx", "cy"), _c("cd0", "cd1", "cd2", "cd3"))
    return got.withColumn("ra", ra).withColumn("dec", dec)


def wcs_pix_to_sky(spark, d):
    return _on_sky(spark, d).where(F.abs("dec") < 89.9).select("det_id", sphere.micro(F.col("ra")).alias("ra_udeg"), sphere.micro(F.col("dec")).alias("dec_udeg"))


def wcs_sky_to_pix(spark, d):
    """Back to the pixel that a position came from."""
    x, y = wcs.sky_to_pixel(F.col("ra"), F.col("dec"), _c("ra_deg", "dec_deg"), _c("cx", "cy"), _c("cd0", "cd1", "cd2", "cd3"))
    return _on_sky(spark, d).select("det_id", sphere.micro(x, 3).alias("x_e3"), sphere.micro(y, 3).alias("y_e3"))


def wcs_params(spark, d):
    cd = _c("cd0", "cd1", "cd2", "cd3")
    r1, r2, t1, t2 = wcs.steps_by_row(cd)
    c1, c2 = wcs.steps_by_column(cd)
    e9 = lambda c: sphere.micro(c, 9)
    return _solutions(spark, d).select(
        "frame_id", sphere.micro(wcs.scale_arcsec(cd)).alias("scale_e6"), sphere.micro(wcs.orientation(cd), 4).alias("orient_e4"), wcs.parity(cd).alias("parity"),
        e9(r1).alias("row1"), e9(r2).alias("row2"), e9(c1).alias("col1"), e9(c2).alias("col2"), sphere.micro(F.cos(F.radians(t1)), 4).alias("cos1"), sphere.micro(F.cos(F.radians(t2)), 4).alias("cos2"),
    )


def wcs_unbinned(spark, d):
    p, cd = wcs.unbinned(_c("cx", "cy"), _c("cd0", "cd1", "cd2", "cd3"), F.lit(2.0))
    return _solutions(spark, d).select("frame_id", *[sphere.micro(c, 1).alias(n) for c, n in zip(p, ("cx_e1", "cy_e1"))], *[sphere.micro(c, 9).alias(f"cd{i}_e9") for i, c in enumerate(cd)])


def residual_rms(spark, d):
    """Fit quality per frame: rms, largest residual and radial trend of a slightly wrong scale."""
    got = _on_sky(spark, d).withColumn("r", F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2))).withColumn("res", F.col("r") * 0.001 + (F.col("det_id") % 7) * 0.01)
    g = got.groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("res") * F.col("res"))).alias("rms"), F.max("res").alias("worst"), F.corr("r", "res").alias("c"))
    trend = F.when((F.col("n") < 3) | F.isnan(F.coalesce("c", F.lit(0.0))), F.lit(0.0)).otherwise(F.coalesce("c", F.lit(0.0)))
    return g.where(F.col("n") >= 3).select("frame_id", "n", sphere.micro(F.col("rms")).alias("rms_e6"), sphere.micro(F.col("worst")).alias("worst_e6"), sphere.micro(trend, 5).alias("trend_e5"))


def lsq_plane(spark, d):
    """Least-squares plane through a known linear field of the detections, by its sums."""
    got = detections(spark, d).select("frame_id", "det_id", (F.col("x") / 1000).alias("x"), (F.col("y") / 1000).alias("y")).withColumn("t", 3.0 + F.col("x") * 2.0 - F.col("y") + (F.col("det_id") % 5) * 0.1)
    from ..operators.matching import plane

    return plane(got, ["frame_id"]).where(F.col("n") >= 20).select("frame_id", "n", *[sphere.micro(F.col(c), 5).alias(f"{c}_e5") for c in ("a0", "a1", "a2")])


def nearest_within_tol(spark, d):
    p = detections(spark, d).select("frame_id", F.col("det_id").alias("id"), "x", "y")
    t = detections(spark, d).where(F.col("det_id") % 2 == 0).select("frame_id", F.col("det_id").alias("tid"), (F.col("x") + 0.75).alias("tx"), (F.col("y") - 0.5).alias("ty"))
    return joins.nearest_within(p, t, ["frame_id"], TOL).select("frame_id", "id", "tid", sphere.micro(F.col("d2"), 4).alias("d2_e4"))


def box_semi_join(spark, d):
    p = detections(spark, d).select("frame_id", F.col("det_id").alias("id"), "x", "y")
    t = detections(spark, d).where(F.col("det_id") % 3 == 0).select("frame_id", (F.col("x") + 10.25).alias("tx"), (F.col("y") + 4.5).alias("ty"))
    return joins.box_semi_join(p, t, ["frame_id"], 20.0)


def points(spark, d, k: int):
    """Numbered points of each frame: its k strongest detections."""
    return image.top_by_flux(detections(spark, d), ["frame_id"], k).select("frame_id", (F.col("rank") - 1).alias("i"), "x", "y")


def knn_points(spark, d):
    return joins.nearest_neighbours(points(spark, d, POINTS), ["frame_id"], 6, grouped=True).select("frame_id", "i", "rank", "j")


def pair_separations(spark, d):
    return joins.pair_separations(points(spark, d, PAIR_POINTS), ["frame_id"]).select("frame_id", "i", "j", sphere.micro(F.col("sep"), 4).alias("sep_e4"))


def max_separation(spark, d):
    """The widest pair of all detections of a frame."""
    return joins.widest(detections(spark, d), ["frame_id"]).select("frame_id", sphere.micro(F.col("widest"), 4).alias("max_e4"))


def band_join(spark, d):
    """How many pairs of detections have the separation, in pixels, of a pair of catalogue stars around the same frame."""
    f = frames(spark, d).select("frame_id", F.col("scale"))
    top = catalog.brightest(catalog.cone_search(stars(spark, d), pointings(spark, d), 64), LIMIT)
    xi, eta = sphere.to_plane(*map(F.col, ("ra", "dec", "ra0", "dec0")))
    sky = top.select(F.col("disc_id").alias("frame_id"), (F.col("rank") - 1).alias("i"), xi.alias("x"), eta.alias("y"))
    sky = joins.pair_separations(sky, ["frame_id"]).join(f.where("scale is not null"), "frame_id")
    sky = sky.select("frame_id", F.col("i").alias("ci"), F.col("j").alias("cj"), (F.col("sep") * 3600.0 / F.col("scale")).alias("want"))
    have = joins.pair_separations(points(spark, d, PAIR_POINTS), ["frame_id"])
    return joins.band_join(have, sky, "sep", "want", TOL, 0.005, keys=["frame_id"], repeat="right").groupBy("frame_id").agg(F.count(F.lit(1)).alias("n"))


def first_location(spark, d):
    """The preferred attempt of each frame: solved first, then by path and number."""
    s = table(spark, d, "solve_log").dropDuplicates(["log_id"])
    return joins.best_row(s, ["frame_id"], [F.coalesce(F.col("outcome.solved"), F.lit(False)).desc(), F.col("path").asc(), F.col("log_id").asc()]).select("frame_id", "path", "log_id")


def centre_neighbours(spark, d):
    """How many other solved centres lie within half a degree of each, counted inside the radius join."""
    s = table(spark, d, "solve_log").select("log_id", F.col("outcome.field.center.ra").alias("ra"), F.col("outcome.field.center.dec").alias("dec")).dropDuplicates(["log_id"]).withColumnRenamed("log_id", "id")
    return spatial_join.neighbour_counts(s, 0.5).select(F.col("query_id").alias("log_id"), F.col("n").alias("neighbours"))


def _px(spark, d):
    return image.pixels(table(spark, d, "embeddings"), "vec_id", "embedding", WIDTH)


def superpixel_2x2(spark, d):
    return image.superpixels(_px(spark, d), "vec_id").select("vec_id", "y", "x", sphere.micro(F.col("v"), 7).alias("v_e7"))


def _mesh(spark, d):
    return image.background_mesh(_px(spark, d), "vec_id", TILE)


def tile_background(spark, d):
    return _mesh(spark, d).select("vec_id", "ty", "tx", sphere.micro(F.col("level"), 7).alias("level_e7"), sphere.micro(F.col("noise"), 7).alias("noise_e7"))


def median_noise(spark, d):
    return _mesh(spark, d).groupBy("vec_id").agg(sphere.micro(image.upper_median("noise"), 7).alias("noise_e7"))


def _lit(spark, d):
    return image.with_background(_px(spark, d), _mesh(spark, d), "vec_id", TILE)


def bilinear_background(spark, d):
    return _lit(spark, d).select("vec_id", "y", "x", sphere.micro(F.col("level"), 7).alias("level_e7"), sphere.micro(F.col("noise"), 7).alias("noise_e7"))


def threshold_mask(spark, d):
    return image.above_threshold(_lit(spark, d), K_SIGMA).select("vec_id", "y", "x")


def _blobs(spark, d):
    return image.moments(image.labelled(image.above_threshold(_lit(spark, d), K_SIGMA), "vec_id"), ["vec_id", "label"], WIDTH, WIDTH, 1)


def blob_moments(spark, d):
    """Sums over every component of every image."""
    return _blobs(spark, d).select("vec_id", "label", "npix", "edge", *[sphere.micro(F.col(c)).alias(f"{c}_e6") for c in ("peak", "s", "sx", "sy", "sxx", "syy", "sxy")])


def blob_shapes(spark, d):
    return image.shapes(_blobs(spark, d)).where(F.col("npix") >= 3).select("vec_id", "label", *[sphere.micro(F.col(c), 4).alias(f"{c}_e4") for c in ("cx", "cy", "ellipticity", "fwhm_px")])


def _sized(spark, d):
    f = frames(spark, d).select("frame_id", F.col("naxis1").alias("nx"), F.col("naxis2").alias("ny"))
    return detections(spark, d).join(f, "frame_id")


def rejection_cascade(spark, d):
    e = (F.col("x") < 8) | (F.col("y") < 8) | (F.col("x") + 8 >= F.col("nx")) | (F.col("y") + 8 >= F.col("ny"))
    return image.rejections(_sized(spark, d).withColumn("edge", e).withColumnRenamed("flux", "s"), ["frame_id"], min_pix=8, factor=3.0)


def saturation_level(spark, d):
    return image.saturation_level(detections(spark, d), ["frame_id"]).select("frame_id", sphere.micro(F.col("level"), 2).alias("level_e2"))


def image_concentration(spark, d):
    return image.concentration(_sized(spark, d), ["frame_id"]).select("frame_id", "n", "busiest", sphere.micro(F.col("concentration")).alias("concentration_ppm"))


def flux_topk(spark, d):
    return image.top_by_flux(detections(spark, d), ["frame_id"], KEEP).select("frame_id", "rank", "det_id")


def flux_topk_stratified(spark, d):
    return image.stratified_by_flux(_sized(spark, d), ["frame_id"], 30, least=20, threshold=4.0).select("frame_id", "rank", "det_id", "stratified")


def median_quality(spark, d):
    return image.median_quality(detections(spark, d), ["frame_id"])


QUERIES = [
    frame_geometry, radius_rules, catalogue_limit, pointing_hint, sexagesimal, epoch_years, mosaic_class, wcs_pix_to_sky, wcs_sky_to_pix, wcs_params, wcs_unbinned, residual_rms, lsq_plane,
    nearest_within_tol, box_semi_join, knn_points, pair_separations, max_separation, band_join, first_location, centre_neighbours, superpixel_2x2, tile_background, median_noise,
    bilinear_background, threshold_mask, blob_moments, blob_shapes, rejection_cascade, saturation_level, image_concentration, flux_topk, flux_topk_stratified, median_quality,
]


def queries():
    return {q.__name__: q for q in QUERIES}


# --- SQL -----------------------------------------------------------------------------------------

FRAMES = "f as (select *, case when xpixsz > 0 and focallen > 0 then 206.265e0*xpixsz*binning/focallen end scale from (select distinct * from frames))"
DETS = "dt as (select distinct on (det_id) * from detections where isfinite(flux))"
SOLS = f"""{FRAMES}, sol0 as (select frame_id, ra_deg, dec_deg, naxis1, naxis2, (naxis1-1)/2.0e0 cx, (naxis2-1)/2.0e0 cy, coalesce(scale, 2.0e0)/3600.0e0 s, radians((frame_id*37) % 360) t,
  case when frame_id % 2 = 0 then 1.0e0 else -1.0e0 end m from f where isfinite(ra_deg) and isfinite(dec_deg)),
sol as (select *, -s*cos(t)*m cd0, s*sin(t) cd1, s*sin(t)*m cd2, s*cos(t) cd3 from sol0)"""
ONSKY = f"""{SOLS}, {DETS}, o0 as (select det_id, frame_id, x, y, cx, cy, ra_deg, radians(dec_deg) d0, radians(cd0*(x-cx)+cd1*(y-cy)) xi, radians(cd2*(x-cx)+cd3*(y-cy)) eta from dt join sol using (frame_id)),
onsky as (select *, {MOD('ra_deg + degrees(atan2(xi, cos(d0) - eta*sin(d0)))', '360.0e0')} ra, degrees(atan2(sin(d0) + eta*cos(d0), sqrt(xi*xi + pow(cos(d0) - eta*sin(d0), 2)))) as dec from o0)"""
PX = "px as (select vec_id, cast(p//8 as int) y, cast(p%8 as int) x, cast(v as double) v from (select vec_id, unnest(range(0,64)) p, unnest(embedding) v from embeddings))"
MESH = f"""{PX}, tl as (select vec_id, y//{TILE} ty, x//{TILE} tx, list_sort(list(v)) s from px group by all),
mesh as (select vec_id, ty, tx, s[len(s)//2+1] as level, greatest(0.001e0, s[len(s)//2+1] - s[len(s)*1587//10000+1]) noise from tl)"""
BG = f"""{MESH}, b0 as (select *, greatest(0.0e0, least(1.0e0, (y+0.5e0)/{TILE}-0.5e0)) cy, greatest(0.0e0, least(1.0e0, (x+0.5e0)/{TILE}-0.5e0)) cx from px),
b1 as (select *, cast(floor(cy) as int) y0, cast(floor(cx) as int) x0, cy-floor(cy) dy, cx-floor(cx) dx from b0),
lit as (select b1.*, {{mix}} from b1 join mesh a on a.vec_id=b1.vec_id and a.ty=y0 and a.tx=x0 join mesh b on b.vec_id=b1.vec_id and b.ty=y0 and b.tx=least(x0+1,1)
  join mesh c on c.vec_id=b1.vec_id and c.ty=least(y0+1,1) and c.tx=x0 join mesh e on e.vec_id=b1.vec_id and e.ty=least(y0+1,1) and e.tx=least(x0+1,1))"""
BG = BG.replace("{mix}", ", ".join(f"a.{n}*(1-dx)*(1-dy)+b.{n}*dx*(1-dy)+c.{n}*(1-dx)*dy+e.{n}*dx*dy as {n}" for n in ("level", "noise")))
BLOB = f"""{BG}, mk as (select *, greatest(v - level, 0.0e0) w from lit where v > level + {K_SIGMA}e0*noise),
rc as (select vec_id, y*8+x p, y*8+x r from mk union select mk.vec_id, mk.y*8+mk.x, rc.r from rc join mk on mk.vec_id = rc.vec_id and abs(mk.y - rc.p//8) <= 1 and abs(mk.x - rc.p%8) <= 1),
lb as (select vec_id, p, min(r) r from rc group by all), ml as (select mk.*, cast(r//8 as bigint) * 4294967296 + r%8 as label from mk join lb on lb.vec_id = mk.vec_id and lb.p = mk.y*8+mk.x),
blob as (select vec_id, label, count(*) npix, greatest(max(v), 0) peak, sum(w) s, sum(x*w) sx, sum(y*w) sy, sum(x*x*w) sxx, sum(y*y*w) syy, sum(x*y*w) sxy, bool_or(x<1 or y<1 or x+1>=8 or y+1>=8) edge from ml group by vec_id, label)"""
SIZED = f"{DETS}, fr as (select distinct frame_id, naxis1 nx, naxis2 ny from frames), sz as (select dt.*, nx, ny from dt join fr using (frame_id))"
PTS = lambda k: f"{DETS}, pts as (select * from (select frame_id, row_number() over (partition by frame_id order by flux desc, det_id) - 1 i, x, y from dt) where i < {k})"
SEPS = "seps as (select a.frame_id, a.i, b.i j, sqrt((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)) sep from pts a join pts b on a.frame_id is not distinct from b.frame_id and a.i < b.i)"


def oracle_sql():
    half = "sqrt(w*w + h*h)/2.0e0*1.10e0"
    grid = lambda g, v, n: f"cast(least(floor({v}/{n}*{g}), {g}-1) as int)"
    med = lambda c: f"list_sort(list({c}))[count({c})//2+1] {c}"
    return {
        "frame_geometry": f"with {FRAMES}, g as (select *, naxis1*scale/3600.0e0 w, naxis2*scale/3600.0e0 h from f) select frame_id, {micro('scale')} scale_e6, {micro('w')} width_udeg, {micro('h')} height_udeg, {micro(f'coalesce({half}, 2.5e0)')} radius_udeg, case when bayerpat is not null then 2 else 1 end factor from g",
        "radius_rules": f"""with {FRAMES}, g as (select *, naxis1*scale/3600.0e0 w, naxis2*scale/3600.0e0 h, frame_id % 5 fov from f), r as (select *, {half} hd,
  case when fov > 0 then fov/2.0e0*sqrt(1 + pow(case when naxis1 > 0 and naxis2 > 0 then cast(naxis1 as double)/naxis2 else 1 end, 2))*1.10e0 end gv from g)
select frame_id, {micro('least(coalesce(hd, gv, 2.5e0), 2.5e0)')} radius_udeg, case when gv/hd not between 0.75e0 and 1.25e0 then {micro('(gv/hd-1)*100', 3)} end mismatch_e3 from r""",
        "catalogue_limit": f"with {DETS} select frame_id, greatest(300, least(5000, 3*count(*))) lim from dt group by frame_id",
        "pointing_hint": f"""with {FRAMES}, o as (select *, ra_deg between 0 and 360 and dec_deg between -90 and 90 and dec_deg <> -90 ok from f)
select frame_id, case when ok then {micro('ra_deg')} end ra_udeg, case when ok then {micro('dec_deg')} end dec_udeg, {micro("ra_deg", 7)} hint_ra_e7, {micro("dec_deg", 7)} hint_dec_e7 from o""",
        "sexagesimal": f"""with {FRAMES}, s as (select frame_id i, case when frame_id % 3 = 0 then '-' else '' end g, case when frame_id % 2 = 0 then ':' else ' ' end p from f)
select i frame_id, g || lpad(cast(i%24 as varchar),2,'0') || p || lpad(cast(i%60 as varchar),2,'0') || p || lpad(cast(i*7%60 as varchar),2,'0') || '.5' as text,
  {micro("case when g = '-' then -1.0e0 else 1.0e0 end * (i%24 + (i%60)/60.0e0 + ((i*7)%60 + 0.5e0)/3600.0e0)")} value_e6 from s""",
        "epoch_years": f"with {FRAMES} select frame_id, {micro('year(date_obs) + ((month(date_obs)-1)*30.4375e0 + (day(date_obs)-1))/365.25e0')} epoch_e6 from f",
        "mosaic_class": "select distinct log_id, coalesce(header.is_cfa, filt_eff = 'OSC', false) mosaic from solve_log",
        "wcs_pix_to_sky": f"with {ONSKY} select det_id, {micro('ra')} ra_udeg, {micro('dec')} dec_udeg from onsky where abs(dec) < 89.9",
        "wcs_sky_to_pix": f"with {ONSKY} select det_id, {micro('x', 3)} x_e3, {micro('y', 3)} y_e3 from onsky",
        "wcs_params": f"""with {SOLS} select frame_id, {micro('s*3600')} scale_e6, {micro(MOD('degrees(atan2(cd1, cd3))', '360.0e0'), 4)} orient_e4, case when m > 0 then 'normal' else 'mirrored' end parity,
  {micro('s', 9)} row1, {micro('s', 9)} row2, -{micro('s', 9)} col1, {micro('s', 9)} col2, {micro('cos(atan2(-cd1, cd0))', 4)} cos1, {micro('cos(atan2(cd2, cd3))', 4)} cos2 from sol""",
        "wcs_unbinned": f"with {SOLS} select frame_id, {micro('cx*2 + 0.5e0', 1)} cx_e1, {micro('cy*2 + 0.5e0', 1)} cy_e1, " + ", ".join(f"{micro(f'cd{i}/2', 9)} cd{i}_e9" for i in range(4)) + " from sol",
        "residual_rms": f"""with {ONSKY}, r as (select frame_id, sqrt(pow(x-cx,2)+pow(y-cy,2)) r, det_id % 7 * 0.01e0 e from onsky), q as (select *, r*0.001e0 + e res from r)
select frame_id, count(*) n, {micro('sqrt(avg(res*res))')} rms_e6, {micro('max(res)')} worst_e6, {micro('coalesce(corr(r, res), 0)', 5)} trend_e5 from q group by frame_id having count(*) >= 3""",
        "lsq_plane": f"""with {DETS}, p as (select frame_id, x/1000 x, y/1000 y, 3.0e0 + x/1000*2.0e0 - y/1000 + det_id%5*0.1e0 t from dt),
c as (select frame_id, count(*) n, avg(x) mx, avg(y) my, avg(t) mt, var_pop(x) xx, var_pop(y) yy, covar_pop(x,y) xy, covar_pop(x,t) xt, covar_pop(y,t) yt from p group by frame_id having count(*) >= 20),
s as (select *, (xt*yy - yt*xy)/(xx*yy - xy*xy) a1, (yt*xx - xt*xy)/(xx*yy - xy*xy) a2 from c)
select frame_id, n, {micro('mt - a1*mx - a2*my', 5)} a0_e5, {micro('a1', 5)} a1_e5, {micro('a2', 5)} a2_e5 from s""",
        "nearest_within_tol": f"""with {DETS}, t as (select frame_id, det_id tid, x+0.75e0 tx, y-0.5e0 ty from dt where det_id % 2 = 0),
j as (select frame_id, det_id id, tid, pow(x-tx,2)+pow(y-ty,2) d2 from dt join t using (frame_id) where abs(x-tx) <= 2.5e0 and pow(x-tx,2)+pow(y-ty,2) <= 6.25e0)
select frame_id, id, tid, {micro('d2', 4)} d2_e4 from (select *, row_number() over (partition by frame_id, id order by d2, tid) r from j) where r = 1""",
        "box_semi_join": f"with {DETS} select frame_id, det_id id from dt a where exists (select 1 from dt b where b.frame_id = a.frame_id and b.det_id % 3 = 0 and abs(a.x-b.x-10.25e0) <= 20 and abs(a.y-b.y-4.5e0) <= 20)",
        "knn_points": f"""with {PTS(POINTS)}, n as (select a.frame_id, a.i, b.i j, row_number() over (partition by a.frame_id, a.i order by (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y), b.i) "rank" from pts a join pts b on a.frame_id is not distinct from b.frame_id and a.i <> b.i)
select frame_id, i, "rank", j from n where "rank" <= 6""",
        "pair_separations": f"with {PTS(PAIR_POINTS)}, {SEPS} select frame_id, i, j, {micro('sep', 4)} sep_e4 from seps",
        "max_separation": f"with {DETS} select a.frame_id, {micro('sqrt(max((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y)))', 4)} max_e4 from dt a join dt b using (frame_id) where not isnan(a.x+a.y+b.x+b.y) group by 1",
        "band_join": f"""with {PTS(PAIR_POINTS)}, {SEPS}, {FRAMES}, {POINTED}, top as (select * from (select *, {BRIGHT} rk from cone) where rk <= {LIMIT}), {LINES_TO_PLANE.replace('from cone', 'from top')},
cs as (select a.disc_id frame_id, sqrt((a.xi-b.xi)*(a.xi-b.xi)+(a.eta-b.eta)*(a.eta-b.eta))*3600.0e0/scale want from plane a join plane b on a.disc_id = b.disc_id and a.rk < b.rk join f on f.frame_id = a.disc_id where scale is not null)
select seps.frame_id, count(*) n from seps join cs using (frame_id) where abs(want - sep) <= {TOL}e0 + abs(sep)*0.005e0 group by 1""",
        "first_location": "select frame_id, path, log_id from (select frame_id, path, log_id, row_number() over (partition by frame_id order by coalesce(outcome.solved, false) desc, path, log_id) r from (select distinct on (log_id) * from solve_log)) where r = 1",
        "centre_neighbours": f"""with s as (select distinct log_id, outcome.field.center.ra r, outcome.field.center.dec d from solve_log where isfinite(outcome.field.center.ra))
select a.log_id, count(*) neighbours from s a join s b on a.log_id <> b.log_id and abs(a.d - b.d) < 0.51e0
where 2.0e0*degrees(asin(least(1.0e0,sqrt(pow(sin(radians(b.d-a.d)/2.0e0),2)+cos(radians(a.d))*cos(radians(b.d))*pow(sin(radians(b.r-a.r)/2.0e0),2))))) <= 0.5e0 group by a.log_id""",
        "superpixel_2x2": f"with {PX} select vec_id, y//2 y, x//2 x, {micro('avg(v)', 7)} v_e7 from px group by vec_id, y//2, x//2",
        "tile_background": f"with {MESH} select vec_id, ty, tx, {micro('level', 7)} level_e7, {micro('noise', 7)} noise_e7 from mesh",
        "median_noise": f"with {MESH} select vec_id, {micro('list_sort(list(noise))[count(*)//2+1]', 7)} noise_e7 from mesh group by vec_id",
        "bilinear_background": f"with {BG} select vec_id, y, x, {micro('level', 7)} level_e7, {micro('noise', 7)} noise_e7 from lit",
        "threshold_mask": f"with {BG} select vec_id, y, x from lit where v > level + {K_SIGMA}e0*noise",
        "blob_moments": f"with recursive {BLOB} select vec_id, label, npix, edge, " + ", ".join(f"{micro(c)} {c}_e6" for c in ("peak", "s", "sx", "sy", "sxx", "syy", "sxy")) + " from blob",
        "blob_shapes": f"""with recursive {BLOB}, c as (select *, sx/s cx, sy/s cy from blob where s > 0 and npix >= 3), m as (select *, greatest(sxx/s - cx*cx, 0) mxx, greatest(syy/s - cy*cy, 0) myy, sxy/s - cx*cy mxy from c),
ab as (select *, sqrt(greatest((mxx+myy)/2 + sqrt(pow(mxx-myy,2)/4 + mxy*mxy), 1e-9)) a, sqrt(greatest((mxx+myy)/2 - sqrt(pow(mxx-myy,2)/4 + mxy*mxy), 0)) b from m)
select vec_id, label, {micro('cx', 4)} cx_e4, {micro('cy', 4)} cy_e4, {micro('1-b/a', 4)} ellipticity_e4, {micro('2.354820045e0*greatest(sqrt(a*b), 1e-6)', 4)} fwhm_px_e4 from ab""",
        "rejection_cascade": f"""with {SIZED}, md as (select frame_id, greatest(list_sort(list(npix))[count(*)//2+1], 1) mid from sz where npix >= 8 group by frame_id),
w as (select frame_id, case when npix < 8 then 'too_small' when npix > greatest(coalesce(mid,1)*3.0e0, 32) then 'extended' when peak >= 65535*0.999e0 then 'saturated' when x < 8 or y < 8 or x+8 >= nx or y+8 >= ny then 'edge'
  when flux <= 0 then 'too_small' when ellipticity > 0.6 then 'elongated' else 'kept' end why from sz left join md using (frame_id))
select frame_id, """ + ", ".join(f"count(*) filter (why = '{r}') {r}" for r in ("too_small", "extended", "saturated", "edge", "elongated", "kept")) + " from w group by frame_id",
        "saturation_level": f"with {DETS}, p as (select frame_id, peak, count(*) n from dt group by all), q as (select *, row_number() over (partition by frame_id order by peak desc) r from p) select frame_id, case when n >= 8 then {micro('peak*(1-1e-6)', 2)} end level_e2 from q where r = 1",
        "image_concentration": f"with {SIZED}, h as (select frame_id, {grid(8, 'x', 'nx')} gx, {grid(8, 'y', 'ny')} gy, count(*) n from sz group by all) select frame_id, sum(n) n, max(n) busiest, {micro('max(n)/(sum(n)/64.0e0)')} concentration_ppm from h group by frame_id",
        "flux_topk": f'with {DETS} select frame_id, "rank", det_id from (select frame_id, det_id, row_number() over (partition by frame_id order by flux desc, det_id) "rank" from dt) where "rank" <= {KEEP}',
        "flux_topk_stratified": f"""with {SIZED}, r as (select *, row_number() over (partition by frame_id order by flux desc, det_id) "rank", count(*) over (partition by frame_id) total from sz),
h as (select frame_id, total, {grid(8, 'x', 'nx')} gx, {grid(8, 'y', 'ny')} gy, count(*) n from r where "rank" <= 30 group by all),
c as (select frame_id, greatest(1, least(16, cast(round(2*sqrt(total/30)) as int))) g from h group by frame_id, total having total > 30 and sum(n) >= 20 and max(n)/(sum(n)/64.0e0) >= 4),
k as (select *, row_number() over (partition by frame_id, gy, gx order by flux desc, det_id) rnd from (select r.*, {grid('g', 'x', 'nx')} gx, {grid('g', 'y', 'ny')} gy from r join c using (frame_id))),
u as (select *, row_number() over (partition by frame_id order by rnd, gy, gx) turn from k)
select frame_id, "rank", det_id, false stratified from r where "rank" <= 30 and frame_id not in (select frame_id from c)
union all select frame_id, row_number() over (partition by frame_id order by flux desc, det_id), det_id, true from u where turn <= 30""",
        "median_quality": f"with {DETS} select frame_id, {med('fwhm_px')}, {med('ellipticity')}, {med('theta_deg')} from dt group by frame_id",
    }
