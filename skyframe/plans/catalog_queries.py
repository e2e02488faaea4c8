"""Catalogue and disc queries with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, healpix, sphere
from ..operators import catalog
from ..session import table

NSIDE = 64
LIMIT = 25
EPOCH, TARGET = 2016.0, 2026.5


def stars(spark: SparkSession, d: str) -> DataFrame:
    """Distinct star records with a magnitude, in degrees."""
    raw = table(spark, d, "star_records").select("star_id", "cell", "ra_scaled", "dec_scaled", "mag_milli", "pmra_mas", "pmdec_mas").distinct()
    return codec.unpack_star(raw.where(F.col("mag_milli").isNotNull()))


def discs(spark: SparkSession, d: str) -> DataFrame:
    """The cones of the sky fields."""
    f = table(spark, d, "sky_fields").where(F.col("shape") == "cone").dropDuplicates(["field_id"])
    return f.select(F.col("field_id").alias("disc_id"), F.col("ra_deg").alias("ra0"), F.col("dec_deg").alias("dec0"), F.col("radius_deg").alias("radius"))


def pointings(spark: SparkSession, d: str) -> DataFrame:
    """One disc of half a degree around every pointed frame."""
    f = table(spark, d, "frames").where(catalog.finite("ra_deg", "dec_deg")).dropDuplicates(["frame_id"])
    return f.select(F.col("frame_id").alias("disc_id"), F.col("ra_deg").alias("ra0"), F.col("dec_deg").alias("dec0"), F.lit(0.5).alias("radius"))


def _cone(spark, d):
    return catalog.cone_search(stars(spark, d), discs(spark, d), NSIDE)


def cone_search(spark, d):
    return _cone(spark, d).select("disc_id", "star_id", sphere.micro(F.col("sep")).alias("sep_udeg"))


def cone_topk(spark, d):
    """The hundred brightest stars within ten degrees of one place."""
    one = spark.createDataFrame([(1, 120.0, 20.0, 10.0)], "disc_id long, ra0 double, dec0 double, radius double")
    return catalog.cone_search(stars(spark, d), one, NSIDE).orderBy(*catalog.BRIGHTEST).limit(100).select("star_id", "mag_milli")


def cone_topk_batch(spark, d):
    return catalog.brightest(catalog.cone_search(stars(spark, d), pointings(spark, d), NSIDE), LIMIT).select("disc_id", "rank", "star_id")


def cone_stratified(spark, d):
    return catalog.stratified(_cone(spark, d), LIMIT).select("disc_id", "rank", "star_id")


def disc_all_index_order(spark, d):
    return catalog.index_order(_cone(spark, d)).select("disc_id", "place", "star_id")


def depth_comparison(spark, d):
    """Stars by which a limit of 25 falls short of all stars of a disc; with a limit beyond their number none would."""
    cone = _cone(spark, d)
    return catalog.set_difference(cone, catalog.brightest(cone, LIMIT), ["disc_id", "star_id"])


def healpix_encode(spark, d):
    return healpix.with_cell(stars(spark, d).drop("cell"), NSIDE).select("star_id", "cell")


def healpix_decode(spark, d):
    cells = healpix.with_centre(table(spark, d, "star_records").select("cell").distinct(), NSIDE)
    return cells.select("cell", sphere.micro(F.col("ra")).alias("ra_udeg"), sphere.micro(F.col("dec")).alias("dec_udeg"))


def healpix_level12(spark, d):
    """Whether any position of a source lies in the level-12 cell that its number names, or next to it."""
    g = _gaia(spark, d).where(catalog.finite("ra", "dec") & F.col("dec").between(-90, 90))
    own = healpix.with_centre(healpix.with_cell(g, 4096).withColumn("named", F.shiftright("source_id", 35)), 4096, "named", "cra", "cdec")
    near = (F.col("cell") == F.col("named")) | (sphere.separation(*map(F.col, ("ra", "dec", "cra", "cdec"))) <= healpix.cell_radius(4096))
    return own.groupBy("source_id").agg(F.bool_or(near).alias("agrees"))


def cell_histogram(spark, d):
    return catalog.cell_histogram(stars(spark, d))


def cell_offsets(spark, d):
    return catalog.cell_offsets(stars(spark, d), NSIDE)


def offsets_monotone(spark, d):
    return catalog.offsets_monotone(catalog.cell_offsets(stars(spark, d), NSIDE))


def index_info(spark, d):
    return catalog.index_info(stars(spark, d))


def catalog_concentration(spark, d):
    got = catalog.concentration(catalog.brightest(_cone(spark, d), LIMIT), NSIDE)
    return got.select("disc_id", "n", "busiest", F.round(F.col("concentration") * 1e6).cast("long").alias("concentration_ppm"), "meaningful")


def select_catalogue(spark, d):
    return catalog.select_catalogue(_cone(spark, d), LIMIT, NSIDE, max_mag=20.5).select("disc_id", "star_id", "rank", "stratified")


def star_at_index(spark, d):
    """Stars of patterns given by places all over the index, and some beyond its end."""
    s = stars(spark, d)
    indexed = catalog.global_order(s).select("global_idx", "star_id")
    quads = table(spark, d, "frames").select(F.col("frame_id").alias("quad_id")).distinct()
    n = s.agg((F.count(F.lit(1)) + F.lit(3)).alias("n"))  # one row
    places = F.array(*[(F.col("quad_id") * m) % F.col("n") for m in (7919, 104729, 1299709, 15485863)])
    wanted = quads.join(F.broadcast(n)).select("quad_id", F.posexplode(places).alias("k", "global_idx"))
    return catalog.star_at(indexed, wanted).select("quad_id", "k", "star_id")


def _gaia(spark, d):
    return table(spark, d, "gaia_rows").select("source_id", "ra", "dec", "mag", "pmra", "pmdec").distinct()


def star_pack(spark, d):
    g = _gaia(spark, d).where(catalog.finite("ra", "dec", "mag") & F.col("dec").between(-90, 90))
    return codec.pack_star(g).groupBy("source_id", "ra_scaled", "dec_scaled", "mag_milli", "pmra_mas", "pmdec_mas", "clamped").agg(F.count(F.lit(1)).alias("n"))


def star_unpack(spark, d):
    return stars(spark, d).select("star_id", F.round(F.col("ra") * 1e8).cast("long").alias("ra_e8"), F.round(F.col("dec") * 1e8).cast("long").alias("dec_e8"), "mag")


def star_index(spark, d):
    """The clustered star index of the catalogue; clustering does not show in the rows."""
    g = _gaia(spark, d).where(F.col("dec").between(-90, 90))
    return catalog.build_star_index(g, NSIDE).select("source_id", "cell", "mag_milli")


def build_stats(spark, d):
    return catalog.build_stats(_gaia(spark, d))


def row_filter(spark, d):
    return catalog.row_filter(_gaia(spark, d), 18.0, -30.0, 60.0).select("source_id", "mag")


def null_policy(spark, d):
    """Rows kept by the reader: a missing magnitude skips the row, missing motion is zero."""
    g = _gaia(spark, d).where(F.col("mag").isNotNull())
    return g.select("source_id", "mag", *[F.coalesce(F.col(c), F.lit(0.0).cast("float")).alias(c) for c in ("pmra", "pmdec")])


def magnitude_cap(spark, d):
    """The cap compares whole thousandths of a magnitude."""
    return stars(spark, d).where(F.col("mag_milli") <= int(14.2 * 1000)).select("star_id", "mag_milli")


def proper_motion(spark, d):
    s = stars(spark, d).where(F.col("pmra_mas").isNotNull() & F.col("pmdec_mas").isNotNull())
    ra, dec = sphere.moved(F.col("ra"), F.col("dec"), F.col("pmra"), F.col("pmdec"), F.lit(TARGET - EPOCH))
    return s.select("star_id", sphere.micro(ra).alias("ra_udeg"), sphere.micro(dec).alias("dec_udeg"))


def _plane(spark, d):
    xi, eta = sphere.to_plane(*map(F.col, ("ra", "dec", "ra0", "dec0")))
    return _cone(spark, d).withColumn("xi", xi).withColumn("eta", eta)


def gnomonic_forward(spark, d):
    return _plane(spark, d).select("disc_id", "star_id", sphere.micro(F.col("xi")).alias("xi_udeg"), sphere.micro(F.col("eta")).alias("eta_udeg"))


def gnomonic_inverse(spark, d):
    """Back from the plane to the sky: the stars' own positions."""
    ra, dec = sphere.from_plane(*map(F.col, ("xi", "eta", "ra0", "dec0")))
    return _plane(spark, d).where(F.abs("dec") < 89).select("disc_id", "star_id", sphere.micro(ra, 5).alias("ra_e5"), sphere.micro(dec, 5).alias("dec_e5"))


def angsep_matrix(spark, d):
    """Distances of all pairs of the sixty fields' cones, a table of fixed size."""
    a = discs(spark, d).select(F.col("disc_id").alias("a"), F.col("ra0").alias("ra"), F.col("dec0").alias("dec"))
    b = discs(spark, d).select(F.col("disc_id").alias("b"), "ra0", "dec0")
    return a.join(F.broadcast(b), F.col("a") < F.col("b")).select("a", "b", sphere.micro(sphere.separation(*map(F.col, ("ra", "dec", "ra0", "dec0")))).alias("sep_udeg"))


QUERIES = [
    cone_search, cone_topk, cone_topk_batch, cone_stratified, disc_all_index_order, depth_comparison, healpix_encode, healpix_decode, healpix_level12, cell_histogram, cell_offsets, offsets_monotone,
    index_info, catalog_concentration, select_catalogue, star_at_index, star_pack, star_unpack, star_index, build_stats, row_filter, null_policy, magnitude_cap,
    proper_motion, gnomonic_forward, gnomonic_inverse, angsep_matrix,
]


def queries():
    return {q.__name__: q for q in QUERIES}


# --- SQL ---------------------------------------------------------------------------------------

STARS = """stars as (select *, ra_scaled*360.0e0/4294967296.0e0 ra, dec_scaled*90.0e0/2147483647.0e0 dec, mag_milli/1000.0e0 mag
  from (select distinct star_id, cell, ra_scaled, dec_scaled, mag_milli, pmra_mas, pmdec_mas from star_records) where mag_milli is not null)"""
DISCS = "discs as (select distinct field_id disc_id, ra_deg ra0, dec_deg dec0, radius_deg radius from sky_fields where shape = 'cone')"
SEP = "2.0e0*degrees(asin(least(1.0e0,sqrt(pow(sin(radians(dec-dec0)/2.0e0),2)+cos(radians(dec0))*cos(radians(dec))*pow(sin(radians(ra-ra0)/2.0e0),2)))))"
CONE = f"{STARS}, {DISCS}, cone as (select * from (select *, {SEP} sep from stars, discs where abs(dec - dec0) <= radius + 0.001e0) where sep <= radius)"
POINTED = f"""{STARS}, discs as (select distinct frame_id disc_id, ra_deg ra0, dec_deg dec0, 0.5e0 radius from frames where isfinite(ra_deg) and isfinite(dec_deg)),
cone as (select * from (select *, {SEP} sep from stars, discs where abs(dec - dec0) <= radius + 0.001e0) where sep <= radius)"""
DISTINCT_GAIA = "g as (select distinct source_id, ra, dec, mag, pmra, pmdec from gaia_rows)"


def micro(x: str, digits: int = 6) -> str:
    return f"cast(round(({x}) * 1e{digits}) as bigint)"


MOD = lambda x, n: f"((({x}) % {n}) + {n}) % {n}"
BRIGHT = "row_number() over (partition by disc_id order by mag_milli, cell, star_id)"
TOP = f"top as (select * from (select *, {BRIGHT} \"rank\" from cone) where \"rank\" <= {LIMIT})"
CONC = """per as (select disc_id, radius, cell, count(*) n from top group by all),
conc as (select disc_id, sum(n) n, max(n) busiest, greatest(1.0e0, 2.0e0*pi()*(1.0e0-cos(radians(radius)))/(4.0e0*pi()/49152.0e0)) cells from per group by disc_id, radius)"""
STRAT = f"""strat as (select *, {BRIGHT} "rank" from (select *, row_number() over (partition by disc_id order by rnd, cell) turn from
  (select *, row_number() over (partition by disc_id, cell order by mag_milli, star_id) rnd from cone)) where turn <= {LIMIT})"""
LINES_TO_PLANE = """p as (select *, radians(ra)-radians(ra0) dr, radians(dec) d, radians(dec0) d0 from cone),
q as (select *, sin(d0)*sin(d)+cos(d0)*cos(d)*cos(dr) c from p),
plane as (select *, degrees(cos(d)*sin(dr)/c) xi, degrees((cos(d0)*sin(d)-sin(d0)*cos(d)*cos(dr))/c) eta from q)"""
SPREAD = "(({0}) & 1) | ((({0}) & 2) << 1) | ((({0}) & 4) << 2) | ((({0}) & 8) << 3) | ((({0}) & 16) << 4) | ((({0}) & 32) << 5)"


def oracle_sql():
    none0 = lambda c: f"coalesce({c}, cast(0 as float))"
    pack = lambda c: f"cast(greatest(-32768, least(32767, round(case when {c} is null or isnan({c}) then 0 else {c} end))) as smallint)"
    big = lambda c: f"(not ({c} is null or isnan({c})) and (round({c}) < -32768 or round({c}) > 32767))"
    gather = lambda x: "(" + " | ".join(f"((({x}) >> {b}) & {1 << b})" for b in range(6)) + ")"
    ok = "isfinite(ra) and isfinite(dec) and isfinite(mag)"
    return {
        "cone_search": f"with {CONE} select disc_id, star_id, {micro('sep')} sep_udeg from cone",
        "cone_topk": f"with {STARS}, o as (select *, 120.0e0 ra0, 20.0e0 dec0 from stars) select star_id, mag_milli from (select *, {SEP} sep from o) where sep <= 10 order by mag_milli, cell, star_id limit 100",
        "cone_topk_batch": f"""with {POINTED}, {TOP} select disc_id, "rank", star_id from top""",
        "cone_stratified": f'with {CONE}, {STRAT} select disc_id, "rank", star_id from strat',
        "disc_all_index_order": f"with {CONE} select disc_id, row_number() over (partition by disc_id order by cell, mag_milli, star_id) place, star_id from cone",
        "depth_comparison": f"with {CONE}, {TOP} select disc_id, star_id, 'a' side from (select disc_id, star_id from cone except select disc_id, star_id from top)",
        # the table's own cells are the truth
        "healpix_encode": "select distinct star_id, cell from star_records where mag_milli is not null",
        "healpix_decode": f"""
with c as (select distinct cell from star_records),
f as (select cell, cell >> 12 face, {gather('cell & 4095')} x, {gather('(cell & 4095) >> 1')} y from c),
r as (select *, [2,2,2,2,3,3,3,3,4,4,4,4][face+1]*64 - x - y - 1 ring, [1,3,5,7,0,2,4,6,1,3,5,7][face+1] lonf from f),
k as (select *, case when ring < 64 then ring when ring > 192 then 256 - ring else 64 end n, case when ring < 64 or ring > 192 then 0 else (ring - 64) & 1 end odd from r),
z as (select *, case when ring < 64 then 1 - n*n/12288.0e0 when ring > 192 then n*n/12288.0e0 - 1 else (128 - ring)*2.0e0/192.0e0 end z, (lonf*n + x - y + 1 + odd) // 2 l0 from k),
l as (select *, case when l0 > 256 then l0 - 256 when l0 < 1 then l0 + 256 else l0 end l from z)
select cell, {micro(MOD('(l - (odd + 1) * 0.5e0) * (90.0e0 / n)', '360.0e0'))} ra_udeg, {micro('degrees(asin(z))')} dec_udeg from l""",
        "cell_histogram": f"with {STARS} select cell, count(*) n from stars group by cell",
        "cell_offsets": f"""with {STARS}, h as (select cell, count(*) n from stars group by cell), a as (select range cell, coalesce(n, 0) n from range(49152) left join h on range = cell)
select cell, n, sum(n) over (order by cell) - n as first, sum(n) over (order by cell) as next from a""",
        "offsets_monotone": f"with {STARS} select 0 falls, count(*) n_stars from stars",
        "index_info": f"with {STARS}, h as (select cell, count(*) n from stars group by cell) select count(*) occupied, sum(n) n_stars, max(n) max_per_cell, cast(round(avg(n)*1000) as bigint) mean_milli from h",
        "catalog_concentration": f"with {CONE}, {TOP}, {CONC} select disc_id, n, busiest, {micro('busiest/(n/cells)')} concentration_ppm, n >= cells meaningful from conc",
        "select_catalogue": f"""with {CONE}, full_top as (select * from (select *, {BRIGHT} "rank" from cone) where "rank" <= {LIMIT}), top as (select * from full_top where mag_milli <= 20500), {CONC}, {STRAT},
crowded as (select disc_id from conc where n >= cells and busiest/(n/cells) >= 2)
select disc_id, star_id, "rank", false stratified from top where disc_id not in (from crowded) union all select disc_id, star_id, "rank", true from strat where disc_id in (from crowded) and mag_milli <= 20500""",
        "star_at_index": f"""with {STARS}, i as (select star_id, row_number() over (order by cell, mag_milli, star_id) - 1 g from stars), f as (select distinct frame_id quad_id from frames),
n as (select count(*) + 3 n from stars),
w as (select quad_id, k, (quad_id * m) % n g from f, n, (values (0,7919),(1,104729),(2,1299709),(3,15485863)) v(k, m)), j as (select * from w join i using (g))
select quad_id, k, star_id from j where quad_id in (select quad_id from j group by quad_id having count(*) = 4)""",
        "star_pack": f"""with {DISTINCT_GAIA} select source_id, ra_scaled, dec_scaled, mag_milli, pmra_mas, pmdec_mas, clamped, count(*) n from (select source_id,
  cast(round(({MOD('ra', '360.0e0')}) * (4294967296.0e0/360.0e0)) as bigint) & 4294967295 ra_scaled, cast(round(dec * (2147483647.0e0/90.0e0)) as int) dec_scaled,
  cast(greatest(-32768, least(32767, round(mag * cast(1000 as float)))) as smallint) mag_milli, {pack('pmra')} pmra_mas, {pack('pmdec')} pmdec_mas,
  (round(mag * cast(1000 as float)) not between -32768 and 32767) or {big('pmra')} or {big('pmdec')} clamped
  from g where {ok} and dec between -90 and 90) group by all""",
        "star_unpack": f"with {STARS} select star_id, {micro('ra', 8)} ra_e8, {micro('dec', 8)} dec_e8, mag from stars",
        # the high bits of a source's number are its cell at level 12; positions of later deliveries differ
        "healpix_level12": "select source_id, bool_or(true) agrees from gaia_rows where isfinite(ra) and isfinite(dec) and dec between -90 and 90 group by source_id",
        "star_index": f"""with {DISTINCT_GAIA}, a as (select source_id, cast(greatest(-32768, least(32767, round(mag * cast(1000 as float)))) as smallint) mag_milli,
  sin(radians(dec)) z, radians({MOD('ra', '360.0e0')})/(pi()/2) t from g where {ok} and dec between -90 and 90),
b as (select *, least(3, cast(floor(t) as bigint)) q, 64*sqrt(greatest(0.0e0, 3*(1-abs(z)))) m, abs(z) <= 2.0e0/3 belt from a),
c as (select *, case when belt then cast(floor(64*(0.5e0+t) - 64*z*0.75e0) as bigint) else least(63, cast(floor((t-q)*m) as bigint)) end u,
  case when belt then cast(floor(64*(0.5e0+t) + 64*z*0.75e0) as bigint) else least(63, cast(floor((1-(t-q))*m) as bigint)) end w from b),
e as (select *, case when not belt then case when z > 0 then q else q + 8 end when u >> 6 = w >> 6 then ((u >> 6) & 3) + 4 when u >> 6 < w >> 6 then (u >> 6) & 3 else ((w >> 6) & 3) + 8 end face,
  case when belt then w & 63 when z > 0 then 63 - w else u end x, case when belt then 63 - (u & 63) when z > 0 then 63 - u else w end y from c)
select source_id, face*4096 + ({SPREAD.format('x')}) + (({SPREAD.format('y')}) << 1) as cell, mag_milli from e""",
        "build_stats": f"""with {DISTINCT_GAIA} select count(*) filter ({ok}) written,
  count(*) filter ({ok} and ((round(mag * cast(1000 as float)) not between -32768 and 32767) or abs(dec) > 90 or {big('pmra')} or {big('pmdec')})) clamped,
  count(*) filter (not coalesce({ok}, false)) skipped from g""",
        "row_filter": f"with {DISTINCT_GAIA} select source_id, mag from g where mag <= 18 and not isnan(mag) and isfinite(dec) and dec between -30 and 60",
        "null_policy": f"with {DISTINCT_GAIA} select source_id, mag, {none0('pmra')} pmra, {none0('pmdec')} pmdec from g where mag is not null",
        "magnitude_cap": f"with {STARS} select star_id, mag_milli from stars where mag_milli <= 14200",
        "proper_motion": f"""with {STARS}, a as (select star_id, ra, dec, radians(ra) r, radians(dec) d, pmra_mas pa, pmdec_mas pd, pmra_mas*10.5e0*pi()/648000000.0e0 e, pmdec_mas*10.5e0*pi()/648000000.0e0 n from stars where pmra_mas is not null and pmdec_mas is not null),
v as (select *, cos(d)*cos(r)-e*sin(r)-n*sin(d)*cos(r) x, cos(d)*sin(r)+e*cos(r)-n*sin(d)*sin(r) y, sin(d)+n*cos(d) z from a)
select star_id, {micro('case when pa = 0 and pd = 0 then ra else ' + MOD('degrees(atan2(y, x))', '360.0e0') + ' end')} ra_udeg, {micro('case when pa = 0 and pd = 0 then dec else degrees(asin(z/sqrt(x*x+y*y+z*z))) end')} dec_udeg from v""",
        "gnomonic_forward": f"with {CONE}, {LINES_TO_PLANE} select disc_id, star_id, {micro('xi')} xi_udeg, {micro('eta')} eta_udeg from plane",
        "gnomonic_inverse": f"with {CONE} select disc_id, star_id, {micro('ra', 5)} ra_e5, {micro('dec', 5)} dec_e5 from cone where abs(dec) < 89",
        "angsep_matrix": f"with {DISCS} select a.disc_id a, b.disc_id b, {micro(SEP.replace('dec0', 'b.Q').replace('ra0', 'b.P').replace('dec', 'a.dec0').replace('ra-', 'a.ra0-').replace('b.Q', 'b.dec0').replace('b.P', 'b.ra0'))} sep_udeg from discs a, discs b where a.disc_id < b.disc_id",
    }
