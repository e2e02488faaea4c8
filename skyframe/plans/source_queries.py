"""Files written and read back: queries whose result went through a format, with SQL over the tables it came from."""

from __future__ import annotations

import os
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..functions import codec, frame, sphere
from ..operators import catalog, quads
from ..session import checkpoint_dir, table
from ..sources import catalog_files, fits, logs, mirror, quad_files, sidecar
from . import frame_queries
from .catalog_queries import CONE, DISTINCT_GAIA, MOD, NSIDE, SPREAD, _cone, _gaia, micro, stars
from .frame_queries import PX, SOLS, WIDTH
from .quad_queries import BAND, PICKED, TILES

MAX_MAG, LOW, HIGH = 18.0, -30.0, 60.0
BOUNDS = (95.0, 125.0, -5.0, 25.0)


def _folder(spark) -> str:
    """A new folder below the shared one."""
    path = f"{checkpoint_dir(spark).removeprefix('file:')}/files-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


def _rows(spark, d):
    return _gaia(spark, d).where(catalog.finite("ra", "dec"))


def catalog_reader(spark, d):
    """Shards in two layouts, one under other names, through the strict reader."""
    path, g = _folder(spark), _rows(spark, d)
    plain = g.withColumnRenamed("mag", "phot_g_mean_mag")
    plain.where("source_id % 2 = 0").write.option("header", True).csv(f"{path}/a")
    plain.where("source_id % 2 <> 0").select("pmdec", "pmra", F.col("ra").alias("RAJ"), "source_id", "phot_g_mean_mag", "dec").write.option("header", True).csv(f"{path}/b")
    parts = [catalog_files.read_shards(spark, files, spec) for k, spec in (("a", None), ("b", "ra=RAJ")) if (files := catalog_files.shard_files(f"{path}/{k}"))]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return got.select("source_id", sphere.micro(F.col("ra"), 9).alias("ra_e9"), sphere.micro(F.col("dec"), 9).alias("dec_e9"), "mag", "pmra", "pmdec")


def mirror_filter(spark, d):
    """Large files filtered into narrow shards, guarded by their manifest, and read."""
    path = _folder(spark)
    _rows(spark, d).withColumnRenamed("mag", "phot_g_mean_mag").write.option("header", True).csv(f"{path}/raw")
    mirror.build(spark, catalog_files.shard_files(f"{path}/raw"), f"{path}/mirror", MAX_MAG, LOW, HIGH)
    if catalog_files.check_manifest(f"{path}/mirror", MAX_MAG, LOW, HIGH) is None:
        raise catalog_files.CatalogError("the mirror has no manifest")
    got = catalog_files.read_shards(spark, catalog_files.shard_files(f"{path}/mirror"))
    return got.select(sphere.micro(F.col("ra"), 9).alias("ra_e9"), sphere.micro(F.col("dec"), 9).alias("dec_e9"), "mag", "pmra", "pmdec")


def star_index_file(spark, d):
    """The star index as a binary file, verified by its digest and read by ranges of cells."""
    path = f"{_folder(spark)}/stars{catalog_files.STAR_SUFFIX}"
    g = _rows(spark, d).where(F.col("dec").between(-90, 90))
    catalog_files.write_binary(catalog.build_star_index(g, NSIDE), NSIDE, 2016.0, "gaia", path)
    catalog_files.open_binary(catalog_files.pick(os.path.dirname(path)), verify=True)
    got = catalog_files.read_binary(spark, path)
    return got.groupBy(*got.columns).agg(F.count(F.lit(1)).alias("n"))


def quad_index_file(spark, d):
    """The pattern index by band, opened with the star index that it was built from."""
    path, s = _folder(spark), stars(spark, d)
    meta = catalog.index_meta(s, NSIDE, 2016.0, "stars")
    quad_files.write_quad_index(quads.build_quad_index(s), meta, f"{path}/quads")
    got = quad_files.open_quad_index(spark, f"{path}/quads", meta).withColumn("k", codec.pack_code(F.col("code")))
    return got.select("band", "tile_scale", "disc_id", "place", "clamped", *[F.col("k")[i].alias(f"k{i}") for i in range(4)], F.concat_ws(",", F.transform("stars", lambda v: v.cast("string"))).alias("stars"))


def cone_csv(spark, d):
    return sidecar.cone_csv(_cone(spark, d)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def cone_json(spark, d):
    return sidecar.cone_json(_cone(spark, d)).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def log_roundtrip(spark, d):
    """The solve log as lines of JSON and back."""
    path = f"{_folder(spark)}/log"
    logs.write_log(table(spark, d, "solve_log").dropDuplicates(["log_id"]), path)
    rms = F.col("outcome.fit.rms_deg")
    got = logs.read_log(spark, path).where("broken is null")
    return got.select("log_id", "frame_id", "rig", F.col("outcome.solved").alias("solved"), F.col("outcome.reason").alias("reason"), F.col("outcome.stars_matched").alias("matched"), F.when(~F.isnan(rms), sphere.micro(rms, 9)).alias("rms_e9"))


def fits_cards(spark, d):
    """Header cards of an image file of every frame, read by name."""

    def make(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                head = [("FRAME", int(r.frame_id)), ("XPIXSZ", float(r.xpixsz)), ("RIG", str(r.rig).replace("'", "''"))]
                head += [("FOCALLEN", float(r.focallen))] if r.focallen is not None and np.isfinite(r.focallen) else []
                rows.append((str(r.frame_id), fits.write_image(np.zeros((2, 2)), head)))
            yield pd.DataFrame(rows, columns=["path", "content"])

    files = table(spark, d, "frames").dropDuplicates(["frame_id"]).where("xpixsz is not null").select("frame_id", "xpixsz", "focallen", "rig").mapInPandas(make, "path string, content binary")
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    got = fits.header_cards(files).groupBy("path").agg(*[value(n).alias(n) for n in ("FRAME", "XPIXSZ", "FOCALLEN", "RIG", "NAXIS1")], F.count(F.lit(1)).alias("cards"))
    return got.select(F.col("FRAME").cast("long").alias("frame_id"), sphere.micro(F.col("XPIXSZ").cast("double")).alias("xpixsz_e6"), sphere.micro(F.col("FOCALLEN").cast("double")).alias("focallen_e6"), F.col("RIG").alias("rig"), F.col("NAXIS1").cast("int").alias("naxis1"), "cards")


def fits_pixels(spark, d):
    """Every embedding as a 16-bit image and back: its pixels, and the means of 2 x 2 cells of a colour mosaic."""

    def run(batches):
        for pdf in batches:
            for i, e in zip(pdf.vec_id, pdf.embedding):
                px = np.asarray(e, float).reshape(WIDTH, WIDTH) * 1000 + 30000
                for mosaic in (False, True):
                    _, got, binned = fits.read_image(fits.write_image(px, [("BAYERPAT", "RGGB")] if mosaic else []))
                    y, x = np.indices(got.shape)
                    yield pd.DataFrame({"vec_id": i, "binned": binned, "y": y.ravel(), "x": x.ravel(), "v4": np.rint(got.ravel() * 4).astype(int)})

    return table(spark, d, "embeddings").select("vec_id", "embedding").mapInPandas(run, "vec_id long, binned int, y int, x int, v4 long")


def header_update(spark, d):
    """Image files whose headers get the position of a field in place, read from their folder."""
    path = _folder(spark)
    f = table(spark, d, "sky_fields").where("shape = 'cone'").dropDuplicates(["field_id"]).select("field_id", "ra_deg", "dec_deg")

    def make(batches):
        for pdf in batches:
            for i in pdf.field_id:
                with open(f"{path}/{i}.fits", "wb") as out:
                    out.write(fits.write_image(np.full((4, 4), float(i)), [("CRVAL1", 0.0), ("OBJECT", str(i))]))
            yield pdf.assign(path=[f"{path}/{i}.fits" for i in pdf.field_id])

    made = f.mapInPandas(make, "field_id long, ra_deg double, dec_deg double, path string")
    fits.update_headers(made, lambda r: [("CRVAL1", float(r["ra_deg"])), ("CRVAL2", float(r["dec_deg"])), ("HISTORY", "placed")]).where("error is not null").count()
    value = lambda n: F.max(F.when(F.col("name") == n, F.col("value")))
    got = fits.header_cards(fits.read_frames(spark, path)).groupBy("path").agg(*[value(n).alias(n) for n in ("OBJECT", "CRVAL1", "CRVAL2", "HISTORY")], F.count_if(F.col("name") == "CRVAL1").alias("times"))
    return got.select(F.col("OBJECT").cast("long").alias("field_id"), *[sphere.micro(F.col(c).cast("double")).alias(n) for c, n in (("CRVAL1", "ra_udeg"), ("CRVAL2", "dec_udeg"))], F.col("HISTORY").alias("history"), "times")


SIDECAR = ["CRPIX1", "CRPIX2", "CRVAL1", "CRVAL2", "CDELT1", "CDELT2", "CD1_1", "CD1_2", "CD2_1", "CD2_2"]


def solution_sidecars(spark, d):
    """The values of each frame's solution as its INI and its card sidecar give them."""

    def run(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                place = ([r.ra_deg, r.dec_deg], [r.cx, r.cy], [r.cd0, r.cd1, r.cd2, r.cd3])
                text = dict(line.split("=", 1) for line in sidecar.ini(*place, "solve").splitlines())
                block = sidecar.card_block(sidecar.merged_cards([("NAXIS1", 1), ("CRVAL1", 0.0)], *place))
                cards = fits.read_header(block)[0]
                for name, v in (("ini", [float(text[k]) for k in SIDECAR]), ("cards", [fits.number(cards, k) for k in SIDECAR])):
                    rows.append((r.frame_id, name, *v))
            yield pd.DataFrame(rows, columns=["frame_id", "kind", *SIDECAR])

    got = frame_queries._solutions(spark, d).mapInPandas(run, "frame_id long, kind string, " + ", ".join(f"{k} double" for k in SIDECAR))
    return got.select("frame_id", "kind", *[sphere.micro(F.col(k), 9 if k.startswith("CD") else 6).alias(k.lower()) for k in SIDECAR])


def sweep_bounds(spark, d):
    """The tiles of a part of the sky at two scales."""
    got = quads.tile_sweep(spark, 2.0, BOUNDS).withColumn("scale", F.lit(2.0)).unionByName(quads.tile_sweep(spark, 0.5, BOUNDS).withColumn("scale", F.lit(0.5)))
    return got.select("scale", "disc_id", sphere.micro(F.col("ra0")).alias("ra_udeg"), sphere.micro(F.col("dec0")).alias("dec_udeg"))


def retry_predicate(spark, d):
    """Which failed attempts another extraction is worth, and whether their reason is a known one."""
    s = table(spark, d, "solve_log").dropDuplicates(["log_id"]).where("outcome.reason is not null")
    return s.select("log_id", F.col("outcome.reason").isin(frame.RETRIED).alias("retried"), F.col("outcome.reason").isin(frame.REASONS).alias("known"))


QUERIES = [
    catalog_reader, mirror_filter, star_index_file, quad_index_file, cone_csv, cone_json, log_roundtrip, fits_cards, fits_pixels, header_update, solution_sidecars, sweep_bounds, retry_predicate,
]


def queries():
    return {q.__name__: q for q in QUERIES}


def oracle_sql():
    real = "isfinite(ra) and isfinite(dec)"
    none0 = lambda c: f"coalesce({c}, cast(0 as float)) {c}"
    pack = lambda c: f"cast(greatest(-32768, least(32767, round(case when {c} is null or isnan({c}) then 0 else {c} end))) as smallint)"
    read = f"{micro('ra', 9)} ra_e9, {micro('dec', 9)} dec_e9, mag, {none0('pmra')}, {none0('pmdec')}"
    line = lambda p: f"printf('{p}', ra, dec, mag, coalesce(cast(pmra_mas as double), 0), coalesce(cast(pmdec_mas as double), 0))"
    text = '{"ra_deg":%.9f,"dec_deg":%.9f,"phot_g_mean_mag":%.4f,"pmra_mas_yr":%.3f,"pmdec_mas_yr":%.3f}'
    cards = "cx+1 crpix1, cy+1 crpix2, ra_deg crval1, dec_deg crval2, s cdelt1, s cdelt2, cd0 cd1_1, cd1 cd1_2, cd2 cd2_1, cd3 cd2_2"
    shown = ", ".join(f"{micro(k.lower(), 9 if k.startswith('CD') else 6)} {k.lower()}" for k in SIDECAR)
    quoted = lambda names: ", ".join(f"'{n}'" for n in names)
    return {
        "catalog_reader": f"with {DISTINCT_GAIA} select source_id, {read} from g where {real} and mag is not null",
        "mirror_filter": f"with {DISTINCT_GAIA} select {read} from g where {real} and mag <= {MAX_MAG} and not isnan(mag) and dec between {LOW} and {HIGH}",
        "star_index_file": f"""with {DISTINCT_GAIA}, a as (select source_id, cast(round(({MOD('ra', '360.0e0')}) * (4294967296.0e0/360.0e0)) as bigint) & 4294967295 ra_scaled, cast(round(dec * (2147483647.0e0/90.0e0)) as int) dec_scaled,
  cast(greatest(-32768, least(32767, round(mag * cast(1000 as float)))) as smallint) mag_milli, {pack('pmra')} pmra_mas, {pack('pmdec')} pmdec_mas, sin(radians(dec)) z, radians({MOD('ra', '360.0e0')})/(pi()/2) t
  from g where {real} and isfinite(mag) and dec between -90 and 90),
b as (select *, least(3, cast(floor(t) as bigint)) q, 64*sqrt(greatest(0.0e0, 3*(1-abs(z)))) m, abs(z) <= 2.0e0/3 belt from a),
c as (select *, case when belt then cast(floor(64*(0.5e0+t) - 64*z*0.75e0) as bigint) else least(63, cast(floor((t-q)*m) as bigint)) end u,
  case when belt then cast(floor(64*(0.5e0+t) + 64*z*0.75e0) as bigint) else least(63, cast(floor((1-(t-q))*m) as bigint)) end w from b),
e as (select *, case when not belt then case when z > 0 then q else q + 8 end when u >> 6 = w >> 6 then ((u >> 6) & 3) + 4 when u >> 6 < w >> 6 then (u >> 6) & 3 else ((w >> 6) & 3) + 8 end face,
  case when belt then w & 63 when z > 0 then 63 - w else u end x, case when belt then 63 - (u & 63) when z > 0 then 63 - u else w end y from c)
select face*4096 + ({SPREAD.format('x')}) + (({SPREAD.format('y')}) << 1) as cell, ra_scaled, dec_scaled, mag_milli, pmra_mas, pmdec_mas, count(*) n from e group by all""",
        "quad_index_file": f"""with {PICKED} select {BAND('diag')} band, a.scale tile_scale, a.disc_id, p2 place, len(list_filter(code, lambda v: v < -1 or v > 2)) > 0 clamped,
{', '.join(f'cast(round(greatest(0.0e0, least(1.0e0, (code[{i + 1}]+1)/3.0e0))*65535.0e0) as int) k{i}' for i in range(4))}, concat_ws(',', a.star_id, b.star_id, c.star_id, e.star_id) stars
from sel join sp a using (tile) join sp b using (tile) join sp c using (tile) join sp e using (tile) where a.i=i0 and b.i=i1 and c.i=i2 and e.i=i3""",
        "cone_csv": f"with {CONE} select {line('%.9f,%.9f,%.4f,%.3f,%.3f')} as value, count(*) n from cone group by 1",
        "cone_json": f"with {CONE} select {line(text)} as value, count(*) n from cone group by 1",
        "log_roundtrip": f"select distinct log_id, frame_id, rig, outcome.solved solved, outcome.reason reason, outcome.stars_matched matched, case when not isnan(outcome.fit.rms_deg) then {micro('outcome.fit.rms_deg', 9)} end rms_e9 from solve_log",
        "fits_cards": f"select distinct frame_id, {micro('xpixsz')} xpixsz_e6, case when isfinite(focallen) then {micro('focallen')} end focallen_e6, rig, 2 naxis1, 9 + case when isfinite(focallen) then 1 else 0 end cards from frames where xpixsz is not null",
        "fits_pixels": f"""with {PX}, q as (select vec_id, y, x, greatest(0, least(65535, round_even(v*1000+30000, 0))) p from px)
select vec_id, 1 binned, y, x, cast(p*4 as bigint) v4 from q union all select vec_id, 2, y//2, x//2, cast(sum(p) as bigint) from q group by vec_id, y//2, x//2""",
        "header_update": f"select distinct field_id, {micro('ra_deg')} ra_udeg, {micro('dec_deg')} dec_udeg, 'placed' history, 1 times from sky_fields where shape = 'cone'",
        "solution_sidecars": f"with {SOLS}, v as (select frame_id, kind, {cards} from sol, (values ('ini'), ('cards')) k(kind)) select frame_id, kind, {shown} from v",
        "sweep_bounds": f"with a as ({TILES(2.0)} union all {TILES(0.5)}) select scale, disc_id, {micro('ra0')} ra_udeg, {micro('dec0')} dec_udeg from a where ra0 between {BOUNDS[0]} and {BOUNDS[1]} and dec0 between {BOUNDS[2]} and {BOUNDS[3]}",
        "retry_predicate": f"select distinct log_id, outcome.reason in ({quoted(frame.RETRIED)}) retried, outcome.reason in ({quoted(frame.REASONS)}) known from solve_log where outcome.reason is not null",
    }
