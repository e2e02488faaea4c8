"""Pattern and matching queries with the SQL that checks them."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import codec, sphere
from ..operators import catalog, matching, quads
from ..session import cut, stored, table
from .catalog_queries import CONE, LINES_TO_PLANE, NSIDE, SEP, STARS, discs, micro, stars
from .frame_queries import FRAMES, PTS, frames, points

#: Points of a frame or field, neighbours of a point, and patterns.
N_POINTS, N_NEAR, N_QUADS = 500, 6, 600
TOL = 0.02


def _image(spark, d, cap=None):
    return quads.build_quads(points(spark, d, N_POINTS), ["frame_id"], N_NEAR, N_QUADS, cap, grouped=True)


def _code(c: str = "code", n: str = "c"):
    return [sphere.micro(F.col(c)[i], 8).alias(f"{n}{i}_e8") for i in range(4)]


def quad_form(spark, d):
    return _image(spark, d).select("frame_id", "place", "seed", F.concat_ws(",", F.transform("idx", lambda v: v.cast("string"))).alias("idx"))


def quad_code(spark, d):
    return _image(spark, d).select("frame_id", "place", *_code(), sphere.micro(F.col("diag"), 4).alias("diag_e4"))


def quad_code_packed(spark, d):
    got = _image(spark, d).select("frame_id", "place", codec.pack_code(F.col("code")).alias("k"), codec.code_clamped(F.col("code")).alias("clamped"))
    return got.select("frame_id", "place", "clamped", *[F.col("k")[i].alias(f"k{i}") for i in range(4)])


def quad_code_roundtrip(spark, d):
    """Largest error of unpacked codes: within half a step of the packing."""
    err = F.array_max(F.zip_with("code", codec.unpack_code(codec.pack_code(F.col("code"))), lambda a, b: F.abs(a - b)))
    inside = ~codec.code_clamped(F.col("code"))
    return _image(spark, d).where(inside).select("frame_id", "place", (err <= 3.0 / 65535 / 2 + 1e-12).alias("exact"))


def quad_conditioning_topk(spark, d):
    return _image(spark, d, 25).select("frame_id", "place", F.concat_ws(",", F.transform("idx", lambda v: v.cast("string"))).alias("idx"))


def _scaled(spark, d):
    return _image(spark, d).join(frames(spark, d).select("frame_id", "scale"), "frame_id")


def quad_band(spark, d):
    return _scaled(spark, d).where("scale is not null").select("frame_id", "place", quads.band_of(F.col("diag") * F.col("scale") / 3600.0).alias("band"))


def band_search(spark, d):
    return quads.bands_to_search(_scaled(spark, d), "diag", "scale").select("frame_id", "place", "band")


def _sky(spark, d):
    """Patterns of the brightest stars of the sky fields, in their tangent planes."""
    top = catalog.brightest(catalog.cone_search(stars(spark, d), discs(spark, d), NSIDE), N_POINTS)
    xi, eta = sphere.to_plane(*map(F.col, ("ra", "dec", "ra0", "dec0")))
    return quads.build_quads(top.select("disc_id", (F.col("rank") - 1).alias("i"), xi.alias("x"), eta.alias("y")), ["disc_id"], N_NEAR, N_QUADS, grouped=True)


def _direction(sign=1.0):
    p = F.col("p")
    return F.degrees(F.atan2(p[1]["y"] - p[0]["y"], (p[1]["x"] - p[0]["x"]) * sign))


def _matches(spark, d, points=False):
    """Image patterns against those of the sky, as they are and mirrored.

    Only codes, sizes and directions meet, and the ``points`` of the patterns where they are asked for.
    """
    idx = lambda name: [F.col("idx").alias(name)] if points else []
    img = _image(spark, d).select("frame_id", F.col("place").alias("iq"), "code", *idx("image_idx"), F.col("diag").alias("idiag"), _direction().alias("irot"))
    sky, parts = _sky(spark, d), []
    for m in (False, True):
        side = quads.with_code(sky, "p", "code", True) if m else sky
        parts.append(side.select("disc_id", F.col("place").alias("cq"), F.col("code").alias("rcode"), *idx("sky_idx"), F.col("diag").alias("cdiag"), _direction(-1.0 if m else 1.0).alias("crot"), F.lit(m).alias("mirrored")))
    got = quads.code_join(img, parts[0].unionByName(parts[1]), TOL)
    rot = F.pmod(F.col("crot") - F.col("irot"), F.lit(360.0))
    return got.withColumn("scale", F.col("cdiag") / F.col("idiag")).withColumn("rot", rot).withColumn("ord", (F.col("iq") * 1000 + F.col("cq")) * 2 + F.col("mirrored").cast("int"))


KEYS = ["frame_id", "disc_id"]


def quad_code_join(spark, d):
    return _matches(spark, d).select(*KEYS, "iq", "cq", "mirrored", sphere.micro(F.col("scale"), 9).alias("scale_e9"), sphere.micro(F.cos(F.radians("rot")), 5).alias("cos_e5"))


def quantile_edges(spark, d):
    # rounding keeps the order, so the codes may be rounded before their ranks are found, and take less room
    runs = quads.build_quads(points(spark, d, N_POINTS), ["frame_id"], N_NEAR, N_QUADS, grouped=True, then=quads.code_runs(digits=8))
    return quads.edges_of_runs(stored(runs), [], digits=8).select("axis", "i", F.col("edge").cast("long").alias("edge_e8"))


def quad_grid_join(spark, d):
    """The matches again, in either parity, through grids of equal population over the sky's patterns of each band that an image pattern may lie in."""
    probes = quads.bands_to_search(_scaled(spark, d), "diag", "scale").select("frame_id", F.col("place").alias("iq"), "code", "band")
    sky = _sky(spark, d)
    sides = [(quads.with_code(sky, "p", "code", True) if m else sky).select("disc_id", F.col("place").alias("cq"), "code", quads.band_of(F.col("diag")).alias("band"), F.lit(m).alias("mirrored")) for m in (False, True)]
    index = cut(sides[0].unionByName(sides[1]))
    # the fewer patterns, here those of the sky, are the ones that are repeated for the bins that they may touch
    return quads.grid_join(probes, index.withColumnRenamed("code", "rcode"), quads.quantile_edges(index, ["band"]), TOL, ["band"]).select("frame_id", "disc_id", "iq", "cq", "mirrored")


def vote_histogram(spark, d):
    return matching.votes(_matches(spark, d), KEYS).select(*KEYS, "bs", "br", "mirrored", "n", "merged")


def _won(spark, d):
    m = cut(_matches(spark, d, points=True))
    return matching.winners(m, matching.winning_bin(matching.votes(m, KEYS), KEYS, 1), KEYS)


def majority_match(spark, d):
    return matching.majority(_won(spark, d), KEYS).select(*KEYS, "image_i", "sky_i", "n")


def circular_mean(spark, d):
    got = matching.summary(_won(spark, d), KEYS)
    return got.select(*KEYS, "votes", sphere.micro(F.col("scale"), 8).alias("scale_e8"), sphere.micro(F.cos(F.radians("rotation")), 4).alias("cos_e4"), "mirrored")


def match_spread(spark, d):
    """Distinct image stars of the winners, and their spread against that of all points."""
    used = _won(spark, d).select(*KEYS, F.explode("image_idx").alias("i")).distinct()
    pts = points(spark, d, N_POINTS)
    part = used.join(pts, ["frame_id", "i"]).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("stars"), matching.spread(pts, []).alias("part"))
    whole = pts.groupBy("frame_id").agg(matching.spread(pts, []).alias("whole"))
    return part.join(whole, "frame_id").select(*KEYS, "stars", sphere.micro(F.when(F.col("whole") > 0, F.col("part") / F.col("whole")).otherwise(0.0), 5).alias("spread_e5"))


def runner_up(spark, d):
    votes = _matches(spark, d).groupBy("frame_id", "disc_id").agg(F.count(F.lit(1)).alias("n"))
    return matching.runner_up(votes, ["frame_id"], "n", "disc_id")


def hypothesis_counter(spark, d):
    """Candidates offered per frame, before any of them is tested."""
    return _matches(spark, d).groupBy("frame_id").agg(F.count(F.lit(1)).alias("offered"))


def tile_sweep(spark, d):
    parts = [quads.tile_sweep(spark, s).withColumn("scale", F.lit(s)) for s in (8.0, 4.0, 2.0)]
    got = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return got.select("scale", "disc_id", sphere.micro(F.col("ra0")).alias("ra_udeg"), sphere.micro(F.col("dec0")).alias("dec_udeg"))


def _index(spark, d):
    return quads.build_quad_index(stars(spark, d))


def quad_index(spark, d):
    return _index(spark, d).select("tile_scale", "disc_id", "place", "band", F.concat_ws(",", F.transform("stars", lambda v: v.cast("string"))).alias("stars"))


def quad_index_info(spark, d):
    return quads.quad_index_info(_index(spark, d))


def poisson_confidence(spark, d):
    s = table(spark, d, "solve_log").dropDuplicates(["log_id"])
    area = F.col("naxis1") * F.col("naxis2") * F.pow(F.col("outcome.field.scale_arcsec") / 3600.0, 2)
    lam, dec = matching.chance(F.col("outcome.stars_matched"), F.col("outcome.stars_used"), F.lit(300), F.lit(5.0 / 3600), area)
    return s.where("outcome.stars_matched is not null and outcome.field.scale_arcsec is not null").select("log_id", sphere.micro(lam, 5).alias("chance_e5"), sphere.micro(dec, 5).alias("decades_e5"))


def blind_gate(spark, d):
    """Which attempts pass the gate of a blind search with as many hypotheses as the log number."""
    s = table(spark, d, "solve_log").dropDuplicates(["log_id"]).where("outcome.stars_matched is not null and outcome.field.scale_arcsec is not null")
    area = F.col("naxis1") * F.col("naxis2") * F.pow(F.col("outcome.field.scale_arcsec") / 3600.0, 2)
    k = matching.blind_matched(F.col("outcome.stars_matched"), F.col("outcome.fit.used"))
    _, dec = matching.chance(k, F.col("outcome.stars_used"), F.lit(300), F.lit(5.0 / 3600), area)
    need = matching.blind_threshold(F.col("log_id") % 1000)
    rms = F.col("outcome.fit.rms_deg") * 3600.0 / F.col("outcome.field.scale_arcsec")
    ok = matching.accepted(F.coalesce(k, F.lit(0)), dec, rms, need)
    hinted = matching.accepted(F.col("outcome.stars_matched"), F.lit(20.0), rms)
    return s.select("log_id", F.when(F.col("log_id") % 1000 > 0, sphere.micro(need, 5)).alias("need_e5"), ok.alias("accepted"), hinted.alias("hinted"))


QUERIES = [
    quad_form, quad_code, quad_code_packed, quad_code_roundtrip, quad_conditioning_topk, quad_band, band_search, quad_code_join, quantile_edges, quad_grid_join, vote_histogram,
    majority_match, circular_mean, match_spread, runner_up, hypothesis_counter, tile_sweep, quad_index, quad_index_info, poisson_confidence, blind_gate,
]


def queries():
    return {q.__name__: q for q in QUERIES}


# --- SQL ---------------------------------------------------------------------------------------


def _quads(pts: str, key: str, name: str, limit: int, near: int = N_NEAR) -> str:
    """CTEs from points (key, i, x, y) to patterns ``name`` (key, place, seed, i0..i3, x0.., c0..c3, diag)."""
    n = name
    return f"""{n}_nn as (select * from (select a.{key}, a.i, b.i j, row_number() over (partition by a.{key}, a.i order by (b.x-a.x)*(b.x-a.x)+(b.y-a.y)*(b.y-a.y), b.i) rk
  from {pts} a join {pts} b on a.{key} is not distinct from b.{key} and a.i <> b.i) where rk <= {near}),
{n}_tr as (select a.{key}, a.i seed, a.j j1, b.j j2, c.j j3, a.rk*10000+b.rk*100+c.rk ord, list_sort([a.i, a.j, b.j, c.j]) st from {n}_nn a
  join {n}_nn b on a.{key} is not distinct from b.{key} and a.i=b.i and a.rk<b.rk join {n}_nn c on b.{key} is not distinct from c.{key} and b.i=c.i and b.rk<c.rk),
{n}_on as (select * from {n}_tr qualify row_number() over (partition by {key}, st order by seed, ord) = 1),
{n}_p as (select o.{key}, seed, ord, seed i0, j1 i1, j2 i2, j3 i3, a.x x0, a.y y0, b.x x1, b.y y1, c.x x2, c.y y2, e.x x3, e.y y3 from {n}_on o
  join {pts} a on a.{key} is not distinct from o.{key} and a.i=seed join {pts} b on b.{key} is not distinct from o.{key} and b.i=j1
  join {pts} c on c.{key} is not distinct from o.{key} and c.i=j2 join {pts} e on e.{key} is not distinct from o.{key} and e.i=j3),
{_codes(n + '_p', n + '_k', 1)},
{n} as (select * from (select *, row_number() over (partition by {key} order by r, seed) place from (select *, row_number() over (partition by {key}, seed order by ord) r from {n}_k)) where place <= {limit})"""


def _codes(src: str, out: str, sign: int) -> str:
    pairs = [(0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2), (1, 2, 0, 3), (1, 3, 0, 2), (2, 3, 0, 1)]
    dd = [f"(x{b}-x{a})*(x{b}-x{a})+(y{b}-y{a})*(y{b}-y{a})" for a, b, _, _ in pairs]
    pick = lambda k, ax: "case " + " ".join(f"when d{n} = best then {ax}{p[k]}" for n, p in enumerate(pairs)) + " end"
    sx = lambda e: f"({sign}*({e}))"
    roles = ", ".join(f"{sx(pick(k, 'x')) if ax == 'x' else pick(k, 'y')} p{r}{ax}" for k, r in enumerate("abcd") for ax in "xy")
    fr = []
    for w, (a, b) in enumerate((("a", "b"), ("b", "a"))):
        for q in "cd":
            al = f"((p{q}x-p{a}x)*(p{b}x-p{a}x)+(p{q}y-p{a}y)*(p{b}y-p{a}y))/best"
            ac = f"((p{q}x-p{a}x)*(p{b}y-p{a}y)-(p{q}y-p{a}y)*(p{b}x-p{a}x))/best"
            fr += [f"round({al}-{ac}, 12) f{q}{w}x", f"round({al}+{ac}, 12) f{q}{w}y"]
    opts = ", ".join(f"case when f{u}{w}x <= f{v}{w}x and f{u}{w}x + f{v}{w}x <= 1 then [f{u}{w}x, f{u}{w}y, f{v}{w}x, f{v}{w}y] end" for w in (0, 1) for u, v in (("c", "d"), ("d", "c")))
    return f"""{out}_d as (select *, {", ".join(f"{e} d{n}" for n, e in enumerate(dd))} from {src}),
{out}_b as (select *, greatest(d0,d1,d2,d3,d4,d5) best from {out}_d where least(d0,d1,d2,d3,d4,d5) > 1e-12),
{out}_r as (select *, {roles} from {out}_b), {out}_f as (select *, {", ".join(fr)} from {out}_r),
{out} as (select *, list_min(list_filter([{opts}], lambda o: o is not null)) code, sqrt(best) diag from {out}_f where len(list_filter([{opts}], lambda o: o is not null)) > 0)"""


SKY = f"""{CONE}, top as (select * from (select *, row_number() over (partition by disc_id order by mag_milli, cell, star_id) rk from cone) where rk <= {N_POINTS}),
{LINES_TO_PLANE.replace('from cone', 'from top')}, sp as (select disc_id, rk-1 i, xi x, eta y from plane)"""
IMAGE = f"{PTS(N_POINTS)}, {_quads('pts', 'frame_id', 'iq', N_QUADS)}"
BOTH = f"""{IMAGE}, {SKY}, {_quads('sp', 'disc_id', 'cq', N_QUADS)}, cm_in as (select * exclude (code, diag, d0,d1,d2,d3,d4,d5,best,pax,pay,pbx,pby,pcx,pcy,pdx,pdy,fc0x,fc0y,fd0x,fd0y,fc1x,fc1y,fd1x,fd1y) from cq), {_codes('cm_in', 'cm', -1)},
sides as (select disc_id, place, code, diag, i0, i1, i2, i3, x0, y0, x1, y1, false mirrored from cq union all select disc_id, place, code, diag, i0, i1, i2, i3, -x0, y0, -x1, y1, true from cm),
ib as (select *, cast(floor(code[1]/0.02) as int) b from iq), sb as (select *, cast(floor(code[1]/0.02) as int) + o b from sides, (values (-1),(0),(1)) v(o)),
m as (select frame_id, disc_id, ib.place iq, sb.place cq, mirrored, sb.diag cdiag, sb.diag/ib.diag scale, [ib.i0, ib.i1, ib.i2, ib.i3] ii, [sb.i0, sb.i1, sb.i2, sb.i3] si,
  ((degrees(atan2(sb.y1-sb.y0, sb.x1-sb.x0)) - degrees(atan2(ib.y1-ib.y0, ib.x1-ib.x0))) % 360 + 360) % 360 rot from ib join sb using (b)
  where pow(ib.code[1]-sb.code[1],2)+pow(ib.code[2]-sb.code[2],2)+pow(ib.code[3]-sb.code[3],2)+pow(ib.code[4]-sb.code[4],2) <= 0.02e0*0.02e0)"""
VOTES = f"""{BOTH}, mb as (select *, cast(round(ln(scale)/0.02e0) as bigint) bs, cast(round(rot/5.0e0) as bigint) br from m), own as (select frame_id, disc_id, bs, br, mirrored, count(*) n from mb group by all),
vt as (select a.frame_id, a.disc_id, a.bs, a.br, a.mirrored, a.n, cast(sum(b.n) as bigint) merged from own a join own b on a.frame_id=b.frame_id and a.disc_id=b.disc_id and a.mirrored=b.mirrored and abs(a.bs-b.bs)<=1 and least(abs(a.br-b.br), 72-abs(a.br-b.br))<=1 group by all),
wb as (select * from vt where merged >= 1 qualify row_number() over (partition by frame_id, disc_id order by merged desc, bs, br, mirrored) = 1),
won as (select mb.* from mb join wb using (frame_id, disc_id, mirrored) where abs(mb.bs-wb.bs)<=1 and least(abs(mb.br-wb.br), 72-abs(mb.br-wb.br))<=1)"""


MIDS = [math.sqrt(quads.BANDS[i] * quads.BANDS[i + 1]) for i in range(5)]
BAND = lambda e: "case " + " ".join(f"when {e} < {m!r}e0 then {i}" for i, m in enumerate(MIDS)) + " else 5 end"
SEARCHED = f"""zs as (select frame_id, place, diag*scale/3600.0e0 z from iq join f using (frame_id)), bs(band, deg) as (values {', '.join(f'({i}, {x}e0)' for i, x in enumerate(quads.BANDS))}),
zx as (select *, z/deg between 0.5 and 2 hit, row_number() over (partition by frame_id, place order by abs(ln(z/deg)), band) nr from zs, bs), zy as (select *, bool_or(hit) over (partition by frame_id, place) any_hit from zx),
searched as (select frame_id, place, band from zy where z is null or hit or (not any_hit and nr = 1))"""
S4 = "(x{1}-x{0})*(x{1}-x{0})+(y{1}-y{0})*(y{1}-y{0})"
SRT = "list_reverse_sort([" + ", ".join(f"sqrt({S4.format(a, b)})" for a, b, _, _ in quads.PAIRS) + "])"
COND = f"least(abs((code[2]-code[1])/2), abs((code[4]-code[3])/2), ({SRT}[1]-{SRT}[2])/{SRT}[1])"
PICK = f"""cnd as (select *, count(*) over (partition by {{k}}) <= 25 few from {{q}}), cn as (select *, case when few then 0.0e0 else round({COND}, 9) end cond from cnd),
cr as (select *, row_number() over (partition by {{k}}, seed order by cond desc, case when few then ord end, [i0,i1,i2,i3]) r2 from cn),
sel as (select * from (select *, row_number() over (partition by {{k}} order by r2, seed) p2 from cr) where p2 <= 25)"""
TILES = lambda s: f"""select {s}e0 scale, cast(id*1000000+j as bigint) disc_id, 360.0e0/n_ra*(j+0.5e0) ra0, dec0, {s / 2}e0 radius, id tile_band from (select range id, -90+{180 / round(180 / s)!r}e0*(range+0.5e0) dec0,
  greatest(1, cast(round(360.0e0*cos(radians(-90+{180 / round(180 / s)!r}e0*(range+0.5e0)))/{s}) as int)) n_ra from range({round(180 / s)})), range(0, {round(360 / s) + 1}) t(j) where j < n_ra"""  # noqa: E731
PICKED = f"""{STARS}, discs as ({' union all '.join(TILES(s) for s in quads.BANDS)}),
sb as (select stars.*, sc, cast(floor((dec+90)*nd/180.0e0) as bigint) + o tile_band from stars, (values {', '.join(f'({s}e0, {round(180 / s)})' for s in quads.BANDS)}) z(sc, nd), (values (-1),(0),(1)) v(o)),
cone as (select * from (select scale, disc_id, ra0, dec0, radius, star_id, cell, ra, dec, mag_milli, {SEP} sep from discs join sb on discs.tile_band = sb.tile_band and scale = sc and abs(dec-dec0) <= radius + 0.001e0) where sep <= radius),
top as (select * from (select *, row_number() over (partition by scale, disc_id order by mag_milli, cell, star_id) rk from cone) where rk <= 14), {LINES_TO_PLANE.replace('from cone', 'from top')},
sp as (select (scale, disc_id) tile, scale, disc_id, rk-1 i, xi x, eta y, star_id from plane), {_quads('sp', 'tile', 'tq', 4096, 6)}, {PICK.format(k='tile', q='tq')}"""


def oracle_sql():
    idx = "concat_ws(',', i0, i1, i2, i3) idx"
    spread = "sqrt(var_pop(x) + var_pop(y))"
    solved = "s as (select distinct on (log_id) * from solve_log where outcome.stars_matched is not null and outcome.field.scale_arcsec is not null)"
    lam = "outcome.stars_used*300*pi()*(5.0e0/3600)*(5.0e0/3600)/(naxis1*naxis2*pow(outcome.field.scale_arcsec/3600.0e0,2))"
    dec = lambda k: f"case when {k} > 0 and {k} > lam then greatest(0, ((case when {k} < 2 then 0 else {k}*ln({k})-{k}+0.5e0*ln(2*pi()*{k}) end) + lam - {k}*ln(lam))/ln(10.0e0)) else 0.0e0 end"
    return {
        "quad_form": f"with {IMAGE} select frame_id, place, seed, {idx} from iq",
        "quad_code": f"with {IMAGE} select frame_id, place, {', '.join(f'{micro(f'code[{i + 1}]', 8)} c{i}_e8' for i in range(4))}, {micro('diag', 4)} diag_e4 from iq",
        "quad_code_packed": f"with {IMAGE} select frame_id, place, len(list_filter(code, lambda v: v < -1 or v > 2)) > 0 clamped, {', '.join(f'cast(round(greatest(0.0e0, least(1.0e0, (code[{i + 1}]+1)/3.0e0))*65535.0e0) as int) k{i}' for i in range(4))} from iq",
        "quad_code_roundtrip": f"with {IMAGE} select frame_id, place, true exact from iq where len(list_filter(code, lambda v: v < -1 or v > 2)) = 0",
        "quad_conditioning_topk": f"with {IMAGE}, {PICK.format(k='frame_id', q='iq')} select frame_id, p2 place, {idx} from sel",
        "quad_band": f"with {IMAGE}, {FRAMES} select frame_id, place, {BAND('diag*scale/3600.0e0')} band from iq join f using (frame_id) where scale is not null",
        "band_search": f"with {IMAGE}, {FRAMES}, {SEARCHED} select frame_id, place, band from searched",
        "quad_code_join": f"with {BOTH} select frame_id, disc_id, iq, cq, mirrored, {micro('scale', 9)} scale_e9, {micro('cos(radians(rot))', 5)} cos_e5 from m",
        "quantile_edges": f"""with {IMAGE}, v as (select unnest([0,1,2,3]) axis, unnest(code) v from iq), r as (select *, row_number() over (partition by axis order by v)-1 rk, count(*) over (partition by axis) n from v)
select axis, i, {micro('v', 8)} edge_e8 from r join (select range i from range(49)) on rk = i*(n-1)//48""",
        "quad_grid_join": f"""with {BOTH}, {FRAMES}, {SEARCHED} select m.frame_id, m.disc_id, iq, cq, m.mirrored from m join searched w on w.frame_id = m.frame_id and w.place = iq and w.band = {BAND('m.cdiag')}""",
        "vote_histogram": f"with {VOTES} select frame_id, disc_id, bs, br, mirrored, n, merged from vt",
        "majority_match": f"""with {VOTES}, z as (select frame_id, disc_id, ((iq*1000+cq)*2+cast(mirrored as int))*4+k seen, ii[k+1] image_i, si[k+1] sky_i from won, range(4) t(k)),
t as (select frame_id, disc_id, image_i, sky_i, count(*) n, min(seen) seen from z group by all) select frame_id, disc_id, image_i, sky_i, n from t qualify row_number() over (partition by frame_id, disc_id, image_i order by n desc, seen) = 1""",
        "circular_mean": f"with {VOTES} select frame_id, disc_id, count(*) votes, {micro('avg(scale)', 8)} scale_e8, {micro('cos(atan2(sum(sin(radians(rot))), sum(cos(radians(rot)))))', 4)} cos_e4, first(mirrored) mirrored from won group by all",
        "match_spread": f"""with {VOTES}, u as (select distinct frame_id, disc_id, unnest(ii) i from won), pa as (select frame_id, disc_id, count(*) stars, {spread} part from u join pts using (frame_id, i) group by all),
wh as (select frame_id, {spread} whole from pts group by all) select frame_id, disc_id, stars, {micro('case when whole > 0 then part/whole else 0 end', 5)} spread_e5 from pa join wh using (frame_id)""",
        "runner_up": f"""with {BOTH}, v as (select frame_id, disc_id, count(*) n from m group by all), r as (select *, row_number() over (partition by frame_id order by n desc, disc_id) k from v)
select frame_id, max(disc_id) filter (k=1) best, max(n) filter (k=1) best_score, max(n) filter (k=2) second_score from r group by frame_id""",
        "hypothesis_counter": f"with {BOTH} select frame_id, count(*) offered from m group by frame_id",
        "tile_sweep": f"with a as ({' union all '.join(TILES(s) for s in (8, 4, 2))}) select scale, disc_id, {micro('ra0')} ra_udeg, {micro('dec0')} dec_udeg from a",
        "quad_index": f"with {PICKED} select a.scale tile_scale, a.disc_id, p2 place, {BAND('diag')} band, concat_ws(',', a.star_id, b.star_id, c.star_id, e.star_id) stars from sel join sp a using (tile) join sp b using (tile) join sp c using (tile) join sp e using (tile) where a.i=i0 and b.i=i1 and c.i=i2 and e.i=i3",
        "quad_index_info": f"with {PICKED} select {BAND('diag')} band, count(*) n from sel group by 1",
        "poisson_confidence": f"with {solved}, l as (select *, {lam} lam, outcome.stars_matched k from s) select log_id, {micro('case when k > 0 and lam > 0 then lam else 0 end', 5)} chance_e5, {micro(dec('k'), 5)} decades_e5 from l",
        "blind_gate": f"""with {solved}, l as (select *, {lam} lam, greatest(0, outcome.stars_matched - outcome.fit.used) k, outcome.fit.rms_deg*3600.0e0/outcome.field.scale_arcsec rms,
  12+greatest(0, log10(nullif(log_id % 1000, 0))) need from s), g as (select *, {dec('k')} dcd from l)
select log_id, case when log_id % 1000 > 0 then {micro('need', 5)} end need_e5, log_id % 1000 > 0 and coalesce(k >= 10 and dcd >= need and not isnan(rms) and rms <= 3, false) accepted, coalesce(outcome.stars_matched >= 10 and not isnan(rms) and rms <= 3, false) hinted from g""",
    }
