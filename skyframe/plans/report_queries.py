"""Report queries with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sphere
from ..operators import report
from ..session import table
from .catalog_queries import micro
from .frame_queries import DETS, _sized

LADDER = ["0.1.0", "0.1.1", "0.2.0"]


def _att(spark, d):
    return report.attempts(table(spark, d, "solve_log"))


def solve_rate(spark, d):
    return report.solve_rate(_att(spark, d))


def reason_histogram(spark, d):
    return report.reasons(_att(spark, d))


def _p(df):
    return df.select("*", *[sphere.micro(F.col("p")[i], 5).alias(n) for i, n in enumerate(("p50_e5", "p90_e5", "p99_e5"))], sphere.micro(F.col("worst"), 5).alias("worst_e5")).drop("p", "worst")


def separation_percentiles(spark, d):
    return _p(report.breakdown(_att(spark, d).withColumn("every", F.lit("x")), [["every"]])).drop("level", "every")


def breakdown_grouping_sets(spark, d):
    return _p(report.breakdown(_att(spark, d), [["binning"], ["mosaic"], ["tool_version"]]))


def gate_report(spark, d):
    return report.gate(_att(spark, d)).withColumn("rate", sphere.micro(F.col("rate")))


def stratified_sample(spark, d):
    a = _att(spark, d).select("log_id", "naxis1", "naxis2", "filt_eff", "binning", "db_dec")
    return report.stratified_sample(a, ["naxis1", "naxis2", "filt_eff", "binning"], "log_id", 200, "db_dec").select("log_id")


def _vectors(spark, d):
    s = _sized(spark, d)
    return s.withColumn("dx", (F.col("det_id") % 11 - 5) * 0.01 + F.col("x") * 0.0001).withColumn("dy", (F.col("det_id") % 7 - 3) * 0.01 - F.col("y") * 0.0001)


def residual_field(spark, d):
    got = report.residual_field(_vectors(spark, d), "frame_id")
    return got.select("frame_id", "gy", "gx", "n", sphere.micro(F.col("dx"), 12).alias("dx_e12"), sphere.micro(F.col("dy"), 12).alias("dy_e12"))


def _rig_vectors(spark, d):
    rig = table(spark, d, "frames").select("frame_id", "rig").dropDuplicates(["frame_id"])
    return _vectors(spark, d).join(rig, "frame_id")


def pattern_correlation(spark, d):
    return report.pattern_correlation(_rig_vectors(spark, d), "frame_id", "rig").select("rig", "a", "b", sphere.micro(F.col("r"), 5).alias("r_e5"))


def pattern_verdict(spark, d):
    got = report.pattern_verdict(_rig_vectors(spark, d), "frame_id", "rig")
    return got.select("rig", "frames", "pairs", *[sphere.micro(F.col(c), 5).alias(f"{c}_e5") for c in ("p10", "median", "p90", "signal", "scatter")], "verdict")


def failure_merge(spark, d):
    got = report.merge_failures(_att(spark, d), "frame_id", ["run_at", "log_id"])
    return got.select("frame_id", "log_id", "solved", F.col("outcome.reason").alias("reason"))


def retry_ladder_union(spark, d):
    a = _att(spark, d).where("solved")
    rungs = [a.where(F.col("tool_version") == v).groupBy("frame_id").agg(F.min("log_id").alias("log_id")) for v in LADDER]
    return report.ladder(rungs, "frame_id")


def header_card_upsert(spark, d):
    f = table(spark, d, "frames").dropDuplicates(["frame_id"])
    names = [("NAXIS1", "naxis1"), ("NAXIS2", "naxis2"), ("XBINNING", "binning"), ("FILTER", "filt_eff")]
    cards = lambda cells: F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), v.alias("value")) for i, (n, v) in enumerate(cells, 1)]))
    head = f.select("frame_id", cards([(n, F.col(c).cast("string")) for n, c in names] + [("COMMENT", F.lit("raw"))]).alias("c")).select("frame_id", "c.*")
    new = f.where(F.col("ra_deg").isNotNull()).select("frame_id", cards([("XBINNING", F.lit("1")), ("CTYPE1", F.lit("RA---TAN")), ("COMMENT", F.lit("solved"))]).alias("c")).select("frame_id", "c.*")
    return report.upsert_cards(head, new, "frame_id")


QUERIES = [
    solve_rate, reason_histogram, separation_percentiles, breakdown_grouping_sets, gate_report, stratified_sample, residual_field, pattern_correlation, pattern_verdict, failure_merge,
    retry_ladder_union, header_card_upsert,
]


def queries():
    return {q.__name__: q for q in QUERIES}


ATT = """att as (select *, coalesce(outcome.solved, false) solved, case when coalesce(outcome.solved, false) then
  3600*2.0e0*degrees(asin(least(1.0e0,sqrt(pow(sin(radians(outcome.field.center.dec-db_dec)/2.0e0),2)+cos(radians(db_dec))*cos(radians(outcome.field.center.dec))*pow(sin(radians(outcome.field.center.ra-db_ra)/2.0e0),2))))) end sep,
  coalesce(header.is_cfa, filt_eff = 'OSC', false) mosaic from (select distinct on (log_id) * from solve_log))"""


def oracle_sql():
    stats = f"count(*) n, count(*) filter (solved) solved, {micro('quantile_cont(sep, 0.5)', 5)} p50_e5, {micro('quantile_cont(sep, 0.9)', 5)} p90_e5, {micro('quantile_cont(sep, 0.99)', 5)} p99_e5, {micro('max(sep)', 5)} worst_e5, count(*) filter (sep > 30) gross"
    level = lambda k, c: f"select {k} as level, " + ", ".join(f"{f'cast({x} as varchar)' if x == c else 'null'} {x}" for x in ("binning", "mosaic", "tool_version")) + f", {stats} from att group by {c}"
    strata = "naxis1, naxis2, filt_eff, binning"
    vec = f"""{DETS}, fr as (select distinct frame_id, rig, naxis1 nx, naxis2 ny from frames), vc as (select frame_id, rig, x, y, nx, ny, (det_id%11-5)*0.01e0+x*0.0001e0 dx, (det_id%7-3)*0.01e0-y*0.0001e0 dy from dt join fr using (frame_id)),
fd as (select frame_id, rig, cast(greatest(0, least(3, floor(y/ny*4))) as int) gy, cast(greatest(0, least(3, floor(x/nx*4))) as int) gx, count(*) n, avg(dx) dx, avg(dy) dy from vc group by 1, 2, 3, 4 having count(*) >= 2)"""
    pair = f"""{vec}, per as (select rig, frame_id, count(*) stars from vc where rig is not null group by all), ev as (select *, row_number() over (partition by rig order by frame_id) - 1 i, count(*) over (partition by rig) sz from per),
us as (select rig, frame_id from ev where i % greatest(1, sz//12) = 0 and i // greatest(1, sz//12) < 12 and stars >= 15), us4 as (select *, count(*) over (partition by rig) frames from us qualify count(*) over (partition by rig) >= 4),
l0 as (select fd.rig, fd.frame_id, frames, gy, gx, 0 ax, dx v from fd join us4 using (frame_id) union all select fd.rig, fd.frame_id, frames, gy, gx, 1, dy from fd join us4 using (frame_id)),
lg as (select * from l0 qualify count(*) over (partition by rig, gy, gx, ax) = frames),
pr as (select a.rig, a.frame_id a, b.frame_id b, corr(a.v, b.v) r from lg a join lg b on a.rig = b.rig and a.gy = b.gy and a.gx = b.gx and a.ax = b.ax and a.frame_id < b.frame_id group by all having stddev_pop(a.v) > 0 and stddev_pop(b.v) > 0)"""
    return {
        "solve_rate": f"with {ATT} select count(*) n, count(*) filter (solved) solved, count(*) filter (not solved and outcome is not null) failed, count(*) filter (outcome is null) errors from att",
        "reason_histogram": f"with {ATT} select case when outcome is null then coalesce(parse_error, 'unknown') else coalesce(outcome.reason, '?') end reason, count(*) n from att where not solved group by 1",
        "separation_percentiles": f"with {ATT} select {stats} from att",
        "breakdown_grouping_sets": f"with {ATT} {level(0, 'binning')} union all {level(1, 'mosaic')} union all {level(2, 'tool_version')}",
        "gate_report": f"""with {ATT}, g as (select count(*) filter (solved)/count(*) rate, quantile_cont(sep, 0.5) m, quantile_cont(sep, 0.99) p, count(*) filter (sep > 30) gross from att)
select {micro('rate')} rate, gross, rate >= 0.95 rate_ok, m <= 5 median_ok, p <= 30 p99_ok, gross <= 0 gross_ok, true parity_ok, rate >= 0.95 and m <= 5 and p <= 30 and gross <= 0 passed from g""",
        "stratified_sample": f"""with {ATT}, z as (select {strata}, count(*) size from att group by all), w as (select *, least(size, greatest(1, cast(round_even(200*size/sum(size) over (), 0) as bigint))) want from z),
e as (select *, sum(want) over () - 200 excess from w), sp as (select *, case when excess > 0 then want - 1 else size - want end spare from e),
st as (select *, unnest(range(1, cast(least(spare, abs(excess)) as bigint) + 1)) rd from sp where spare > 0 and excess <> 0),
tk as (select {strata}, count(*) moved from (select *, row_number() over (order by rd, size desc, {strata.replace(', ', ' nulls first, ')} nulls first) turn from st) where turn <= abs(excess) group by all),
al as (select sp.*, want + coalesce(moved, 0) * case when excess > 0 then -1 else 1 end places from sp left join tk on {' and '.join(f'sp.{c} is not distinct from tk.{c}' for c in strata.split(', '))}),
s as (select log_id, {strata}, row_number() over (partition by {strata} order by db_dec nulls first, log_id)-1 r from att),
p as (select s.*, size, places, cast(((r+1)*places-1)//size as bigint) slot from s join al on {' and '.join(f's.{c} is not distinct from al.{c}' for c in strata.split(', '))}),
c as (select log_id, md5('20260814:' || log_id) h from p qualify row_number() over (partition by {strata}, slot order by md5('20260814:' || log_id), log_id) = 1)
select log_id from c order by h, log_id limit 200""",
        "residual_field": f"with {vec} select frame_id, gy, gx, n, {micro("dx", 12)} dx_e12, {micro("dy", 12)} dy_e12 from fd",
        "pattern_correlation": f"with {pair} select rig, a, b, {micro('r', 5)} r_e5 from pr",
        "pattern_verdict": f"""with {pair}, cl as (select rig, frames, gy, gx, ax, abs(avg(v)) m, stddev_pop(v) s from lg group by all), pa as (select rig, frames, avg(m) signal, avg(s) scatter from cl group by all),
q as (select rig, count(*) pairs, quantile_cont(r, 0.1) p10, quantile_cont(r, 0.5) median, quantile_cont(r, 0.9) p90 from pr group by rig), j as (select pa.*, coalesce(pairs, 0) pairs, p10, median, p90 from pa left join q using (rig))
select rig, frames, pairs, {", ".join(f"{micro(c, 5)} {c}_e5" for c in ("p10", "median", "p90", "signal", "scatter"))}, case when median > 0.5 and signal > scatter then 'stable' when median > 0.25 then 'partly' else 'not' end verdict from j""",
        "failure_merge": f"with {ATT} select frame_id, log_id, solved, outcome.reason reason from att qualify row_number() over (partition by frame_id order by case when solved then 2 when outcome.reason = 'LOW_CONFIDENCE' then 1 else 0 end desc, run_at desc, log_id desc) = 1",
        "retry_ladder_union": f"""with {ATT}, s as (select frame_id, log_id, case tool_version when '0.1.0' then 1 when '0.1.1' then 2 when '0.2.0' then 3 end rung from att where solved),
b as (select frame_id, rung, min(log_id) log_id from s where rung is not null group by all) select frame_id, log_id, rung from b qualify row_number() over (partition by frame_id order by rung) = 1""",
        "header_card_upsert": """with f as (select distinct * from frames), h as (select frame_id, unnest([1,2,3,4,5]) pos, unnest(['NAXIS1','NAXIS2','XBINNING','FILTER','COMMENT']) "name",
  unnest([cast(naxis1 as varchar), cast(naxis2 as varchar), case when ra_deg is null then cast(binning as varchar) else '1' end, filt_eff, 'raw']) "value" from f)
select * from h union all select frame_id, 6, 'CTYPE1', 'RA---TAN' from f where ra_deg is not null union all select frame_id, 7, 'COMMENT', 'solved' from f where ra_deg is not null""",
    }
