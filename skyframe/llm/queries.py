"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import leakage, packing, sentences, sketch, topn

ALPHA = 0.01


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    got = sketch.solve_percentiles(table(spark, d, "solve_log"), ALPHA)
    return got.withColumn("estimate", F.col("estimate").cast("float"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.brightest_and_strongest(table(spark, d, "star_records"), table(spark, d, "detections")).drop("rank")


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    sizes = packing.token_counts(table(spark, d, "documents"))
    return packing.pack(sizes, packing.container_kinds(table(spark, d, "containers")))


def p6_usage(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers of each capacity are."""
    return packing.usage(p6_packed(spark, d), packing.container_kinds(table(spark, d, "containers")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), edited=False)
    return leakage.exact(found).select("doc_id", "item_id")


def p7_scores(spark: SparkSession, d: str) -> DataFrame:
    """All aligned pairs, edited copies included, with their scores."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_percentiles": p1_percentiles, "p3_found": p3_found, "p6_packed": p6_packed, "p6_usage": p6_usage, "p7_found": p7_found, "p7_scores": p7_scores, "p8_found": p8_found}


def oracle_sql() -> dict[str, str]:
    g = (1 + ALPHA) / (1 - ALPHA)
    metrics = " union all ".join(f"select rig, run_day, '{m}' metric, {m} v from once" for m in sketch.SOLVE_METRICS)
    cols = ", ".join(f"cast({c} as double) {m}" for m, c in sketch.SOLVE_METRICS.items())
    wanted = ", ".join(f"({p!r}e0)" for p in sketch.PERCENTILES)
    return {
        # exact percentiles of all values, then the bucket of each: the sketch must hit it
        "p1_percentiles": f"""
with once as (select distinct log_id, rig, cast(run_at as date) run_day, {cols} from solve_log),
m as ({metrics}),
v as (select 'rig_day' as level, rig, run_day, metric, v from m union all select 'rig', rig, null, metric, v from m),
r as (select *, row_number() over (partition by level, rig, run_day, metric order by v) - 1 rk,
        count(*) over (partition by level, rig, run_day, metric) n from v where v is not null and not isnan(v)),
x as (select level, rig, run_day, metric, p percentile, n, v from r join (values {wanted}) q(p) on rk = floor(p * (n - 1))),
b as (select *, cast(sign(v) as int) sgn, cast(case when v = 0 then 0 when isinf(v) then {sketch.INFINITE}
        else ceil(ln(abs(v)) / {math.log(g)!r}e0) end as int) bucket from x)
select level, rig, run_day, metric, percentile, n, sgn, bucket,
  cast(case when sgn = 0 then 0 else sgn * {2.0 / (g + 1.0)!r}e0 * pow({g!r}e0, bucket) end as float) estimate from b""",
        "p3_found": """
select kind, group_id, item_id from (
  select 'cell' kind, cell group_id, star_id item_id, row_number() over (partition by cell order by mag_milli, star_id) rn
  from (select distinct cell, star_id, mag_milli from star_records where mag_milli is not null)
  union all
  select 'frame', frame_id, det_id, row_number() over (partition by frame_id order by flux desc, det_id)
  from (select distinct frame_id, det_id, flux from detections where isfinite(flux))) where rn <= 10""",
    }
