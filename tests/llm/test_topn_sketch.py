import math

import numpy as np
import pytest
from conftest import DATA, check_query
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skyframe.llm import queries, sketch, topn

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    check_query(spark, duck, queries.queries()[name], SQL[name])


def run(spark, rows, n=2, salts=3):
    df = spark.createDataFrame(rows, "g long, i long, s double, rank string, __salt string")
    return sorted(map(tuple, topn.top_n_per_group(df, ["g"], "i", [F.col("s")], n, salts).collect()), key=str)


def test_top_n_ties_nulls_repeats_and_clashing_names(spark):
    rows = [(1, 5, 1.0), (1, 4, 1.0), (1, 4, 1.0), (1, 9, 0.5), (None, 1, 3.0), (2, 7, 2.0)]
    got = run(spark, [(*r, "x", "y") for r in rows] * 3)
    assert got == sorted([(1, 9, 1), (1, 4, 2), (None, 1, 1), (2, 7, 1)], key=str)


def test_top_n_of_nothing(spark):
    assert run(spark, []) == []


def test_top_n_of_one_hot_group(spark):
    df = spark.range(20000).select(F.lit(1).alias("g"), F.col("id").alias("i"), F.pmod(F.xxhash64("id"), F.lit(50)).cast("double").alias("s"))
    got = [(r["s"], r["i"]) for r in topn.top_n_per_group(df, ["g"], "i", [F.col("s")], 10).join(df, ["g", "i"]).orderBy("rank").collect()]
    assert got == sorted((r["s"], r["i"]) for r in df.collect())[:10]


def test_descending_order(spark):
    df = spark.createDataFrame([(1, 1, 5.0), (1, 2, 7.0), (1, 3, 7.0)], "g long, i long, s double")
    got = topn.top_n_per_group(df, ["g"], "i", [(F.col("s"), "desc")], 2).orderBy("rank").collect()
    assert [r["i"] for r in got] == [2, 3]


def test_frames_leave_out_what_is_not_finite(spark):
    s = spark.createDataFrame([(1, 3, None), (2, 3, 5)], "star_id long, cell long, mag_milli short")
    d = spark.createDataFrame([(i, 1, v) for i, v in enumerate([None, float("nan"), float("inf"), -float("inf"), -3.0, 4.0])], "det_id long, frame_id long, flux double")
    got = topn.brightest_and_strongest(s, d).collect()
    assert [(r["kind"], r["item_id"]) for r in sorted(got)] == [("cell", 2), ("frame", 4), ("frame", 5)] or {(r["kind"], r["item_id"], r["rank"]) for r in got} == {("cell", 2, 1), ("frame", 5, 1), ("frame", 4, 2)}


VALUES = st.lists(st.one_of(st.floats(allow_nan=True, allow_infinity=True, allow_subnormal=False), st.integers(-3, 3).map(float)), min_size=1, max_size=60)


@settings(max_examples=8, deadline=None)
@given(VALUES, st.sampled_from([0.01, 0.1]))
def test_percentiles_are_within_their_bound_and_merge(spark, values, alpha):
    rows = [(k % 3, v) for k, v in enumerate(values)] + [(0, None)]
    days = sketch.sketch(spark.createDataFrame(rows, "day int, v double"), ["day"], "v", alpha)
    whole = sketch.merge(days.withColumn("all", F.lit(1)), ["all"])
    wanted = [0.0, 0.25, 0.5, 0.99, 1.0]
    got = {r["percentile"]: r for r in sketch.percentiles(whole, ["all"], wanted).collect()}
    good = np.sort([v for v in values if not math.isnan(v)])
    if not len(good):
        assert not got
        return
    for p in wanted:
        exact, r = good[math.floor(p * (len(good) - 1))], got[p]
        assert r["n"] == len(good)
        assert r["estimate"] == exact if math.isinf(exact) else abs(r["estimate"] - exact) <= alpha * abs(exact) * (1 + 1e-9)


def test_day_sketches_merge_to_the_rig(spark):
    log = spark.read.parquet(f"{DATA}/solve_log.parquet")
    got = sketch.solve_percentiles(log)
    n = got.where("percentile = 0.5").groupBy("level", "metric").agg(F.sum("n").alias("n")).collect()
    assert {(r["level"], r["metric"]): r["n"] for r in n}[("rig", "rms_deg")] == {(r["level"], r["metric"]): r["n"] for r in n}[("rig_day", "rms_deg")]


def test_sketch_of_an_empty_log(spark):
    log = spark.read.parquet(f"{DATA}/solve_log.parquet").limit(0)
    assert sketch.solve_percentiles(log).count() == 0


def test_sketches_of_different_alpha_do_not_merge(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 300.0)], "g int, v double")
    a, b = sketch.sketch(df.where("v < 10"), ["g"], "v", 0.01), sketch.sketch(df.where("v > 10"), ["g"], "v", 0.02)
    assert sketch.merge(a.union(a), ["g"]).first()["cnt"] == 2
    with pytest.raises(Exception, match="different alpha"):
        sketch.merge(a.union(b), ["g"]).collect()


def test_stored_days_combine(spark, tmp_path):
    log = spark.read.parquet(f"{DATA}/solve_log.parquet").select(F.to_date("run_at").alias("run_day"), F.col("outcome.fit.rms_deg").alias("v"))
    path = str(tmp_path / "days")
    days = sketch.sketch(log, ["run_day"], "v")
    sketch.write_days(days, path, "run_day")
    one = days.agg(F.min("run_day")).first()[0]
    sketch.write_days(sketch.sketch(log.where(F.col("run_day") == one), ["run_day"], "v"), path, "run_day")
    whole = lambda df: {tuple(r) for r in sketch.percentiles(sketch.merge(df.withColumn("all", F.lit(1)), ["all"]), ["all"], [0.1, 0.5, 0.9]).collect()}
    assert whole(sketch.read_days(spark, path)) == whole(days) == whole(sketch.sketch(log.withColumn("all", F.lit(1)), ["all"], "v"))
    assert sketch.read_days(spark, path, one, one).select("run_day").distinct().count() == 1


def test_copies_of_one_row_collapse_in_the_map_task(spark):
    df = spark.range(60_000).select(F.lit(1).alias("g"), F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("i"), F.when(F.col("id") % 3 == 0, 5.0).otherwise(1.0).alias("s"))
    slim = topn.collapse(df)
    assert slim.count() <= 20_001 + 8 * 2 and slim.where("i = 7").count() <= 8 * 2
    got = topn.top_n_per_group(df, ["g"], "i", [F.col("s")], 3).orderBy("rank").collect()
    assert [r["i"] for r in got] == [7, 0, 3]
