"""Mergeable percentiles with a relative error bound, from signed logarithmic buckets."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys outside the range of finite buckets.
INFINITE = 1_000_000_000


def bucket_of(value: Column, alpha: float) -> Column:
    """Signed bucket: the value lies in (g^(k-1), g^k] with g = (1+alpha)/(1-alpha)."""
    log_g = math.log((1 + alpha) / (1 - alpha))
    size = F.abs(value)
    return (
        F.when(size == float("inf"), F.lit(INFINITE))
        .when(size == 0, F.lit(0))
        .otherwise(F.ceil(F.log(size) / F.lit(log_g)))
        .cast("int")
    )


def estimate_of(sign: Column, bucket: Column, alpha: Column) -> Column:
    """Representative whose relative distance to all values of its bucket is at most alpha."""
    g = (1 + alpha) / (1 - alpha)
    return (
        F.when(sign == 0, F.lit(0.0))
        .when(bucket == INFINITE, sign * F.lit(float("inf")))
        .otherwise(sign * (2.0 / (g + 1.0)) * F.pow(g, bucket.cast("double")))
    )


def sketch(df: DataFrame, keys: list[str], value: str, alpha: float = 0.01) -> DataFrame:
    """Counts per group and signed bucket: ``keys, alpha, sgn, bucket, cnt``.

    The counts are partial sums before the shuffle, so a hot group costs each map task at
    most one row per bucket. Nulls and NaN are left out; zero has its own bucket, and so
    have both infinities. Groups without any value have no rows. Sketches of separate
    partitions or days are combined with :func:`merge`; nothing is lost in doing so.
    """
    v = F.col(value).cast("double")
    return (
        df.where(v.isNotNull() & ~F.isnan(v))
        .select(*keys, F.signum(v).cast("int").alias("sgn"), bucket_of(v, alpha).alias("bucket"))
        .groupBy(*keys, "sgn", "bucket")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .select(*keys, F.lit(float(alpha)).alias("alpha"), "sgn", "bucket", "cnt")
    )


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Combine sketches into those of the coarser groups ``keys``: matching buckets add up.

    Buckets match only under the same ``alpha``; a group of sketches with several fails the job.
    """
    # buckets that only one of the sketches has must not hide a difference
    known = sketches.groupBy(*keys, "sgn", "bucket").agg(F.sum("cnt").alias("cnt"), F.min("alpha").alias("alpha"), F.max("alpha").alias("__most"))
    w = Window.partitionBy(*keys)
    known = known.withColumn("alpha", F.min("alpha").over(w)).withColumn("__most", F.max("__most").over(w))
    same = F.when(F.col("alpha") == F.col("__most"), F.col("alpha")).otherwise(F.raise_error(F.lit("sketches of different alpha cannot be merged")).cast("double"))
    return known.select(*keys, same.alias("alpha"), "sgn", "bucket", "cnt")


def percentiles(sketches: DataFrame, keys: list[str], wanted: list[float]) -> DataFrame:
    """Percentiles of each sketch: ``keys, percentile, n, sgn, bucket, estimate``.

    The percentile p of n values is that of rank floor(p * (n-1)) from 0 in ascending
    order; the estimate differs from it by at most the sketch's ``alpha`` times its size. A
    group's buckets are bounded by the range of doubles (about 71,000 for alpha = 0.01),
    however many values it has, so the window over them is small.
    """
    signed = F.col("sgn") * F.col("bucket")
    w = Window.partitionBy(*keys)
    cum = F.sum("cnt").over(w.orderBy("sgn", signed).rowsBetween(Window.unboundedPreceding, 0))
    ranked = sketches.withColumn("n", F.sum("cnt").over(w)).withColumn("cum", cum)
    rank = lambda p: F.floor(p * (F.col("n") - 1).cast("double"))
    here = F.filter(F.array(*[F.lit(float(p)) for p in wanted]), lambda p: (rank(p) < F.col("cum")) & (rank(p) >= F.col("cum") - F.col("cnt")))
    estimate = estimate_of(F.col("sgn"), F.col("bucket"), F.col("alpha"))
    return ranked.withColumn("percentile", F.explode(here)).select(*keys, "percentile", "n", "sgn", "bucket", estimate.alias("estimate"))


def write_days(sketches: DataFrame, path: str, day: str) -> None:
    """Store sketches in one folder per value of ``day``; a day that is written again is replaced."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def read_days(spark: SparkSession, path: str, first=None, last=None, day: str = "run_day") -> DataFrame:
    """Stored sketches of the days from ``first`` to ``last``; other days' folders are not read."""
    got = spark.read.parquet(path)
    if first is not None:
        got = got.where(F.col(day) >= F.lit(first))
    return got if last is None else got.where(F.col(day) <= F.lit(last))


#: Metrics of a solve attempt, by name and column.
SOLVE_METRICS = {"rms_deg": "outcome.fit.rms_deg", "extract_ms": "outcome.timings.extract", "stars_matched": "outcome.stars_matched"}
PERCENTILES = [0.05, 0.25, 0.5, 0.75, 0.9, 0.99]


def solve_percentiles(solve_log: DataFrame, alpha: float = 0.01, wanted: list[float] | None = None) -> DataFrame:
    """Percentiles of the solve metrics per rig and per rig and run day.

    The rig's sketches are sums of its days' sketches; the log is read once. Repeated rows
    count once. A null rig or run day is a group of its own; ``level`` tells the rig's row
    from that of an unknown day. Metrics without values in a group give no row.
    """
    once = solve_log.select(
        "log_id", "rig", F.to_date("run_at").alias("run_day"), *[F.col(c).cast("double").alias(m) for m, c in SOLVE_METRICS.items()]
    ).distinct()
    pairs = ", ".join(f"'{m}', {m}" for m in SOLVE_METRICS)
    long = once.selectExpr("rig", "run_day", f"stack({len(SOLVE_METRICS)}, {pairs}) as (metric, value)")
    day = sketch(long, ["rig", "run_day", "metric"], "value", alpha)
    rig = merge(day, ["rig", "metric"])
    both = day.select(F.lit("rig_day").alias("level"), "*").unionByName(rig.select(F.lit("rig").alias("level"), F.lit(None).cast("date").alias("run_day"), "*"))
    return percentiles(both, ["level", "rig", "run_day", "metric"], wanted or PERCENTILES)
