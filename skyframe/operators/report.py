"""Agreement reports over solve logs: rates, percentiles, gates, samples, residual fields."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frame, sphere
from . import ranks

#: Thresholds of the agreement gate (fixed values).
MIN_SOLVE_RATE, MAX_MEDIAN, MAX_P99, GROSS, MAX_GROSS, MAX_PARITY = 0.95, 5.0, 30.0, 30.0, 0, 0
SEED = 20260814


def attempts(log: DataFrame) -> DataFrame:
    """One row per attempt with ``solved``, ``sep`` (arcsec to the recorded centre) and ``mosaic``."""
    sep = sphere.separation(F.col("db_ra"), F.col("db_dec"), F.col("outcome.field.center.ra"), F.col("outcome.field.center.dec")) * 3600.0
    solved = F.coalesce(F.col("outcome.solved"), F.lit(False))
    return log.dropDuplicates(["log_id"]).withColumn("solved", solved).withColumn("sep", F.when(solved, sep)).withColumn("mosaic", frame.is_mosaic(F.col("header.is_cfa"), F.col("filt_eff")))


def solve_rate(att: DataFrame) -> DataFrame:
    return att.agg(F.count(F.lit(1)).alias("n"), F.count_if("solved").alias("solved"), F.count_if(~F.col("solved") & F.col("outcome").isNotNull()).alias("failed"), F.count_if(F.col("outcome").isNull()).alias("errors"))


def reasons(att: DataFrame) -> DataFrame:
    """Failures by reason, and broken runs by their error."""
    why = F.when(F.col("outcome").isNull(), F.coalesce("parse_error", F.lit("unknown"))).otherwise(F.coalesce("outcome.reason", F.lit("?")))
    return att.where(~F.col("solved")).groupBy(why.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


#: Percentiles of the reports.
WANTED = [0.5, 0.9, 0.99]


def breakdown(att: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Rates and separation percentiles by grouping sets; ``level`` numbers the set.

    One pass over the attempts: each is counted once per set. Percentiles are exact, by ranks in
    sorted partitions, so that a group may hold any part of the log.
    """
    names = sorted({c for s in sets for c in s})
    level = lambda k, s: F.struct(F.lit(k).alias("level"), *[(F.col(c).cast("string") if c in s else F.lit(None).cast("string")).alias(c) for c in names])
    rows = att.select("solved", "sep", F.explode(F.array(*[level(k, s) for k, s in enumerate(sets)])).alias("g")).select("g.*", "solved", "sep")
    keys = ["level", *names]
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("solved").alias("solved"), F.max("sep").alias("worst"), F.count_if(F.col("sep") > GROSS).alias("gross"))
    p = ranks.percentiles(rows, keys, "sep", WANTED)
    return counted.alias("a").join(p.alias("b"), _same("a", "b", keys), "left").select(*[F.col(f"a.{c}").alias(c) for c in keys], "n", "solved", "p", "worst", "gross")


def gate(att: DataFrame) -> DataFrame:
    """One row: the measured values and whether each threshold is met."""
    parity = F.count_if(F.col("solved") & (F.col("header.header_parity") == "?"))
    g = att.agg((F.count_if("solved") / F.count(F.lit(1))).alias("rate"), F.count_if(F.col("sep") > GROSS).alias("gross"), parity.alias("parity"))
    one = F.lit(1).alias("one")
    p = ranks.percentiles(att.select(one, "sep"), ["one"], "sep", WANTED)
    g = g.select("*", one).join(p, "one", "left")  # one row each
    ok = [F.col("rate") >= MIN_SOLVE_RATE, F.col("p")[0] <= MAX_MEDIAN, F.col("p")[2] <= MAX_P99, F.col("gross") <= MAX_GROSS, F.col("parity") <= MAX_PARITY]
    return g.select("rate", "gross", *[c.alias(n) for c, n in zip(ok, ("rate_ok", "median_ok", "p99_ok", "gross_ok", "parity_ok"))], F.coalesce(reduce(and_, ok), F.lit(False)).alias("passed"))


def _same(a: str, b: str, cols: list[str]):
    return reduce(and_, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols])


def allocation(sizes: DataFrame, strata: list[str], n: int) -> DataFrame:
    """Places of each stratum (``strata, size``): proportional and at least one, then brought to n in all.

    The strata give or take one place a round, the largest first, as long as they have any to
    spare; each keeps one. The table has one row per stratum, of which there are few.
    """
    whole = Window.partitionBy()
    share = F.greatest(F.lit(1), F.bround(n * F.col("size") / F.sum("size").over(whole))).cast("long")
    got = sizes.withColumn("want", F.least("size", share)).withColumn("excess", F.sum("want").over(whole) - n)
    got = got.withColumn("spare", F.when(F.col("excess") > 0, F.col("want") - 1).otherwise(F.col("size") - F.col("want")))
    steps = got.where("spare > 0 and excess <> 0").withColumn("round", F.explode(F.sequence(F.lit(1), F.least("spare", F.abs("excess")).cast("int"))))
    turn = F.row_number().over(Window.orderBy("round", F.desc("size"), *strata))
    taken = steps.withColumn("turn", turn).where(F.col("turn") <= F.abs("excess")).groupBy(*strata).agg(F.count(F.lit(1)).alias("moved"))
    moved = F.coalesce("moved", F.lit(0)) * F.when(F.col("excess") > 0, -1).otherwise(1)
    both = got.alias("a").join(taken.alias("b"), _same("a", "b", strata), "left")
    return both.select(*[F.col(f"a.{c}").alias(c) for c in strata], "size", (F.col("want") + moved).alias("places"))


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, along: str) -> DataFrame:
    """n rows with at least one of every stratum, spread along one column within each.

    Shares are those of :func:`allocation`. A stratum is cut into as many ranges of ``along`` as
    it has places, and the row with the smallest seeded hash is taken from each; with more
    strata than places the n smallest hashes are kept (:func:`left_out` tells what is missing
    then). The result is the same on every run and any cluster. Places in a stratum come from
    sorted partitions, so no stratum is ever in one task.
    """
    per = df.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    number = ranks.numbered(df.select(*strata, key, along), [*strata, along, key], "__at")
    first = number.groupBy(*strata).agg(F.min("__at").alias("__first"))
    sized = allocation(per, strata, n).alias("w").join(first.alias("f"), _same("w", "f", strata)).select(*[F.col(f"w.{c}").alias(c) for c in strata], "size", "places", "__first")
    got = number.alias("a").join(sized.alias("b"), _same("a", "b", strata)).select("a.*", "size", "places", "__first")
    slot = F.floor(((F.col("__at") - F.col("__first") + 1) * F.col("places") - 1) / F.col("size"))
    hashed = F.md5(F.concat_ws(":", F.lit(str(SEED)), F.col(key).cast("string")))
    chosen = got.groupBy(*strata, slot.alias("slot")).agg(F.min(F.struct(hashed.alias("h"), F.col(key).alias("k"))).alias("m"))
    return df.join(chosen.orderBy("m").limit(n).select(F.col("m.k").alias(key)), key, "left_semi")


def left_out(df: DataFrame, sample: DataFrame, axis: str) -> DataFrame:
    """Values of an axis that rows have and the sample lacks; a sample should be refused unless this is empty."""
    a, b = df.select(axis).distinct().alias("a"), sample.select(axis).distinct().alias("b")
    return a.join(b, _same("a", "b", [axis]), "left_anti")


def residual_field(vectors: DataFrame, key: str, grid: int = 4, least: int = 2) -> DataFrame:
    """Mean residual vectors over a grid of each frame; cells with fewer than ``least`` are left out."""
    cell = lambda v, n: F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.col(v) / F.col(n) * grid))).cast("int")
    return vectors.groupBy(key, cell("y", "ny").alias("gy"), cell("x", "nx").alias("gx")).agg(F.count(F.lit(1)).alias("n"), F.avg("dx").alias("dx"), F.avg("dy").alias("dy")).where(F.col("n") >= least)


#: Thresholds of the verdict on residual patterns, frames compared of a group, and the least of vectors and frames (fixed values).
STABLE, PARTLY, FRAMES_COMPARED, LEAST_VECTORS, LEAST_FRAMES = 0.5, 0.25, 12, 15, 4


def evenly(rows: DataFrame, key: str, group: str, want: int) -> DataFrame:
    """At most ``want`` rows of each group at even steps in the order of the key; no group is in one task."""
    placed = ranks.numbered(rows.select(group, key), [group, key], "__at")
    per = placed.groupBy(group).agg(F.min("__at").alias("__first"), F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / want)).alias("__step"))
    at = F.col("__at") - F.col("__first")
    return placed.join(per, group).where((at % F.col("__step") == 0) & (at / F.col("__step") < want)).select(group, key)


def chosen_fields(vectors: DataFrame, key: str, group: str) -> DataFrame:
    """Residual fields of the frames that a group's verdict rests on, one row per frame, cell and axis.

    At even steps FRAMES_COMPARED frames of a group are looked at, and those of them with
    LEAST_VECTORS vectors used; groups with fewer than LEAST_FRAMES are left out, and so are
    cells that not all of a group's frames have. Rows without a group take no part.
    """
    per = vectors.where(F.col(group).isNotNull()).groupBy(group, key).agg(F.count(F.lit(1)).alias("__n"))
    used = evenly(per, key, group, FRAMES_COMPARED).join(per, [group, key]).where(F.col("__n") >= LEAST_VECTORS).drop("__n")
    frames = used.groupBy(group).agg(F.count(F.lit(1)).alias("frames")).where(F.col("frames") >= LEAST_FRAMES)
    used = used.join(frames, group)
    fields = residual_field(vectors.join(used.select(key), key, "left_semi"), key).join(used, key)
    axes = F.explode(F.array(F.struct(F.lit(0).alias("axis"), F.col("dx").alias("v")), F.struct(F.lit(1).alias("axis"), F.col("dy").alias("v"))))
    long = fields.select(group, key, "frames", "gy", "gx", axes.alias("c")).select(group, key, "frames", "gy", "gx", "c.*")
    return long.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(group, "gy", "gx", "axis"))).where(F.col("__n") == F.col("frames")).drop("__n")


def pattern_correlation(vectors: DataFrame, key: str, group: str) -> DataFrame:
    """``group, a, b, r``: correlation of the residual patterns of every two of a group's chosen frames."""
    long = chosen_fields(vectors, key, group)
    a, b = (long.select(group, F.col(key).alias(n), "gy", "gx", "axis", F.col("v").alias(v)) for n, v in (("a", "va"), ("b", "vb")))
    pairs = a.join(b, [group, "gy", "gx", "axis"]).where("a < b")  # at most 66 pairs of a group
    got = pairs.groupBy(group, "a", "b").agg(F.corr("va", "vb").alias("r"), F.stddev_pop("va").alias("__a"), F.stddev_pop("vb").alias("__b"))
    return got.where("__a > 0 and __b > 0").drop("__a", "__b")


def pattern_verdict(vectors: DataFrame, key: str, group: str) -> DataFrame:
    """Per group: frames, pairs, median and 10th and 90th percentile of r, repeatable part, scatter, and the verdict."""
    cells = chosen_fields(vectors, key, group).groupBy(group, "frames", "gy", "gx", "axis").agg(F.abs(F.avg("v")).alias("m"), F.stddev_pop("v").alias("s"))
    parts = cells.groupBy(group, "frames").agg(F.avg("m").alias("signal"), F.avg("s").alias("scatter"))
    p = pattern_correlation(vectors, key, group).groupBy(group).agg(F.count(F.lit(1)).alias("pairs"), F.percentile("r", F.array(*[F.lit(x) for x in (0.1, 0.5, 0.9)])).alias("p"))
    got = parts.join(p, group, "left").select(group, "frames", F.coalesce("pairs", F.lit(0)).alias("pairs"), *[F.col("p")[i].alias(c) for i, c in enumerate(("p10", "median", "p90"))], "signal", "scatter")
    stable = (F.col("median") > STABLE) & (F.col("signal") > F.col("scatter"))
    return got.withColumn("verdict", F.when(stable, "stable").when(F.col("median") > PARTLY, "partly").otherwise("not"))


def merge_failures(att: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Outcome to report for each key: a success, else the last refusal by the gate, else the last failure."""
    rank = F.when(F.col("solved"), 2).when(F.col("outcome.reason") == "LOW_CONFIDENCE", 1).otherwise(0)
    r = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("rank"), *[F.col(c).desc() for c in order]))
    return att.withColumn("rank", rank).withColumn("__r", r).where(F.col("__r") == 1).drop("__r")


def ladder(rungs: list[DataFrame], key: str) -> DataFrame:
    """Rows of the first rung that has the key: each next rung adds only what is still missing."""
    out = rungs[0].withColumn("rung", F.lit(1))
    for k, r in enumerate(rungs[1:], 2):
        out = out.unionByName(r.join(out.select(key).distinct(), key, "left_anti").withColumn("rung", F.lit(k)))
    return out


def upsert_cards(header: DataFrame, cards: DataFrame, key: str) -> DataFrame:
    """Header cards ``key, pos, name, value`` with new values for known names and new cards appended.

    Comment cards are never replaced. New cards follow in their own order.
    """
    plain = ~F.col("name").isin("COMMENT", "HISTORY", "")
    last = header.groupBy(key).agg(F.max("pos").alias("last"))
    h, c = header.alias("h"), cards.select(key, "name", F.col("pos").alias("cpos"), F.col("value").alias("cvalue"))
    kept = h.join(c.where(plain), [key, "name"], "left").select(key, "pos", "name", F.coalesce("cvalue", "value").alias("value"))
    fresh = c.where(plain).join(header.select(key, "name").distinct(), [key, "name"], "left_anti").unionByName(c.where(~plain))
    place = F.row_number().over(Window.partitionBy(key).orderBy("cpos"))
    fresh = fresh.join(last, key, "left").select(key, (F.coalesce("last", F.lit(0)) + place).alias("pos"), "name", F.col("cvalue").alias("value"))
    return kept.unionByName(fresh)
