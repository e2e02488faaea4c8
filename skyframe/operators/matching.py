"""Matching of star patterns, fits and statistical gates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def plane(points: DataFrame, keys: list[str]) -> DataFrame:
    """Least-squares ``t = a0 + a1 x + a2 y`` per key from partial sums; null where the points are on a line.

    The sums are centred (covariances), which keeps their digits; they combine before the shuffle.
    """
    cov = lambda a, b: F.covar_pop(a, b)
    g = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("t").alias("mt"),
        cov("x", "x").alias("xx"), cov("y", "y").alias("yy"), cov("x", "y").alias("xy"), cov("x", "t").alias("xt"), cov("y", "t").alias("yt"),
    ).withColumn("det", F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy"))
    ok = (F.col("n") >= 3) & (F.abs("det") > 1e-12 * F.col("xx") * F.col("yy"))
    g = g.withColumn("a1", F.when(ok, (F.col("xt") * F.col("yy") - F.col("yt") * F.col("xy")) / F.col("det")))
    g = g.withColumn("a2", F.when(ok, (F.col("yt") * F.col("xx") - F.col("xt") * F.col("xy")) / F.col("det")))
    return g.select(*keys, "n", (F.col("mt") - F.col("a1") * F.col("mx") - F.col("a2") * F.col("my")).alias("a0"), "a1", "a2")


def chance(matched: Column, n_image: Column, n_cat: Column, tol_deg: Column, area: Column) -> tuple[Column, Column]:
    """Expected chance matches, and the decades by which the matches exceed them (Poisson tail term).

    Zero decades for no matches, empty or degenerate inputs, and up to the expected number.
    """
    lam = n_image * n_cat * math.pi * tol_deg * tol_deg / area
    usable = (matched > 0) & (n_image > 0) & (n_cat > 0) & (tol_deg > 0) & (area > 0)
    k = matched.cast("double")
    log_factorial = F.when(k < 2, F.lit(0.0)).otherwise(k * F.log(k) - k + 0.5 * F.log(2 * math.pi * k))
    decades = F.greatest(F.lit(0.0), (log_factorial + lam - k * F.log(lam)) / math.log(10))
    expected = F.when(usable & (lam > 0), lam).otherwise(F.lit(0.0))
    return expected, F.when(usable & (lam > 0) & (k > lam), decades).otherwise(F.lit(0.0))


def blind_threshold(hypotheses: Column, base: float = 12.0) -> Column:
    """Decades asked for after so many hypotheses; none offered fails closed."""
    return F.when(hypotheses > 0, base + F.greatest(F.lit(0.0), F.log10(hypotheses.cast("double")))).otherwise(F.lit(float("inf")))


def blind_matched(reprojected: Column, fitted: Column) -> Column:
    """Matches beyond those that the fit was made from."""
    return F.greatest(F.lit(0), reprojected - fitted)


def accepted(matched: Column, decades: Column, rms_px: Column, need: Column | None = None, min_matched: int = 10, max_rms_px: float = 3.0) -> Column:
    need = F.lit(12.0) if need is None else need
    return F.coalesce((matched >= min_matched) & (decades >= need) & ~F.isnan(rms_px) & (rms_px <= max_rms_px), F.lit(False))


def votes(matches: DataFrame, keys: list[str]) -> DataFrame:
    """Bins of scale (2 percent) and rotation (5 degrees) of pattern matches, with their neighbours' votes.

    ``matches`` has ``keys, scale, rot, mirrored``. Rotation wraps: the first and the last bin are
    neighbours, and bin 72, which rounding can give, stays a bin of its own as the definition has it.
    """
    b = matches.withColumn("bs", F.round(F.log("scale") / 0.02).cast("long")).withColumn("br", F.round(F.col("rot") / 5.0).cast("long"))
    own = b.groupBy(*keys, "bs", "br", "mirrored").agg(F.count(F.lit(1)).alias("n"))
    # a bin gives its votes to all bins at most one step away, once each; wrapped = min(d, 72 - d) <= 1
    steps = F.array(*[F.lit(s).cast("long") for s in (-72, -71, -1, 0, 1, 71, 72)])
    given = own.withColumn("ds", F.explode(F.array(*[F.lit(s).cast("long") for s in (-1, 0, 1)]))).withColumn("dr", F.explode(steps))
    kept = F.when((F.col("ds") == 0) & (F.col("dr") == 0), F.col("n"))
    to = given.select(*keys, (F.col("bs") + F.col("ds")).alias("bs"), (F.col("br") + F.col("dr")).alias("br"), "mirrored", "n", kept.alias("own"))
    merged = to.groupBy(*keys, "bs", "br", "mirrored").agg(F.max("own").alias("own"), F.sum("n").alias("merged"))
    return merged.where("own is not null").select(*keys, "bs", "br", "mirrored", F.col("own").alias("n"), "merged")


def winning_bin(bins: DataFrame, keys: list[str], min_votes: int = 4) -> DataFrame:
    """The bin with most votes of each key, if enough; ties by scale, rotation, parity."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("merged"), "bs", "br", "mirrored"))
    return bins.withColumn("__r", r).where((F.col("__r") == 1) & (F.col("merged") >= min_votes)).drop("__r")


def winners(matches: DataFrame, best: DataFrame, keys: list[str]) -> DataFrame:
    """The matches that voted for the winning bin or its neighbours."""
    w = best.select(*keys, F.col("bs").alias("ws"), F.col("br").alias("wr"), F.col("mirrored").alias("wm"))
    bs, br = F.round(F.log("scale") / 0.02).cast("long"), F.round(F.col("rot") / 5.0).cast("long")
    d = F.abs(br - F.col("wr"))
    return matches.join(w, keys).where((F.col("mirrored") == F.col("wm")) & (F.abs(bs - F.col("ws")) <= 1) & (F.least(d, 72 - d) <= 1)).drop("ws", "wr", "wm")


def majority(won: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, image_i, sky_i, n``: for each image star the catalogue star that most matches pair it with.

    ``won`` has ``image_idx, sky_idx`` (four stars each, in the order seed, neighbours) and an
    ``ord``; a tie goes to the pair seen first.
    """
    pairs = won.select(*keys, "ord", F.posexplode(F.arrays_zip("image_idx", "sky_idx")).alias("k", "p")).select(*keys, (F.col("ord") * 4 + F.col("k")).alias("seen"), F.col("p.image_idx").alias("image_i"), F.col("p.sky_idx").alias("sky_i"))
    tally = pairs.groupBy(*keys, "image_i", "sky_i").agg(F.count(F.lit(1)).alias("n"), F.min("seen").alias("seen"))
    r = F.row_number().over(Window.partitionBy(*keys, "image_i").orderBy(F.desc("n"), "seen"))
    return tally.withColumn("__r", r).where(F.col("__r") == 1).select(*keys, "image_i", "sky_i", "n")


def summary(won: DataFrame, keys: list[str]) -> DataFrame:
    """Votes, mean scale and circular mean of the rotation of the winning matches."""
    rad = F.radians("rot")
    mean = F.pmod(F.degrees(F.atan2(F.sum(F.sin(rad)), F.sum(F.cos(rad)))), F.lit(360.0))
    return won.groupBy(*keys).agg(F.count(F.lit(1)).alias("votes"), F.avg("scale").alias("scale"), mean.alias("rotation"), F.first("mirrored").alias("mirrored"))


def spread(points: DataFrame, keys: list[str]) -> Column:
    """Root mean square distance to the centroid, as an aggregate over ``x, y``."""
    return F.sqrt(F.var_pop("x") + F.var_pop("y"))


def runner_up(scores: DataFrame, keys: list[str], score: str, item: str) -> DataFrame:
    """Best and second-best score per key."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), item))
    two = scores.withColumn("__r", r).where(F.col("__r") <= 2)
    pick = lambda n, c: F.max(F.when(F.col("__r") == n, F.col(c)))
    return two.groupBy(*keys).agg(pick(1, item).alias("best"), pick(1, score).alias("best_score"), pick(2, score).alias("second_score"))
