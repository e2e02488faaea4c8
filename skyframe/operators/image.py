"""Images as pixel tables, and selections of detections; frames may be any in number."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import whole_groups
from . import geometry, ranks


def pixels(images: DataFrame, key: str, values: str, width: int) -> DataFrame:
    """``key, y, x, v`` of images held as flat arrays."""
    return images.select(key, F.posexplode(values).alias("p", "v")).select(key, F.floor(F.col("p") / width).cast("int").alias("y"), (F.col("p") % width).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def superpixels(px: DataFrame, key: str) -> DataFrame:
    """Means of 2x2 cells: a colour-filter mosaic at half size."""
    return px.groupBy(key, F.floor(F.col("y") / 2).cast("int").alias("y"), F.floor(F.col("x") / 2).cast("int").alias("x")).agg(F.avg("v").alias("v"))


def upper_median(v: str) -> Column:
    """Element n/2 of the ascending values."""
    return F.expr(f"percentile_disc(0.5) within group (order by {v} desc)")


def _upper_median_rank() -> Column:
    """The same as a rank of ``n`` values, for ``ranks.values_at``."""
    return F.array(F.struct(F.lit(0).alias("i"), F.floor(F.col("n") / 2).alias("rank")))


def background_mesh(px: DataFrame, key: str, tile: int) -> DataFrame:
    """``key, ty, tx, level, noise`` of square tiles, ragged ones at the borders included.

    The level is the upper median; the noise its distance to the value at 15.87 percent of the
    ranks, at least 0.001, and 1 for tiles of fewer than 8 pixels. A tile is bounded by its area.
    """
    at = F.floor(F.col("n") * 1587 / 10000).cast("int")
    per = px.groupBy(key, F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx")).agg(F.array_sort(F.collect_list("v")).alias("s")).withColumn("n", F.size("s"))
    level = F.get("s", F.floor(F.col("n") / 2).cast("int"))
    noise = F.when(F.col("n") < 8, F.lit(1.0)).otherwise(F.greatest(F.lit(0.001), level - F.get("s", at)))
    return per.select(key, "ty", "tx", level.alias("level"), noise.alias("noise"))


def with_background(px: DataFrame, mesh: DataFrame, key: str, tile: int) -> DataFrame:
    """Add ``level, noise`` at each pixel, bilinear between tile centres and flat beyond them."""
    # a mesh is whole, so its sorted rows are a table of my + 1 rows and mx + 1 columns
    grid = mesh.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ty", "tx", "level", "noise"))).alias("m"), F.max("ty").alias("my"), F.max("tx").alias("mx"))
    place = lambda v, top: F.greatest(F.lit(0.0), F.least(F.col(top).cast("double"), (F.col(v) + 0.5) / tile - 0.5))
    df = px.join(grid, key).withColumn("cy", place("y", "my")).withColumn("cx", place("x", "mx"))
    df = df.withColumn("y0", F.floor("cy").cast("int")).withColumn("x0", F.floor("cx").cast("int"))
    df = df.withColumn("y1", F.least(F.col("y0") + 1, "my")).withColumn("x1", F.least(F.col("x0") + 1, "mx"))
    df = df.withColumn("dy", F.col("cy") - F.col("y0")).withColumn("dx", F.col("cx") - F.col("x0"))
    for name, y, x in (("a", "y0", "x0"), ("b", "y0", "x1"), ("c", "y1", "x0"), ("d", "y1", "x1")):
        df = df.withColumn(name, F.get("m", F.col(y) * (F.col("mx") + 1) + F.col(x)))
    mix = lambda f: (
        F.col(f"a.{f}") * (1 - F.col("dx")) * (1 - F.col("dy")) + F.col(f"b.{f}") * F.col("dx") * (1 - F.col("dy")) + F.col(f"c.{f}") * (1 - F.col("dx")) * F.col("dy") + F.col(f"d.{f}") * F.col("dx") * F.col("dy")
    )
    return df.select(*px.columns, mix("level").alias("level"), mix("noise").alias("noise"))


def above_threshold(px: DataFrame, k: float) -> DataFrame:
    return px.where(F.col("v") > F.col("level") + k * F.col("noise"))


def labelled(px: DataFrame, key: str) -> DataFrame:
    """Add ``label``: the first pixel (``y << 32 | x``) of the 8-connected component that a pixel belongs to.

    ``px`` has the pixels of interest of each image. A task takes whole images; memory is that
    of the images of a few thousand pixels together, or of one larger image.
    """
    schema = T.StructType([*px.schema.fields, T.StructField("label", T.LongType())])

    def run(batches):
        for t, starts in whole_groups(batches, [key], 1 << 14):
            y, x = (t.column(c).to_numpy().astype(np.int64) for c in ("y", "x"))
            label = np.empty(len(y), np.int64)
            for a, b in zip(starts, [*starts[1:], len(y)]):
                mask = np.zeros((y[a:b].max() - y[a:b].min() + 1, x[a:b].max() - x[a:b].min() + 1), bool)
                mask[y[a:b] - y[a:b].min(), x[a:b] - x[a:b].min()] = True
                ys, xs, number = geometry.components(mask)
                _, first = np.unique(number, return_index=True)
                grid = np.zeros(mask.shape, np.int64)
                grid[ys, xs] = (ys[first] + y[a:b].min() << 32 | xs[first] + x[a:b].min())[number]
                label[a:b] = grid[y[a:b] - y[a:b].min(), x[a:b] - x[a:b].min()]
            yield from t.append_column("label", pa.array(label)).to_batches(1 << 16)

    return px.repartition(key).sortWithinPartitions(key, "y", "x").mapInArrow(run, schema)


def moments(px: DataFrame, keys: list[str], width: int, height: int, margin: int) -> DataFrame:
    """Sums over labelled pixels, weighted by the light above the background."""
    w = F.greatest(F.col("v") - F.col("level"), F.lit(0.0))
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    edge = (x < margin) | (y < margin) | (x + margin >= width) | (y + margin >= height)
    return px.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("npix"), F.greatest(F.max("v"), F.lit(0.0)).alias("peak"), F.sum(w).alias("s"), F.sum(x * w).alias("sx"), F.sum(y * w).alias("sy"),
        F.sum(x * x * w).alias("sxx"), F.sum(y * y * w).alias("syy"), F.sum(x * y * w).alias("sxy"), F.bool_or(edge).alias("edge"),
    )


def shapes(blobs: DataFrame) -> DataFrame:
    """Centroid, width, ellipticity and angle of blobs with light, from their moments."""
    df = blobs.where(F.col("s") > 0).withColumn("cx", F.col("sx") / F.col("s")).withColumn("cy", F.col("sy") / F.col("s"))
    df = df.withColumn("mxx", F.greatest(F.lit(0.0), F.col("sxx") / F.col("s") - F.col("cx") * F.col("cx"))).withColumn("myy", F.greatest(F.lit(0.0), F.col("syy") / F.col("s") - F.col("cy") * F.col("cy")))
    df = df.withColumn("mxy", F.col("sxy") / F.col("s") - F.col("cx") * F.col("cy"))
    half, diff = (F.col("mxx") + F.col("myy")) / 2, F.col("mxx") - F.col("myy")
    common = F.sqrt(diff * diff / 4 + F.col("mxy") * F.col("mxy"))
    df = df.withColumn("a", F.sqrt(F.greatest(half + common, F.lit(1e-9)))).withColumn("b", F.sqrt(F.greatest(half - common, F.lit(0.0))))
    return df.withColumn("ellipticity", 1 - F.col("b") / F.col("a")).withColumn("fwhm_px", 2.354820045 * F.greatest(F.sqrt(F.col("a") * F.col("b")), F.lit(1e-6))).withColumn("theta_deg", 0.5 * F.degrees(F.atan2(2 * F.col("mxy"), diff)))


def rejections(blobs: DataFrame, keys: list[str], min_pix: int = 4, factor: float = 25.0, saturation: float = 65535 * 0.999, max_ellipticity: float = 0.6) -> DataFrame:
    """Counts per key of blobs by the first reason that rejects them, and of those kept.

    ``blobs`` has ``npix, peak, edge, s, ellipticity``. The largest allowed size follows the
    upper median of the sizes of at least ``min_pix``.
    """
    big = ranks.values_at(blobs.where(F.col("npix") >= min_pix), keys, "npix", _upper_median_rank()).select(*keys, F.greatest("npix", F.lit(1)).alias("mid"))
    limit = F.greatest(F.coalesce("mid", F.lit(1)) * factor, F.lit(4.0 * min_pix))
    why = (
        F.when(F.col("npix") < min_pix, "too_small").when(F.col("npix") > limit, "extended").when(F.col("peak") >= saturation, "saturated").when(F.col("edge"), "edge")
        .when(F.col("s") <= 0, "too_small").when(F.col("ellipticity") > max_ellipticity, "elongated").otherwise("kept")
    )
    got = blobs.join(big, keys, "left").withColumn("why", why)
    return got.groupBy(*keys).agg(*[F.count_if(F.col("why") == r).alias(r) for r in ("too_small", "extended", "saturated", "edge", "elongated", "kept")])


def saturation_level(blobs: DataFrame, keys: list[str], least: int = 8) -> DataFrame:
    """Level above which a frame is saturated: just below its maximum if that recurs, else infinite."""
    top = blobs.groupBy(*keys, "peak").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.max(F.struct("peak", "n")).alias("t"))
    return top.select(*keys, F.when(F.col("t.n") >= least, F.col("t.peak") * (1 - 1e-6)).alias("level"))


def top_by_flux(stars: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The k strongest detections of each key with their rank; ties by ``det_id``. Pushed below the shuffle."""
    r = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("flux"), "det_id"))
    return stars.withColumn("rank", r).where(F.col("rank") <= k)


def _cell(grid: Column, v: str, size: str) -> Column:
    return F.least(F.floor(F.col(v) / F.col(size) * grid), grid - 1).cast("int")


def concentration(stars: DataFrame, keys: list[str], grid: int = 8) -> DataFrame:
    """Share of the busiest of grid x grid cells against an even spread; needs ``nx, ny``."""
    g = F.lit(grid)
    per = stars.groupBy(*keys, _cell(g, "y", "ny").alias("gy"), _cell(g, "x", "nx").alias("gx")).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.sum("n").alias("n"), F.max("n").alias("busiest")).withColumn("concentration", F.col("busiest") / (F.col("n") / float(grid * grid)))


def stratified_by_flux(stars: DataFrame, keys: list[str], keep: int, least: int = 64, threshold: float = 5.0) -> DataFrame:
    """The strongest ``keep`` detections of each key, taken cell by cell in rounds where they crowd.

    A key is crowded if it has more than ``keep`` detections, its strongest ``keep`` are at
    least ``least`` and their busiest cell holds ``threshold`` times an even share. The grid gets
    finer with the excess, from 1 to 16 cells a side.
    """
    count = stars.groupBy(*keys).agg(F.count(F.lit(1)).alias("total"))
    top = top_by_flux(stars, keys, keep)
    crowd = concentration(top, keys).join(count, keys).where((F.col("total") > keep) & (F.col("n") >= least) & (F.col("concentration") >= threshold))
    g = F.greatest(F.lit(1), F.least(F.lit(16), F.round(2 * F.sqrt(F.col("total") / keep)).cast("int")))
    crowd = crowd.select(*keys, g.alias("g"))
    plain = top.join(crowd, keys, "left_anti").withColumn("stratified", F.lit(False))
    cells = stars.join(crowd, keys).withColumn("gy", _cell(F.col("g"), "y", "ny")).withColumn("gx", _cell(F.col("g"), "x", "nx"))
    rnd = F.row_number().over(Window.partitionBy(*keys, "gy", "gx").orderBy(F.desc("flux"), "det_id"))
    turn = F.row_number().over(Window.partitionBy(*keys).orderBy("round", "gy", "gx"))
    spread = cells.withColumn("round", rnd).where(F.col("round") <= keep).withColumn("turn", turn).where(F.col("turn") <= keep)
    spread = spread.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("flux"), "det_id"))).withColumn("stratified", F.lit(True))
    return plain.unionByName(spread.select(*plain.columns))


def median_quality(stars: DataFrame, keys: list[str]) -> DataFrame:
    """Upper medians of width, ellipticity and angle of each key, by ranks in sorted partitions."""
    names = ["fwhm_px", "ellipticity", "theta_deg"]
    long = stars.select(*keys, F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).cast("double").alias("v")) for c in names])).alias("c")).select(*keys, "c.*")
    got = ranks.values_at(long, [*keys, "what"], "v", _upper_median_rank())
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("what") == c, F.col("v"))).alias(c) for c in names])
