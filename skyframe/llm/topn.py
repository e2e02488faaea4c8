"""The N best items of every group, by two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import narrow_batches

#: Rows of a map task among which copies are looked for at once.
ROWS_AT_ONCE = 1 << 18


def _once(batches):
    for t in narrow_batches(batches, ROWS_AT_ONCE):
        yield from t.group_by(t.column_names, use_threads=False).aggregate([]).to_batches(ROWS_AT_ONCE)


def collapse(df: DataFrame) -> DataFrame:
    """The rows with the copies among each ROWS_AT_ONCE rows of a map task taken out, before any shuffle."""
    return df.mapInArrow(_once, df.schema)


def top_n_per_group(df: DataFrame, keys: list[str], item: str, order: list[Column], n: int, salts: int = 16) -> DataFrame:
    """Keep the ``n`` first rows of each group ``keys`` in the order ``order`` then ``item``.

    Stage one hashes each group's items into ``salts`` subgroups and keeps the first ``n``
    of each; Spark pushes that limit below the shuffle (WindowGroupLimit), so a map task
    sends at most ``n`` different rows per subgroup however many it reads. Copies of a row are
    collapsed in the map task, so that one row with very many copies does not fill a subgroup.
    Stage two ranks the at
    most ``n * salts`` survivors of a group. No task ever holds a whole hot group.

    Nulls: a null key forms a group of its own, as in SQL windows; rows with a null item
    are ranked after others of equal order; filter null scores before the call.
    Ties: equal order values are decided by the smaller ``item``.
    Repeated rows (equal in keys, order and item) count once. An item that recurs with
    different order values takes a rank for each of them.
    Empty input gives an empty result. Other columns are dropped, names cannot clash.
    """
    names = [f"__o{i}" for i in range(len(order))]
    slim = df.select(*keys, item, *[c.alias(x) for c, x in zip(_bare(order), names)], F.pmod(F.xxhash64(item), F.lit(salts)).cast("int").alias("__salt"))
    by = [_directed(o, x) for o, x in zip(order, names)] + [F.col(item).asc_nulls_last()]
    first = (
        collapse(slim).withColumn("__r", F.dense_rank().over(Window.partitionBy(*keys, "__salt").orderBy(*by)))
        .where(F.col("__r") <= n)
        .groupBy(*keys, "__salt", item, *names)
        .agg(F.lit(1).alias("__one"))
    )
    return (
        first.select(*keys, item, *names)
        .withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by)))
        .where(F.col("rank") <= n)
        .select(*keys, item, "rank")
    )


def _bare(order: list) -> list[Column]:
    return [o[0] if isinstance(o, tuple) else o for o in order]


def _directed(o, name: str) -> Column:
    return F.col(name).desc() if isinstance(o, tuple) and o[1] == "desc" else F.col(name).asc()


def brightest_and_strongest(stars: DataFrame, detections: DataFrame, n: int = 10, salts: int = 16) -> DataFrame:
    """The ``n`` brightest stars per cell and strongest detections per frame in one ranking.

    Both kinds are ranked by one plan on ``(kind, group_id)``; the score is the magnitude
    or the negated flux, so that smaller is better. Null, NaN and infinite values are no
    candidates. A group without candidates has no rows.
    """
    cells = stars.where(F.col("mag_milli").isNotNull()).select(
        F.lit("cell").alias("kind"), F.col("cell").cast("long").alias("group_id"), F.col("star_id").cast("long").alias("item_id"), F.col("mag_milli").cast("double").alias("score")
    )
    flux = F.col("flux")
    frames = detections.where(flux.isNotNull() & ~F.isnan(flux) & (F.abs(flux) < float("inf"))).select(
        F.lit("frame").alias("kind"), F.col("frame_id").cast("long").alias("group_id"), F.col("det_id").cast("long").alias("item_id"), (-flux).alias("score")
    )
    return top_n_per_group(cells.unionByName(frames), ["kind", "group_id"], "item_id", [F.col("score")], n, salts).select("kind", "group_id", "item_id", "rank")
