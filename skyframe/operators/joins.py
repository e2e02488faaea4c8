"""Tolerance joins as equi-joins on bins with an exact recheck; none compares all pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import whole_groups
from . import geometry


def _bins(low: Column, high: Column, width: float) -> Column:
    return F.sequence(F.floor(low / width).cast("long"), F.floor(high / width).cast("long"))


def band_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, tol: float, rel_tol: float = 0.0, width: float | None = None, keys: list[str] | None = None, repeat: str = "left") -> DataFrame:
    """Pairs with ``|right - left| <= tol + |left| * rel_tol``.

    The rows of one side (``repeat``, which should be the smaller one) are repeated for each bin
    that their band touches, those of the other have one bin, so each pair is found once and the
    residual is exact. Columns of both sides must have distinct names but for ``keys``. Null and
    NaN match nothing. ``rel_tol`` must be below 1.
    """
    width = width or max(2 * tol, 1e-12)
    known = lambda df, c: df.where(F.col(c).isNotNull() & ~F.isnan(c))
    a, b, half = known(left, left_value), known(right, right_value), F.lit(tol) + F.abs(F.col(left_value)) * rel_tol
    if repeat == "left":
        v, reach = F.col(left_value), half
    else:  # the widest band of any left value that can reach this right one
        v = F.col(right_value)
        reach = tol + (F.abs(v) + tol) * (rel_tol / (1.0 - rel_tol)) + 1e-9
    many, one = F.explode(_bins(v - reach, v + reach, width)), F.floor(F.col(right_value if repeat == "left" else left_value) / width).cast("long")
    a, b = (a.withColumn("__bin", many), b.withColumn("__bin", one)) if repeat == "left" else (a.withColumn("__bin", one), b.withColumn("__bin", many))
    return a.join(b, [*(keys or []), "__bin"]).where(F.abs(F.col(right_value) - F.col(left_value)) <= half).drop("__bin")


def _grid(df: DataFrame, x: str, y: str, cell: float, around: bool) -> DataFrame:
    gx, gy = F.floor(F.col(x) / cell).cast("long"), F.floor(F.col(y) / cell).cast("long")
    if not around:
        return df.withColumn("__gx", gx).withColumn("__gy", gy)
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    return df.withColumn("__s", step).withColumn("__gx", gx + F.col("__s.i")).withColumn("__gy", gy + F.col("__s.j")).drop("__s")


def nearest_within(points: DataFrame, targets: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """For each point (``keys, id, x, y``) the nearest target (``keys, tid, tx, ty``) within ``tol``.

    Points without one are left out; equal distances go to the smaller ``tid``. Targets of a hot
    key spread over the cells of the grid.
    """
    got = _grid(points, "x", "y", tol, True).join(_grid(targets, "tx", "ty", tol, False), [*keys, "__gx", "__gy"])
    d2 = F.pow(F.col("x") - F.col("tx"), 2) + F.pow(F.col("y") - F.col("ty"), 2)
    near = got.withColumn("d2", d2).where(F.col("d2") <= tol * tol)
    return near.groupBy(*keys, "id").agg(F.min(F.struct("d2", "tid")).alias("b")).select(*keys, "id", F.col("b.tid").alias("tid"), F.col("b.d2").alias("d2"))


def box_semi_join(points: DataFrame, targets: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Points with any target within ``tol`` in both coordinates; each point once."""
    got = _grid(points, "x", "y", tol, True).join(_grid(targets, "tx", "ty", tol, False), [*keys, "__gx", "__gy"])
    hit = got.where((F.abs(F.col("x") - F.col("tx")) <= tol) & (F.abs(F.col("y") - F.col("ty")) <= tol))
    return hit.select(*keys, "id").distinct()


def best_row(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__r") == 1).drop("__r")


def pair_separations(points: DataFrame, keys: list[str]) -> DataFrame:
    """Distances of all pairs within bounded point sets: ``keys, i, j, sep`` with i < j.

    ``points`` must be limited per key beforehand (``top_by_flux``); each row meets the others of
    its key by a set of structs, so the pairs of a key are made where the key is.
    """
    sets = points.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("pts"))
    a, b = F.col("a"), F.col("b")
    return (
        sets.select(*keys, F.explode("pts").alias("a"), "pts")
        .select(*keys, "a", F.explode("pts").alias("b"))
        .where(a["i"] < b["i"])
        .select(*keys, a["i"].alias("i"), b["i"].alias("j"), F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])).alias("sep"))
    )


def nearest_neighbours(points: DataFrame, keys: list[str], k: int, grouped: bool = False) -> DataFrame:
    """``keys, i, rank, j, d2``: the k nearest points of each point of a bounded set, ties by the smaller ``i``.

    Sets must be bounded per key (``top_by_flux``). ``grouped`` says that the rows come from a
    window over ``keys`` in the order of ``i``, so they need not be shuffled again.
    """
    slim = points.select(*keys, "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    slim = slim if grouped else slim.repartition(*keys).sortWithinPartitions(*keys, "i")
    number = points.schema["i"].dataType
    schema = T.StructType([*[points.schema[c] for c in keys], T.StructField("i", number), T.StructField("rank", T.IntegerType()), T.StructField("j", number), T.StructField("d2", T.DoubleType())])

    def run(batches):
        for t, starts in whole_groups(batches, keys, 1 << 13):
            x, y = (t.column(c).to_numpy() for c in ("x", "y"))
            own, rank, other = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for a, b in zip(starts, [*starts[1:], len(x)]):
                if b - a > 1:
                    near = geometry.nearest(x[a:b], y[a:b], min(k, b - a - 1))
                    own.append(np.repeat(np.arange(a, b), near.shape[1]))
                    rank.append(np.tile(np.arange(1, near.shape[1] + 1), b - a))
                    other.append(a + near.ravel())
            own, rank, other = (np.concatenate(v) for v in (own, rank, other))
            d2 = (x[other] - x[own]) ** 2 + (y[other] - y[own]) ** 2
            at = pa.array(own)
            cols = [t.column(c).take(at).combine_chunks() for c in keys] + [t.column("i").take(at).combine_chunks(), pa.array(rank.astype(np.int32)), t.column("i").take(pa.array(other)).combine_chunks(), pa.array(d2)]
            yield from pa.Table.from_arrays(cols, names=schema.names).to_batches(1 << 16)

    return slim.mapInArrow(run, schema)


def widest(points: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, widest``: the largest distance between two points (``x, y``) of each key, however many it has.

    The ends of the widest pair are corners of the convex hull. Each map task sends the corners
    of what it has read of a key, and hulls of hulls are made behind the shuffle. Points with a
    null or NaN coordinate are left out; a key with one point has the distance 0.
    """
    slim = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))

    def corners(batches):
        for t, starts in whole_groups(batches, keys, 1 << 16):
            x, y = (t.column(c).to_numpy() for c in ("x", "y"))
            keep = [a + geometry.hull(x[a:b], y[a:b]) for a, b in zip(starts, [*starts[1:], len(x)])]
            yield from t.take(pa.array(np.concatenate(keep))).to_batches()

    def measure(batches):
        for t, starts in whole_groups(batches, keys, 1 << 13):
            x, y = (t.column(c).to_numpy() for c in ("x", "y"))
            far = [geometry.diameter(x[a:b], y[a:b]) for a, b in zip(starts, [*starts[1:], len(x)])]
            yield from t.select(keys).take(pa.array(starts)).append_column("widest", pa.array(far)).to_batches()

    few = slim.sortWithinPartitions(*keys).mapInArrow(corners, slim.schema)
    schema = T.StructType([*[points.schema[c] for c in keys], T.StructField("widest", T.DoubleType())])
    return few.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(measure, schema)
