"""Star patterns of four: building, canonical codes, selection, and similarity joins of codes."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import sphere
from ..session import stored, whole_groups
from . import catalog, geometry, ranks

#: Scales of the pattern bands in degrees (fixed values).
BANDS = [0.25, 0.5, 1.0, 2.0, 4.0, 8.0]
#: The six pairs of four points in order, each with the two points that it leaves.
PAIRS = [(0, 1, 2, 3), (0, 2, 1, 3), (0, 3, 1, 2), (1, 2, 0, 3), (1, 3, 0, 2), (2, 3, 0, 1)]


def triples(k: int) -> list[tuple[int, int, int]]:
    return [(a, b, c) for a in range(k) for b in range(a + 1, k) for c in range(b + 1, k)]


def canonical_codes(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes (n, 4) and diagonals (n) of n patterns given as (n, 4) coordinates; NaN where points coincide.

    The widest pair (the first, if several) spans the frame from (0,0) to (1,1); of its two
    directions and the two orders of the other points, those with xC <= xD and xC + xD <= 1 are
    valid and the lexicographically smallest is kept. Codes are rounded to 1e-12, which stands
    for the slack of comparisons.
    """
    rows = np.arange(len(x))
    pairs = np.array(PAIRS)
    d2 = np.stack([(x[:, j] - x[:, i]) ** 2 + (y[:, j] - y[:, i]) ** 2 for i, j, _, _ in PAIRS], axis=1)
    role = pairs[d2.argmax(1)] if len(x) else np.empty((0, 4), np.int64)
    best = d2.max(1) if len(x) else np.empty(0)
    px, py = ([v[rows, role[:, k]] for k in range(4)] for v in (x, y))
    code = np.full((len(x), 4), np.inf)
    with np.errstate(divide="ignore", invalid="ignore"):
        for a, b in ((0, 1), (1, 0)):
            ux, uy = px[b] - px[a], py[b] - py[a]
            at = {}
            for q in (2, 3):
                qx, qy = px[q] - px[a], py[q] - py[a]
                along, across = (qx * ux + qy * uy) / best, (qx * uy - qy * ux) / best
                at[q] = (np.round(along - across, 12), np.round(along + across, 12))
            for u, v in ((2, 3), (3, 2)):
                option = np.stack([*at[u], *at[v]], axis=1)
                valid = (option[:, 0] <= option[:, 2]) & (option[:, 0] + option[:, 2] <= 1.0)
                differs = option != code
                first = differs.argmax(1)
                smaller = option[rows, first] < code[rows, first]
                take = valid & differs.any(1) & smaller
                code[take] = option[take]
    code[(d2.min(1, initial=np.inf) <= 1e-12) | ~np.isfinite(code).all(1)] = np.nan
    return code, np.sqrt(best)


def with_code(df: DataFrame, p: str = "p", code: str = "code", mirrored: bool = False) -> DataFrame:
    """Add the canonical code and diagonal of four points; a set with coinciding points is dropped.

    Whole Arrow batches are coded in numpy: the same rule as a column expression takes Spark
    longer to compile than to run.
    """
    df = df.drop(code, "diag")
    schema = T.StructType([*df.schema.fields, T.StructField(code, T.ArrayType(T.DoubleType())), T.StructField("diag", T.DoubleType())])
    sign = -1.0 if mirrored else 1.0

    def run(batches):
        for batch in batches:
            flat = batch.column(p).flatten()
            x, y = (flat.field(k).to_numpy(zero_copy_only=False).reshape(-1, 4) for k in ("x", "y"))
            codes, diag = canonical_codes(sign * x, y)
            keep = np.flatnonzero(np.isfinite(codes[:, 0]))
            out = pa.Table.from_batches([batch]).take(pa.array(keep))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1) * 4, pa.int32()), pa.array(codes[keep].ravel()))
            yield from out.append_column(code, lists).append_column("diag", pa.array(diag[keep])).to_batches()

    return df.mapInArrow(run, schema)


def mirrored_codes(code: np.ndarray) -> np.ndarray:
    """Codes (n, 4) of the mirrored patterns; a code is itself a mirrored picture of its pattern's points."""
    zero = np.zeros(len(code))
    return canonical_codes(np.stack([zero, zero + 1, code[:, 0], code[:, 2]], axis=1), np.stack([zero, zero + 1, code[:, 1], code[:, 3]], axis=1))[0]


#: Rows of point sets whose patterns are coded together.
ROWS_AT_ONCE = 1 << 13


def conditioning(code: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How far patterns are from being ambiguous: off their own diagonal, and the widest pair from the next."""
    off = np.minimum(np.abs((code[:, 1] - code[:, 0]) / 2), np.abs((code[:, 3] - code[:, 2]) / 2))
    d = np.sort(np.stack([np.sqrt((x[:, j] - x[:, i]) ** 2 + (y[:, j] - y[:, i]) ** 2) for i, j, _, _ in PAIRS], axis=1), axis=1)
    return np.minimum(off, (d[:, 5] - d[:, 4]) / d[:, 5])


def _places(group: np.ndarray, seed: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Patterns in interleaved order, and the place of each in its group: one rank of every seed before the next rank."""
    seed = seed[order]
    rank = np.arange(len(order)) - np.searchsorted(seed, seed)
    again = np.lexsort((seed, rank, group[order]))
    order = order[again]
    return order, np.arange(len(order)) - np.searchsorted(group[order], group[order]) + 1


def point_patterns(x: np.ndarray, y: np.ndarray, starts: np.ndarray, k: int, limit: int, cap: int | None = None):
    """Patterns of many point sets at once: rows of the four points, place, code and diagonal.

    Each point with every three of its k nearest makes a set of four, which belongs to its
    first seed and the first such three. Of each point set the first ``limit`` patterns are kept,
    in interleaved order. With ``cap``, at most so many are kept of these, the best-conditioned
    of each seed first; all in their order if they are few.
    """
    k = max(3, min(12, k))
    idx, owner = [np.empty((0, 4), np.int64)], [np.empty(0, np.int64)]
    for g, (a, b) in enumerate(zip(starts, [*starts[1:], len(x)])):
        if b - a >= 4:
            near = geometry.nearest(x[a:b], y[a:b], min(k, b - a - 1))
            t = np.array(triples(near.shape[1]))
            idx.append(a + np.concatenate([np.repeat(np.arange(b - a), len(t))[:, None], near[:, t].reshape(-1, 3)], axis=1))
            owner.append(np.full(len(idx[-1]), g))
    idx, owner = np.concatenate(idx), np.concatenate(owner)
    same = np.sort(idx, axis=1)
    order = np.lexsort(same.T)
    new = np.ones(len(order), bool)
    new[1:] = (same[order][1:] != same[order][:-1]).any(1)
    first = np.sort(np.minimum.reduceat(order, np.flatnonzero(new))) if len(order) else order
    code, diag = canonical_codes(x[idx[first]], y[idx[first]])
    ok = np.isfinite(code[:, 0])
    idx, owner, code, diag = idx[first][ok], owner[first][ok], code[ok], diag[ok]
    order, place = _places(owner, idx[:, 0], np.arange(len(idx)))
    order, place = order[place <= limit], place[place <= limit]
    if cap is not None:
        order = np.sort(order)
        idx, owner, code, diag = idx[order], owner[order], code[order], diag[order]
        few = np.bincount(owner, minlength=len(starts))[owner] <= cap
        cond = np.where(few, 0.0, np.round(conditioning(code, x[idx], y[idx]), 9))  # rounding makes ties of equal shapes
        turn = np.where(few, np.arange(len(idx)), 0)
        order, place = _places(owner, idx[:, 0], np.lexsort((*idx.T[::-1], turn, -cond, idx[:, 0])))
        order, place = order[place <= cap], place[place <= cap]
    return idx[order], place, code[order], diag[order]


POINT = T.ArrayType(T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())]))


def build_quads(points: DataFrame, keys: list[str], k: int = 6, limit: int = 600, cap: int | None = None, name: str = "i", grouped: bool = False, then=None) -> DataFrame:
    """``keys, place, seed, idx, p, code, diag``: the patterns of point sets (``keys, i, x, y``), see :func:`point_patterns`.

    ``idx`` has the points' values of the column ``name`` in the order seed, neighbours, ``seed``
    the first ``i`` of it, ``p`` their places. Sets must be bounded per key (``top_by_flux``,
    ``tile_points``); a set of fewer than four points has no pattern. A task takes whole sets,
    many at a time, in numpy. ``grouped`` says that the rows come from a window over ``keys`` in
    the order of ``i``, so they need not be shuffled again. ``then``, a function of a task's
    batches and the schema of what it makes of them, spares patterns the way out of the task.
    """
    long = T.LongType()
    fields = [*[points.schema[c] for c in keys], T.StructField("place", long), T.StructField("seed", long), T.StructField("idx", T.ArrayType(long)), T.StructField("p", POINT), T.StructField("code", T.ArrayType(T.DoubleType())), T.StructField("diag", T.DoubleType())]
    slim = points.select(*keys, "i", "x", "y", *([name] if name != "i" else []))
    if not grouped:
        slim = slim.repartition(*keys).sortWithinPartitions(*keys, "i")

    def run(batches):
        for t, starts in whole_groups(batches, keys, ROWS_AT_ONCE):
            x, y = (t.column(c).to_numpy().astype(float) for c in ("x", "y"))
            idx, place, code, diag = point_patterns(x, y, starts, k, limit, cap)
            n = len(idx)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 4, pa.int32()), v)
            flat = pa.StructArray.from_arrays([pa.array(x[idx].ravel()), pa.array(y[idx].ravel())], names=["x", "y"])
            named = pa.array(t.column(name).to_numpy()[idx].ravel(), pa.int64())
            seed = pa.array(t.column("i").to_numpy()[idx[:, 0]], pa.int64())
            keyed = [t.column(c).take(pa.array(idx[:, 0])).combine_chunks() for c in keys]
            yield from pa.Table.from_arrays([*keyed, pa.array(place.astype(np.int64)), seed, lists(named), lists(flat), lists(pa.array(code.ravel())), pa.array(diag)], names=[f.name for f in fields]).to_batches(1 << 14)

    if then is not None:
        return slim.mapInArrow(lambda batches: then[0](run(batches)), then[1])
    return slim.mapInArrow(run, T.StructType(fields))


def band_of(diag_deg: Column, bands: list[float] = BANDS) -> Column:
    """Number of the band by the geometric means between neighbouring scales; the last is open."""
    out = F.lit(len(bands) - 1)
    for i in reversed(range(len(bands) - 1)):
        out = F.when(diag_deg < math.sqrt(bands[i] * bands[i + 1]), F.lit(i)).otherwise(out)
    return out


def bands_to_search(df: DataFrame, diag_px: str, scale_arcsec: str, bands: list[float] = BANDS) -> DataFrame:
    """``band`` rows for each pattern: those within a factor of two of its size, else the nearest, all without a scale."""
    size = F.col(diag_px) * F.col(scale_arcsec) / 3600.0
    every = F.array(*[F.struct(F.lit(i).alias("band"), F.lit(float(b)).alias("deg")) for i, b in enumerate(bands)])
    near = F.filter(every, lambda b: (size / b["deg"]).between(0.5, 2.0))
    best = F.array_min(F.transform(every, lambda b: F.struct(F.abs(F.log(size / b["deg"])).alias("off"), b["band"].alias("band"))))
    chosen = F.when(F.col(scale_arcsec).isNull(), F.transform(every, lambda b: b["band"])).when(F.size(near) > 0, F.transform(near, lambda b: b["band"])).otherwise(F.array(best["band"]))
    return df.withColumn("band", F.explode(chosen))


def code_join(left: DataFrame, right: DataFrame, tol: float, left_code: str = "code", right_code: str = "rcode", keys: list[str] | None = None) -> DataFrame:
    """Pairs whose codes are within ``tol``: equi-join on bins of three axes, then the exact distance.

    A bin is twice as wide as the tolerance, so a right row is repeated for two bins of an axis
    at most. Column names of the sides must differ but for ``keys``; give only the columns that
    are needed, since right rows travel up to eight times.
    """
    axes, width = (0, 1, 3), 2 * tol
    cell = lambda v: F.floor(v / width).cast("long")
    a, b = left, right
    for ax in axes:
        a = a.withColumn(f"__b{ax}", cell(F.col(left_code)[ax]))
        v = F.col(right_code)[ax]
        b = b.withColumn(f"__b{ax}", F.explode(F.sequence(cell(v - tol), cell(v + tol))))
    d2 = sum(((F.col(left_code)[i] - F.col(right_code)[i]) * (F.col(left_code)[i] - F.col(right_code)[i]) for i in range(4)), F.lit(0.0))
    names = [f"__b{ax}" for ax in axes]
    return a.join(b, [*(keys or []), *names]).withColumn("d2", d2).where(F.col("d2") <= tol * tol).drop(*names)


def code_runs(keys: list[T.StructField] = (), digits: int | None = None):
    """What packs the codes of a task (``build_quads(then=...)``) for :func:`edges_of_runs`, and the schema of that."""
    return lambda batches: ranks.packed_runs(batches, [f.name for f in keys], "code", digits), ranks.runs_schema(keys)


def edges_of_runs(runs: DataFrame, keys: list[str], bins: int = 48, digits: int | None = None) -> DataFrame:
    """:func:`quantile_edges` of packed runs of codes; with ``digits`` in whole numbers of 10^-digits."""
    got = ranks.values_of_runs(runs, keys, lambda n: [i * (n - 1) // bins for i in range(bins + 1)], digits)
    return got.select(*keys, F.col("axis").cast("int"), F.col("i").cast("int"), F.col("value").alias("edge"))


def quantile_edges(codes: DataFrame, keys: list[str], bins: int = 48) -> DataFrame:
    """``keys, axis, i, edge``: values at ranks floor(i (n-1) / bins) of each code axis.

    Exact for any number of codes: they are kept as packed runs, in which ranks are found by
    counting (``ranks.values_of_runs``), so that a pattern band, of which there are few, is never
    in one task, and no code is shuffled.
    """
    run, schema = code_runs([codes.schema[k] for k in keys])
    return edges_of_runs(stored(codes.select(*keys, "code").mapInArrow(run, schema)), keys, bins)


def grid_join(left: DataFrame, right: DataFrame, edges: DataFrame, tol: float, keys: list[str], bins: int = 48) -> DataFrame:
    """The same pairs as :func:`code_join` within each key, over bins of equal population along the first two axes.

    ``left`` has ``code`` and one bin a row, ``right`` has ``rcode`` and should be the smaller side: it
    is repeated for the bins that the box around a code touches. ``edges`` (of the index, usually)
    are two arrays of ``bins + 1`` numbers a key. The other two axes are left to the exact
    distance: over four, a row would be repeated for hundreds of cells.
    """
    arrays = edges.where("axis < 2").groupBy(*keys).agg(*[F.transform(F.array_sort(F.collect_list(F.when(F.col("axis") == ax, F.struct("i", "edge")))), lambda e: e["edge"]).alias(f"__e{ax}") for ax in (0, 1)])
    bin_of = lambda ax, v: F.least(F.greatest(F.size(F.filter(f"__e{ax}", lambda e: e <= v)) - 1, F.lit(0)), F.lit(bins - 1))
    arrays = F.broadcast(arrays)  # a row for each of the few bands
    a = left.join(arrays, keys).withColumns({f"__b{ax}": bin_of(ax, F.col("code")[ax]) for ax in (0, 1)}).drop("__e0", "__e1")
    b = right.join(arrays, keys)
    for ax in (0, 1):
        v = F.col("rcode")[ax]
        b = b.withColumn(f"__b{ax}", F.explode(F.sequence(bin_of(ax, v - tol), bin_of(ax, v + tol))))
    b = b.drop("__e0", "__e1")
    d2 = sum(((F.col("code")[i] - F.col("rcode")[i]) * (F.col("code")[i] - F.col("rcode")[i]) for i in range(4)), F.lit(0.0))
    return a.join(b, [*keys, "__b0", "__b1"]).withColumn("d2", d2).where(F.col("d2") <= tol * tol).drop("__b0", "__b1")


def tile_sweep(spark, scale: float, bounds: tuple[float, float, float, float] = (0.0, 360.0, -90.0, 90.0)) -> DataFrame:
    """Tiles of equal latitude steps over the sky: ``disc_id, ra0, dec0, radius``; bounds are inclusive and do not wrap."""
    n_dec = max(1, round(180.0 / scale))
    step = 180.0 / n_dec
    df = spark.range(n_dec).withColumn("dec0", -90.0 + step * (F.col("id") + 0.5))
    df = df.withColumn("n_ra", F.greatest(F.lit(1), F.round(360.0 * F.cos(F.radians("dec0")) / scale).cast("int")))
    df = df.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n_ra") - 1))).withColumn("ra0", 360.0 / F.col("n_ra") * (F.col("j") + 0.5))
    inside = F.col("ra0").between(bounds[0], bounds[1]) & F.col("dec0").between(bounds[2], bounds[3])
    return df.where(inside).select((F.col("id") * 1000000 + F.col("j")).alias("disc_id"), "ra0", "dec0", F.lit(scale / 2).alias("radius"))


def tile_points(stars: DataFrame, scales: list[float], budget: int = 14, bounds: tuple[float, float, float, float] = (0.0, 360.0, -90.0, 90.0)) -> DataFrame:
    """The brightest stars of each tile of the sweeps in its tangent plane: ``tile_scale, disc_id, i, star_id, x, y``.

    A star names its tiles itself: the sweep is regular, so only the tiles of its own and the
    neighbouring bands next to it can reach it. Nothing is joined; the limit is pushed below the
    one shuffle, which is by tile. Rows come tile by tile, brightest first.
    """
    every = F.array(*[F.struct(F.lit(float(s)).alias("tile_scale"), F.lit(max(1, round(180.0 / s))).alias("n_dec")) for s in scales])
    df = stars.where(catalog.finite("ra", "dec")).select("star_id", "cell", "ra", "dec", "mag_milli", F.explode(every).alias("t")).select("*", "t.*").drop("t")
    step, half = 180.0 / F.col("n_dec"), F.col("tile_scale") / 2
    df = df.withColumn("band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.least(F.floor((F.col("dec") + 90.0) / step), F.col("n_dec") - 1) + o)))
    df = df.where(F.col("band").between(0, F.col("n_dec") - 1)).withColumn("dec0", -90.0 + step * (F.col("band") + 0.5)).where(F.abs(F.col("dec") - F.col("dec0")) <= half)
    df = df.withColumn("n_ra", F.greatest(F.lit(1), F.round(360.0 * F.cos(F.radians("dec0")) / F.col("tile_scale")).cast("int")))
    # around a pole all tiles of a band are looked at
    own = F.floor(F.col("ra") / 360.0 * F.col("n_ra"))
    near = F.when(F.col("n_ra") <= 8, F.sequence(F.lit(0).cast("long"), F.col("n_ra").cast("long") - 1)).otherwise(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda o: F.pmod(own + o, F.col("n_ra").cast("long"))))
    df = df.withColumn("j", F.explode(near)).withColumn("ra0", 360.0 / F.col("n_ra") * (F.col("j") + 0.5))
    df = df.where(F.col("ra0").between(bounds[0], bounds[1]) & F.col("dec0").between(bounds[2], bounds[3]))
    df = df.where(sphere.separation(*map(F.col, ("ra0", "dec0", "ra", "dec"))) <= half).withColumn("disc_id", F.col("band") * 1000000 + F.col("j"))
    place = F.row_number().over(Window.partitionBy("tile_scale", "disc_id").orderBy(*catalog.BRIGHTEST))
    top = df.withColumn("rank", place).where(F.col("rank") <= budget)
    xi, eta = sphere.to_plane(*map(F.col, ("ra", "dec", "ra0", "dec0")))
    return top.select("tile_scale", "disc_id", (F.col("rank") - 1).alias("i"), "star_id", xi.alias("x"), eta.alias("y")).where(F.col("x").isNotNull())


def build_quad_index(stars: DataFrame, scales: list[float] = BANDS, cap: int = 25, bounds: tuple[float, float, float, float] = (0.0, 360.0, -90.0, 90.0), budget: int = 14) -> DataFrame:
    """Patterns of all tiles at the given scales: ``tile_scale, disc_id, place, band, code, diag, stars``.

    One shuffle, of the tiles' brightest stars; each tile is bounded by its star budget and pattern cap.
    """
    keys = ["tile_scale", "disc_id"]
    got = build_quads(tile_points(stars, scales, budget, bounds), keys, 6, 4096, cap, "star_id", grouped=True)
    return got.select(*keys, "place", band_of(F.col("diag")).alias("band"), "code", "diag", F.col("idx").alias("stars"))


def quad_index_info(index: DataFrame) -> DataFrame:
    return index.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
