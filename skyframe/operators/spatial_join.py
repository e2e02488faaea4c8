"""Complete radius joins on the sphere: Voronoi partitions and local vantage-point trees.

Points and query discs are assigned to the Voronoi cells of pivots. A disc is replicated to
every cell that the triangle inequality cannot exclude: when ``d(q, p_i) - d(q, p_0)`` exceeds
twice the radius (``p_0`` the nearest pivot), no point within the radius can have ``p_i`` as its
nearest pivot. Inside a cell, a vantage-point tree over the points answers the discs with the
exact great-circle metric. Pivots decide only where work is done, never what is found.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import narrow_batches

#: Border tolerance in radians (1e-8 arcsec): borders are inclusive despite rounding.
EDGE = 5e-14
#: Slack of pruning bounds, far above the rounding of ``arccos`` of a dot product near 1.
SLACK = 2e-7
CHUNK_ROWS = 1 << 17
LEAF = 24
PAIRS_AT_ONCE = 1 << 20
#: Points, and discs, of a cell that go into one part of it.
PART_ROWS = 1 << 16

SHIPPED = "cell int, part int, side int, id long, ra double, dec double, radius double"
FOUND = "query_id long, point_id long, point_ra double, point_dec double"
COUNTED = "query_id long, n long"


@dataclass
class Pivots:
    """Two levels of pivots: ``top`` super cells, each divided by its own ``low`` pivots.

    ``first[g]`` is the number of the first cell of super cell g. Samples tell which cells are
    hot: the points of cell c are split into ``parts[c]`` parts and its discs into
    ``disc_parts[c]``; every part of the one meets every part of the other.
    """

    top: np.ndarray
    low: list[np.ndarray]
    first: np.ndarray
    parts: np.ndarray
    disc_parts: np.ndarray


def to_xyz(ra_deg: np.ndarray, dec_deg: np.ndarray) -> np.ndarray:
    ra, dec = np.radians(ra_deg), np.radians(dec_deg)
    c = np.cos(dec)
    return np.stack([c * np.cos(ra), c * np.sin(ra), np.sin(dec)], axis=1)


def angle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Great-circle distance in radians of paired unit vectors, exact for small angles."""
    d = a - b
    return 2.0 * np.arcsin(np.minimum(1.0, 0.5 * np.sqrt(np.einsum("ij,ij->i", d, d))))


def _sample(rows: DataFrame, n: int, most: int) -> tuple[np.ndarray, int]:
    """Unit vectors of about ``most`` distinct rows (``id, ra, dec``), twice as many at most, and how many rows each stands for.

    The sample is chosen by a hash of the row, hence copies of a row are sampled together or not at all.
    """
    step = max(1, n // most)
    got = rows.where(F.pmod(F.xxhash64("id", "ra", "dec"), F.lit(step)) == 0).select("id", "ra", "dec").distinct().limit(2 * most).toPandas()
    xyz = to_xyz(got["ra"].to_numpy(), got["dec"].to_numpy())
    return xyz[np.random.default_rng(7).permutation(len(xyz))], step


def fit_pivots(points: DataFrame, discs: DataFrame | None = None, n: int | None = None, n_discs: int | None = None, most: int = 65536, rows_per_cell: int = 2000) -> Pivots:
    """Choose pivots from a sample of distinct points, and split cells that samples show to be hot.

    ``points`` and ``discs`` have ``id, ra, dec``; ``n`` and ``n_discs`` are their numbers, or
    bounds of them, where they are known without reading the rows. The number of pivots follows
    that of the points up to ``most`` (1.6 MB of pivots), so cells stay small where the sky is
    dense; at most ``8 * most`` rows of either table come to the driver.
    """
    n = points.count() if n is None else n
    wanted = int(min(most, max(16, n // rows_per_cell)))
    rows, step = _sample(points, n, 4 * wanted) if n else (np.empty((0, 3)), 1)
    seeds = rows if len(rows) else to_xyz(np.arange(12) * 30.0, np.linspace(-75, 75, 12))
    k = max(1, int(math.isqrt(min(wanted, len(seeds)))))
    top, chosen = seeds[:k], seeds[: max(k, wanted)]
    home = (chosen @ top.T).argmax(1)
    low = [chosen[home == g] if (home == g).any() else top[g : g + 1] for g in range(k)]
    first = np.concatenate([[0], np.cumsum([len(x) for x in low])]).astype(np.int64)
    one = np.ones(int(first[-1]), np.int64)
    pivots = Pivots(top, low, first, one, one)
    split = lambda xyz, step: np.maximum(1, np.bincount(assign(xyz, pivots), minlength=len(one)) * step // PART_ROWS)
    pivots.parts = split(rows, step)
    if discs is not None:
        n_discs = discs.count() if n_discs is None else n_discs
        if n_discs > PART_ROWS:
            pivots.disc_parts = split(*_sample(discs, n_discs, 4 * wanted))
    return pivots


def assign(xyz: np.ndarray, pivots: Pivots) -> np.ndarray:
    """Cell of each point: the nearest low pivot within the nearest super cell."""
    home = (xyz @ pivots.top.T).argmax(1)
    order = np.argsort(home, kind="stable")
    cuts = np.searchsorted(home[order], np.arange(len(pivots.top) + 1))
    cell = np.empty(len(xyz), np.int64)
    for g in np.flatnonzero(np.diff(cuts)):
        at = order[cuts[g] : cuts[g + 1]]
        cell[at] = pivots.first[g] + (xyz[at] @ pivots.low[g].T).argmax(1)
    return cell


def _near(xyz: np.ndarray, radius: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = np.arccos(np.clip(xyz @ pivots.T, -1.0, 1.0))
    return np.nonzero(d - d.min(1, keepdims=True) <= 2.0 * (radius[:, None] + SLACK))


def replicate(xyz: np.ndarray, radius: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray]:
    """(disc, cell) for every cell that may hold a point of the disc."""
    who, home = _near(xyz, radius, pivots.top)
    order = np.argsort(home, kind="stable")
    who, home = who[order], home[order]
    cuts = np.searchsorted(home, np.arange(len(pivots.top) + 1))
    discs, cells = [], []
    for g in np.flatnonzero(np.diff(cuts)):
        at = who[cuts[g] : cuts[g + 1]]
        i, c = _near(xyz[at], radius[at], pivots.low[g])
        discs.append(at[i])
        cells.append(pivots.first[g] + c)
    return (np.concatenate(discs), np.concatenate(cells)) if discs else (np.empty(0, np.int64), np.empty(0, np.int64))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.arange(total) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)


class VantageForest:
    """Vantage-point trees of many cells, built and searched level by level in numpy."""

    def __init__(self, xyz: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        self.perm = np.arange(len(xyz))
        self.xyz = xyz
        self.start: list[np.ndarray] = []
        made, s, e = 0, starts.astype(np.int64), ends.astype(np.int64)
        cols: dict[str, list[np.ndarray]] = {k: [] for k in ("start", "end", "left", "right", "in_max", "out_min", "out_max")}
        while len(s):
            big = (e - s) > LEAF
            left, right = np.full(len(s), -1), np.full(len(s), -1)
            in_max, out_min, out_max = (np.zeros(len(s)) for _ in range(3))
            bs, be = s[big], e[big]
            nxt_s, nxt_e = bs[:0], be[:0]
            if len(bs):
                length = be - bs - 1
                at, node = _ranges(bs + 1, length), np.repeat(np.arange(len(bs)), length)
                d = angle(xyz[self.perm[at]], xyz[self.perm[bs]][node])
                order = np.lexsort((d, node))
                self.perm[at], d = self.perm[at][order], d[order]
                mid = bs + 1 + length // 2
                base = np.concatenate([[0], np.cumsum(length)[:-1]])
                in_max[big], out_min[big], out_max[big] = d[base + length // 2 - 1], d[base + length // 2], d[base + length - 1]
                after = made + len(s)
                left[big], right[big] = after + np.arange(len(bs)), after + len(bs) + np.arange(len(bs))
                nxt_s, nxt_e = np.concatenate([bs + 1, mid]), np.concatenate([mid, be])
            for k, v in zip(cols, (s, e, left, right, in_max, out_min, out_max)):
                cols[k].append(v)
            made += len(s)
            s, e = nxt_s, nxt_e
        for k, v in cols.items():
            setattr(self, k, np.concatenate(v) if v else np.empty(0))

    def search(self, xyz: np.ndarray, radius: np.ndarray, root: np.ndarray):
        """Yield (query, point) index arrays; ``root[q]`` is the tree of query q."""
        q, node = np.arange(len(xyz)), root
        while len(q):
            leaf = self.left[node] < 0
            lq, ln = q[leaf], node[leaf]
            sizes = self.end[ln] - self.start[ln]
            cuts = np.searchsorted(np.cumsum(sizes), np.arange(PAIRS_AT_ONCE, int(sizes.sum()) + PAIRS_AT_ONCE, PAIRS_AT_ONCE))
            lo = 0
            for hi in [*(cuts + 1)]:
                size = sizes[lo:hi]
                if len(size):
                    i, j = np.repeat(lq[lo:hi], size), self.perm[_ranges(self.start[ln[lo:hi]], size)]
                    ok = angle(xyz[i], self.xyz[j]) <= radius[i] + EDGE
                    yield i[ok], j[ok]
                lo = hi
            q, node = q[~leaf], node[~leaf]
            vp = self.perm[self.start[node]]
            d, r = angle(xyz[q], self.xyz[vp]), radius[q]
            ok = d <= r + EDGE
            yield q[ok], vp[ok]
            tol = r + 1e-12
            inner = d - tol <= self.in_max[node]
            outer = (d + tol >= self.out_min[node]) & (d - tol <= self.out_max[node])
            q, node = np.concatenate([q[inner], q[outer]]), np.concatenate([self.left[node[inner]], self.right[node[outer]]])


def _ship(pivots: Pivots, side: int):
    """mapInArrow function that sends points (side 0) or discs (side 1) to their cells."""

    def run(batches):
        for t in narrow_batches(batches, CHUNK_ROWS):
            t = t.group_by(t.column_names).aggregate([])  # copies collapse before the shuffle
            ids, ra, dec, radius = (t.column(k).to_numpy() for k in ("id", "ra", "dec", "radius"))
            xyz = to_xyz(ra, dec)
            at, cell = replicate(xyz, np.radians(radius), pivots) if side else (np.arange(len(ids)), assign(xyz, pivots))
            points, discs = pivots.parts[cell], pivots.disc_parts[cell]
            mix = (ids[at] ^ (ids[at] >> 17)) & 0x7FFFFFFF
            # a point goes to each part of the discs, a disc to each part of the points
            again = points if side else discs
            other = _ranges(np.zeros(len(at), np.int64), again)
            at, cell, mix, points, discs = (np.repeat(v, again) for v in (at, cell, mix, points, discs))
            part = other * discs + mix % discs if side else mix % points * discs + other
            cols = [cell.astype(np.int32), part.astype(np.int32), np.full(len(at), side, np.int32), ids[at], ra[at], dec[at], radius[at]]
            yield from pa.Table.from_arrays([pa.array(c) for c in cols], names=["cell", "part", "side", "id", "ra", "dec", "radius"]).to_batches(65536)

    return run


def _key(t: pa.Table) -> np.ndarray:
    """One number for cell and part."""
    return t.column("cell").to_numpy().astype(np.int64) << 32 | t.column("part").to_numpy()


def _whole_cells(batches):
    """Cut a partition sorted by cell into tables of whole parts of cells, of about CHUNK_ROWS rows.

    A table holds more only where one part does, and parts have about PART_ROWS points and discs.
    """
    held = None
    for t in narrow_batches(batches, CHUNK_ROWS):
        held = t if held is None else pa.concat_tables([held, t])
        cut = int(np.searchsorted(_key(held), _key(held.slice(held.num_rows - 1))[0]))
        if cut:
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def _hits(batches):
    """For each group of parts: ids of discs and of the points in them, and the points' positions."""
    for t in _whole_cells(batches):
        t = t.group_by(t.column_names).aggregate([])
        key = _key(t)
        side, ids, ra, dec, radius = (t.column(k).to_numpy() for k in ("side", "id", "ra", "dec", "radius"))
        p, q = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        p = p[np.argsort(key[p], kind="stable")]
        if not len(p) or not len(q):
            continue
        starts = np.flatnonzero(np.concatenate([[True], key[p][1:] != key[p][:-1]]))
        trees = key[p][starts]
        root = np.searchsorted(trees, key[q])
        ok = (root < len(trees)) & (trees[np.minimum(root, len(trees) - 1)] == key[q])
        q, root = q[ok], root[ok]
        forest = VantageForest(to_xyz(ra[p], dec[p]), starts, np.append(starts[1:], len(p)))
        for i, j in forest.search(to_xyz(ra[q], dec[q]), np.radians(radius[q]), root):
            if len(i):
                yield ids[q[i]], ids[p[j]], ra[p[j]], dec[p[j]]


def _local(batches):
    for found in _hits(batches):
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in found], names=["query_id", "point_id", "point_ra", "point_dec"])


def _local_counts(batches):
    for query, point, _, _ in _hits(batches):
        who, n = np.unique(query[query != point], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(n.astype(np.int64))], names=["query_id", "n"])


def _clean(df: DataFrame, *names: str) -> DataFrame:
    df = df.select(F.col("id").cast("long").alias("id"), *[F.col(c).cast("double").alias(c) for c in names])
    bad = F.col("id").isNull()
    for c in names:
        bad = bad | F.col(c).isNull() | F.isnan(c)
    return df.where(~bad)


def _meet(points: DataFrame, discs: DataFrame, pivots: Pivots | None) -> DataFrame:
    """Points and discs of each part of each cell together, sorted by it: the one shuffle."""
    points, discs = _clean(points, "ra", "dec"), _clean(discs, "ra", "dec", "radius")
    pivots = pivots or fit_pivots(points, discs)
    sent = points.withColumn("radius", F.lit(0.0)).mapInArrow(_ship(pivots, 0), SHIPPED).unionByName(discs.mapInArrow(_ship(pivots, 1), SHIPPED))
    return sent.repartition("cell", "part").sortWithinPartitions("cell", "part")


def radius_join(points: DataFrame, discs: DataFrame, pivots: Pivots | None = None) -> DataFrame:
    """All (disc, point) pairs whose great-circle distance is at most the disc's radius.

    ``points`` has ``id long, ra, dec``; ``discs`` also ``radius`` (degrees). Returns
    ``query_id, point_id, point_ra, point_dec``; a pair may recur if an id has several
    positions. Complete for any pivots; borders are inclusive. Rows with a null or NaN in
    these columns match nothing. Copies of a row are dropped before and after the one
    shuffle; cells with very many points or discs are split into parts. Further
    columns are ignored, so their names cannot clash. Empty input gives an empty result.
    """
    return _meet(points, discs, pivots).mapInArrow(_local, FOUND)


def neighbour_counts(points: DataFrame, radius: float, pivots: Pivots | None = None) -> DataFrame:
    """``query_id, n``: how many other points lie within ``radius`` degrees of each; those with none are left out.

    ``points`` has ``id, ra, dec`` with one position per id. Pairs are counted where they are
    found and never become rows. Nulls, NaN, copies and empty input as in :func:`radius_join`.
    """
    counted = _meet(points, points.withColumn("radius", F.lit(float(radius))), pivots).mapInArrow(_local_counts, COUNTED)
    return counted.groupBy("query_id").agg(F.sum("n").alias("n"))


def bounding_discs(fields: DataFrame) -> DataFrame:
    """Discs ``id, ra, dec, radius`` that cover sky regions (cones and boxes).

    A box's disc is centred at its middle and reaches its farthest corner; one that spans
    more than 180 degrees of right ascension gets the whole sky, since its farthest point
    need not be a corner. Incomplete regions give no disc.
    """
    half = F.pmod(F.col("ra_max") - F.col("ra_min"), F.lit(360.0)) / 2
    half = F.when(F.col("ra_max") - F.col("ra_min") >= 360, F.lit(180.0)).otherwise(half)
    mid = (F.col("dec_min") + F.col("dec_max")) / 2
    corner = lambda dec: F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt(
        F.pow(F.sin(F.radians(dec - mid) / 2), 2) + F.cos(F.radians(mid)) * F.cos(F.radians(dec)) * F.pow(F.sin(F.radians(half) / 2), 2)))))
    box = F.col("shape") == "box"
    return fields.select(
        F.col("field_id").alias("id"),
        F.when(box, F.pmod(F.col("ra_min") + half, F.lit(360.0))).otherwise(F.col("ra_deg")).alias("ra"),
        F.when(box, mid).otherwise(F.col("dec_deg")).alias("dec"),
        F.when(box, F.when(half > 90, F.lit(180.0)).otherwise(F.greatest(corner(F.col("dec_min")), corner(F.col("dec_max"))) + 1e-9))
        .otherwise(F.col("radius_deg")).alias("radius"),
    ).where(F.col("radius") >= 0)


def inside_regions(points: DataFrame, fields: DataFrame, pivots: Pivots | None = None) -> DataFrame:
    """(field_id, point_id) for each point inside a cone or box; borders are inclusive.

    The radius join with the regions' bounding discs finds the candidates; boxes are then
    tested exactly. A box with ``ra_min > ra_max`` runs across 0h. The regions meet their
    candidates by an equi-join on the id, whatever their number.
    """
    got = radius_join(points, bounding_discs(fields.dropDuplicates(["field_id"])), pivots)
    boxes = fields.dropDuplicates(["field_id"]).select("field_id", "shape", "ra_min", "ra_max", "dec_min", "dec_max")
    ra, dec = F.col("point_ra"), F.col("point_dec")
    in_ra = F.when(F.col("ra_min") <= F.col("ra_max"), ra.between(F.col("ra_min"), F.col("ra_max"))).otherwise((ra >= F.col("ra_min")) | (ra <= F.col("ra_max")))
    return (
        got.join(boxes, F.col("query_id") == F.col("field_id"))
        .where((F.col("shape") == "cone") | (dec.between(F.col("dec_min"), F.col("dec_max")) & in_ra))
        .select("field_id", "point_id")
    )


def star_positions(stars: DataFrame) -> DataFrame:
    """``id, ra, dec`` of packed star records."""
    return stars.select(
        F.col("star_id").alias("id"),
        (F.col("ra_scaled").cast("double") * 360.0 / 4294967296.0).alias("ra"),
        (F.col("dec_scaled").cast("double") * 90.0 / 2147483647.0).alias("dec"),
    )


def valid_sources(gaia: DataFrame) -> DataFrame:
    """``id, ra, dec`` of catalogue rows with a possible position; ra taken modulo 360."""
    ra, dec = F.col("ra"), F.col("dec")
    turned = F.pmod(ra, F.lit(360.0))
    return gaia.where(ra.isNotNull() & ~F.isnan(ra) & (F.abs(ra) < float("inf")) & dec.between(-90.0, 90.0)).select(
        F.col("source_id").alias("id"), F.when(turned >= 360.0, F.lit(0.0)).otherwise(turned).alias("ra"), "dec"
    )


def sources_near_and_inside(gaia: DataFrame, stars: DataFrame, fields: DataFrame, arcsec: float = 1.5) -> DataFrame:
    """``kind, source_id, other_id``: star records near each source and sky fields around it.

    A source counts if any of its rows does; each triple comes out once. Rows without a
    possible position are left out.
    """
    sources, n = valid_sources(gaia), gaia.count()  # a count of whole rows comes from the files' footers
    places = star_positions(stars)
    near = radius_join(places, sources.withColumn("radius", F.lit(arcsec / 3600.0)), fit_pivots(places, sources, stars.count(), n))
    inside = inside_regions(sources, fields, fit_pivots(sources, n=n))
    return (
        near.select(F.lit("near").alias("kind"), F.col("query_id").alias("source_id"), F.col("point_id").alias("other_id"))
        .unionByName(inside.select(F.lit("inside").alias("kind"), F.col("point_id").alias("source_id"), F.col("field_id").alias("other_id")))
        .distinct()
    )
