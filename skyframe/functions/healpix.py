"""Nested HEALPix cells: column expressions for many rows, numpy for covers of discs."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ring and longitude offsets of the twelve base faces (fixed values of the nested scheme).
FACE_RING = [2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]
FACE_LON = [1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7]


def order_of(nside: int) -> int:
    """log2 of a valid nside; raises for any other number."""
    if not (1 <= nside <= 4096 and nside & (nside - 1) == 0):
        raise ValueError(f"nside {nside} is not a power of two in 1..4096")
    return nside.bit_length() - 1


def cells(nside: int) -> int:
    order_of(nside)
    return 12 * nside * nside


def cell_radius(nside: int) -> float:
    """Upper bound, in degrees, of the distance from a cell's centre to its points: a cap of four cell areas."""
    area = 4 * math.pi / cells(nside)
    return math.degrees(math.acos(max(-1.0, 1.0 - 4 * area / (2 * math.pi))))


def _spread(v: Column) -> Column:
    """Bits of a number below 2^12 moved to the even places."""
    v = v.cast("long")
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def _gather(v: Column) -> Column:
    v = v.bitwiseAND(F.lit(0x55555555).cast("long"))
    for shift, mask in ((1, 0x33333333), (2, 0x0F0F0F0F), (4, 0x00FF00FF), (8, 0x0000FFFF)):
        v = v.bitwiseOR(F.shiftright(v, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return v


def with_cell(df: DataFrame, nside: int, ra: str = "ra", dec: str = "dec", out: str = "cell") -> DataFrame:
    """Add the nested cell of each position; null, NaN and infinite positions give null.

    The steps are separate projections, so that expressions stay small; Catalyst keeps them in
    one stage of generated code.
    """
    ns, order = float(nside), order_of(nside)
    c = lambda n: F.col(f"__{n}")
    long = lambda x: x.cast("long")  # noqa: E731  (truncates)
    known = lambda n: F.when(F.abs(F.col(n).cast("double")) < float("inf"), F.col(n))  # noqa: E731  (NaN compares as greater)
    turned = F.pmod(known(ra), F.lit(360.0))
    df = df.withColumn("__z", F.sin(F.radians(known(dec)))).withColumn("__t", F.radians(F.when(turned >= 360.0, F.lit(0.0)).otherwise(turned)) / (math.pi / 2))
    df = df.withColumn("__q", F.least(long(c("t")), F.lit(3))).withColumn("__m", ns * F.sqrt(F.greatest(3.0 * (1.0 - F.abs(c("z"))), F.lit(0.0)))).withColumn("__f", c("t") - c("q"))
    belt = F.abs(c("z")) <= 2.0 / 3.0
    up = long(ns * (0.5 + c("t")) - ns * c("z") * 0.75)
    down = long(ns * (0.5 + c("t")) + ns * c("z") * 0.75)
    df = df.withColumn("__a", F.when(belt, up).otherwise(F.least(long(c("f") * c("m")), F.lit(nside - 1))))
    df = df.withColumn("__b", F.when(belt, down).otherwise(F.least(long((1.0 - c("f")) * c("m")), F.lit(nside - 1))))
    df = df.withColumn("__belt", belt).withColumn("__fa", F.shiftright(c("a"), order)).withColumn("__fb", F.shiftright(c("b"), order))
    face = F.when(c("fa") == c("fb"), c("fa").bitwiseAND(F.lit(3)) + 4).when(c("fa") < c("fb"), c("fa").bitwiseAND(F.lit(3))).otherwise(c("fb").bitwiseAND(F.lit(3)) + 8)
    face = F.when(c("belt"), face).when(c("z") > 0, c("q")).otherwise(c("q") + 8)
    low = F.lit(nside - 1)
    x = F.when(c("belt"), c("b").bitwiseAND(low)).when(c("z") > 0, low - c("b")).otherwise(c("a"))
    y = F.when(c("belt"), low - c("a").bitwiseAND(low)).when(c("z") > 0, low - c("a")).otherwise(c("b"))
    df = df.withColumn(out, F.when(c("z").isNotNull() & c("t").isNotNull(), face * (nside * nside) + _spread(x) + F.shiftleft(_spread(y), 1)))
    return df.drop("__z", "__t", "__q", "__m", "__f", "__a", "__b", "__belt", "__fa", "__fb")


def with_centre(df: DataFrame, nside: int, cell: str = "cell", ra: str = "ra", dec: str = "dec") -> DataFrame:
    """Add the centre of each nested cell."""
    order = order_of(nside)
    c = lambda n: F.col(f"__{n}")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), c("face") + 1)
    df = df.withColumn("__face", F.shiftright(cell, 2 * order).cast("int")).withColumn("__in", F.col(cell).bitwiseAND(F.lit(nside * nside - 1).cast("long")))
    df = df.withColumn("__x", _gather(c("in"))).withColumn("__y", _gather(F.shiftright(c("in"), 1)))
    df = df.withColumn("__ring", pick(FACE_RING) * nside - c("x") - c("y") - 1)
    north, south = c("ring") < nside, c("ring") > 3 * nside
    df = df.withColumn("__n", F.when(north, c("ring")).when(south, 4 * nside - c("ring")).otherwise(F.lit(nside)))
    df = df.withColumn("__odd", F.when(north | south, F.lit(0)).otherwise((c("ring") - nside).bitwiseAND(F.lit(1))))
    df = df.withColumn("__l", F.floor((pick(FACE_LON) * c("n") + c("x") - c("y") + 1 + c("odd")) / F.lit(2)))
    part = c("n").cast("double") * c("n") / (3.0 * nside * nside)
    z = F.when(north, 1.0 - part).when(south, part - 1.0).otherwise((2 * nside - c("ring")) * 2.0 / (3.0 * nside))
    lon = F.when(c("l") > 4 * nside, c("l") - 4 * nside).when(c("l") < 1, c("l") + 4 * nside).otherwise(c("l"))
    df = df.withColumn(ra, F.pmod((lon - (c("odd").cast("double") + 1.0) * 0.5) * (90.0 / c("n")), F.lit(360.0))).withColumn(dec, F.degrees(F.asin(z)))
    return df.drop("__face", "__in", "__x", "__y", "__ring", "__n", "__odd", "__l")


def centres(nside: int, cell: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Centres of these cells (all of them by default), in numpy."""
    order = order_of(nside)
    cell = np.arange(cells(nside)) if cell is None else cell
    face, inside = cell >> (2 * order), cell & (nside * nside - 1)
    x, y = np.zeros(len(cell), np.int64), np.zeros(len(cell), np.int64)
    for b in range(order):
        x |= ((inside >> (2 * b)) & 1) << b
        y |= ((inside >> (2 * b + 1)) & 1) << b
    ring = np.array(FACE_RING)[face] * nside - x - y - 1
    north, south = ring < nside, ring > 3 * nside
    k = np.where(north, ring, np.where(south, 4 * nside - ring, nside))
    part = k * k / (3.0 * nside * nside)
    z = np.where(north, 1 - part, np.where(south, part - 1, (2 * nside - ring) * 2.0 / (3.0 * nside)))
    odd = np.where(north | south, 0, (ring - nside) & 1)
    lon = (np.array(FACE_LON)[face] * k + x - y + 1 + odd) // 2
    lon = np.where(lon > 4 * nside, lon - 4 * nside, np.where(lon < 1, lon + 4 * nside, lon))
    return ((lon - (odd + 1) * 0.5) * (90.0 / k)) % 360.0, np.degrees(np.arcsin(z))


def _vectors(ra: np.ndarray, dec: np.ndarray) -> np.ndarray:
    ra, dec = np.radians(ra), np.radians(dec)
    return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=1)


@lru_cache(maxsize=16)
def _centre_vectors(nside: int) -> np.ndarray:
    return _vectors(*centres(nside))


def cells_in_discs(nside: int, ra: np.ndarray, dec: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(disc, cell) for every cell that may hold points of each disc, ascending: a padded superset of the true cover.

    All discs walk down the levels of the nested scheme together: of a level's cells only the
    children of those that may touch the disc are looked at.
    """
    middle = _vectors(ra, dec)
    disc, cell = np.repeat(np.arange(len(ra)), 12), np.tile(np.arange(12), len(ra))
    for order in range(order_of(nside) + 1):
        here = 1 << order
        if order:
            disc, cell = np.repeat(disc, 4), (cell[:, None] * 4 + np.arange(4)).ravel()
        limit = np.radians(np.minimum(180.0, radius + cell_radius(here)))
        at = _centre_vectors(here)[cell] if here <= 64 else _vectors(*centres(here, cell))
        near = np.einsum("ij,ij->i", at, middle[disc]) >= np.cos(limit)[disc] - 1e-12
        disc, cell = disc[near], cell[near]
    order = np.lexsort((cell, disc))
    return disc[order], cell[order]


def cells_in_disc(nside: int, ra: float, dec: float, radius: float) -> list[int]:
    return cells_in_discs(nside, *(np.array([v], float) for v in (ra, dec, radius)))[1].tolist()
