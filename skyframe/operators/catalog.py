"""Star catalogues: clustered tables, disc queries, brightest and stratified selections."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import codec, healpix, sphere
from ..session import narrow_batches, shuffle_width
from . import ranks


def row_filter(df: DataFrame, max_mag: float, min_dec: float = -90.0, max_dec: float = 90.0) -> DataFrame:
    """Rows with ``mag <= max_mag`` and a declination in the range, all inclusive; null and NaN fail."""
    if not (math.isfinite(max_mag) and -90 <= min_dec <= max_dec <= 90):
        raise ValueError("need a finite magnitude and -90 <= min_dec <= max_dec <= 90")
    mag = F.col("mag")
    return df.where((mag <= max_mag) & ~F.isnan(mag) & F.col("dec").between(min_dec, max_dec))


def finite(*names: str) -> Column:
    """Whether all of these columns are finite; null is not."""
    ok = F.lit(True)
    for n in names:
        v = F.col(n).cast("double")
        ok = ok & F.coalesce(F.abs(v) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(v, F.lit(0.0)))
    return ok


def build_stats(df: DataFrame) -> DataFrame:
    """One row: how many stars would be written, clamped and skipped."""
    ok = finite("ra", "dec", "mag")
    packed = codec.pack_star(df.withColumn("__ok", ok))
    return packed.agg(F.count_if("__ok").alias("written"), F.count_if(F.col("__ok") & F.col("clamped")).alias("clamped"), F.count_if(~F.col("__ok")).alias("skipped"))


def build_star_index(df: DataFrame, nside: int = 64) -> DataFrame:
    """Packed stars with their cell, clustered by cell and brightest first within it.

    Range partitions follow the density of the sky, so the write is balanced and a reader's
    cell predicate prunes whole files and row groups. Rows without a finite position and
    magnitude are left out; equal magnitudes are ordered by ``source_id``.
    """
    stars = codec.pack_star(healpix.with_cell(df.where(finite("ra", "dec", "mag")), nside))
    return stars.repartitionByRange("cell", "mag_milli").sortWithinPartitions("cell", "mag_milli", "source_id")


def index_meta(index: DataFrame, nside: int, epoch: float, name: str) -> DataFrame:
    """The one-row header of an index with an order-free fingerprint of its records."""
    row = F.xxhash64("cell", "ra_scaled", "dec_scaled", "mag_milli", "pmra_mas", "pmdec_mas")
    return index.agg(F.count(F.lit(1)).alias("n_stars"), F.max("mag_milli").alias("mag_limit_milli"), F.bit_xor(row).alias("fingerprint")).select(
        F.lit(name).alias("name"), F.lit(1).alias("version"), F.lit(nside).alias("nside"), F.lit(epoch).alias("epoch"), "n_stars", "mag_limit_milli", "fingerprint"
    )


def cell_histogram(stars: DataFrame) -> DataFrame:
    return stars.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


#: Cells of a block, within which offsets are summed; the blocks are summed on their own.
BLOCK_CELLS = 4096


def cell_offsets(stars: DataFrame, nside: int) -> DataFrame:
    """Every cell with the number of stars before and up to it, as a prefix table.

    The sums run over blocks of cells in parallel and over the blocks' totals (at most 49,152), so
    no task has all cells, let alone stars.
    """
    every = stars.sparkSession.range(healpix.cells(nside)).withColumnRenamed("id", "cell")
    counted = every.join(cell_histogram(stars), "cell", "left").select("cell", F.coalesce("n", F.lit(0)).alias("n")).withColumn("block", F.floor(F.col("cell") / BLOCK_CELLS))
    inside = F.sum("n").over(Window.partitionBy("block").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("total").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = counted.groupBy("block").agg(F.sum("n").alias("total")).select("block", F.coalesce(before, F.lit(0)).alias("before"))
    got = counted.withColumn("inside", inside).join(blocks, "block").withColumn("next", F.col("before") + F.col("inside"))
    return got.select("cell", "n", (F.col("next") - F.col("n")).alias("first"), "next")


def offsets_monotone(offsets: DataFrame) -> DataFrame:
    """One row: how many entries of a prefix table fall below their predecessor, and its end."""
    blocks = offsets.select("cell", "next", F.floor(F.col("cell") / BLOCK_CELLS).alias("block"))
    before = F.lag("next").over(Window.partitionBy("block").orderBy("cell"))
    per = blocks.withColumn("falls", F.col("next") < before).groupBy("block").agg(
        F.count_if("falls").alias("falls"), F.min_by("next", "cell").alias("low"), F.max_by("next", "cell").alias("high"), F.max("next").alias("most")
    )
    last = F.lag("high").over(Window.orderBy("block"))
    return per.withColumn("step", F.col("low") < last).agg((F.sum("falls") + F.count_if("step")).alias("falls"), F.max("most").alias("n_stars"))


def index_info(stars: DataFrame) -> DataFrame:
    per = cell_histogram(stars)
    return per.agg(F.count(F.lit(1)).alias("occupied"), F.sum("n").alias("n_stars"), F.max("n").alias("max_per_cell"), F.round(F.avg("n") * 1000).cast("long").alias("mean_milli"))


#: Discs whose covers are computed together, and about how many cells these may have.
DISCS_AT_ONCE, CELLS_AT_ONCE = 4096, 1 << 20
#: Pairs of a star and a disc that one task of the cone join is to test.
PAIRS_PER_PART = 1 << 20
#: Cells of which a table may be sent to all tasks: those of nside 256 (12 MB).
MOST_CELLS = 12 * 256 * 256


def disc_cells(discs: DataFrame, nside: int) -> DataFrame:
    """Cells that may hold points of each disc, one row per (disc, cell); a padded superset.

    ``discs`` has ``disc_id, ra0, dec0, radius``, which the rows keep. Covers are computed in
    numpy for many discs at once, down the levels of the nested scheme.
    """

    def cover(batches):
        for t in narrow_batches(batches, DISCS_AT_ONCE):
            ra, dec, radius = (t.column(c).to_numpy() for c in ("ra0", "dec0", "radius"))
            wide = np.radians(np.minimum(180.0, radius + healpix.cell_radius(nside)))
            load = np.cumsum(1 + healpix.cells(nside) * (1 - np.cos(wide)) / 2) // CELLS_AT_ONCE
            for part in np.split(np.arange(len(ra)), np.flatnonzero(np.diff(load)) + 1):
                at, cell = healpix.cells_in_discs(nside, ra[part], dec[part], radius[part])
                yield from t.take(pa.array(part[at])).append_column("cell", pa.array(cell)).to_batches(1 << 16)

    usable = discs.where(finite("ra0", "dec0", "radius") & (F.col("radius") >= 0))
    usable = usable.select("disc_id", *[F.col(c).cast("double").alias(c) for c in ("ra0", "dec0", "radius")])
    return usable.mapInArrow(cover, T.StructType([*usable.schema.fields, T.StructField("cell", T.LongType())]))


def cone_search(stars: DataFrame, discs: DataFrame, nside: int = 64) -> DataFrame:
    """Stars within each disc: equi-join on the cell, then the exact distance.

    ``stars`` has ``star_id, cell, ra, dec, mag_milli``. The join never compares a disc with
    stars outside its cover. Cells with many stars and many discs are split: their stars are
    dealt to as many parts as the pairs demand, to each of which the discs go. Both borders and
    poles are exact. Adds ``sep`` in degrees. Empty inputs give an empty result.
    """
    cover = disc_cells(discs, nside)
    width = shuffle_width(stars.sparkSession)
    per = cell_histogram(stars).join(cover.groupBy("cell").agg(F.count(F.lit(1)).alias("discs")), "cell")
    hot = per.select("cell", F.ceil(F.col("n") * F.col("discs") / PAIRS_PER_PART).cast("int").alias("parts")).where(F.col("parts") > 1)
    hot = F.broadcast(hot) if healpix.cells(nside) <= MOST_CELLS else hot
    parts = F.coalesce("parts", F.lit(1))
    left = stars.join(hot, "cell", "left").withColumn("part", F.pmod(F.xxhash64("star_id"), parts).cast("int")).drop("parts")
    right = cover.join(hot, "cell", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    # a number of partitions that is asked for is not put together: the work is in the pairs, not in the bytes
    near = left.repartition(width, "cell", "part").join(right.repartition(width, "cell", "part"), ["cell", "part"]).drop("part")
    sep = sphere.separation(F.col("ra0"), F.col("dec0"), F.col("ra"), F.col("dec"))
    return near.where(F.abs(F.col("dec") - F.col("dec0")) <= F.col("radius") + 1e-9).withColumn("sep", sep).where(F.col("sep") <= F.col("radius"))


BRIGHTEST = ["mag_milli", "cell", "star_id"]


def brightest(cone: DataFrame, k: int | Column, bound: int | None = None) -> DataFrame:
    """The k brightest stars of each disc; ties by cell, then star. The limit is pushed below the shuffle.

    A column k is each disc's own limit; then a ``bound`` that no limit exceeds is what is pushed.
    """
    order = F.row_number().over(Window.partitionBy("disc_id").orderBy(*BRIGHTEST))
    return cone.withColumn("rank", order).where(F.col("rank") <= (k if bound is None else bound)).where(F.col("rank") <= k)


def stratified(cone: DataFrame, k: int | Column, bound: int | None = None) -> DataFrame:
    """k stars of each disc taken in rounds, the brightest unused star of every cell per round.

    The first window keeps at most k stars of a cell before the second one orders the rounds.
    The result is ranked by magnitude.
    """
    rnd = F.row_number().over(Window.partitionBy("disc_id", "cell").orderBy("mag_milli", "star_id"))
    turn = F.row_number().over(Window.partitionBy("disc_id").orderBy("round", "cell"))
    taken = cone.withColumn("round", rnd).where(F.col("round") <= (k if bound is None else bound)).where(F.col("round") <= k).withColumn("turn", turn).where(F.col("turn") <= k)
    return taken.withColumn("rank", F.row_number().over(Window.partitionBy("disc_id").orderBy(*BRIGHTEST))).drop("round", "turn")


def index_order(cone: DataFrame) -> DataFrame:
    """All stars of each disc numbered in index order (cell, magnitude).

    A star's place is its place in its cell and disc, after all stars of the disc's earlier
    cells: only counts per cell pass through one task per disc.
    """
    place = F.row_number().over(Window.partitionBy("disc_id", "cell").orderBy("mag_milli", "star_id"))
    before = F.sum("__n").over(Window.partitionBy("disc_id").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    first = cone.groupBy("disc_id", "cell").agg(F.count(F.lit(1)).alias("__n")).select("disc_id", "cell", F.coalesce(before, F.lit(0)).alias("__first"))
    return cone.withColumn("__in", place).join(first, ["disc_id", "cell"]).withColumn("place", F.col("__first") + F.col("__in")).drop("__in", "__first")


def concentration(selected: DataFrame, nside: int = 64) -> DataFrame:
    """How much of a disc's selection its busiest cell holds, against an even share.

    ``selected`` has ``disc_id, radius, cell``. ``meaningful`` tells whether there are at least
    as many stars as cells.
    """
    per = selected.groupBy("disc_id", "radius", "cell").agg(F.count(F.lit(1)).alias("n"))
    one = 4 * math.pi / healpix.cells(nside)
    cover = F.greatest(F.lit(1.0), 2 * math.pi * (1.0 - F.cos(F.radians("radius"))) / one)
    total = per.groupBy("disc_id", "radius").agg(F.sum("n").alias("n"), F.max("n").alias("busiest")).withColumn("cells", cover)
    return total.select("disc_id", "n", "busiest", (F.col("busiest") / (F.col("n") / F.col("cells"))).alias("concentration"), (F.col("n") >= F.col("cells")).alias("meaningful"))


def select_catalogue(cone: DataFrame, limit: int | Column, nside: int = 64, threshold: float = 2.0, max_mag: float | None = None, bound: int | None = None) -> DataFrame:
    """Brightest stars of each disc, or a stratified choice where those crowd into few cells.

    ``limit`` may be a column of the cone with each disc's own limit, none above ``bound``.

    The magnitude cap applies after the limit and before the concentration is taken, as the
    selection's definition demands, so a cap can change which choice is made.
    """
    cap = F.lit(True) if max_mag is None else F.col("mag_milli") <= int(max(-32768, min(32767, max_mag * 1000)))
    top = brightest(cone, limit, bound).where(cap)
    crowded = concentration(top, nside).where(F.col("meaningful") & (F.col("concentration") >= threshold)).select("disc_id")
    plain = top.join(crowded, "disc_id", "left_anti").withColumn("stratified", F.lit(False))
    spread = stratified(cone.join(crowded, "disc_id", "left_semi"), limit, bound).where(cap).withColumn("stratified", F.lit(True))
    return plain.unionByName(spread)


def global_order(stars: DataFrame) -> DataFrame:
    """Add ``global_idx``, a star's place in the whole index (cell, magnitude, star), from 0.

    The stars are sorted in range partitions, which split a hot cell, and a partition's first
    place is the number of stars before it.
    """
    return ranks.numbered(stars, ["cell", "mag_milli", "star_id"], "global_idx")


def star_at(indexed: DataFrame, wanted: DataFrame) -> DataFrame:
    """Patterns whose stars all exist: ``quad_id, k, global_idx`` joined with the stars."""
    got = wanted.join(indexed, "global_idx")
    whole = got.groupBy("quad_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == 4).select("quad_id")
    return got.join(whole, "quad_id", "left_semi")


def set_difference(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that only one of two selections has, with ``side`` (a or b): none if they are the same set.

    Compares selections of different depth or order by their stars, e.g. all stars of a disc
    with the brightest k for a k beyond their number. Repeated rows count once; nulls are equal.
    """
    both = a.select(*columns, F.lit(1).alias("__a"), F.lit(0).alias("__b")).unionByName(b.select(*columns, F.lit(0).alias("__a"), F.lit(1).alias("__b")))
    tally = both.groupBy(*columns).agg(F.max("__a").alias("__a"), F.max("__b").alias("__b")).where("__a <> __b")
    return tally.select(*columns, F.when(F.col("__a") == 1, "a").otherwise("b").alias("side"))


def assert_compatible(star_meta: DataFrame, quad_meta: DataFrame) -> None:
    """Refuse a pattern index that was built from another star index."""
    a, b = star_meta.select("fingerprint").first(), quad_meta.select("star_fingerprint").first()
    if a is None or b is None or a[0] != b[0]:
        raise ValueError("the pattern index was not built from this star index")


def write_index(index: DataFrame, meta: DataFrame, path: str) -> None:
    index.write.mode("errorifexists").parquet(f"{path}/stars")
    meta.write.mode("errorifexists").parquet(f"{path}/meta")


def open_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stars and header of a written index; refuses an unknown version or a wrong star count."""
    stars, meta = spark.read.parquet(f"{path}/stars"), spark.read.parquet(f"{path}/meta")
    head = meta.first()
    if head is None or head["version"] != 1:
        raise ValueError("unknown index version")
    healpix.order_of(head["nside"])
    if stars.count() != head["n_stars"]:
        raise ValueError("the index is truncated")
    return stars, meta


def verify_index(stars: DataFrame, meta: DataFrame) -> bool:
    """Whether the records still have the fingerprint of the header; reads the whole table."""
    head = meta.first()
    return index_meta(stars, head["nside"], head["epoch"], head["name"]).first()["fingerprint"] == head["fingerprint"]
