"""Exact ranks of very large groups: sorted range partitions with offsets, never a group in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut, shuffle_width


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` in range partitions, sorted and materialised, with ``__id`` ascending and dense within a partition."""
    width = shuffle_width(df.sparkSession)
    placed = cut(df.repartitionByRange(width, *order).sortWithinPartitions(*order))
    return placed.withColumn("__id", F.monotonically_increasing_id())


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Add ``name``, the place of each row in this order, from 0; ``order`` must tell all rows apart.

    The only window is over one row per partition.
    """
    rows = _sorted(df, order).withColumn("__part", F.shiftright("__id", 33))
    per = rows.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__least"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    first = per.select("__part", "__least", F.coalesce(before, F.lit(0)).alias("__before"))  # one row per partition
    got = rows.join(F.broadcast(first), "__part")
    return got.withColumn(name, F.col("__before") + F.col("__id") - F.col("__least")).drop("__id", "__part", "__n", "__least", "__before")


def values_at(df: DataFrame, keys: list[str], value: str, wanted: Column, name: str = "i") -> DataFrame:
    """``keys, n, name, rank, value``: the values at given ranks of each key, counted from 0 in ascending order.

    ``wanted`` is an array of structs (``i``, ``rank``) in terms of a column ``n``, the number
    of values of the key. Nulls and NaN have no rank; keys may be null. The rows of a key are
    spread over as many sorted partitions as they fill, and only counts per key and partition
    are put together, so one key may hold any part of the rows.
    """
    v = F.col(value)
    rows = _sorted(df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).select(*keys, value), [*keys, value]).withColumn("__part", F.shiftright("__id", 33))
    per = rows.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"), F.min("__id").alias("__least"))
    w = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = per.withColumn("n", F.sum("__n").over(w)).withColumn("__before", before)
    asked = spans.withColumn("__w", F.explode(F.filter(wanted, lambda x: (x["rank"] >= F.col("__before")) & (x["rank"] < F.col("__before") + F.col("__n")))))
    asked = asked.select(*keys, "n", F.col("__w.i").alias(name), F.col("__w.rank").alias("rank"), (F.col("__least") + F.col("__w.rank") - F.col("__before")).alias("__id"))
    return asked.join(rows.select("__id", value), "__id").drop("__id")


def percentiles(df: DataFrame, keys: list[str], value: str, wanted: list[float]) -> DataFrame:
    """``keys, p``: an array of the percentiles, interpolated linearly between ranks; keys without values have no row."""
    at = lambda p: F.col("n").cast("double").__sub__(1) * p
    pairs = [F.struct(F.lit(2 * k + up).alias("i"), (F.ceil(at(p)) if up else F.floor(at(p))).alias("rank")) for k, p in enumerate(wanted) for up in (0, 1)]
    got = values_at(df, keys, value, F.array(*pairs))
    pick = lambda i: F.max(F.when(F.col("i") == i, F.col(value)))
    one = got.groupBy(*keys).agg(F.max("n").alias("n"), *[pick(i).alias(f"__v{i}") for i in range(2 * len(wanted))])
    mix = [F.col(f"__v{2 * k}") + (F.col(f"__v{2 * k + 1}") - F.col(f"__v{2 * k}")) * (at(p) - F.floor(at(p))) for k, p in enumerate(wanted)]
    return one.select(*keys, F.array(*mix).alias("p"))


#: Values of a key that are sorted together, values of a packed run, and bits of a number that one pass of :func:`values_of_runs` settles.
SORTED_AT_ONCE, RUN, BITS = 1 << 20, 1 << 16, 14
_TOP = 1 << 63


def _numbers(v: np.ndarray, digits: int | None) -> np.ndarray:
    """Integers in the order of finite or infinite values: their own bits, or whole numbers of 10^-digits as ``sphere.micro`` rounds them."""
    if digits is not None:
        v = v * float(10**digits)
        whole = np.trunc(v)
        return (whole + np.where(np.abs(v - whole) >= 0.5, np.sign(v), 0.0)).astype(np.int64)
    bits = (v + 0.0).view(np.int64)  # one zero
    return bits ^ ((bits >> 63) & (_TOP - 1))


def _value(number: int, digits: int | None) -> float:
    if digits is not None:
        return float(number)
    return float(np.array([number ^ (_TOP - 1) if number < 0 else number], np.int64).view(float)[0])


def _pack(numbers: np.ndarray) -> bytes:
    """Steps between sorted numbers as zstd of their bytes, all first bytes before all second ones."""
    steps = np.diff(numbers.view(np.uint64), prepend=numbers.view(np.uint64)[:1])
    return pa.compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T), codec="zstd", asbytes=True)


def _unpack(packed: bytes, n: int, first: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, 8 * n, codec="zstd"), np.uint8).reshape(8, n)
    steps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(steps, dtype=np.uint64) + np.uint64(first % (1 << 64))


def runs_schema(fields: list[T.StructField]) -> T.StructType:
    return T.StructType([*fields, *[T.StructField(c, T.LongType()) for c in ("axis", "n", "first", "last")], T.StructField("packed", T.BinaryType())])


def packed_runs(batches, keys: list[str], column: str, digits: int | None = None):
    """Batches of sorted, packed runs (:func:`runs_schema`) of the values of an array column, each place in the array an axis of its own.

    A run holds values of one key and axis, about as many as are sorted at once by :data:`RUN`; nulls
    and NaN are left out. Arrays must be equally long. With ``digits`` values are rounded first.
    """

    def flush(held):
        t = pa.Table.from_batches(held)
        lists = t.column(column).combine_chunks()
        rows = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
        if not len(rows):
            return
        v = lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
        group = np.zeros(len(rows), np.int64)
        for k in keys:
            c = t.column(k).combine_chunks().take(pa.array(rows)).dictionary_encode(null_encoding="encode")
            group = np.unique(group * (len(c.dictionary) + 1) + c.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1]
        order = np.argsort(group, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            key = t.select(keys).slice(int(rows[part[0]]), 1)
            for axis in range(v.shape[1]):
                own = v[part, axis]
                numbers = np.sort(_numbers(own[~np.isnan(own)], digits))
                for run in (numbers[a : a + RUN] for a in range(0, len(numbers), RUN)):
                    yield pa.RecordBatch.from_arrays(
                        [*[key.column(k).combine_chunks() for k in keys], *[pa.array([int(x)], pa.int64()) for x in (axis, len(run), run[0], run[-1])], pa.array([_pack(run)], pa.binary())], names=[*keys, "axis", "n", "first", "last", "packed"]
                    )

    held, n = [], 0
    for b in batches:
        held.append(b.select([*keys, column]))
        n += b.num_rows
        if n >= SORTED_AT_ONCE:
            yield from flush(held)
            held, n = [], 0
    if held:
        yield from flush(held)


def values_of_runs(runs: DataFrame, keys: list[str], wanted, digits: int | None = None) -> DataFrame:
    """``keys, axis, n, i, rank, value``: the values at the ranks ``wanted(n)``, a list, of each key and axis of packed runs.

    The runs are read a few times (two for eight digits, five for doubles as they are) and nothing
    of them is shuffled but counts: each pass counts the values by the next :data:`BITS` bits of
    their distance from the least, only within the spans that hold a wanted rank, and so at last
    finds the values themselves, however many values lie close together. Keys must be few.
    """
    spark, schema = runs.sparkSession, runs.schema
    found = runs.groupBy(*keys, "axis").agg(F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last")).collect()
    group = {(*[r[k] for k in keys], r["axis"]): g for g, r in enumerate(found)}
    least = [r["first"] for r in found]
    before = max([1, *((r["last"] - r["first"]).bit_length() for r in found)])
    asked = [(g, 0, i, rank) for g, r in enumerate(found) for i, rank in enumerate(wanted(r["n"]))]
    while before:
        after = max(0, before - BITS)
        spans = {g: np.unique(np.array([a[1] for a in asked if a[0] == g], np.uint64)) for g in range(len(found))}

        def count(batches, before=before, after=after, spans=spans):
            held, size = {}, 0

            def merge():
                for g, parts in held.items():
                    at, back = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                    held[g] = [(at, np.bincount(back, np.concatenate([p[1] for p in parts])).astype(np.int64))]

            for t in batches:
                for row in (t.slice(k, 1).to_pylist()[0] for k in range(t.num_rows)):
                    g = group[(*[row[k] for k in keys], row["axis"])]
                    # of 64 bits none is left of the first span
                    span_of = lambda u: u >> np.uint64(before) if before < 64 else u * np.uint64(0)
                    ends = span_of(np.array([row["first"] - least[g], row["last"] - least[g]], np.uint64))
                    lo, hi = np.searchsorted(spans[g], ends[0]), np.searchsorted(spans[g], ends[1], side="right")
                    if lo == hi:
                        continue
                    u = _unpack(row["packed"], row["n"], row["first"] - least[g])
                    place = np.searchsorted(spans[g], span_of(u)).clip(max=len(spans[g]) - 1)
                    at = u[spans[g][place] == span_of(u)] >> np.uint64(after)
                    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(at)), bool), at[1:] != at[:-1]]))
                    held.setdefault(g, []).append((at[new], np.diff(new, append=len(at))))
                    size += len(new)
                    if size > 1 << 21:
                        merge()
                        size = 0
            merge()
            for g, [(at, n)] in held.items():
                yield from pa.table({"g": np.full(len(at), g), "span": (at >> np.uint64(before - after)).view(np.int64), "at": at.view(np.int64), "n": n}).to_batches(1 << 14)

        counts = runs.mapInArrow(count, "g long, span long, at long, n long").groupBy("g", "span", "at").agg(F.sum("n").alias("n"))
        below = F.sum("n").over(Window.partitionBy("g", "span").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
        few = F.broadcast(spark.createDataFrame([(g, s - (1 << 64) if s >= _TOP else s, i, rank) for g, s, i, rank in asked], "g long, span long, i long, rank long"))
        hit = counts.withColumn("below", below).join(few, ["g", "span"]).where((F.col("rank") >= F.col("below")) & (F.col("rank") < F.col("below") + F.col("n")))
        asked = [(r["g"], r["at"] % (1 << 64), r["i"], r["rank"] - r["below"]) for r in hit.select("g", "at", "i", "rank", "below").collect()]
        before = after
    ranks = {g: wanted(r["n"]) for g, r in enumerate(found)}
    rows = [(*[found[g][k] for k in keys], found[g]["axis"], found[g]["n"], i, ranks[g][i], _value(u + least[g], digits)) for g, u, i, _ in asked]
    long = [T.StructField(c, T.LongType()) for c in ("axis", "n", "i", "rank")]
    return spark.createDataFrame(rows, T.StructType([*[schema[k] for k in keys], *long, T.StructField("value", T.DoubleType())]))
