import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyframe import session
from skyframe.functions import healpix, sphere
from skyframe.operators import catalog, geometry, image, joins, quads, ranks, report


def test_percentiles_of_hot_null_and_tied_groups(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": np.where(rng.uniform(size=3000) < 0.9, "hot", None), "v": np.round(rng.normal(size=3000), 1)})
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, v double").union(spark.createDataFrame([("hot", None), ("hot", float("nan")), ("none", None)], "g string, v double"))
    got = {r["g"]: r["p"] for r in ranks.percentiles(df, ["g"], "v", [0.0, 0.5, 0.99, 1.0]).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        assert np.allclose(got[g if isinstance(g, str) else None], np.quantile(part.v, [0.0, 0.5, 0.99, 1.0]))
    assert set(got) == {"hot", None}


def test_numbering_is_dense(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("a"), F.col("id").alias("b"))
    got = [(r["a"], r["b"]) for r in ranks.numbered(df, ["a", "b"], "at").orderBy("at").collect()]
    assert got == sorted(got) and sorted(r["at"] for r in ranks.numbered(df, ["a", "b"], "at").collect()) == list(range(1000))
    assert ranks.numbered(df.limit(0), ["a", "b"], "at").count() == 0


def test_whole_groups_over_batch_borders():
    t = pa.table({"k": pa.array([None, None, 1, 1, 1, 2, 2, 3, 3, 3]), "v": list(range(10))})
    for rows in (1, 2, 3, 100):
        got = [x for part, starts in session.whole_groups(iter(t.to_batches(2)), ["k"], rows) for x in np.split(part.column("v").to_numpy(), starts[1:])]
        assert [g.tolist() for g in got] == [[0, 1], [2, 3, 4], [5, 6], [7, 8, 9]]


def test_widest_pair_and_hull(spark):
    rng = np.random.default_rng(2)
    p = pd.DataFrame({"g": rng.integers(0, 5, 600), "x": np.round(rng.normal(size=600), 1), "y": np.round(rng.normal(size=600), 1)})
    df = spark.createDataFrame(p).union(spark.createDataFrame([(9, 1.0, 1.0), (9, 1.0, 1.0), (8, None, 2.0), (7, float("nan"), 0.0)], "g long, x double, y double"))
    got = {r["g"]: r["widest"] for r in joins.widest(df, ["g"]).collect()}
    for g, q in p.groupby("g"):
        z = q.x.to_numpy() + 1j * q.y.to_numpy()
        assert abs(got[g] - np.abs(z[:, None] - z).max()) < 1e-12
    assert got[9] == 0.0 and 8 not in got and 7 not in got
    line = np.arange(10.0)
    assert sorted(geometry.hull(line, 2 * line)) == [0, 9]


def test_nearest_breaks_ties_by_number():
    g = np.arange(16)
    x, y = (g % 4).astype(float), (g // 4).astype(float)
    d2 = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2
    np.fill_diagonal(d2, np.inf)
    assert (geometry.nearest(x, y, 5) == np.argsort(d2, axis=1, kind="stable")[:, :5]).all()


def test_labels_of_components(spark):
    px = [(1, 0, 0), (1, 1, 1), (1, 5, 5), (2, 3, 3), (2, 3, 4), (2, 9, 9)]
    got = {(r["k"], r["y"], r["x"]): r["label"] for r in image.labelled(spark.createDataFrame(px, "k long, y int, x int"), "k").collect()}
    at = lambda y, x: y << 32 | x
    assert got == {(1, 0, 0): 0, (1, 1, 1): 0, (1, 5, 5): at(5, 5), (2, 3, 3): at(3, 3), (2, 3, 4): at(3, 3), (2, 9, 9): at(9, 9)}


def test_covers_against_all_cells():
    rng = np.random.default_rng(3)
    ra, dec, radius = rng.uniform(0, 360, 60), np.degrees(np.arcsin(rng.uniform(-1, 1, 60))), rng.choice([0.0, 0.5, 20.0, 180.0], 60)
    disc, cell = healpix.cells_in_discs(16, ra, dec, radius)
    at = healpix._vectors(*healpix.centres(16))
    for i in range(60):
        near = at @ healpix._vectors(ra[i : i + 1], dec[i : i + 1])[0] >= np.cos(np.radians(min(180, radius[i] + healpix.cell_radius(16)))) - 1e-12
        assert cell[disc == i].tolist() == np.flatnonzero(near).tolist()


def test_a_hot_cell_is_split(spark, monkeypatch):
    monkeypatch.setattr(catalog, "PAIRS_PER_PART", 50)
    stars = healpix.with_cell(spark.range(300).selectExpr("id star_id", "100D + id / 1000D ra", "10D dec", "cast(id as int) mag_milli"), 64)
    discs = spark.range(40).selectExpr("id disc_id", "100D + id / 100D ra0", "10D dec0", "0.05D radius")
    got = {(r["disc_id"], r["star_id"]) for r in catalog.cone_search(stars, discs).collect()}
    s, d = stars.toPandas(), discs.toPandas()
    want = {(int(k), int(i)) for k, r0 in zip(d.disc_id, d.ra0) for i, r in zip(s.star_id, s.ra) if abs(r - r0) * np.cos(np.radians(10)) <= 0.05 + 1e-6}
    assert got <= want and len(want - got) <= 80 and len(got) == catalog.cone_search(stars, discs).count()


def test_tiles_of_stars_against_all_tiles(spark):
    rng = np.random.default_rng(4)
    n = 400
    dec = np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    dec[:60], dec[60:80] = rng.uniform(84, 90, 60), [90, -90, 89.99, -89.99] * 5
    s = healpix.with_cell(spark.createDataFrame(pd.DataFrame({"star_id": range(n), "ra": rng.uniform(0, 360, n), "dec": dec, "mag_milli": rng.integers(0, 50, n)})), 64)
    got = {(r["tile_scale"], r["disc_id"], r["star_id"]) for r in quads.tile_points(s, [8.0, 1.0], budget=10**6).collect()}
    want = set()
    for scale in (8.0, 1.0):
        cone = catalog.cone_search(s, quads.tile_sweep(spark, scale))
        want |= {(scale, r["disc_id"], r["star_id"]) for r in cone.select("disc_id", "star_id").collect()}
    assert got == want and got


def test_patterns_of_many_sets_are_those_of_each():
    rng = np.random.default_rng(5)
    sizes = [0 + 1, 3, 4, 30, 7]
    x, y = rng.uniform(size=sum(sizes)), rng.uniform(size=sum(sizes))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for cap in (None, 5):
        idx, place, code, diag = quads.point_patterns(x, y, starts, 6, 40, cap)
        for a, n in zip(starts, sizes):
            mine = (idx[:, 0] >= a) & (idx[:, 0] < a + n)
            one = quads.point_patterns(x[a : a + n], y[a : a + n], np.array([0]), 6, 40, cap)
            assert (idx[mine] - a == one[0]).all() and (place[mine] == one[1]).all() and np.array_equal(code[mine], one[2])


def test_same_set_whatever_the_depth(spark):
    cone = spark.createDataFrame([(1, i, 10 - i, 5) for i in range(8)] + [(None, 1, 1, 5)] * 2, "disc_id long, star_id long, mag_milli int, cell long")
    assert catalog.set_difference(cone, catalog.brightest(cone, 1000), ["disc_id", "star_id"]).count() == 0
    short = catalog.set_difference(catalog.brightest(cone, 3), cone, ["disc_id", "star_id"]).collect()
    assert {(r["star_id"], r["side"]) for r in short} == {(i, "b") for i in range(5)}


@pytest.mark.parametrize("n", [7, 40, 199])
def test_allocation_gives_the_number_asked_for(spark, n):
    sizes = spark.createDataFrame([("a", 1), ("b", 3), (None, 150), ("d", 45), ("e", 1)], "s string, size long")
    got = {r["s"]: (r["size"], r["places"]) for r in report.allocation(sizes, ["s"], n).collect()}
    assert sum(p for _, p in got.values()) == n and all(1 <= p <= z for z, p in got.values())


def test_sample_names_what_it_leaves_out(spark):
    df = spark.range(100).selectExpr("id k", "id % 10 binning", "id * 1.0D dec")
    some = report.stratified_sample(df, ["binning"], "k", 20, "dec")
    assert some.count() == 20 and report.left_out(df, some, "binning").count() == 0
    few = report.stratified_sample(df, ["binning"], "k", 4, "dec")
    assert few.count() == 4 and report.left_out(df, few, "binning").count() == 6


def test_edges_of_codes_close_and_far_and_equal(spark):
    rng = np.random.default_rng(6)
    n = 3000
    v = np.stack([rng.normal(size=n), 0.3 + rng.integers(0, 9, n) * 1e-15, rng.integers(-2, 3, n) * 0.0, np.exp(rng.uniform(-600, 600, n)) * rng.choice([-1, 1], n)], axis=1)
    v[:3, 3], v[5, 0] = [np.inf, -np.inf, -np.finfo(float).max], np.nan
    band = [None if b == 2 else int(b) for b in rng.integers(0, 3, n)]
    rows = [(b, c) for b, c in zip(band, v.tolist())] + [(0, None), (7, [0.25, -0.0, 0.5, 1.0])]
    got = {(r["band"], r["axis"], r["i"]): r["edge"] for r in quads.quantile_edges(spark.createDataFrame(rows, "band int, code array<double>").repartition(5), ["band"]).collect()}
    for b in (0, 1, None, 7):
        for axis in range(4):
            own = np.sort([c[axis] for k, c in rows if k == b and c is not None and not np.isnan(c[axis])])
            assert [got.pop((b, axis, i)) for i in range(49)] == [own[i * (len(own) - 1) // 48] for i in range(49)]
    assert not got
    assert quads.quantile_edges(spark.createDataFrame([], "band int, code array<double>"), ["band"]).count() == 0


def test_packed_runs_hold_all_values_and_round_as_micro(spark, monkeypatch):
    monkeypatch.setattr(ranks, "SORTED_AT_ONCE", 100)
    monkeypatch.setattr(ranks, "RUN", 7)
    v = np.concatenate([np.random.default_rng(7).normal(size=250), [0.5, -0.5, 1.5, -1.5, 2.5, 0.49999999999999994]])
    t = pa.table({"code": pa.array(v.reshape(-1, 1).tolist(), pa.list_(pa.float64()))})
    for digits in (None, 0, 8):
        runs = [b.to_pylist()[0] for b in ranks.packed_runs(iter(t.to_batches(30)), [], "code", digits)]
        got = sorted(ranks._value(int(x), digits) for r in runs for x in ranks._unpack(r["packed"], r["n"], r["first"]).view(np.int64))
        want = v.tolist() if digits is None else [r[0] for r in spark.createDataFrame([(x,) for x in v.tolist()], "v double").select(sphere.micro(F.col("v"), digits)).collect()]
        assert got == sorted(want) and max(r["n"] for r in runs) <= 7


def test_edges_leave_few_bytes_of_each_code(spark, tmp_path):
    sc = spark.sparkContext
    session.checkpoint_dir(spark)
    former = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    try:
        codes = spark.range(100_000, numPartitions=4).select(F.lit(0).alias("band"), F.array(*[F.round(F.rand(i), 12) for i in range(4)]).alias("code"))
        assert quads.quantile_edges(codes, ["band"]).count() == 4 * 49
        assert sum(p.stat().st_size for p in tmp_path.rglob("*") if p.is_file()) < 8 * 400_000
    finally:
        sc._jsc.sc().setCheckpointDir(former)
