import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from skyframe.operators import spatial_join as sj

POINTS = "id long, ra double, dec double"


def brute(p, q):
    out = set()
    for d in q.itertuples():
        sep = np.degrees(sj.angle(sj.to_xyz(p.ra.to_numpy(), p.dec.to_numpy()), np.repeat(sj.to_xyz(np.array([d.ra]), np.array([d.dec])), len(p), 0)))
        out |= {(d.id, int(i)) for i in p.id[sep <= d.radius]}
    return out


@pytest.mark.parametrize("radius", [0.0004, 0.5, 40.0, 180.0])
def test_equals_brute_force_with_dense_patch_and_poles(spark, radius):
    rng = np.random.default_rng(3)
    n = 1500 if radius < 100 else 200
    ra, dec = rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))
    ra[: n // 3], dec[: n // 3] = 200 + rng.normal(0, 0.01, n // 3), 10 + rng.normal(0, 0.01, n // 3)
    dec[-5:], ra[-10:-5] = [90, -90, 89.9999, -89.9999, 90], [0, 359.9999, 0.0001, 360, 0]
    p = pd.DataFrame({"id": range(n), "ra": ra, "dec": dec})
    q = p.iloc[:: 7 if radius < 100 else 50].assign(ra=lambda d: (d.ra + 0.0002) % 360, radius=radius)
    got = sj.radius_join(spark.createDataFrame(p), spark.createDataFrame(q)).select("query_id", "point_id").distinct().collect()
    assert {tuple(r) for r in got} == brute(p, q)


def test_nulls_copies_and_clashing_columns(spark):
    p = spark.createDataFrame([(1, 10.0, 5.0, "x"), (1, 10.0, 5.0, "x"), (2, None, 5.0, "x"), (3, float("nan"), 1.0, "x"), (None, 10.0, 5.0, "x")], POINTS + ", cell string")
    d = spark.createDataFrame([(7, 10.0, 5.0, 0.1), (8, 10.0, 5.0, None), (9, None, 5.0, 1.0)], POINTS + ", radius double")
    assert [tuple(r) for r in sj.radius_join(p, d).select("query_id", "point_id").collect()] == [(7, 1)]


def test_many_copies_of_one_place_are_whole(spark):
    p = spark.range(4000).selectExpr("id", "120.0D ra", "-30.0D dec")
    d = spark.createDataFrame([(1, 120.0, -30.0, 0.001)], POINTS + ", radius double")
    assert sj.radius_join(p, d).count() == 4000


def test_empty_inputs(spark):
    p, d = spark.createDataFrame([], POINTS), spark.createDataFrame([], POINTS + ", radius double")
    assert sj.radius_join(p, d).count() == 0
    assert sj.radius_join(spark.createDataFrame([(1, 1.0, 1.0)], POINTS), d).count() == 0


def test_boxes_across_zero_and_inclusive_borders(spark):
    f = spark.createDataFrame([(1, "box", None, None, None, 350.0, 10.0, -5.0, 5.0), (2, "cone", 0.0, 90.0, 1.0, None, None, None, None)], "field_id long, shape string, ra_deg double, dec_deg double, radius_deg double, ra_min double, ra_max double, dec_min double, dec_max double")
    p = spark.createDataFrame([(1, 350.0, 5.0), (2, 10.0, -5.0), (3, 10.001, 0.0), (4, 0.0, 0.0), (5, 77.0, 89.0), (6, 77.0, 88.99)], POINTS)
    assert {tuple(r) for r in sj.inside_regions(p, f).collect()} == {(1, 1), (1, 2), (1, 4), (2, 5)}


def test_right_ascension_is_taken_modulo_360(spark):
    g = spark.createDataFrame([(1, 370.0, 0.0), (2, -10.0, 0.0), (3, 10.0, 91.0), (4, float("inf"), 0.0)], "source_id long, ra double, dec double")
    assert sorted((r["id"], r["ra"]) for r in sj.valid_sources(g).collect()) == [(1, 10.0), (2, 350.0)]


def test_hot_points_and_hot_discs_of_one_cell_are_split(spark, monkeypatch):
    monkeypatch.setattr(sj, "PART_ROWS", 100)
    rng = np.random.default_rng(5)
    p = pd.DataFrame({"id": range(3000), "ra": 120.0, "dec": -30.0})
    p.loc[2000:, "ra"] = rng.uniform(0, 360, 1000)
    q = pd.DataFrame({"id": range(1500), "ra": 120.0, "dec": -30.0 + rng.uniform(-2e-3, 2e-3, 1500), "radius": 0.001})
    points, discs = spark.createDataFrame(p), spark.createDataFrame(q)
    pivots = sj.fit_pivots(points, discs)
    assert pivots.parts.max() >= 10 and pivots.disc_parts.max() >= 10
    got = [tuple(r) for r in sj.radius_join(points, discs, pivots).select("query_id", "point_id").collect()]
    assert len(got) == len(set(got)) and set(got) == brute(p, q)


def test_more_than_five_thousand_cells(spark):
    rng = np.random.default_rng(6)
    n = 9000
    p = pd.DataFrame({"id": range(n), "ra": rng.uniform(0, 360, n), "dec": np.degrees(np.arcsin(rng.uniform(-1, 1, n)))})
    q = p.iloc[::9].assign(radius=1.0)
    points = spark.createDataFrame(p)
    pivots = sj.fit_pivots(points, rows_per_cell=1)
    assert len(pivots.parts) > 5000
    cells = next(sj._ship(pivots, 0)(iter([pa.RecordBatch.from_pandas(p.assign(radius=0.0), preserve_index=False)])))
    tables = list(sj._whole_cells(iter(pa.Table.from_batches([cells]).sort_by([("cell", "ascending"), ("part", "ascending")]).to_batches(500))))
    keys = [set(sj._key(t).tolist()) for t in tables]
    assert sum(map(len, keys)) == len(set().union(*keys))
    got = {tuple(r) for r in sj.radius_join(points, spark.createDataFrame(q), pivots).select("query_id", "point_id").collect()}
    assert got == brute(p, q)


def test_neighbour_counts(spark):
    rng = np.random.default_rng(8)
    p = pd.DataFrame({"id": range(400), "ra": rng.uniform(0, 3, 400), "dec": rng.uniform(-1, 2, 400)})
    pairs = brute(p, p.assign(radius=0.2))
    want = pd.Series([a for a, b in pairs if a != b]).value_counts().to_dict()
    assert {r["query_id"]: r["n"] for r in sj.neighbour_counts(spark.createDataFrame(p), 0.2).collect()} == want
