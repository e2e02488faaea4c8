import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from skyframe.functions import healpix, sql
from skyframe.operators import catalog, plate, quads
from skyframe.plans import solve
from skyframe.session import cut
from skyframe.sources import fits, logs
from skyframe.sources import quad_files as qf


def stars(spark, n=400):
    rows = spark.range(n).selectExpr("id star_id", "cast((id * 7919) % 2000 as double) / 100 + 100 ra", "cast((id * 104729) % 2000 as double) / 100 ra2", "cast(8000 + id * 31 % 4000 as int) mag_milli")
    from skyframe.functions import healpix

    return healpix.with_cell(rows.withColumn("dec", F.col("ra2")).drop("ra2"), 64)


def test_partitioned_index_and_its_stars(spark, tmp_path):
    s = stars(spark)
    index = cut(quads.build_quad_index(cut(s), [4.0], bounds=(95.0, 125.0, -5.0, 25.0)))
    meta = spark.createDataFrame([(42, 2016.0)], "fingerprint long, epoch double")
    qf.write_quad_index(index, meta, str(tmp_path / "q"))
    got = qf.open_quad_index(spark, str(tmp_path / "q"), meta)
    assert got.count() == index.count() > 100
    err = got.alias("a").join(index.alias("b"), ["disc_id", "place"]).select(F.array_max(F.zip_with("a.code", "b.code", lambda x, y: F.abs(x - y))).alias("e"), (F.col("a.stars") == F.col("b.stars")).alias("same"))
    worst = err.agg(F.max("e"), F.min("same")).first()
    assert worst[0] <= 3 / 65535 and worst[1]
    with pytest.raises(qf.QuadIndexError):
        qf.open_quad_index(spark, str(tmp_path / "q"), spark.createDataFrame([(43, 2016.0)], "fingerprint long, epoch double"))


def test_head_and_records():
    head = qf.pack_head(7, 2016.0, -5, quads.BANDS)
    assert len(head) == 128 and qf.read_head(head) == {"n_quads": 7, "epoch": 2016.0, "star_fingerprint": -5, "bands": quads.BANDS}
    for bad in (head[:100], b"X" + head[1:]):
        with pytest.raises(qf.QuadIndexError):
            qf.read_head(bad)
    codes, idx = np.arange(8).reshape(2, 4), np.arange(8).reshape(2, 4) + 70000
    data = qf.pack_records(codes, idx)
    assert len(data) == 48 and all((a == b).all() for a, b in zip(qf.read_records(data), (codes, idx)))


def test_canonical_codes_do_not_depend_on_the_frame():
    rng = np.random.default_rng(4)
    x, y = rng.uniform(0, 10, (200, 4)), rng.uniform(0, 10, (200, 4))
    code, diag = quads.canonical_codes(x, y)
    z = (x + 1j * y) * 2.5 * np.exp(0.9j) + (3 - 8j)
    turned, wide = quads.canonical_codes(z.real, z.imag)
    assert np.allclose(code, turned, atol=1e-9) and np.allclose(wide, diag * 2.5)
    order = rng.permuted(np.tile(np.arange(4), (200, 1)), axis=1)
    mixed, _ = quads.canonical_codes(np.take_along_axis(x, order, 1), np.take_along_axis(y, order, 1))
    assert np.allclose(code, mixed, atol=1e-9)
    same, _ = quads.canonical_codes(np.zeros((1, 4)), np.zeros((1, 4)))
    assert np.isnan(same).all() and len(quads.canonical_codes(np.empty((0, 4)), np.empty((0, 4)))[0]) == 0


def test_sql_names(spark):
    sql.register(spark)
    assert spark.sql("select sky_separation(0D, 0D, 90D, 0D)").first()[0] == pytest.approx(90)
    assert spark.sql("select count(*) from cells_in_disc(8, 10D, 0D, 5D)").first()[0] > 3


def test_logs_round_trip(spark, tmp_path):
    log = spark.read.parquet(f"{DATA}/solve_log.parquet").limit(50)
    logs.write_log(log, str(tmp_path / "log"))
    got = logs.read_log(spark, str(tmp_path / "log"))
    rows = got.collect()
    assert len(rows) == 50 and all(r["broken"] is None for r in rows)
    assert {r["log_id"] for r in rows} == {r["log_id"] for r in log.collect()}


def test_residual_vectors_are_small_for_the_truth():
    px, cat, truth = fits.synthetic_field(50.0, 10.0, 3.0, seed=9, stars=30)
    got = plate.residual_vectors(px, truth, cat.ra.to_numpy(), cat.dec.to_numpy())
    assert len(got) > 15 and np.median(np.abs(got[:, 2:])) < 0.3


def test_bands_and_catalogue_selection(spark):
    df = spark.createDataFrame([(0.2,), (0.36,), (100.0,)], "d double").select(quads.band_of(F.col("d")).alias("b"))
    assert [r["b"] for r in df.collect()] == [0, 1, 5]
    s = stars(spark)
    one = spark.createDataFrame([(1, 110.0, 10.0, 5.0)], "disc_id long, ra0 double, dec0 double, radius double")
    cone = catalog.cone_search(s, one)
    top = [r["star_id"] for r in catalog.brightest(cone, 20).orderBy("rank").collect()]
    want = sorted(cone.collect(), key=lambda r: (r["mag_milli"], r["cell"], r["star_id"]))[:20]
    assert top == [r["star_id"] for r in want]
    assert catalog.stratified(cone, 10**6).count() == cone.count()


def test_each_frame_has_its_own_catalogue_limit(spark):
    # 400 bright stars in one spot, 1500 faint ones around it
    rng = np.random.default_rng(16)
    ra, dec = np.append(rng.uniform(110, 110.05, 400), rng.uniform(108, 112, 1500)), np.append(rng.uniform(10, 10.05, 400), rng.uniform(8, 12, 1500))
    rows = [(i, float(a), float(b), 5000 + i, 0.0, 0.0) for i, (a, b) in enumerate(zip(ra, dec))]
    s = cut(healpix.with_cell(spark.createDataFrame(rows, "star_id long, ra double, dec double, mag_milli int, pmra double, pmdec double"), 64))
    frames = spark.createDataFrame([("a", 110.0, 10.0, 2.0, 300, None), ("b", 110.0, 10.0, 2.0, 600, None)], "path string, ra0 double, dec0 double, radius double, lim int, date_obs string")
    got = solve.catalogue_for(frames, s, 64).toPandas()
    for path, lim in (("a", 300), ("b", 600)):
        disc = frames.where(F.col("path") == path).select(F.col("path").alias("disc_id"), "ra0", "dec0", "radius")
        want = catalog.select_catalogue(catalog.cone_search(s, disc, 64), lim).toPandas()
        mine = got[got.disc_id == path]
        assert want.stratified.all() and len(mine) == lim
        assert sorted(mine.cra.round(9)) == sorted(want.ra.round(9))
        assert ((mine.cra - 110.025).abs() < 0.025).sum() < lim / 4
