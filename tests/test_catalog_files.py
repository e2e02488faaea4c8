import json

import numpy as np
import pytest

from skyframe.functions import healpix
from skyframe.operators import catalog
from skyframe.sources import catalog_files as cf
from skyframe.sources import fits, mirror

HEAD = "source_id,ra,dec,pmra,pmdec,phot_g_mean_mag"


def write(folder, name, lines):
    (folder / name).write_text("\n".join(lines) + "\n")
    return str(folder / name)


def test_reader_by_name_not_position(spark, tmp_path):
    a = write(tmp_path, "a.csv", ["# c", HEAD, "5,10,20,null,1.5,12.5", "x,11,21,1,,13", "7,1,1,1,1,null"])
    b = write(tmp_path, "b.csv", ["phot_g_mean_mag,dec,ra,pmdec,pmra", "9,1,2,3,4"])
    rows = {r["ra"]: r for r in cf.read_shards(spark, cf.shard_files(str(tmp_path))).collect()}
    assert set(rows) == {10.0, 11.0, 2.0}
    assert rows[10.0]["pmra"] == 0 and rows[11.0]["source_id"] == 0 and rows[2.0]["dec"] == 1.0 and rows[2.0]["pmra"] == 4
    assert a < b


def test_reader_refuses(spark, tmp_path):
    bad = write(tmp_path, "a.csv", [HEAD, "1,zzz,2,3,4,5"])
    with pytest.raises(Exception):
        cf.read_shards(spark, [bad]).collect()
    with pytest.raises(cf.CatalogError):
        cf.columns_of(write(tmp_path, "c.csv", ["ra,dec"]))
    with pytest.raises(cf.CatalogError):
        cf.columns_of(bad, "nope=x")
    assert cf.columns_of(write(tmp_path, "d.csv", ["RAJ,dec,pmra,pmdec,phot_g_mean_mag"]), "ra=RAJ")["ra"] == "RAJ"
    write(tmp_path, "e.csv.gz", [""])
    with pytest.raises(cf.CatalogError):
        cf.shard_files(str(tmp_path))


def test_manifest(tmp_path):
    assert cf.check_manifest(str(tmp_path), 14, -90, 90) is None
    good = {"max_mag": 14.0, "min_dec": -90.0, "max_dec": 45.0, "files": 1, "complete": True}
    write(tmp_path, "a.csv", [HEAD])
    write(tmp_path, "mirror.json", [json.dumps(good)])
    assert cf.check_manifest(str(tmp_path), 14, -90, 45)["files"] == 1
    for change, args in (({}, (15, -90, 45)), ({}, (14, -90, 90)), ({"complete": False}, (14, -90, 45)), ({"files": 2}, (14, -90, 45))):
        write(tmp_path, "mirror.json", [json.dumps(good | change)])
        with pytest.raises(cf.CatalogError):
            cf.check_manifest(str(tmp_path), *args)


def index(spark):
    rows = [(i, float(i * 37 % 360), float(i * 13 % 170 - 85), float(8 + i % 7), 1.0, None) for i in range(300)]
    return catalog.build_star_index(spark.createDataFrame(rows, "source_id long, ra double, dec double, mag float, pmra float, pmdec float"), 8)


def test_binary_round_trip_and_corruption(spark, tmp_path):
    path = str(tmp_path / "x.idx")
    df = index(spark)
    cf.write_binary(df, 8, 2016.0, "test", path)
    head, offsets, records = cf.open_binary(path, verify=True)
    assert head["n_stars"] == 300 and offsets[-1] == 300 and len(records) == 300
    want = sorted(tuple(r) for r in df.select("cell", "ra_scaled", "dec_scaled", "mag_milli", "pmra_mas", "pmdec_mas").collect())
    assert sorted(tuple(r) for r in cf.read_binary(spark, path, 3).collect()) == want
    data = bytearray(open(path, "rb").read())
    for at, cut in ((0, None), (None, -1), (-5, None)):
        bad = bytearray(data)
        if at is not None:
            bad[at] ^= 255
        open(path, "wb").write(bad[:cut] if cut else bad)
        with pytest.raises(cf.CatalogError):
            cf.open_binary(path, verify=True)


def test_parquet_index(spark, tmp_path):
    df = index(spark)
    catalog.write_index(df, catalog.index_meta(df, 8, 2016.0, "t"), str(tmp_path / "i"))
    stars, meta = catalog.open_index(spark, str(tmp_path / "i"))
    assert catalog.verify_index(stars, meta) and not catalog.verify_index(stars.limit(299), meta)


def test_cover_holds_every_cell(spark):
    pts = spark.range(2000).selectExpr("id", "cast(id * 7919 % 36000 as double) / 100 ra", "cast(id * 104729 % 18001 as double) / 100 - 90 dec")
    cells = {(r["ra"], r["dec"]): r["cell"] for r in healpix.with_cell(pts, 16).collect()}
    import numpy as np

    from skyframe.operators.plate import separation

    for ra, dec, rad in ((0.0, 0.0, 5.0), (359.9, 89.0, 3.0), (200.0, -90.0, 10.0)):
        cover = set(healpix.cells_in_disc(16, ra, dec, rad))
        assert all(c in cover for (a, b), c in cells.items() if separation(np.float64(a), b, ra, dec) <= rad)
    assert healpix.cells_in_disc(16, 0, 0, 180) == list(range(12 * 256))
    with pytest.raises(ValueError):
        healpix.order_of(3)


def test_impossible_positions_have_no_cell_and_do_not_fail(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, nan, 1.0, 1.0), (2, 1.0, nan, 1.0), (3, inf, 1.0, nan), (4, None, 1.0, None), (5, 1.0, 95.0, 40.0)], "source_id long, ra double, dec double, mag float")
    df = df.selectExpr("*", "cast(null as float) pmra", "cast('NaN' as float) pmdec")
    assert [r["cell"] for r in healpix.with_cell(df, 64).orderBy("source_id").collect()][:4] == [None] * 4
    got = catalog.build_stats(df).first()
    assert (got["written"], got["clamped"], got["skipped"]) == (1, 1, 4)
    assert catalog.build_star_index(df, 64).count() == 1


def test_index_files_are_picked_by_name(tmp_path):
    with pytest.raises(cf.CatalogError):
        cf.pick(str(tmp_path / "none"))
    with pytest.raises(cf.CatalogError):
        cf.pick(None)
    assert cf.pick(str(tmp_path), cf.QUAD_SUFFIX, needed=False) is None
    for n in ("b", "a", "c"):
        (tmp_path / f"{n}{cf.STAR_SUFFIX}").write_text("")
    (tmp_path / f"0{cf.STAR_SUFFIX}").mkdir()
    assert cf.pick(str(tmp_path)) == str(tmp_path / f"a{cf.STAR_SUFFIX}")


def test_mirror_filters_restarts_and_guards(spark, tmp_path):
    import gzip

    wide = "solution_id,source_id,ra,dec,phot_g_mean_mag,pmra,pmdec"
    rows = ["1,1,10,20,12.5,1,2", "1,2,10,50,12.5,1,2", "1,3,10,20,15,1,2", "1,4,10,20,null,1,2", "1,5,10,,9,1,2", "1,6,10,-30,14,null,"]
    with gzip.open(tmp_path / "x.csv.gz", "wt") as f:
        f.write("# note\n" + "\n".join([wide, *rows]) + "\n")
    (tmp_path / "y.csv").write_text(wide + "\n1,7,1,89,3,1,1\n")
    out = str(tmp_path / "mirror")
    sources = [str(tmp_path / "x.csv.gz"), str(tmp_path / "y.csv")]
    assert mirror.build(spark, sources, out, 14.0, -30.0, 45.0) == 2
    assert open(f"{out}/x.csv").read() == "ra,dec,pmra,pmdec,phot_g_mean_mag\n10,20,1,2,12.5\n10,-30,null,,14\n"
    assert open(f"{out}/y.csv").read().count("\n") == 1
    assert cf.check_manifest(out, 14.0, -30.0, 45.0)["rows"] == 2 and cf.read_shards(spark, cf.shard_files(out)).count() == 2
    open(f"{out}/y.csv", "a").write("1,2,3,4,5\n")  # a shard that is there is not made again
    assert mirror.build(spark, sources, out, 14.0, -30.0, 45.0) == 3


def test_header_update_in_place(spark, tmp_path):
    px = np.arange(600.0).reshape(20, 30)
    path = tmp_path / "f.fits"
    path.write_bytes(fits.write_image(px, [("CRVAL1", 1.0), ("OBJECT", "M31")]))
    before = path.read_bytes()
    fits.update_header(str(path), [("CRVAL1", 2.5), ("CTYPE1", "RA---TAN"), ("COMMENT", "solved")])
    cards, got, _ = fits.read_image(path.read_bytes())
    assert len(path.read_bytes()) == len(before) and (got == px).all()
    assert fits.number(cards, "CRVAL1") == 2.5 and [n for n, _ in cards].count("CRVAL1") == 1 and fits.text(cards, "CTYPE1") == "RA---TAN" and ("COMMENT", "solved") in cards and fits.text(cards, "OBJECT") == "M31"
    now = path.read_bytes()
    done = fits.update_headers(spark.createDataFrame([(str(path),), (str(tmp_path / "none.fits"),)], "path string"), lambda r: [("COMMENT", "x")] * 100).collect()
    assert all(r["error"] for r in done) and path.read_bytes() == now and sorted(p.name for p in tmp_path.iterdir()) == ["f.fits"]
