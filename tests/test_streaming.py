import time

from conftest import DATA

from skyframe.functions import healpix
from skyframe.sources import fits
from skyframe.streaming import watch


def test_solve_rate_stream(spark):
    src = spark.read.parquet(f"{DATA}/solve_log.parquet")
    stream = spark.readStream.schema(src.schema).parquet(f"{DATA}/solve_log.parque[t]")
    q = watch.solve_rate_by_window(stream).writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    end = time.time() + 120
    while q.isActive and time.time() < end:
        q.awaitTermination(1)
    q.stop()
    got = spark.table("rates").agg({"n": "sum"}).first()[0]
    assert got and got <= src.select("log_id").distinct().count()


def test_frames_are_solved_as_they_arrive(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    px, cat, _ = fits.synthetic_field(120.0, 35.0, 4.0, seed=3)
    stars = healpix.with_cell(spark.createDataFrame(cat.assign(star_id=range(len(cat)), mag_milli=(cat.mag * 1000).astype(int), pmra=0.0, pmdec=0.0)), 64)
    data = fits.write_image(px, [("RA", 120.0), ("DEC", 35.0), ("XPIXSZ", 3.8), ("FOCALLEN", 206.265 * 3.8 / 4.0)])
    (folder / "a.fits").write_bytes(data)
    q = watch.watch_frames(spark, str(folder), stars, out, str(tmp_path / "log"))
    try:
        q.processAllAvailable()
        (folder / "b.fits").write_bytes(data[:5000])
        q.processAllAvailable()
    finally:
        q.stop()
    got = {r["path"].rsplit("/", 1)[-1]: (r["solved"], r["reason"]) for r in spark.read.parquet(out).collect()}
    assert got == {"a.fits": (True, None), "b.fits": (False, "CANNOT_READ")}
