"""A local mirror of catalogue shards: filtered copies of large files, restartable, with a manifest."""

from __future__ import annotations

import json
import os

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import catalog_files

NARROW = ["ra", "dec", "pmra", "pmdec", "phot_g_mean_mag"]


def _manifest(folder: str, facts: dict) -> None:
    """Write the manifest beside its place and move it there, so that no reader sees half of it."""
    path = os.path.join(folder, "mirror.json")
    with open(path + ".tmp", "w") as f:
        json.dump(facts, f)
    os.replace(path + ".tmp", path)


def build(spark: SparkSession, sources: list[str], folder: str, max_mag: float, min_dec: float = -90.0, max_dec: float = 90.0, source: str = "") -> int:
    """Filter each source file (CSV, may be compressed) into a narrow shard of the folder; returns the rows of the mirror.

    The manifest says ``complete: false`` until all shards are there, so that no index is built
    from half a sky. A shard that exists is not made again. A file without rows in the range
    becomes a shard with only a header. Each file is one task, which streams it.
    """
    os.makedirs(folder, exist_ok=True)
    facts = {"source": source, "max_mag": max_mag, "min_dec": min_dec, "max_dec": max_dec, "epoch": 2016.0, "files": len(sources), "rows": 0, "complete": False}
    _manifest(folder, facts)
    names = [os.path.basename(p).split(".csv")[0] + ".csv" for p in sources]
    if len(set(names)) < len(names):
        raise catalog_files.CatalogError("two sources would become the same shard")
    todo = [(p, os.path.join(folder, n)) for p, n in zip(sources, names) if not os.path.exists(os.path.join(folder, n))]
    if todo:
        def run(batches):
            for pdf in batches:
                for p, out in zip(pdf.source, pdf.shard):
                    with open(out + ".tmp", "w") as f:
                        f.write(",".join(NARROW) + "\n")
                        for part in pd.read_csv(p, comment="#", dtype=str, keep_default_na=False, usecols=NARROW, chunksize=200_000):
                            mag, dec = (pd.to_numeric(part[c], errors="coerce") for c in ("phot_g_mean_mag", "dec"))
                            part[(mag <= max_mag) & (dec >= min_dec) & (dec <= max_dec)][NARROW].to_csv(f, header=False, index=False)
                    os.replace(out + ".tmp", out)
                    yield pd.DataFrame({"shard": [out]})

        spark.createDataFrame(todo, "source string, shard string").repartition(len(todo)).mapInPandas(run, "shard string").count()
    shards = catalog_files.shard_files(folder)
    rows = spark.read.text(shards).where(~F.col("value").startswith("ra,") & (F.length("value") > 0)).count() if shards else 0
    _manifest(folder, facts | {"rows": rows, "complete": True})
    return rows
