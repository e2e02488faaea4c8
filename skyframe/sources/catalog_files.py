"""Catalogue shards on disk: strict reader, manifest guards, binary index files."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, healpix
from ..session import narrow_batches
from .delimited import DEFAULTS, ROLES, column_spec, header_names

COMPRESSED = (".gz", ".bz2", ".zst")


class CatalogError(ValueError):
    """A catalogue that must not be read as it is."""


#: Suffix of star and pattern index files.
STAR_SUFFIX, QUAD_SUFFIX = ".skystars", ".skyquads"
PACKED_ROWS = 1 << 16


def pick(folder: str | None, suffix: str = STAR_SUFFIX, needed: bool = True) -> str | None:
    """The first file of a folder with the suffix, by name; none is an error only if one is needed.

    A missing or unreadable folder counts as empty. A pattern index is not needed: without one
    there is no blind search.
    """
    try:
        names = sorted(n for n in os.listdir(folder or "") if n.endswith(suffix) and os.path.isfile(os.path.join(folder, n)))
    except OSError:
        names = []
    if not names and needed:
        raise CatalogError("no star index found")
    return os.path.join(folder, names[0]) if names else None


def shard_files(folder: str) -> list[str]:
    """Sorted CSV files of a folder; a compressed file is refused, since part of the sky would go missing."""
    names = sorted(os.listdir(folder))
    bad = [n for n in names if n.endswith(COMPRESSED)]
    if bad:
        raise CatalogError(f"{len(bad)} compressed shards")
    return [os.path.join(folder, n) for n in names if n.endswith(".csv")]


def columns_of(path: str, overrides: str | None = None) -> dict[str, str]:
    """Column of each role by name; the source number is optional, the others must be there."""
    given = column_spec(overrides)
    if overrides and len(given) != len([p for p in overrides.split(",") if p.strip()]):
        raise CatalogError(f"bad column override in {overrides!r}")
    with open(path, encoding="utf-8") as f:
        head = next((line for line in f if line.strip() and not line.startswith("#")), None)
    if head is None:
        raise CatalogError(f"{path} has no header")
    names = header_names(head)
    out = {r: given.get(r, d) for r, d in DEFAULTS.items()}
    missing = [c for r, c in out.items() if c not in names and r != "source_id"]
    if missing:
        raise CatalogError(f"{path} lacks {missing}")
    return {r: c for r, c in out.items() if c in names}


def read_shards(spark: SparkSession, files: list[str], overrides: str | None = None) -> DataFrame:
    """Typed rows of shards with one header layout each; garbage in a number fails the job.

    A missing magnitude skips the row, missing motion is zero, an unreadable source number is zero.
    """
    layouts: dict[tuple, list[str]] = {}
    for f in files:
        layouts.setdefault(tuple(sorted(columns_of(f, overrides).items())), []).append(f)
    parts = []
    for layout, paths in layouts.items():
        raw = spark.read.option("comment", "#").option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(paths)
        cols = dict(layout)
        value = lambda r: F.when(~F.lower(F.trim(F.col(f"`{cols[r]}`"))).isin("", "null"), F.trim(F.col(f"`{cols[r]}`")))  # noqa: E731, B023
        number = lambda r: value(r).cast("double")
        source = F.coalesce(F.expr(f"try_cast(trim(`{cols['source_id']}`) as bigint)"), F.lit(0)) if "source_id" in cols else F.lit(0)
        parts.append(raw.select(source.cast("long").alias("source_id"), number("ra").alias("ra"), number("dec").alias("dec"), number("mag").cast("float").alias("mag"), *[F.coalesce(number(r), F.lit(0.0)).cast("float").alias(r) for r in ("pmra", "pmdec")]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.where(F.col("mag").isNotNull()).select(*ROLES)


def check_manifest(folder: str, max_mag: float, min_dec: float, max_dec: float) -> dict | None:
    """The mirror's manifest, if any; refuses a build that the mirror cannot serve."""
    path = os.path.join(folder, "mirror.json")
    if not os.path.exists(path):
        return None
    try:
        with open(path) as f:
            m = json.load(f)
    except (OSError, ValueError) as e:
        raise CatalogError("the manifest cannot be read") from e
    if not m.get("complete", False):
        raise CatalogError("the mirror is incomplete")
    if max_mag > m["max_mag"] or min_dec < m["min_dec"] or max_dec > m["max_dec"]:
        raise CatalogError("the mirror is shallower or narrower than asked for")
    if len(shard_files(folder)) < m["files"]:
        raise CatalogError("the mirror has fewer files than its manifest")
    return m


# ---- binary star index: header, offsets per cell, 16-byte records -----------------------------

def write_binary(index: DataFrame, nside: int, epoch: float, name: str, path: str) -> None:
    """Write an index as one file of packed records in index order.

    The executors sort and pack; the driver takes whole packed chunks one after another, writes
    them, and keeps only the counts per cell.
    """
    ordered = index.orderBy("cell", "mag_milli", "source_id").select("cell", "ra_scaled", "dec_scaled", "mag_milli", "pmra_mas", "pmdec_mas")

    def pack(batches):
        for t in narrow_batches(batches, PACKED_ROWS):
            rec = np.zeros(t.num_rows, codec.STAR_RECORD)
            for f, c in zip(codec.STAR_RECORD.names, t.column_names[1:]):
                rec[f] = t.column(c).to_numpy()
            cell, n = np.unique(t.column("cell").to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([rec.tobytes()], pa.binary()), pa.array([cell.tolist()]), pa.array([n.tolist()])], names=["records", "cells", "counts"])

    offsets = np.zeros(healpix.cells(nside) + 1, np.int64)
    digest = hashlib.sha256()
    with open(path, "wb") as f:
        f.write(b"\0" * (codec.STAR_HEAD.size + offsets.nbytes))
        for r in ordered.mapInArrow(pack, "records binary, cells array<long>, counts array<long>").toLocalIterator(prefetchPartitions=True):
            digest.update(r["records"])
            f.write(r["records"])
            offsets[np.array(r["cells"]) + 1] += np.array(r["counts"])
        f.seek(0)
        f.write(codec.pack_star_head(nside, int(offsets.sum()), epoch, name, digest.digest()))
        f.write(np.cumsum(offsets).astype("<i8").tobytes())


def open_binary(path: str, verify: bool = False) -> tuple[dict, np.ndarray, np.ndarray]:
    """Header, offsets and records of a binary index; refuses any that does not hold together."""
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        data = f.read(codec.STAR_HEAD.size)
        head = codec.read_star_head(data)
        if head is None:
            raise CatalogError("the index is cut off" if len(data) < codec.STAR_HEAD.size else "not an index, or of another version")
        nside, n = head["nside"], head["n_stars"]
        healpix.order_of(nside)
        count = healpix.cells(nside) + 1
        if size != codec.STAR_HEAD.size + count * 8 + n * codec.STAR.size:
            raise CatalogError("the index has the wrong length")
        offsets = np.frombuffer(f.read(count * 8), "<i8")
    if (np.diff(offsets) < 0).any() or offsets[0] != 0 or offsets[-1] != n:
        raise CatalogError("the offsets are not ascending or do not end at the last star")
    records = np.memmap(path, codec.STAR_RECORD, "r", codec.STAR_HEAD.size + count * 8, (n,)) if n else np.empty(0, codec.STAR_RECORD)
    if verify and hashlib.sha256(records.tobytes()).hexdigest() != head["digest"]:
        raise CatalogError("the records do not have their digest")
    return head, offsets, records


def read_binary(spark: SparkSession, path: str, parts: int = 8) -> DataFrame:
    """A binary index as a DataFrame; each task maps the file and reads its own range of cells."""
    head, _, _ = open_binary(path)
    nside = head["nside"]

    def run(batches):
        import pandas as pd

        _, offsets, rec = open_binary(path)
        for pdf in batches:
            for k in pdf.id:
                lo, hi = (healpix.cells(nside) * v // parts for v in (k, k + 1))
                r = rec[offsets[lo] : offsets[hi]]
                cell = np.repeat(np.arange(lo, hi), np.diff(offsets[lo : hi + 1]))
                yield pd.DataFrame({"cell": cell, "ra_scaled": r["ra"].astype(np.int64), "dec_scaled": r["dec"], "mag_milli": r["mag"], "pmra_mas": r["pmra"], "pmdec_mas": r["pmdec"]})

    return spark.range(0, parts, 1, parts).mapInPandas(run, "cell long, ra_scaled long, dec_scaled int, mag_milli short, pmra_mas short, pmdec_mas short")
