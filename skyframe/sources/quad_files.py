"""Pattern indexes on disk: partitioned by band, tied to the star index that they were built from."""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators.quads import BANDS

MOST_BANDS = 8
#: magic, version, bands, quads, epoch, fingerprint of the stars, scales in thousandths of a degree
HEAD = struct.Struct("<8sIIQdq8H72x")
MAGIC = b"SKYFQUAD"


class QuadIndexError(ValueError):
    """A pattern index that cannot be used."""


def pack_head(n: int, epoch: float, fingerprint: int, bands: list[float]) -> bytes:
    """128-byte header; band scales are whole thousandths of a degree."""
    if not 1 <= len(bands) <= MOST_BANDS:
        raise QuadIndexError(f"{len(bands)} bands")
    scales = [round(b * 1000) for b in bands] + [0] * (MOST_BANDS - len(bands))
    return HEAD.pack(MAGIC, 1, len(bands), n, epoch, fingerprint, *scales)


def read_head(data: bytes) -> dict:
    if len(data) < HEAD.size:
        raise QuadIndexError("the header is cut off")
    magic, version, k, n, epoch, fingerprint, *scales = HEAD.unpack(data[: HEAD.size])
    if magic != MAGIC or version != 1 or not 1 <= k <= MOST_BANDS:
        raise QuadIndexError("not a pattern index, or of another version")
    return {"n_quads": n, "epoch": epoch, "star_fingerprint": fingerprint, "bands": [s / 1000 for s in scales[:k]]}


def quad_meta(index: DataFrame, star_meta: DataFrame, bands: list[float] = BANDS) -> DataFrame:
    """One-row header with the fingerprint of the star index."""
    stars = star_meta.select(F.col("fingerprint").alias("star_fingerprint"), "epoch")
    return index.agg(F.count(F.lit(1)).alias("n_quads")).join(F.broadcast(stars)).withColumn("bands", F.array(*[F.lit(float(b)) for b in bands])).withColumn("version", F.lit(1))


def write_quad_index(index: DataFrame, star_meta: DataFrame, path: str, bands: list[float] = BANDS) -> None:
    """Packed codes partitioned by band, in the order of tiles and places within each."""
    packed = index.select("band", "tile_scale", "disc_id", "place", codec.pack_code(F.col("code")).alias("code"), codec.code_clamped(F.col("code")).alias("clamped"), "stars")
    packed.repartitionByRange("band", "tile_scale", "disc_id").sortWithinPartitions("band", "tile_scale", "disc_id", "place").write.mode("errorifexists").partitionBy("band").parquet(f"{path}/quads")
    quad_meta(index, star_meta, bands).write.mode("errorifexists").parquet(f"{path}/meta")


def open_quad_index(spark: SparkSession, path: str, star_meta: DataFrame) -> DataFrame:
    """Patterns with unpacked codes; refuses another star index, version or count."""
    quads, meta = spark.read.parquet(f"{path}/quads"), spark.read.parquet(f"{path}/meta").first()
    stars = star_meta.first()
    if meta is None or meta["version"] != 1:
        raise QuadIndexError("unknown version")
    if stars is None or meta["star_fingerprint"] != stars["fingerprint"]:
        raise QuadIndexError("built from another star index")
    if quads.count() != meta["n_quads"]:
        raise QuadIndexError("the index is cut off")
    return quads.withColumn("code", codec.unpack_code(F.col("code")))


def pack_records(codes: np.ndarray, stars: np.ndarray) -> bytes:
    """24-byte records of packed codes (n, 4) and star numbers (n, 4)."""
    kind = np.dtype([("code", "<u2", 4), ("stars", "<u4", 4)])
    out = np.empty(len(codes), kind)
    out["code"], out["stars"] = codes, stars
    return out.tobytes()


def read_records(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    if len(data) % 24:
        raise QuadIndexError("the records are cut off")
    got = np.frombuffer(data, np.dtype([("code", "<u2", 4), ("stars", "<u4", 4)]))
    return got["code"], got["stars"]
