"""Solve logs as lines of JSON, with their schema spelled out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIMINGS = ", ".join(f"{n}: double" for n in "decode background extract caller quads catalogue match_ fit verify total".split())
HEADER = "struct<has_wcs: boolean, header_scale_arcsec: double, header_parity: string, expected_scale_arcsec: double, is_cfa: boolean>"
OUTCOME = (
    "struct<solved: boolean, reason: string, detail: string, field: struct<center: struct<ra: double, dec: double>, scale_arcsec: double>, stars_detected: int, stars_used: int, stars_matched: int, "
    f"fit: struct<used: int, rms_deg: double, max_residual_deg: double, radial_trend: double>, timings: struct<{TIMINGS}>>"
)
SCHEMA = (
    "log_id long, path string, frame_id long, rig string, tool_version string, run_at timestamp, ingested_at timestamp, db_ra double, db_dec double, naxis1 int, naxis2 int, binning int, filt_eff string, "
    f"hint_ra double, hint_dec double, pointing_src string, exit_code int, wall_s double, parse_error string, header {HEADER}, outcome {OUTCOME}"
)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Records of a log; a line that is no object comes out with its text in ``broken`` and nulls elsewhere."""
    return spark.read.schema(SCHEMA + ", broken string").option("columnNameOfCorruptRecord", "broken").json(path)


def write_log(log: DataFrame, path: str) -> None:
    """One object per line, nulls kept; numbers that are not finite become null."""
    cells = [F.when(F.isnan(n) | (F.abs(n) == float("inf")), None).otherwise(F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in log.dtypes]
    log.select(*cells).write.mode("errorifexists").option("ignoreNullFields", False).json(path)
