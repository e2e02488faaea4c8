"""Names under which the operators can be used from Spark SQL."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from . import healpix


@udtf(returnType="cell: bigint")
class CellsInDisc:
    """``cells_in_disc(nside, ra, dec, radius)``: one row per cell that may hold points of the disc."""

    def eval(self, nside: int, ra: float, dec: float, radius: float):
        if None not in (nside, ra, dec, radius):
            for c in healpix.cells_in_disc(nside, ra, dec, radius):
                yield (c,)


def register(spark: SparkSession) -> None:
    """Register the table function, and the great-circle distance as a SQL function."""
    spark.udtf.register("cells_in_disc", CellsInDisc)
    spark.sql("""
        create or replace temporary function sky_separation(ra1 double, dec1 double, ra2 double, dec2 double) returns double
        return 2 * degrees(asin(least(1.0, sqrt(pow(sin(radians(dec2 - dec1) / 2), 2) + cos(radians(dec1)) * cos(radians(dec2)) * pow(sin(radians(ra2 - ra1) / 2), 2)))))
    """)
