"""Queries of the general data-preparation problems and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import spatial_join
from ..session import table
from ..sources.shards import ShardSet


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return spatial_join.sources_near_and_inside(table(spark, d, "gaia_rows"), table(spark, d, "star_records"), table(spark, d, "sky_fields"))


def _shards(spark: SparkSession, d: str) -> ShardSet:
    return ShardSet(table(spark, d, "raw_lines"), table(spark, d, "shard_files"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _shards(spark, d).changes()


def p4_unified(spark: SparkSession, d: str) -> DataFrame:
    """All loadable rows of all shards under canonical names."""
    return _shards(spark, d).loaded()


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    """Schema version and fingerprint of each shard."""
    return _shards(spark, d).versions().select("shard_id", "feed", "seq", "version", "fingerprint")


def p4_steps(spark: SparkSession, d: str) -> DataFrame:
    """The migration steps that lead from version to version."""
    return _shards(spark, d).steps()


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _shards(spark, d).rejected().select("raw_id", "reason")


def p5_loaded(spark: SparkSession, d: str) -> DataFrame:
    """The rows of which p5_found has none, typed."""
    return _shards(spark, d).loaded().select("raw_id", "shard_id", "source_id", "ra", "dec", "mag", "pmra", "pmdec")


def queries():
    return {"p2_found": p2_found, "p4_found": p4_found, "p4_unified": p4_unified, "p4_versions": p4_versions, "p4_steps": p4_steps, "p5_found": p5_found, "p5_loaded": p5_loaded}


HAVERSINE = "2.0e0*degrees(asin(least(1.0e0,sqrt(pow(sin(radians(d2-d1)/2.0e0),2)+cos(radians(d1))*cos(radians(d2))*pow(sin(radians(r2-r1)/2.0e0),2)))))"


def oracle_sql():
    return {
        "p2_found": f"""
with g as (select distinct source_id, ((ra % 360) + 360) % 360 r1, dec d1 from gaia_rows where isfinite(ra) and isfinite(dec) and dec between -90 and 90),
s as (select distinct star_id, ra_scaled*360.0e0/4294967296.0e0 r2, dec_scaled*90.0e0/2147483647.0e0 d2 from star_records),
gb as (select *, cast(floor(d1/0.01e0) as bigint) + o b from g, (values (-1),(0),(1)) v(o)),
sb as (select *, cast(floor(d2/0.01e0) as bigint) b from s),
near as (select source_id, star_id from gb join sb using (b) where abs(d1-d2) < 0.0005e0 and {HAVERSINE} <= 1.5e0/3600.0e0 + 1e-12),
f as (select *, ra_deg r2, dec_deg d2 from sky_fields),
ins as (select source_id, field_id from g, f where case when shape = 'cone' then {HAVERSINE} <= radius_deg + 1e-11
  else d1 between dec_min and dec_max and (case when ra_min <= ra_max then r1 between ra_min and ra_max else r1 >= ra_min or r1 <= ra_max end) end)
select distinct 'near' kind, source_id, star_id other_id from near union all select distinct 'inside', source_id, field_id from ins""",
    }
