"""Batch forms of the reference's four SQL functions.

Each takes DataFrames (the many inputs a caller wants answered at once) and
returns a DataFrame, so a million lookups are one join rather than a million
calls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.functions.geo import vincenty_m
from wattle.operators.spatial_join import within_distance


def distance_between_addresses(addresses: DataFrame, pairs: DataFrame) -> DataFrame:
    """``get_distance_between_addresses(pid1, pid2)``: geodesic metres for every
    (pid1, pid2) row of ``pairs`` - two key joins, no cross join."""
    a1 = addresses.select(F.col("address_detail_pid").alias("pid1"), F.col("lon").alias("lon1"), F.col("lat").alias("lat1"))
    a2 = addresses.select(F.col("address_detail_pid").alias("pid2"), F.col("lon").alias("lon2"), F.col("lat").alias("lat2"))
    j = pairs.select("pid1", "pid2").join(a1, "pid1").join(a2, "pid2")
    return j.select("pid1", "pid2", vincenty_m("lat1", "lon1", "lat2", "lon2").alias("distance_m"))


def addresses_within_radius(addresses: DataFrame, centres: DataFrame, meters: float, centre_id: str = "centre_id") -> DataFrame:
    """``find_addresses_within_radius(lat, lon, m)`` for every centre row (centre_id, lat, lon)."""
    r = addresses.select("address_detail_pid", F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    c = centres.select(centre_id, "lon", "lat")
    return within_distance(c, r, meters, metric="vincenty").select(centre_id, "address_detail_pid", "distance_m")


def suburbs_by_postcode(suburb_postcode: DataFrame, postcodes: DataFrame) -> DataFrame:
    """``get_suburbs_by_postcode(pc)`` for a table of postcodes; primary suburbs first
    when an ``is_primary`` column exists."""
    j = suburb_postcode.join(postcodes.select("postcode").distinct(), "postcode")
    order = ([F.desc("is_primary")] if "is_primary" in j.columns else []) + ["postcode", "locality_name"]
    return j.orderBy(*order)


def postcodes_by_suburb(suburb_postcode: DataFrame, suburbs: DataFrame) -> DataFrame:
    """``get_postcodes_by_suburb(name)`` (case-insensitive) for a table of suburb names."""
    names = suburbs.select(F.upper("locality_name").alias("_u")).distinct()
    j = suburb_postcode.join(names, F.upper(suburb_postcode.locality_name) == names._u).drop("_u")
    order = ([F.desc("is_primary")] if "is_primary" in j.columns else []) + ["locality_name", "postcode"]
    return j.orderBy(*order)
