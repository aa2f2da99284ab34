"""Unit checks for the radius page, geodesic radius, batch API, A5 text and AG19."""

import random

from pyspark.sql import functions as F

from wattle import api
from wattle.functions import geo as G
from wattle.functions.text import lot_address
from wattle.operators import schools as SC
from wattle.operators import spatial_join as S


def test_radius_page_faithful_is_short(spark):
    # Planar degrees and kilometres disagree: at -34 a degree east-west is ~0.83 of a
    # degree north-south.  KNN (planar) order: 3, then A (north, 4.9 km), then B
    # (east, 4.1 km).  With a 4.5 km limit and pages of 2:
    left = spark.createDataFrame([(1, 151.0, -34.0)], "id int, lon double, lat double")
    right = spark.createDataFrame([(3, 151.0, -34.0 + 0.001), (10, 151.0, -34.0 + 0.0440), (20, 151.0 + 0.0441, -34.0)],
                                  "rid int, r_lon double, r_lat double")
    kw = dict(km=4.5, r_deg=0.045, page_size=2, metric="haversine")
    faithful = S.radius_page(left, right, "id", "rid", faithful=True, **kw)
    default = S.radius_page(left, right, "id", "rid", faithful=False, **kw)
    assert sorted(r.rid for r in faithful.collect()) == [3]       # cut [3, A], then A dropped: a short page
    assert sorted(r.rid for r in default.collect()) == [3, 20]    # filter first, then a full page


def test_geodesic_radius_equals_brute_force(spark):
    random.seed(9)
    left = spark.createDataFrame([(i, 151 + random.uniform(0, 0.05), -34 + random.uniform(0, 0.05)) for i in range(20)],
                                 "id int, lon double, lat double")
    right = spark.createDataFrame([(i, 151 + random.uniform(0, 0.05), -34 + random.uniform(0, 0.05)) for i in range(400)],
                                  "rid int, r_lon double, r_lat double")
    got = {(r.id, r.rid) for r in S.within_distance(left, right, 700.0, metric="vincenty").collect()}
    brute = {(r.id, r.rid) for r in left.crossJoin(right).filter(G.vincenty_m("lat", "lon", "r_lat", "r_lon") <= 700.0).collect()}
    assert got == brute and got


def test_batch_api(spark):
    addrs = spark.createDataFrame([("A", 151.0, -34.0), ("B", 151.01, -34.0), ("C", 151.5, -34.0)],
                                  "address_detail_pid string, lon double, lat double")
    pairs = spark.createDataFrame([("A", "B")], "pid1 string, pid2 string")
    d = api.distance_between_addresses(addrs, pairs).first().distance_m
    assert 900 < d < 940
    centres = spark.createDataFrame([(1, 151.0, -34.0)], "centre_id int, lon double, lat double")
    assert {r.address_detail_pid for r in api.addresses_within_radius(addrs, centres, 2000).collect()} == {"A", "B"}
    sp = spark.createDataFrame([("X", "2000", "S"), ("Y", "2000", "S"), ("x", "2001", "S")],
                               "locality_name string, postcode string, state_name string")
    assert [r.locality_name for r in api.suburbs_by_postcode(sp, spark.createDataFrame([("2000",)], "postcode string")).collect()] == ["X", "Y"]
    assert sorted(r.postcode for r in api.postcodes_by_suburb(sp, spark.createDataFrame([("X",)], "locality_name string")).collect()) == ["2000", "2001"]


def test_lot_address_quirk(spark):
    df = spark.createDataFrame([(12, 14, "SMITH", "STREET", None), (12, None, "SMITH", "STREET", 3)],
                               "number_first int, number_last int, street_name string, street_type string, flat_number int")
    parts = {c: F.col(c) for c in df.columns}
    got = [r.a for r in df.select(lot_address(parts).alias("a")).collect()]
    assert got == ["1214SMITH STREET ", "312SMITH STREET "]


def test_year_flag_summary(spark):
    prim = spark.createDataFrame([("Y", "Y"), ("N", "Y")], "kindergart string, year6 string")
    sec = spark.createDataFrame([("Y", "N")], "year7 string, year12 string")
    fut = spark.createDataFrame([(1,)], "x int")
    rows = {r.category: (r.total_schools, r.stat1, r.stat2) for r in SC.year_flag_summary(
        {"Primary Schools": (prim, "kindergart", "year6"), "Secondary Schools": (sec, "year7", "year12"),
         "Future Schools": (fut, None, None)}).collect()}
    assert rows == {"Primary Schools": (2, 1, 2), "Secondary Schools": (1, 1, 0), "Future Schools": (1, 0, 0)}


def test_year_levels_and_tiers(spark):
    df = spark.createDataFrame([("Y", "Y", None), ("N", None, None)], "kindergart string, year1 string, year2 string")
    assert [r.y for r in df.select(SC.year_levels(df).alias("y")).collect()] == ["K, 1", "N/A"]
    assert [r.f for r in df.select(SC.first_year_level(df).alias("f")).collect()] == ["K", None]


def test_three_tier_exact_hides_prefix_and_escapes(spark):
    c = spark.createDataFrame([(1, "ABC PS", "PRIMARY"), (2, "ABC PS NORTH", "PRIMARY"), (3, "X_Y HS", "SECONDARY"),
                               (4, "XAY HS", "SECONDARY")], "school_id int, school_name string, school_type string")
    assert [r.school_id for r in SC.three_tier_match(c, "abc ps").collect()] == [1]
    assert [r.school_id for r in SC.three_tier_match(c, "abc").collect()] == [1, 2]
    assert [r.school_id for r in SC.three_tier_match(c, "x_y").collect()] == [3]
