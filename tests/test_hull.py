"""Two-level convex hull equals a one-pass hull; area of a known square."""

import random

import numpy as np

from wattle.operators.hull import _hull_xy, _spheroid_area, convex_hulls, hull_geojson


def test_area_of_the_whole_spheroid():
    # eight octants; WGS84's surface is 510,065,621.7 km2
    octant = _spheroid_area(np.array([0.0, 45.0, 90.0, 90.0, 45.0, 0.0]), np.array([0.0, 0.0, 0.0, 90.0, 90.0, 90.0]))
    assert abs(8 * octant / 1e6 - 510_065_621.7) < 1


def test_two_level_hull_equals_single_pass(spark):
    random.seed(11)
    rows = [(g, i, random.uniform(0, 1), random.uniform(0, 1)) for g in ("a", "b") for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, id long, lon double, lat double")
    got = {r.g: sorted(zip(r.hull_x, r.hull_y)) for r in convex_hulls(df.repartition(7), ["g"]).collect()}
    for g in ("a", "b"):
        xs = [r[2] for r in rows if r[0] == g]
        ys = [r[3] for r in rows if r[0] == g]
        hx, hy = _hull_xy(__import__("numpy").array(xs), __import__("numpy").array(ys))
        assert got[g] == sorted(zip(hx.tolist(), hy.tolist()))


def test_hull_area_and_geojson(spark):
    pts = [(1, 0.0, 0.0), (2, 0.01, 0.0), (3, 0.01, 0.01), (4, 0.0, 0.01), (5, 0.005, 0.005)]
    df = spark.createDataFrame([("s", *p) for p in pts], "g string, id long, lon double, lat double")
    h = hull_geojson(convex_hulls(df, ["g"])).first()
    assert h.hull_vertices == 4
    # a hundredth of a degree at the equator on WGS84: 1113.195 m east, 1105.743 m north
    assert abs(h.hull_area_m2 - 1113.195 * 1105.743) < 20
    assert h.geojson.startswith('{"type":"Polygon"')
