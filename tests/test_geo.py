"""Geometry scalars and spatial joins against published values and brute force."""

import math
import random

from pyspark.sql import functions as F

from wattle.functions import geo as G
from wattle.operators import spatial_join as S


def _dms(d, m, s):
    return -(abs(d) + m / 60 + s / 3600) if d < 0 else d + m / 60 + s / 3600


def test_vincenty_published_line(spark):
    # Flinders Peak -> Buninyong, the classic published test line: 54,972.271 m.
    lat1, lon1 = _dms(-37, 57, 3.72030), _dms(144, 25, 29.52440)
    lat2, lon2 = _dms(-37, 39, 10.15610), _dms(143, 55, 35.38390)
    r = spark.range(1).select(G.vincenty_m(lat1, lon1, lat2, lon2).alias("d"),
                              G.vincenty_m(lat1, lon1, lat1, lon1).alias("z")).first()
    assert abs(r.d - 54972.271) < 0.01
    assert r.z == 0.0


def test_haversine_and_cosine_agree(spark):
    r = spark.range(1).select(G.haversine_m(-33.8688, 151.2093, -37.8136, 144.9631).alias("h"),
                              (G.cosine_law_km(-33.8688, 151.2093, -37.8136, 144.9631) * 1000).alias("c")).first()
    assert abs(r.h - r.c) < 1.0
    assert 713_000 < r.h < 714_000


def _poly(spark, rings):
    schema = "id int, rings array<array<struct<x:double,y:double>>>"
    return spark.createDataFrame([(1, [[{"x": float(x), "y": float(y)} for x, y in ring] for ring in rings])], schema)


def test_point_in_polygon_edges_holes_multipart(spark):
    shell = [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)]
    hole = [(1, 1), (1, 2), (2, 2), (2, 1), (1, 1)]
    part2 = [(10, 10), (11, 10), (11, 11), (10, 11), (10, 10)]
    poly = _poly(spark, [shell, hole, part2])
    pts = spark.createDataFrame([("in", 3.0, 3.0), ("edge", 4.0, 2.0), ("vertex", 0.0, 0.0), ("hole", 1.5, 1.5),
                                 ("part2", 10.5, 10.5), ("out", 5.0, 5.0), ("hole_edge", 1.0, 1.5)],
                                "name string, x double, y double")
    got = {r.name for r in pts.crossJoin(poly).filter(G.point_in_polygon(F.col("rings"), F.col("x"), F.col("y"))).collect()}
    assert got == {"in", "part2"}
    # The edge-band plan gives the same answer on the same edge cases.
    joined = S.points_in_polygons(pts, poly, "id", size=1.0, lon="x", lat="y", point_id="name")
    assert {r.name for r in joined.collect()} == {"in", "part2"}


def test_grid_pip_equals_brute_force(spark):
    random.seed(7)
    pts = [(i, random.uniform(0, 0.1), random.uniform(0, 0.1)) for i in range(400)]
    pts += [(1000, 0.02, 0.03), (1001, 0.03, 0.02)]  # on cell boundaries
    tri = [(0.005, 0.005), (0.09, 0.02), (0.04, 0.08), (0.005, 0.005)]
    poly = _poly(spark, [tri]).withColumnRenamed("id", "pid")
    p = spark.createDataFrame(pts, "id int, lon double, lat double")
    grid = {r.id for r in S.points_in_polygons(p, poly, "pid", size=0.01, point_id="id").collect()}
    rings = {r.id for r in S.points_in_polygons(p, poly, "pid", size=0.01, method="rings").collect()}
    assert grid == rings
    brute = {r.id for r in p.crossJoin(poly).filter(G.point_in_polygon(F.col("rings"), F.col("lon"), F.col("lat"))).collect()}
    assert grid == brute and len(grid) > 50


def test_radius_and_nearest_equal_brute_force(spark):
    random.seed(3)
    left = spark.createDataFrame([(i, 151 + random.uniform(0, 0.2), -34 + random.uniform(0, 0.2)) for i in range(30)],
                                 "id int, lon double, lat double")
    right = spark.createDataFrame([(i, 151 + random.uniform(0, 0.2), -34 + random.uniform(0, 0.2)) for i in range(500)],
                                  "rid int, r_lon double, r_lat double")
    got = {(r.id, r.rid) for r in S.within_distance(left, right, 1500.0).collect()}
    brute = {(r.id, r.rid) for r in left.crossJoin(right).filter(
        G.haversine_m("lat", "lon", "r_lat", "r_lon") <= 1500.0).collect()}
    assert got == brute and got
    nn = {r.id: r.rid for r in S.nearest_neighbour(left, right, "id", "rid", size=0.0005).collect()}
    d2 = (F.col("r_lon") - F.col("lon")) ** 2 + (F.col("r_lat") - F.col("lat")) ** 2
    best = {}
    for r in left.crossJoin(right).select("id", "rid", d2.alias("d2")).collect():
        if r.id not in best or (r.d2, r.rid) < best[r.id]:
            best[r.id] = (r.d2, r.rid)
    assert nn == {k: v[1] for k, v in best.items()}


def test_nearest_far_outlier_settles(spark):
    left = spark.createDataFrame([(1, 160.0, -20.0)], "id int, lon double, lat double")
    right = spark.createDataFrame([(1, 151.0, -34.0), (2, 151.001, -34.0)], "rid int, r_lon double, r_lat double")
    assert [r.rid for r in S.nearest_neighbour(left, right, "id", "rid", size=0.001).collect()] == [2]


def test_buffer_ring_and_mercator(spark):
    r = spark.range(1).select(G.buffer_ring_3857(151.2, -33.87).alias("ring")).first().ring
    assert len(r) == 33 and r[0] == r[-1]
    rad = [math.hypot((p.x - 151.2) * math.cos(math.radians(-33.87)), p.y + 33.87) * 111195 for p in r]
    assert 4000 < min(rad) and max(rad) < 4300  # ~5 km Mercator units is ~4.15 km true
    x, y = G.to_3857(F.lit(151.2), F.lit(-33.87))
    back = spark.range(1).select(*G.from_3857(x, y)).first()
    assert abs(back[0] - 151.2) < 1e-9 and abs(back[1] + 33.87) < 1e-9


def test_boundary_distance_join_equals_brute_force(spark):
    random.seed(5)
    pts = spark.createDataFrame([(i, 151 + random.uniform(0, 0.05), -34 + random.uniform(0, 0.05)) for i in range(600)],
                                "id int, lon double, lat double")
    ring = [(151.01, -33.99), (151.04, -33.99), (151.04, -33.96), (151.01, -33.96), (151.01, -33.99)]
    poly = _poly(spark, [ring]).withColumnRenamed("id", "pid")
    grid = {r.id for r in S.near_polygon_boundary(pts, poly, "pid", 300.0, size=0.002).collect()}
    dist = F.array_min(F.transform(F.col("rings"), lambda r: G.segment_distance_m(F.col("lon"), F.col("lat"), r)))
    brute = {r.id for r in pts.crossJoin(poly).filter(dist <= 300.0).collect()}
    assert grid == brute and grid


def test_staged_vincenty_equals_expression_form(spark):
    random.seed(21)
    rows = [(151 + random.uniform(-1, 1), -34 + random.uniform(-1, 1), 151 + random.uniform(-1, 1), -34 + random.uniform(-1, 1))
            for _ in range(200)] + [(151.0, -34.0, 151.0, -34.0), (None, -34.0, 151.0, -34.0)]
    df = spark.createDataFrame(rows, "lon1 double, lat1 double, lon2 double, lat2 double")
    a = G.with_vincenty(df.withColumn("e", G.vincenty_m("lat1", "lon1", "lat2", "lon2")), "lat1", "lon1", "lat2", "lon2", "s")
    for r in a.collect():
        assert (r.e is None and r.s is None) or abs(r.e - r.s) < 1e-6


def test_interior_cells_with_hole_and_parts(spark):
    random.seed(13)
    shell = [(0.0, 0.0), (0.1, 0.0), (0.1, 0.1), (0.05, 0.06), (0.0, 0.1), (0.0, 0.0)]
    hole = [(0.02, 0.02), (0.02, 0.04), (0.04, 0.04), (0.04, 0.02), (0.02, 0.02)]
    part = [(0.2, 0.2), (0.25, 0.2), (0.25, 0.25), (0.2, 0.2)]
    poly = _poly(spark, [shell, hole, part]).withColumnRenamed("id", "pid")
    pts = [(i, random.uniform(-0.01, 0.26), random.uniform(-0.01, 0.26)) for i in range(3000)]
    pts += [(9000, 0.02, 0.03), (9001, 0.1, 0.05), (9002, 0.05, 0.06), (9003, 0.03, 0.03)]  # hole edge, shell edge, vertex, in hole
    p = spark.createDataFrame(pts, "id int, lon double, lat double")
    cells = S.classified_cells(poly, "pid", 0.005)
    assert cells.filter("_inside").count() > 50  # the fine grid really has wholly-inside cells
    fast = {r.id for r in S.points_in_polygons(p, poly, "pid", size=0.005, point_id="id").collect()}
    slow = {r.id for r in S.points_in_polygons(p, poly, "pid", size=0.005, method="rings").collect()}
    single = {r.id for r in S.points_in_polygons(p, poly, "pid", size=0.005, point_id="id", single_pass=True).collect()}
    assert fast == slow == single and len(fast) > 300
    assert not ({9000, 9001, 9002, 9003} & fast)


def test_polygon_edges_on_cell_boundaries(spark):
    # Edges lie exactly on cell lines of the 0.01 grid; points on, just inside and
    # just outside them; fast (classified cells) and ring methods must agree.
    shell = [(0.02, 0.02), (0.05, 0.02), (0.05, 0.04), (0.03, 0.04), (0.03, 0.06), (0.02, 0.06), (0.02, 0.02)]
    poly = _poly(spark, [shell]).withColumnRenamed("id", "pid")
    pts, i = [], 0
    for x in [0.0199999, 0.02, 0.0200001, 0.025, 0.03, 0.0300001, 0.045, 0.05, 0.0500001]:
        for y in [0.0199999, 0.02, 0.0200001, 0.03, 0.04, 0.0400001, 0.05, 0.06, 0.0600001]:
            pts.append((i, x, y))
            i += 1
    p = spark.createDataFrame(pts, "id int, lon double, lat double")
    for size in (0.01, 0.005):
        fast = {r.id for r in S.points_in_polygons(p, poly, "pid", size=size, point_id="id").collect()}
        slow = {r.id for r in S.points_in_polygons(p, poly, "pid", size=size, method="rings").collect()}
        assert fast == slow and fast


def test_sydney_melbourne_pair(spark):
    # The CBD points of the two cities (the reference's fixed values): spheroid and
    # sphere distances as quoted for this pair.
    r = spark.range(1).select(G.vincenty_m(-33.8688, 151.2093, -37.8136, 144.9631).alias("v"),
                              G.haversine_m(-33.8688, 151.2093, -37.8136, 144.9631).alias("h")).first()
    assert round(r.v, 3) == 713857.665 and round(r.h, 3) == 713427.481


def test_cover_of_a_large_polygon_is_small(spark):
    from wattle.operators.grid import Cover
    ring = [(150.0, -35.0), (155.0, -35.0), (155.0, -30.0), (150.0, -30.0), (150.0, -35.0)]
    hole = [(151.0, -34.0), (152.0, -33.0), (153.0, -34.0), (151.0, -34.0)]
    rings = [[{"x": x, "y": y} for x, y in r] for r in (ring, hole)]
    tiny = [[{"x": 150.5 + x * 1e-4, "y": -31.0 + y * 1e-4} for x, y in ((0, 0), (1, 0), (1, 1), (0, 0))]]
    polys = spark.createDataFrame([(1, rings), (2, tiny)], "pid int, rings array<array<struct<x:double,y:double>>>")
    cover = Cover(polys, "pid", 0.0025)
    counts = {r["pid"]: r["count"] for r in cover.cells.groupBy("pid").count().collect()}
    assert counts[1] < 10_000 and 1 <= counts[2] <= 4  # 4 million cells of one size
    rng = random.Random(3)
    pts = [(i, rng.uniform(149.9, 155.1), rng.uniform(-35.1, -29.9)) for i in range(3000)] + [(5000 + i, 150.5 + i * 1e-5, -31.0 + i * 5e-6) for i in range(12)]
    p = spark.createDataFrame(pts, "id long, lon double, lat double")
    fast = sorted((r.id, r.pid) for r in S.points_in_polygons(p, polys, "pid", size=0.0025, point_id="id").collect())
    slow = sorted((r.id, r.pid) for r in S.points_in_polygons(p, polys, "pid", size=0.5, method="rings").collect())
    assert fast == slow and len(fast) > 2000


def test_walk_meets_the_cells_of_a_diagonal(spark):
    from pyspark.sql import functions as F

    from wattle.operators.grid import walk_segments
    edges = [(1, 150.0, -34.0, 151.0, -33.0), (2, 150.0, -34.0, 150.0, -33.5), (3, 150.001, -34.0, 150.9, -34.0), (4, 150.2, -33.2, 150.2, -33.2), (5, 151.0, -33.0, 150.3, -34.0)]
    df = spark.createDataFrame(edges, "id int, ax double, ay double, bx double, by double")
    met = {}
    for r in walk_segments(df, F.lit(0.0025), F.lit(0.002), F.lit(0.002)).collect():
        met.setdefault(r.id, set()).add((r._cx, r._cy))
    assert len(met[1]) < 8 * 400  # the box holds 160,000
    for i, ax, ay, bx, by in edges:
        for k in range(2001):
            t = k / 2000
            for dx, dy in ((0, 0), (0.0019, 0), (0, -0.0019), (-0.0013, 0.0013)):
                assert (math.floor((ax + (bx - ax) * t + dx) / 0.0025), math.floor((ay + (by - ay) * t + dy) / 0.0025)) in met[i]


def test_disc_counts_equal_pairs(spark):
    from pyspark.sql import functions as F

    from wattle.functions import geo as G
    from wattle.operators.grid import disc_counts, surely_within_m
    rng = random.Random(8)
    centres = spark.createDataFrame([(i, rng.uniform(151, 151.2), rng.uniform(-34, -33.8)) for i in range(20)] + [(99, None, None), (100, 10.0, 10.0)], "id int, lon double, lat double")
    dots = spark.createDataFrame([(rng.gauss(151.1, 0.05), rng.gauss(-33.9, 0.05)) for _ in range(4000)], "r_lon double, r_lat double")
    _, lon = S.degree_margins(2000.0, F.col("_y"))
    got = disc_counts(centres, dots, "id", math.degrees(2000.0 / G.EARTH_RADIUS_M) * 1.000001, {"n": (surely_within_m(2000.0), G.haversine_m("_y", "_x", "r_lat", "r_lon") <= 2000.0)}, reach_lon=lon)
    want = S.within_distance(centres, dots, 2000.0).groupBy("id").count()
    assert sorted((r.id, r.n) for r in got.filter("n > 0").collect()) == sorted(map(tuple, want.collect()))


def test_nearest_pages_in_sparse_and_dense_places(spark):
    rng = random.Random(9)
    left = [(i, rng.uniform(-170, 170), rng.uniform(-80, 80)) for i in range(15)] + [(50, 151.0, -33.0)]
    right = [(i, rng.gauss(151.0, 0.01), rng.gauss(-33.0, 0.01)) for i in range(600)] + [(900, -100.0, 40.0), (901, 151.0, -33.0), (902, 151.0, -33.0)]
    l = spark.createDataFrame(left, "id int, lon double, lat double")
    r = spark.createDataFrame(right, "rid int, r_lon double, r_lat double")
    near = {x.id: x.rid for x in S.nearest_neighbour(l, r, "id", "rid", size=0.001).collect()}
    key = lambda a, b: ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0])
    assert near == {a[0]: min(right, key=lambda b: key(a, b))[0] for a in left}
    page = S.radius_page(l, r, "id", "rid", km=2.0, r_deg=0.02, page_no=2, page_size=7).collect()
    a = left[-1]
    from wattle.functions.geo import vincenty_m
    d = {x.rid: x.d for x in r.select("rid", (vincenty_m(-33.0, 151.0, "r_lat", "r_lon") / 1000).alias("d")).collect()}
    fits = [b for b in sorted(right, key=lambda b: key(a, b)) if round(d[b[0]], 2) <= 2.0 and key(a, b)[0] <= 0.02 ** 2]
    assert [x.rid for x in sorted(page, key=lambda x: x["rank"])] == [b[0] for b in fits[7:14]]
    assert [x.rid for x in sorted(page, key=lambda x: x["position"])] == [b[0] for b in sorted(fits[7:14], key=lambda b: (round(d[b[0]], 2), b[0]))]


def test_cover_of_some_polygons(spark):
    """The cover of some polygons is part of the whole one, and the points near it are all that can lie in them."""
    from wattle.operators.grid import Cover

    rng = random.Random(3)
    ring = lambda x, y, w: [[{"x": x, "y": y}, {"x": x + w, "y": y}, {"x": x + w / 2, "y": y + w}, {"x": x, "y": y}]]
    rows = [(i, ring(151 + rng.random(), -34 + rng.random(), rng.choice([0.004, 0.05, 0.9]) if i else 0.05)) for i in range(12)]
    schema = "pid int, rings array<array<struct<x:double,y:double>>>"
    polys = spark.createDataFrame(rows, schema)
    points = spark.createDataFrame([(i, 150.9 + 1.2 * rng.random(), -34.1 + 1.2 * rng.random()) for i in range(3000)] + [(-1, None, None)], "id int, lon double, lat double")
    whole = Cover(polys, "pid", 0.0025)
    for some in ([0], [3, 5], []):
        own = Cover(spark.createDataFrame([r for r in rows if r[0] in some], schema), "pid", 0.0025)
        part = whole.of(spark.createDataFrame([(i,) for i in some], "pid int"))
        assert sorted(map(tuple, part.cells.collect())) == sorted(map(tuple, own.cells.collect())) and part.levels == own.levels
        assert sorted(map(tuple, part.edges.collect())) == sorted(map(tuple, own.edges.collect()))
        near = {r.id for r in part.near(points, "lon", "lat").collect()}
        found = {r.id for r in own.candidates(points, "lon", "lat").select("id").collect()}
        assert found <= near and len(near) < (3000 if some else 1)
    polygons = polys.filter("pid IN (3, 5)")
    once = S.points_in_polygons(points, polygons, "pid", 0.0025, point_id="id", once=True, cover=whole.of(polygons.select("pid")))
    assert sorted((r.id, r.pid) for r in once.collect()) == sorted((r.id, r.pid) for r in S.points_in_polygons(points, polygons, "pid", 0.0025, point_id="id").collect())
