"""Spatial joins as grid-cell equi-joins.

No spatial index exists in Spark, so the plan is the one a spatial index gives
a database, expressed with ordinary operators:

1. every point gets a cell ``(floor(lon/s), floor(lat/s))``;
2. every polygon / search disc is exploded to the cells its bounding box covers;
3. an equi-join on the cell pairs candidates (hash-partitioned on the cell, so
   it scales out like any shuffle join; exploded cells go by sort-merge
   (``grid.exploded``), and AQE splits skewed - dense CBD - cells);
4. a bounding-box test, then the exact test (ray casting / distance) filters.

A point lies in exactly one cell, so each (point, polygon) pair is produced at
most once and no de-duplication shuffle is needed.  Big ring arrays are attached
only after the cheap bbox filter, so the shuffle carries ids and boxes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.operators.grid import Cover, crossing_parity, exploded, nearest_cells, ring_edges, walk_segments
from wattle.functions.geo import (EARTH_RADIUS_M, haversine_m, metres_per_degree, point_in_polygon, rings_bbox, square_cell, to_3857, vincenty_m,
                                 with_vincenty)
from wattle.sources.scratch import written

# The sphere (R = 6371 km) and the WGS84 geodesic differ by well under 1 %, so a
# haversine distance outside [0.99, 1.01] x limit decides a geodesic radius test
# without evaluating Vincenty.
_SPHEROID_SLACK = 0.01


def _cells(lo: Column, hi: Column, size: float) -> Column:
    return F.sequence(square_cell(lo, size), square_cell(hi, size))


def polygon_cells(polys: DataFrame, poly_id: str, size: float, rings: str = "rings") -> DataFrame:
    """(poly_id, cx, cy, minx, miny, maxx, maxy) for every cell a polygon's bbox touches."""
    minx, miny, maxx, maxy = rings_bbox(rings)
    b = polys.select(poly_id, minx.alias("minx"), miny.alias("miny"), maxx.alias("maxx"), maxy.alias("maxy"))
    return (b.withColumn("cx", F.explode(_cells(F.col("minx"), F.col("maxx"), size)))
             .withColumn("cy", F.explode(_cells(F.col("miny"), F.col("maxy"), size))))


def polygon_edges(polys: DataFrame, poly_id: str, band: float, rings: str = "rings") -> DataFrame:
    """(poly_id, band, ax, ay, bx, by, maxx) for every ring edge and every latitude band
    ``floor(y / band)`` the edge spans (horizontal edges included, for the on-edge test)."""
    r = polys.select(poly_id, F.explode(rings).alias("_r"))
    n = F.size("_r") - 1
    e = r.select(poly_id, F.inline(F.zip_with(F.slice("_r", 1, n), F.slice("_r", 2, n),
                                              lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"),
                                                                    b["x"].alias("bx"), b["y"].alias("by")))))
    return e.select(poly_id, "ax", "ay", "bx", "by", F.greatest("ax", "bx").alias("maxx"),
                    F.explode(_cells(F.least("ay", "by"), F.greatest("ay", "by"), band)).alias("_band"))


def _parity_pairs(cand: DataFrame, edges: DataFrame, poly_id: str, keys: list[str], lon: str, lat: str,
                  size: float) -> DataFrame:
    """(keys, poly_id) rows of ``cand`` whose point is strictly inside the polygon:
    odd crossing count over the edges of the point's latitude band that reach east
    of it, and on no edge.  Plain column arithmetic, aggregated per key."""
    px, py = F.col(lon), F.col(lat)
    ax, ay, bx, by = F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")
    cross = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    touch = (((bx - ax) * (py - ay) - (by - ay) * (px - ax)) == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) \
        & py.between(F.least(ay, by), F.greatest(ay, by))
    return (cand.withColumn("_band", square_cell(lat, size))
                .join(exploded(edges), [poly_id, "_band"]).filter(F.col("maxx") >= px)
                .groupBy(*keys, poly_id)
                .agg(F.sum(F.when(cross, 1).otherwise(0)).alias("_n"), F.max(touch).alias("_t"))
                .filter((F.col("_n") % 2 == 1) & ~F.col("_t"))
                .drop("_n", "_t"))


def classified_cells(polys: DataFrame, poly_id: str, size: float, rings: str = "rings") -> DataFrame:
    """(poly_id, _cx, _cy, _inside) for the cells of each polygon's bounding box that
    matter: ``_inside`` true for cells wholly inside the polygon, false for cells
    an edge may cross (their points need the exact test); cells wholly outside
    are dropped.

    A cell no edge's box touches cannot contain a boundary point, so all its
    points share the inside/outside status of its centre, which is tested once.
    """
    edges = polygon_edges(polys, poly_id, size, rings)
    boundary = (edges.withColumn("_cx", F.explode(_cells(F.least("ax", "bx"), F.greatest("ax", "bx"), size)))
                     .select(poly_id, "_cx", F.col("_band").alias("_cy")).distinct()
                     .withColumn("_edge", F.lit(True)))
    cells = (polygon_cells(polys, poly_id, size, rings).select(poly_id, F.col("cx").alias("_cx"), F.col("cy").alias("_cy"))
             .join(exploded(boundary), [poly_id, "_cx", "_cy"], "left"))
    open_cells = (cells.filter(F.col("_edge").isNull())
                       .select(poly_id, "_cx", "_cy",
                               ((F.col("_cx") + F.lit(0.5)) * F.lit(size)).alias("_x"),
                               ((F.col("_cy") + F.lit(0.5)) * F.lit(size)).alias("_y")))
    inside = _parity_pairs(open_cells, edges, poly_id, ["_cx", "_cy"], "_x", "_y", size).withColumn("_inside", F.lit(True))
    edge_cells = cells.filter(F.col("_edge").isNotNull()).select(poly_id, "_cx", "_cy", F.lit(False).alias("_inside"))
    return edge_cells.unionByName(inside)


def points_in_polygons(points: DataFrame, polys: DataFrame, poly_id: str, size: float = 0.01,
                       lon: str = "lon", lat: str = "lat", rings: str = "rings", keep_rings: bool = False,
                       point_id: str | None = None, method: str = "edges", single_pass: bool = False,
                       once: bool = False, cover: Cover | None = None) -> DataFrame:
    """All (point, polygon) pairs with ``ST_Contains(polygon, point)``.

    Output: the point columns plus ``poly_id`` and the polygon's other columns
    (rings dropped unless ``keep_rings``).  Points without coordinates never match.

    ``method='edges'`` (default): points join the polygons' quadtree cover (``grid.Cover``):
    large cells inside, small ones along the border.  A point in an inside cell is a hit
    at once; a point in a border cell meets only the edges of its band of latitude that
    reach east of it, and crossing parity plus the on-edge test are a ``groupBy`` of
    plain arithmetic (whole-stage codegen, partial aggregation).  Work per point is one
    lookup for each level in use, never the whole ring; the cover grows with the length
    of the borders, not with the polygons' area.  ``size`` is the smallest cell.
    ``method='rings'`` evaluates the ray cast on the ring arrays (higher-order functions;
    simple, slower).

    ``single_pass=True`` classifies cells of one size and handles both kinds in one scan
    and one aggregate (inside hits are shuffled too).

    ``once=True`` writes the pairs of points and cells, which otherwise are joined once for the inside cells and
    once more for the border.  ``cover``: the cover of ``polys`` of that smallest cell, where the caller has it.
    """
    pts = (points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
                 .withColumn("_cx", square_cell(lon, size)).withColumn("_cy", square_cell(lat, size)))
    others = [c for c in polys.columns if c != poly_id and (keep_rings or c != rings)]
    if method == "rings":
        cells = polygon_cells(polys, poly_id, size, rings).withColumnRenamed("cx", "_cx").withColumnRenamed("cy", "_cy")
        cand = (pts.join(exploded(cells), ["_cx", "_cy"])
                   .filter(F.col(lon).between(F.col("minx"), F.col("maxx")) & F.col(lat).between(F.col("miny"), F.col("maxy")))
                   .drop("_cx", "_cy", "minx", "miny", "maxx", "maxy"))
        hit = cand.join(polys, poly_id).filter(point_in_polygon(F.col(rings), F.col(lon), F.col(lat)))
        return hit if keep_rings else hit.drop(rings)
    if point_id is None:
        raise ValueError("method='edges' needs point_id (a unique point key)")
    if single_pass:
        cand = pts.join(exploded(classified_cells(polys, poly_id, size, rings)), ["_cx", "_cy"]).drop("_cx", "_cy")
    else:
        cover = cover or Cover(polys, poly_id, size, rings)
        cand = cover.candidates(pts.drop("_cx", "_cy"), lon, lat)
        if once:
            cand = written(cand, "candidates")
    carried = [c for c in cand.columns if c not in (point_id, poly_id, "_inside", "_band")]
    if single_pass:
        # One scan: boundary-cell rows pick up their band's edges through a
        # conditional left join, inside-cell rows pass through untouched, and one
        # aggregate decides both.
        edges = polygon_edges(polys, poly_id, size, rings)
        px, py = F.col(lon), F.col(lat)
        ax, ay, bx, by = F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")
        c = cand.withColumn("_band", square_cell(lat, size)).alias("c")
        e = exploded(edges).alias("e")
        cond = ((F.col("c." + poly_id) == F.col("e." + poly_id)) & (F.col("c._band") == F.col("e._band"))
                & ~F.col("c._inside") & (F.col("e.maxx") >= F.col("c." + lon)))
        j = c.join(e, cond, "left").select("c.*", "e.ax", "e.ay", "e.bx", "e.by")
        cross = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        touch = (((bx - ax) * (py - ay) - (by - ay) * (px - ax)) == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) \
            & py.between(F.least(ay, by), F.greatest(ay, by))
        hit = (j.groupBy(point_id, poly_id, "_inside", *carried)
                .agg(F.sum(F.when(cross, 1).otherwise(0)).alias("_n"), F.max(F.coalesce(touch, F.lit(False))).alias("_t"))
                .filter(F.col("_inside") | ((F.col("_n") % 2 == 1) & ~F.col("_t")))
                .drop("_n", "_t", "_inside"))
    else:
        direct = cand.filter(F.col("_inside")).drop("_inside", "_band")
        tested = crossing_parity(cand.filter(~F.col("_inside")).drop("_inside"), cover.edges, poly_id, [point_id, *carried], lon, lat)
        hit = direct.unionByName(tested)
    return hit.join(polys.select(poly_id, *others), poly_id) if others else hit


def degree_margins(meters: float, lat: Column, spheroid: bool = False) -> tuple[Column, Column]:
    """Conservative (dlat, dlon) in degrees that contain every point within ``meters``."""
    r = EARTH_RADIUS_M * (0.99 if spheroid else 1.0)  # the spheroid's meridian radius dips ~0.7 % below the mean
    dlat = math.degrees(meters / r) * 1.000001
    far = F.least(F.lit(89.9), F.abs(lat) + F.lit(dlat))
    return F.lit(dlat), F.lit(dlat) / F.cos(F.radians(far))


def within_distance(left: DataFrame, right: DataFrame, meters: float, size: float | None = None,
                    left_lon: str = "lon", left_lat: str = "lat", right_lon: str = "r_lon", right_lat: str = "r_lat",
                    metric: str = "haversine", distance_col: str = "distance_m") -> DataFrame:
    """J19/SP6: all (left, right) point pairs within ``meters``.

    The (usually smaller) left side is exploded to the cells of its search box;
    the right side stays put in its own cell.  ``metric`` is ``haversine``
    (sphere) or ``vincenty`` (WGS84 spheroid, the reference's geography type).
    Column names of the two sides must not clash (rename before calling).
    """
    spheroid = metric == "vincenty"
    if size is None:
        size = math.degrees(meters / EARTH_RADIUS_M) * 1.25
    dlat, dlon = degree_margins(meters, F.col(left_lat), spheroid)
    l = (left.filter(F.col(left_lon).isNotNull() & F.col(left_lat).isNotNull())
             .withColumn("_minx", F.col(left_lon) - dlon).withColumn("_maxx", F.col(left_lon) + dlon)
             .withColumn("_miny", F.col(left_lat) - dlat).withColumn("_maxy", F.col(left_lat) + dlat))
    l = (l.withColumn("_cx", F.explode(_cells(F.col("_minx"), F.col("_maxx"), size)))
          .withColumn("_cy", F.explode(_cells(F.col("_miny"), F.col("_maxy"), size))))
    r = (right.filter(F.col(right_lon).isNotNull() & F.col(right_lat).isNotNull())
              .withColumn("_cx", square_cell(right_lon, size)).withColumn("_cy", square_cell(right_lat, size)))
    j = (l.join(r, ["_cx", "_cy"])
          .filter(F.col(right_lon).between(F.col("_minx"), F.col("_maxx")) &
                  F.col(right_lat).between(F.col("_miny"), F.col("_maxy"))))
    hav = haversine_m(F.col(left_lat), F.col(left_lon), F.col(right_lat), F.col(right_lon))
    j = j.drop("_cx", "_cy", "_minx", "_maxx", "_miny", "_maxy")
    if not spheroid:
        return j.withColumn(distance_col, hav).filter(F.col(distance_col) <= F.lit(float(meters)))
    m = float(meters)
    inside = (F.when(hav <= F.lit(m * (1 - _SPHEROID_SLACK)), F.lit(True))
               .when(hav > F.lit(m * (1 + _SPHEROID_SLACK)), F.lit(False))
               .otherwise(vincenty_m(F.col(left_lat), F.col(left_lon), F.col(right_lat), F.col(right_lon)) <= F.lit(m)))
    return with_vincenty(j.filter(inside), left_lat, left_lon, right_lat, right_lon, distance_col)


def nearest_neighbour(left: DataFrame, right: DataFrame, left_id: str, right_id: str, size: float = 0.01,
                      left_lon: str = "lon", left_lat: str = "lat", right_lon: str = "r_lon", right_lat: str = "r_lat",
                      exclude_self: bool = False, report_metres: bool = True) -> DataFrame:
    """For each left point the nearest right point (planar degrees, as the
    reference's ``<->`` ordering), ties to the smaller right id; optionally
    excluding the pair with equal ids (self).  ``distance_m`` is the WGS84
    geodesic distance of the chosen pair.

    Exact and without rounds: counts of cells of all sizes tell how far each point's search must
    reach (``grid.nearest_cells``), and one join meets the points of those cells.  ``size`` is the smallest cell.
    """
    rr = right.filter(F.col(right_lon).isNotNull() & F.col(right_lat).isNotNull()).select(right_id, right_lon, right_lat)
    ll = left.filter(F.col(left_lon).isNotNull() & F.col(left_lat).isNotNull()).select(left_id, left_lon, left_lat)
    cells = nearest_cells(ll, rr, left_id, 2 if exclude_self else 1, size, left_lon, left_lat, right_lon, right_lat)
    j = cells.join(rr.withColumn("_fx", square_cell(right_lon, size)).withColumn("_fy", square_cell(right_lat, size)), ["_fx", "_fy"])
    if exclude_self:
        j = j.filter(F.col(left_id) != F.col(right_id))
    dx, dy = F.col(right_lon) - F.col(left_lon), F.col(right_lat) - F.col(left_lat)
    best = j.groupBy(left_id, left_lon, left_lat).agg(F.min(F.struct(
        (dx * dx + dy * dy).alias("d2"), F.col(right_id).alias("rid"), F.col(right_lon).alias("rx"), F.col(right_lat).alias("ry"))).alias("b"))
    out = best.select(left_id, left_lon, left_lat, F.col("b.rid").alias(right_id), F.sqrt(F.col("b.d2")).alias("distance_deg"),
                      F.col("b.rx").alias("_rx"), F.col("b.ry").alias("_ry"))
    if report_metres:
        out = out.withColumn("distance_m", vincenty_m(left_lat, left_lon, "_ry", "_rx"))  # one row a point: a small plan counts for more
    return out.drop("_rx", "_ry")


def near_polygon_boundary(points: DataFrame, polys: DataFrame, poly_id: str, meters: float, size: float | None = None,
                          lon: str = "lon", lat: str = "lat", rings: str = "rings", point_id: str | None = None, spheroid: bool = False,
                          few: bool = False) -> DataFrame:
    """J20/SP9: (point, polygon) pairs whose distance to the polygon boundary is at most
    ``meters`` (inside or outside), with ``boundary_m``.

    Every ring edge is exploded to the cells that it comes within the distance of (``grid.walk_segments``:
    as many as its length asks for, also where it slants); a
    point meets only the edges of its own cell (an edge within ``meters`` always
    covers the point's cell), the point-segment distance is plain column
    arithmetic in a local plane around the point, and the minimum per (point,
    polygon) is an aggregate.  Work per point is the few edges near it, however
    detailed the polygon.

    ``spheroid=True`` measures with the spheroid's radii of curvature at the point
    (metres of a degree north and east) in place of the sphere's.

    ``few=True``: a handful of polygons, whatever the data; the planner may broadcast their edges.
    """
    slack = 0.99 if spheroid else 1.0  # a degree of the spheroid's meridian is up to 0.7 % shorter
    dlat = math.degrees(meters / (EARTH_RADIUS_M * slack)) * 1.000001
    if size is None:
        size = 2 * dlat  # cells about twice the margin: few edges per point, few cells per edge
    e = ring_edges(polys, poly_id, rings)
    far = F.least(F.lit(89.9), F.greatest(F.abs("ay"), F.abs("by")) + F.lit(dlat))
    e = walk_segments(e, F.lit(float(size)), F.lit(dlat) / F.cos(F.radians(far)), F.lit(dlat))
    pid = point_id or "_pid"
    pts = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull())
    if point_id is None:
        pts = pts.withColumn(pid, F.monotonically_increasing_id())
    carried = [c for c in pts.columns if c != pid]
    pts = pts.withColumn("_cx", square_cell(lon, size)).withColumn("_cy", square_cell(lat, size))
    x, y = F.col(lon), F.col(lat)
    kx, ky = metres_per_degree(y) if spheroid else (F.lit(math.pi / 180 * EARTH_RADIUS_M) * F.cos(F.radians(y)), F.lit(math.pi / 180 * EARTH_RADIUS_M))
    j = (pts.join(e if few else exploded(e), ["_cx", "_cy"])
            .withColumn("_ax", (F.col("ax") - x) * kx).withColumn("_ay", (F.col("ay") - y) * ky)
            .withColumn("_bx", (F.col("bx") - x) * kx).withColumn("_by", (F.col("by") - y) * ky)
            .withColumn("_dx", F.col("_bx") - F.col("_ax")).withColumn("_dy", F.col("_by") - F.col("_ay"))
            .withColumn("_l2", F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))
            .withColumn("_t", F.when(F.col("_l2") == 0, F.lit(0.0)).otherwise(
                F.least(F.lit(1.0), F.greatest(F.lit(0.0), -(F.col("_ax") * F.col("_dx") + F.col("_ay") * F.col("_dy")) / F.col("_l2")))))
            .withColumn("_qx", F.col("_ax") + F.col("_t") * F.col("_dx"))
            .withColumn("_qy", F.col("_ay") + F.col("_t") * F.col("_dy"))
            .withColumn("_d", F.sqrt(F.col("_qx") * F.col("_qx") + F.col("_qy") * F.col("_qy"))))
    # Filter after the aggregate: a filter on ``_d`` before it would be pushed into
    # the join condition with the whole distance expression inlined there (no
    # common-subexpression elimination in join conditions); in the projection
    # feeding the aggregate, codegen computes each shared term once.
    out = (j.groupBy(pid, poly_id, *carried).agg(F.min("_d").alias("boundary_m"))
            .filter(F.col("boundary_m") <= F.lit(float(meters))))
    return out.drop("_pid") if point_id is None else out


def within_planar_disc(left: DataFrame, right: DataFrame, r_deg: float, left_lon: str = "lon", left_lat: str = "lat",
                       right_lon: str = "r_lon", right_lat: str = "r_lat") -> DataFrame:
    """SP5: pairs with planar distance in degrees ``<= r_deg`` (``ST_DWithin`` on
    4326 geometry), with ``d2`` = squared planar distance.  Cells of size r_deg,
    3x3 block around the left point."""
    l = (left.filter(F.col(left_lon).isNotNull() & F.col(left_lat).isNotNull())
             .withColumn("_cx", F.explode(F.sequence(square_cell(left_lon, r_deg) - 1, square_cell(left_lon, r_deg) + 1)))
             .withColumn("_cy", F.explode(F.sequence(square_cell(left_lat, r_deg) - 1, square_cell(left_lat, r_deg) + 1))))
    r = (right.filter(F.col(right_lon).isNotNull() & F.col(right_lat).isNotNull())
              .withColumn("_cx", square_cell(right_lon, r_deg)).withColumn("_cy", square_cell(right_lat, r_deg)))
    dx, dy = F.col(right_lon) - F.col(left_lon), F.col(right_lat) - F.col(left_lat)
    return (l.join(r, ["_cx", "_cy"]).withColumn("d2", dx * dx + dy * dy)
             .filter(F.col("d2") <= F.lit(float(r_deg) ** 2)).drop("_cx", "_cy"))


def radius_page(left: DataFrame, right: DataFrame, left_id: str, right_id: str, km: float = 5.0,
                r_deg: float = 0.045, page_no: int = 1, page_size: int = 100, faithful: bool = False,
                metric: str = "vincenty", start_deg: float | None = None, **cols) -> DataFrame:
    """O3: the radius page for many centres at once.

    Candidates are the planar disc of ``r_deg`` degrees (SP5); each gets
    ``distance_km`` (geodesic by default, rounded to 2 dp) and a rank by planar
    distance (ties: smaller right id).  ``faithful=True`` reproduces the
    reference: rank within the disc, cut the page, *then* drop rows beyond
    ``km`` (pages may come out short).  The default filters by ``km`` first and
    pages the remaining rows.

    Only the first ``page_no * page_size`` ranks matter: counts of cells tell how far each
    centre's search must reach for them (``grid.nearest_cells``), at most ``r_deg``.  Points within ``km`` whatever
    their direction can't be dropped, so they alone shorten the search.  Work follows the page size,
    not the disc's population; there is no round and no action.  Ranks use ``row_number() <= literal``, which
    Spark limits map-side.  ``position`` is the row's place on the page by distance, then right id: the reference's final order.
    """
    from pyspark.sql import Window
    llon, llat = cols.get("left_lon", "lon"), cols.get("left_lat", "lat")
    rlon, rlat = cols.get("right_lon", "r_lon"), cols.get("right_lat", "r_lat")
    hi, lo = page_no * page_size, (page_no - 1) * page_size
    centres = left.filter(F.col(llon).isNotNull() & F.col(llat).isNotNull())
    dots = right.filter(F.col(rlon).isNotNull() & F.col(rlat).isNotNull())
    size = start_deg or r_deg / 6
    # a degree measures 111.7 km at most
    cells = nearest_cells(centres, dots, left_id, hi, size, llon, llat, rlon, rlat, r_deg, None if faithful else min(r_deg, km / 111.7))
    cand = cells.join(dots.withColumn("_fx", square_cell(rlon, size)).withColumn("_fy", square_cell(rlat, size)), ["_fx", "_fy"]).drop("_fx", "_fy")
    dx, dy = F.col(rlon) - F.col(llon), F.col(rlat) - F.col(llat)
    cand = cand.withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= F.lit(float(r_deg) ** 2))
    hav = haversine_m(F.col(llat), F.col(llon), F.col(rlat), F.col(rlon))
    rounded = lambda m: F.round(m / 1000.0, 2)
    if metric == "vincenty":
        # the sphere decides but for a narrow band; page rows alone get the spheroid's distance as a column
        fits = (F.when(hav <= F.lit(km * 1000.0 * (1 - _SPHEROID_SLACK)), F.lit(True)).when(hav > F.lit((km * 1000.0 + 5.0) * (1 + _SPHEROID_SLACK)), F.lit(False))
                .otherwise(rounded(vincenty_m(F.col(llat), F.col(llon), F.col(rlat), F.col(rlon))) <= F.lit(float(km))))
    else:
        fits = rounded(hav) <= F.lit(float(km))
    if not faithful:
        cand = cand.filter(fits)
    w = Window.partitionBy(left_id).orderBy("d2", right_id)
    out = cand.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= hi)
    out = out.filter(F.col("rank") > lo)
    if faithful:
        out = out.filter(fits)
    out = with_vincenty(out, llat, llon, rlat, rlon, "_m") if metric == "vincenty" else out.withColumn("_m", hav)
    out = out.withColumn("distance_km", rounded(F.col("_m"))).drop("_m")
    out = out.withColumn("position", F.row_number().over(Window.partitionBy(left_id).orderBy("distance_km", right_id)).cast("long"))
    others = [c for c in left.columns if c not in (left_id, llon, llat)]
    out = out.join(left.select(left_id, *others), left_id) if others else out
    return out.drop("d2")


def near_polyline(points: DataFrame, lines: DataFrame, line_id: str, meters: float, size: float | None = None,
                  lon: str = "lon", lat: str = "lat", path: str = "path", point_id: str | None = None, spheroid: bool = False,
                  few: bool = False) -> DataFrame:
    """Points within ``meters`` of a polyline (``path array<struct<x,y>>``), with
    ``distance_m``; the grid join of ``near_polygon_boundary`` with the line as one ring."""
    as_rings = lines.select(line_id, F.array(F.col(path)).alias("rings"))
    return (near_polygon_boundary(points, as_rings, line_id, meters, size, lon, lat, "rings", point_id, spheroid, few)
            .withColumnRenamed("boundary_m", "distance_m"))


def within_polygon_distance(points: DataFrame, polys: DataFrame, poly_id: str, units: float, point_id: str, lon: str = "lon", lat: str = "lat",
                            rings: str = "rings", inside_size: float = 0.01) -> DataFrame:
    """(point, polygon) pairs whose distance in Mercator units (EPSG:3857) is at most ``units``, with
    ``distance``; 0 for points inside.

    The edges are exploded to the cells that they come within the distance of, a point meets the edges of its
    cell, and the least distance per pair is an aggregate; points inside come from the point-in-polygon join.
    """
    size = 2.0 * units
    x, y = to_3857(lon, lat)
    pts = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(point_id, x.alias("_x"), y.alias("_y"))
    pts = pts.withColumn("_cx", square_cell("_x", size)).withColumn("_cy", square_cell("_y", size))

    def planar(p: Column) -> Column:
        px, py = to_3857(p["x"], p["y"])
        return F.struct(px.alias("x"), py.alias("y"))

    e = ring_edges(polys.withColumn(rings, F.transform(rings, lambda ring: F.transform(ring, planar))), poly_id, rings)
    e = walk_segments(e, F.lit(size), F.lit(float(units)), F.lit(float(units)))
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    len2 = dx * dx + dy * dy
    t = F.when(len2 == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((F.col("_x") - F.col("ax")) * dx + (F.col("_y") - F.col("ay")) * dy) / len2)))
    qx, qy = F.col("ax") + t * dx - F.col("_x"), F.col("ay") + t * dy - F.col("_y")
    near = pts.join(exploded(e), ["_cx", "_cy"]).select(point_id, poly_id, F.sqrt(qx * qx + qy * qy).alias("d")).groupBy(point_id, poly_id).agg(F.min("d").alias("distance"))
    inside = points_in_polygons(points.select(point_id, lon, lat), polys.select(poly_id, rings), poly_id, inside_size, lon, lat, rings, point_id=point_id)
    both = near.filter(F.col("distance") <= F.lit(float(units))).unionByName(inside.select(point_id, poly_id, F.lit(0.0).alias("distance")))
    return both.groupBy(point_id, poly_id).agg(F.min("distance").alias("distance"))
