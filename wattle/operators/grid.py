"""Cells of several sizes: polygon covers, cells along a segment, and counts for nearest-point searches.

A cell of level l is ``base * 2^l`` degrees wide; its index is the base index shifted right by l, so a point's cells of
all levels follow from one division.
"""

from __future__ import annotations

import copy
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.functions.geo import EARTH_RADIUS_M, haversine_m, rings_bbox, square_cell
from wattle.sources.scratch import written

#: A polygon's finest cells are the base cells, or the next larger ones that cut its box into at most so many columns and rows.
FINEST_CUTS = 256
#: Share of a cell by which walked cells are widened against rounding.
_SLACK = 1e-6


def ring_edges(polys: DataFrame, poly_id: str, rings: str = "rings", *more: str) -> DataFrame:
    """(poly_id, more..., ax, ay, bx, by) for every edge of every ring."""
    r = polys.select(poly_id, *more, F.explode(rings).alias("_r"))
    n = F.size("_r") - 1
    return r.select(poly_id, *more, F.inline(F.zip_with(F.slice("_r", 1, n), F.slice("_r", 2, n), lambda a, b: F.struct(
        a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))))


def exploded(df: DataFrame) -> DataFrame:
    """``df``, whose rows were multiplied by ``explode``, to be joined by sort-merge.  The planner takes its size from the
    table before the explode, and so would send many times that to the driver and to every task (broadcast)."""
    return df.hint("merge")


def _index(v: Column, size: Column) -> Column:
    return F.floor(v / size).cast("long")


def walk_segments(edges: DataFrame, size: Column, margin_x: Column | None = None, margin_y: Column | None = None) -> DataFrame:
    """``edges`` (ax, ay, bx, by) once for each cell (_cx, _cy) that the segment meets, or comes within the margins of.

    Row by row: the part of the segment in a row of cells (grown by the margin) has one stretch of columns.  So the number
    of cells follows the segment's length, also where it slants; its box would hold the square of that.
    """
    pad = size * F.lit(_SLACK)
    mx, my = (F.lit(0.0) if margin_x is None else margin_x) + pad, (F.lit(0.0) if margin_y is None else margin_y) + pad
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    low_x, high_x, low_y, high_y = F.least(ax, bx), F.greatest(ax, bx), F.least(ay, by), F.greatest(ay, by)
    rows = edges.select("*", F.explode(F.sequence(_index(low_y - my, size), _index(high_y + my, size))).alias("_cy"))
    start = F.greatest(low_y, F.least(high_y, F.col("_cy") * size - my))
    end = F.least(high_y, F.greatest(low_y, (F.col("_cy") + 1) * size + my))
    at = lambda y: ax + (bx - ax) * (y - ay) / (by - ay)
    flat = high_y - low_y <= pad
    first = F.greatest(low_x, F.when(flat, low_x).otherwise(F.least(at(start), at(end)))) - mx
    last = F.least(high_x, F.when(flat, high_x).otherwise(F.greatest(at(start), at(end)))) + mx
    return rows.select("*", F.explode(F.sequence(_index(F.least(first, last), size), _index(F.greatest(first, last), size))).alias("_cx"))


def crossing_parity(cand: DataFrame, edges: DataFrame, poly_id: str, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, poly_id) of the rows of ``cand`` whose point lies strictly inside: an odd number of crossings to the east among
    the edges of the point's band of latitude, and on no edge.  ``cand`` and ``edges`` both have ``_band``."""
    px, py = F.col(x), F.col(y)
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    cross = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
    touch = (((bx - ax) * (py - ay) - (by - ay) * (px - ax)) == 0) & px.between(F.least(ax, bx), F.greatest(ax, bx)) & py.between(F.least(ay, by), F.greatest(ay, by))
    met = cand.join(exploded(edges), [poly_id, "_band"]).filter(F.col("maxx") >= px)
    return (met.groupBy(*keys, poly_id).agg(F.sum(F.when(cross, 1).otherwise(0)).alias("_n"), F.max(touch).alias("_t"))
            .filter((F.col("_n") % 2 == 1) & ~F.col("_t")).drop("_n", "_t"))


class Cover:
    """Quadtree cover of polygons: large cells inside, small ones along the border.

    ``cells``: (poly_id, _lv, _cx, _cy, _inside).  The border cells of a polygon all have its finest level; a child of a larger
    border cell that no edge meets lies wholly inside or outside, which its centre tells.  Their number follows the border's
    length in finest cells, at most some FINEST_CUTS a side, whatever the polygon's area.  ``edges`` has each
    polygon's edges by band of its finest cell height.  ``levels`` are those that occur.  Cells and edges are written once.
    """

    def __init__(self, polys: DataFrame, poly_id: str, base: float, rings: str = "rings"):
        self.poly_id, self.base = poly_id, base
        minx, miny, maxx, maxy = rings_bbox(rings)
        width = F.greatest(maxx - minx, maxy - miny, F.lit(base))
        cuts = F.greatest(F.lit(0), F.ceil(F.log2(width / F.lit(base * FINEST_CUTS)))).cast("int")
        sized = polys.select(poly_id, rings, cuts.alias("_fine"), (F.ceil(F.log2(width / F.lit(base))) + 1).cast("int").alias("_top"))
        size = F.lit(base) * F.pow(F.lit(2.0), F.col("_fine"))
        # polygons of few files still occupy every task slot
        sized = sized.repartition(int(polys.sparkSession.conf.get("spark.sql.shuffle.partitions")), poly_id)
        edges = ring_edges(sized, poly_id, rings, "_fine", "_top").withColumn("_size", size)
        met = walk_segments(edges, F.col("_size"))
        border = met.select(poly_id, "_fine", F.explode(F.sequence("_fine", F.greatest("_fine", "_top"))).alias("_lv"), "_cx", "_cy")
        up = F.col("_lv") - F.col("_fine")
        border = border.select(poly_id, "_fine", "_lv", F.call_function("shiftright", "_cx", up).alias("_cx"), F.call_function("shiftright", "_cy", up).alias("_cy")).distinct()
        border = written(border, "cover-border")
        banded = edges.select(poly_id, "ax", "ay", "bx", "by", F.greatest("ax", "bx").alias("maxx"),
                              F.explode(F.sequence(_index(F.least("ay", "by"), F.col("_size")), _index(F.greatest("ay", "by"), F.col("_size")))).alias("_band"))
        self.edges = written(banded, "cover-edges")
        four = F.expr("inline(array(struct(0 AS _dx, 0 AS _dy), struct(0 AS _dx, 1 AS _dy), struct(1 AS _dx, 0 AS _dy), struct(1 AS _dx, 1 AS _dy)))")
        children = (border.filter(F.col("_lv") > F.col("_fine")).select(poly_id, "_fine", (F.col("_lv") - 1).alias("_lv"), F.col("_cx").alias("_px"), F.col("_cy").alias("_py"), four)
                    .select(poly_id, "_fine", "_lv", (F.col("_px") * 2 + F.col("_dx")).alias("_cx"), (F.col("_py") * 2 + F.col("_dy")).alias("_cy")))
        whole = children.join(exploded(border.select(poly_id, "_lv", "_cx", "_cy")), [poly_id, "_lv", "_cx", "_cy"], "left_anti")
        cell = F.lit(base) * F.pow(F.lit(2.0), F.col("_lv"))
        x, y = (F.col("_cx") + 0.5) * cell, (F.col("_cy") + 0.5) * cell
        whole = whole.select(poly_id, "_lv", "_cx", "_cy", x.alias("_x"), y.alias("_y"), _index(y, size).alias("_band"))
        inside = crossing_parity(whole, self.edges, poly_id, ["_lv", "_cx", "_cy"], "_x", "_y").select(poly_id, "_lv", "_cx", "_cy", F.lit(True).alias("_inside"))
        fine = border.filter(F.col("_lv") == F.col("_fine")).select(poly_id, "_lv", "_cx", "_cy", F.lit(False).alias("_inside"))
        self.cells = written(fine.unionByName(inside), "cover")
        self.levels = self._levels()

    def _levels(self) -> list[int]:
        return sorted(r[0] for r in self.cells.select("_lv").distinct().collect())

    def of(self, ids: DataFrame) -> Cover:
        """The cover of those polygons alone (``ids`` has their poly_id)."""
        some = copy.copy(self)
        some.cells = written(self.cells.join(ids, self.poly_id, "left_semi"), "cover")
        some.edges = written(self.edges.join(ids, self.poly_id, "left_semi"), "cover-edges")
        some.levels = some._levels()
        return some

    def near(self, points: DataFrame, lon: str, lat: str) -> DataFrame:
        """The points that lie in a cell of the largest level in use with any cell of the cover in it: all that ``candidates``
        can find a polygon for, from one lookup each."""
        top = max(self.levels, default=0)
        up = F.lit(top) - F.col("_lv")
        places = written(self.cells.select(_shift("_cx", up).alias("_cx"), _shift("_cy", up).alias("_cy")).distinct(), "cover-places")
        at = lambda v: F.call_function("shiftright", square_cell(v, self.base), F.lit(top))
        placed = points.select("*", at(lon).alias("_cx"), at(lat).alias("_cy"))
        return placed.join(places, ["_cx", "_cy"], "left_semi").select(*points.columns)

    def candidates(self, points: DataFrame, lon: str, lat: str) -> DataFrame:
        """``points`` once for each polygon with a cell there, with _inside and, for border cells, the _band of the edges."""
        levels = F.explode(F.array(*(F.lit(v) for v in self.levels))) if self.levels else F.lit(0)
        placed = points.select("*", square_cell(lon, self.base).alias("_ix"), square_cell(lat, self.base).alias("_iy"), levels.alias("_lv"))
        placed = placed.select(*points.columns, "_lv", _shift("_ix", F.col("_lv")).alias("_cx"), _shift("_iy", F.col("_lv")).alias("_cy"))
        return placed.join(exploded(self.cells), ["_lv", "_cx", "_cy"]).withColumnRenamed("_cy", "_band").drop("_lv", "_cx")


# ----------------------------------------------------------------------------- count pyramid
#: Levels of a pyramid are every second one: each cell holds 16 of the level before.
LEVEL_STEP = 2


def count_cells(points: DataFrame, lon: str, lat: str, base: float) -> DataFrame:
    """(_fx, _fy, _n): the number of points in every cell of the base size that has any."""
    return points.groupBy(square_cell(lon, base).alias("_fx"), square_cell(lat, base).alias("_fy")).agg(F.count(F.lit(1)).alias("_n"))


def _levels(base: float) -> list[int]:
    """Up to cells so large that the block around any place on earth holds all of it."""
    top = math.ceil(math.log2(360.0 / base))
    return list(range(0, top + LEVEL_STEP, LEVEL_STEP))


def _shift(c: str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(c), by)


def nearest_cells(centres: DataFrame, points: DataFrame, centre_id: str, k: int, base: float, centre_lon: str, centre_lat: str, lon: str, lat: str,
                  farthest: float | None = None, sure: float | None = None) -> DataFrame:
    """(centre_id, lon, lat of the centre, _fx, _fy): base cells of ``points`` that hold its k nearest points (planar degrees).

    Counts per cell of all levels come from one aggregate.  For each centre the smallest level is chosen at which the block
    of 3 x 3 cells around it holds k points: they lie within 2 sqrt(2) cells, so no farther point is among the k nearest.
    Of the occupied base cells that near, those are kept that the k nearest can lie in: cells in order of their
    farthest corner reach k points at some distance, and cells that begin beyond it go.  No loop and no action.

    ``farthest`` cuts the search off at that distance; where the bound exceeds ``sure``, it is used in place of the bound.
    """
    levels = _levels(base)
    fine = count_cells(points, lon, lat, base)
    above = fine.select("*", F.explode(F.array(*(F.lit(v) for v in [*levels, levels[-1] + LEVEL_STEP]))).alias("_lv"))
    above = above.select("_lv", _shift("_fx", F.col("_lv")).alias("_cx"), _shift("_fy", F.col("_lv")).alias("_cy"), "_fx", "_fy", "_n")
    pyramid = above.groupBy("_lv", "_cx", "_cy").agg(F.sum("_n").alias("_m"))
    around = ", ".join(f"struct({v} AS _lv, {x}L AS _dx, {y}L AS _dy)" for v in levels for x in (-1, 0, 1) for y in (-1, 0, 1))
    own = centres.select(F.col(centre_id).alias("_id"), F.col(centre_lon).alias("_x"), F.col(centre_lat).alias("_y"), F.expr(f"inline(array({around}))"))
    block = own.select("_id", "_x", "_y", "_lv", (F.call_function("shiftright", square_cell("_x", base), F.col("_lv")) + F.col("_dx")).alias("_cx"),
                       (F.call_function("shiftright", square_cell("_y", base), F.col("_lv")) + F.col("_dy")).alias("_cy"))
    held = block.join(pyramid, ["_lv", "_cx", "_cy"]).groupBy("_id", "_x", "_y", "_lv").agg(F.sum("_m").alias("_held"))
    chosen = held.groupBy("_id", "_x", "_y").agg(F.coalesce(F.min(F.when(F.col("_held") >= k, F.col("_lv"))), F.lit(levels[-1])).alias("_at"))
    reach = F.lit(base * 2.000001 * math.sqrt(2.0)) * F.pow(F.lit(2.0), F.col("_at"))
    if farthest is not None:
        reach = F.when(reach > F.lit(farthest if sure is None else sure), F.lit(farthest)).otherwise(reach)
    chosen = chosen.select("_id", "_x", "_y", reach.alias("_reach"), (F.col("_at") + LEVEL_STEP).alias("_lv"), (F.lit(base) * F.pow(F.lit(2.0), F.col("_lv"))).alias("_size"))
    box = ("inline(flatten(transform(sequence(bigint(floor((_x - _reach) / _size)), bigint(floor((_x + _reach) / _size))), i -> "
           "transform(sequence(bigint(floor((_y - _reach) / _size)), bigint(floor((_y + _reach) / _size))), j -> struct(i AS _cx, j AS _cy)))))")
    wide = chosen.select("_id", "_x", "_y", "_reach", "_lv", F.expr(box))
    near, far = _cell_distances(base)
    met = wide.join(above, ["_lv", "_cx", "_cy"]).select("_id", "_x", "_y", "_reach", "_fx", "_fy", "_n", near.alias("_near"), far.alias("_far")).filter("_near <= _reach")
    # the distance by which cells that lie wholly nearer hold k points
    running = Window.partitionBy("_id").orderBy("_far", "_fx", "_fy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = met.select("*", F.sum("_n").over(running).alias("_sum"))
    met = met.select("*", F.min(F.when(F.col("_sum") >= k, F.col("_far"))).over(Window.partitionBy("_id")).alias("_enough"))
    # where points may be rejected later, only cells within the sure distance may cut others off
    counts = F.lit(True) if farthest is None or sure is None else F.col("_enough") <= F.lit(sure)
    met = met.filter(F.col("_near") <= F.coalesce(F.when(counts, F.col("_enough")), F.col("_reach")) * 1.000001)
    return met.select(F.col("_id").alias(centre_id), F.col("_x").alias(centre_lon), F.col("_y").alias(centre_lat), "_fx", "_fy")


def _cell_distances(base: float, x: str = "_x", y: str = "_y") -> tuple[Column, Column]:
    """Planar distance from (x, y) to the nearest and the farthest place of the base cell (_fx, _fy)."""
    low_x, low_y = F.col("_fx") * F.lit(base) - F.col(x), F.col("_fy") * F.lit(base) - F.col(y)
    high_x, high_y = low_x + F.lit(base), low_y + F.lit(base)
    near = lambda lo, hi: F.greatest(lo, -hi, F.lit(0.0))
    far = lambda lo, hi: F.greatest(-lo, hi)
    nx, ny, fx, fy = near(low_x, high_x), near(low_y, high_y), far(low_x, high_x), far(low_y, high_y)
    return F.sqrt(nx * nx + ny * ny), F.sqrt(fx * fx + fy * fy)


# ----------------------------------------------------------------------------- counts within discs
def disc_counts(centres: DataFrame, points: DataFrame, centre_id: str, radius_deg: float, tests: dict[str, tuple], centre_lon: str = "lon", centre_lat: str = "lat",
                lon: str = "r_lon", lat: str = "r_lat", cuts: int = 12, reach_lon: Column | None = None) -> DataFrame:
    """(centre_id, a count for each test) of the points around each centre, without listing the pairs.

    ``tests``: name -> (surely, holds): ``surely`` is a condition on a whole cell, given as columns _near, _far (planar
    distances of its nearest and farthest place), _mid_lon, _mid_lat and its half diagonal in metres _half_m; ``holds`` one on a single
    point.  Cells that pass ``surely`` add their count; cells that fail it and reach into the box have their points tested.
    ``radius_deg`` bounds both coordinates (``reach_lon``, a column of the centre's latitude _y, bounds longitude instead); ``cuts`` cells go into it.  Centres without any point are left out.
    """
    base = radius_deg / cuts
    own = centres.filter(F.col(centre_lon).isNotNull() & F.col(centre_lat).isNotNull()).select(centre_id, F.col(centre_lon).alias("_x"), F.col(centre_lat).alias("_y"))
    dots = points.filter(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(
        F.col(lon).alias(lon), F.col(lat).alias(lat), square_cell(lon, base).alias("_fx"), square_cell(lat, base).alias("_fy"))
    counts = dots.groupBy("_fx", "_fy").agg(F.count(F.lit(1)).alias("_n"))
    reach = F.lit(radius_deg)
    wide = reach if reach_lon is None else reach_lon
    around = (own.withColumn("_fx", F.explode(F.sequence(square_cell(F.col("_x") - wide, base), square_cell(F.col("_x") + wide, base))))
              .withColumn("_fy", F.explode(F.sequence(square_cell(F.col("_y") - reach, base), square_cell(F.col("_y") + reach, base)))))
    met = exploded(around).join(counts, ["_fx", "_fy"])
    near, far = _cell_distances(base)
    met = met.select("*", near.alias("_near"), far.alias("_far"), ((F.col("_fx") + 0.5) * base).alias("_mid_lon"), ((F.col("_fy") + 0.5) * base).alias("_mid_lat"),
                     F.lit(math.radians(base) * EARTH_RADIUS_M).alias("_half_m"))
    met = met.select("*", *(surely.alias(f"_in_{name}") for name, (surely, _) in tests.items()))
    all_in = F.lit(True)
    for name in tests:
        all_in = all_in & F.col(f"_in_{name}")
    whole = met.groupBy(centre_id).agg(*(F.sum(F.when(F.col(f"_in_{name}"), F.col("_n")).otherwise(0)).alias(name) for name in tests))
    rim = met.filter(~all_in).select(centre_id, "_x", "_y", "_fx", "_fy", *(f"_in_{name}" for name in tests))
    tested = exploded(rim).join(dots, ["_fx", "_fy"]).groupBy(centre_id).agg(
        *(F.sum(F.when(~F.col(f"_in_{name}") & holds, 1).otherwise(0)).alias(name) for name, (_, holds) in tests.items()))
    return whole.unionByName(tested).groupBy(centre_id).agg(*(F.sum(name).alias(name) for name in tests))


def surely_within_m(metres: float) -> Column:
    """For ``disc_counts``: every place of the cell is within so many metres of the centre on the sphere, as its middle
    is that near less half a diagonal (triangle inequality)."""
    return haversine_m(F.col("_y"), F.col("_x"), F.col("_mid_lat"), F.col("_mid_lon")) + F.col("_half_m") <= F.lit(metres)
