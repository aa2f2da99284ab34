"""Registered spatial queries: catchment mapping (E3), radius and nearest-neighbour
joins (E2), geometry scalars.  Oracles are arithmetic SQL: boxes by BETWEEN,
polygons by an edge table and crossing parity, distances by haversine."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from wattle import jobs
from wattle.functions import geo as G
from wattle.operators import addresses as A
from wattle.operators import grid as GR
from wattle.operators import spatial_join as S
from wattle.plans import domain as D
from wattle.plans.oracle import sql
from wattle.plans.registry import register
from wattle.session import scratch_path
from wattle.sources.tables import Tables

RADIUS_M = 1000.0
CELL = 0.0025  # about 1/16 of a catchment's width: most points fall in wholly-inside cells
NAMED_CATCHMENT = "PLACE1"

def _num(x: float) -> str:
    r = repr(float(x))
    return r if "e" in r else r + "e0"


def vincenty_sql(src: str, lat1: str, lon1: str, lat2: str, lon2: str, steps: int = 6) -> tuple[dict, str]:
    """The Vincenty expression of ``wattle.functions.geo.vincenty_m`` as a chain of SQL
    stages with the same operations in the same order (for the DuckDB oracle).
    Returns (CTEs, name of the last stage, which has column ``vd``)."""
    a, b, f = G.WGS84_A, G.WGS84_B, G.WGS84_F
    ctes = {"v0": f"""SELECT *, atan({_num(1 - f)} * tan(radians({lat1}))) AS u1, atan({_num(1 - f)} * tan(radians({lat2}))) AS u2,
 radians({lon2}) - radians({lon1}) AS vl FROM {src}""",
            "v1": "SELECT *, sin(u1) AS su1, cos(u1) AS cu1, sin(u2) AS su2, cos(u2) AS cu2, vl AS lam0 FROM v0"}
    prev = "v1"

    def terms(lam: str) -> str:
        return (f"SELECT *, sin({lam}) AS sl, cos({lam}) AS cl FROM {{p}}",
                "SELECT *, sqrt(pow(cu2 * sl, 2) + pow(cu1 * su2 - su1 * cu2 * cl, 2)) AS ss, su1 * su2 + cu1 * cu2 * cl AS cs FROM {p}",
                "SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE cu1 * cu2 * sl / ss END AS sa, atan2(ss, cs) AS sig FROM {p}",
                "SELECT *, 1e0 - sa * sa AS c2a FROM {p}",
                "SELECT *, CASE WHEN c2a = 0 THEN 0e0 ELSE cs - 2e0 * su1 * su2 / c2a END AS c2sm, "
                f"{_num(f / 16)} * c2a * (4e0 + {_num(f)} * (4e0 - 3e0 * c2a)) AS cc FROM {{p}}")

    n = 0
    for i in range(steps + 1):
        lam = f"lam{i}"
        for tmpl in terms(lam):
            n += 1
            name = f"vs{n}"
            ctes[name] = tmpl.format(p=prev)
            prev = name
        if i < steps:
            n += 1
            name = f"vs{n}"
            ctes[name] = (f"SELECT * EXCLUDE (sl, cl, ss, cs, sa, sig, c2a, c2sm, cc), vl + (1e0 - cc) * {_num(f)} * sa * "
                          f"(sig + cc * ss * (c2sm + cc * cs * (-1e0 + 2e0 * c2sm * c2sm))) AS lam{i + 1} FROM {prev}")
            prev = name
    n += 1
    ctes[f"vs{n}"] = f"SELECT *, c2a * {_num((a * a - b * b) / (b * b))} AS usq FROM {prev}"
    prev = f"vs{n}"
    n += 1
    ctes[f"vs{n}"] = (f"SELECT *, 1e0 + usq / 16384 * (4096e0 + usq * (-768e0 + usq * (320e0 - 175e0 * usq))) AS aa, "
                      f"usq / 1024 * (256e0 + usq * (-128e0 + usq * (74e0 - 47e0 * usq))) AS bb FROM {prev}")
    prev = f"vs{n}"
    n += 1
    ctes[f"vs{n}"] = (f"SELECT *, bb * ss * (c2sm + bb / 4 * (cs * (-1e0 + 2e0 * c2sm * c2sm) - bb / 6 * c2sm * (-3e0 + 4e0 * ss * ss) "
                      f"* (-3e0 + 4e0 * c2sm * c2sm))) AS ds FROM {prev}")
    prev = f"vs{n}"
    n += 1
    ctes[f"vs{n}"] = f"SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE {_num(b)} * aa * (sig - ds) END AS vd FROM {prev}"
    return ctes, f"vs{n}"


PIP_SQL = """SELECT p.address_detail_pid, p.school_id, p.school_type FROM (
  SELECT a.address_detail_pid, a.lon, a.lat, c.school_id, c.school_type FROM address a JOIN catchment c
  ON a.lon BETWEEN c.x0 AND c.x0 + c.d AND a.lat BETWEEN c.y0 AND c.y0 + c.d WHERE a.date_retired IS NULL) p
JOIN catchment_edge e ON e.school_id = p.school_id
GROUP BY p.address_detail_pid, p.school_id, p.school_type, p.lon, p.lat
HAVING sum(CASE WHEN ((e.ay > p.lat) <> (e.by > p.lat)) AND (p.lon < (e.bx - e.ax) * (p.lat - e.ay) / (e.by - e.ay) + e.ax) THEN 1 ELSE 0 END) % 2 = 1
 AND sum(CASE WHEN (e.bx - e.ax) * (p.lat - e.ay) - (e.by - e.ay) * (p.lon - e.ax) = 0 AND p.lon BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx)
   AND p.lat BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by) THEN 1 ELSE 0 END) = 0"""


def _psql(body: str, *more: str, extra: dict | None = None) -> str:
    ex = {"mapping": PIP_SQL}
    ex.update(extra or {})
    return sql(body, "address", "catchment_edge", *more, extra=ex)


#: Folders of saved tables by session and data folder.
_SAVED: dict[tuple[str, str], str] = {}


def _sources(t: Tables) -> tuple:
    return D.address_active(t), D.street_locality(t), D.street_type_aut(t), D.locality(t), D.catchment_polygons(t), D.school_catchment_name(t)


def saved(t: Tables) -> str:
    """The folder of the saved tables (``jobs``) of this data; built by the session's first query that reads them."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir)
    if key not in _SAVED:
        folder = scratch_path(t.spark, f"saved-{uuid.uuid4().hex}")
        jobs.build(*_sources(t), folder)
        _SAVED[key] = folder
    return _SAVED[key]


def mapping(t: Tables):
    """The saved address-catchment mapping (the materialised view of the reference)."""
    return jobs.read(t.spark, saved(t), jobs.MAPPING)


def computed_mapping(t: Tables):
    """The mapping from the point-in-polygon join itself."""
    pts = A.active(D.address(t), "date_retired").select("address_detail_pid", "lon", "lat")
    return S.points_in_polygons(pts, D.catchment_polygons(t), "school_id", CELL, point_id="address_detail_pid")


@register("j15_address_catchment", _psql("SELECT address_detail_pid, school_id, school_type FROM mapping"))
def j15_address_catchment(spark, d):
    return computed_mapping(Tables(spark, d)).select("address_detail_pid", "school_id", "school_type")


_PER_CATCHMENT_SQL = """SELECT c.school_id, c.school_type, count(m.address_detail_pid) AS address_count FROM catchment c
LEFT JOIN mapping m ON m.school_id = c.school_id GROUP BY c.school_id, c.school_type"""


def addresses_per_catchment(t: Tables):
    """Every catchment with the number of addresses in it, 0 where there are none."""
    return jobs.read(t.spark, saved(t), jobs.STATISTICS).select("school_id", "school_type", "address_count")


@register("ag13_addresses_per_catchment", _psql(_PER_CATCHMENT_SQL))
def ag13_addresses_per_catchment(spark, d):
    return addresses_per_catchment(Tables(spark, d))


@register("ag16_mapping_counts", _psql("""SELECT school_type AS metric, count(*) AS mapping_rows, count(DISTINCT address_detail_pid) AS addresses,
 count(DISTINCT school_id) AS schools FROM mapping GROUP BY school_type
UNION ALL SELECT 'TOTAL', count(*), count(DISTINCT address_detail_pid), count(DISTINCT school_id) FROM mapping"""))
def ag16_mapping_counts(spark, d):
    """AG16/U4: per type and in total, from one pass over the saved mapping (``rollup``)."""
    return jobs.mapping_counts(mapping(Tables(spark, d)))


@register("ag18_overlapping_catchments", _psql("""SELECT m.address_detail_pid, count(*) AS catchment_count,
 string_agg(n.school_name, ', ' ORDER BY n.school_name) AS school_names
FROM mapping m JOIN school_catchment_name n ON m.school_id = n.school_id GROUP BY m.address_detail_pid HAVING count(*) > 1""",
                                               "school_catchment_name"))
def ag18_overlapping_catchments(spark, d):
    """Ids are gathered first; only addresses in several catchments meet the names and are sorted."""
    t = Tables(spark, d)
    several = (mapping(t).groupBy("address_detail_pid").agg(F.collect_list("school_id").alias("ids"))
               .filter(F.size("ids") > 1).select("address_detail_pid", F.explode("ids").alias("school_id")))
    named = several.join(D.school_catchment_name(t), "school_id")
    return named.groupBy("address_detail_pid").agg(F.count(F.lit(1)).alias("catchment_count"),
                                                   F.array_join(F.array_sort(F.collect_list("school_name")), ", ").alias("school_names"))


@register("ag17_catchment_coverage_by_suburb", _psql("""SELECT l.locality_name, count(DISTINCT a.address_detail_pid) AS total_addresses,
 count(DISTINCT CASE WHEN m.school_type = 'PRIMARY' THEN a.address_detail_pid END) AS in_primary,
 count(DISTINCT CASE WHEN m.school_type = 'SECONDARY' THEN a.address_detail_pid END) AS in_secondary
FROM address a JOIN locality l ON a.locality_pid = l.locality_pid LEFT JOIN mapping m ON a.address_detail_pid = m.address_detail_pid
WHERE a.date_retired IS NULL GROUP BY l.locality_name""", "locality"))
def ag17_catchment_coverage_by_suburb(spark, d):
    t = Tables(spark, d)
    a = A.active(D.address(t), "date_retired").join(D.locality(t).select("locality_pid", "locality_name"), "locality_pid")
    # one row for each address with its flags, then sums
    kinds = mapping(t).groupBy("address_detail_pid").agg(F.max((F.col("school_type") == "PRIMARY").cast("int")).alias("_p"), F.max((F.col("school_type") == "SECONDARY").cast("int")).alias("_s"))
    one = a.select("address_detail_pid", "locality_name").distinct().join(kinds, "address_detail_pid", "left")
    return one.groupBy("locality_name").agg(F.count(F.lit(1)).alias("total_addresses"), F.coalesce(F.sum("_p"), F.lit(0)).alias("in_primary"),
                                            F.coalesce(F.sum("_s"), F.lit(0)).alias("in_secondary"))


@register("j18_primary_secondary", _psql("""SELECT a.address_detail_pid, p.school_id AS primary_school_id, s.school_id AS secondary_school_id
FROM address a LEFT JOIN (SELECT * FROM mapping WHERE school_type = 'PRIMARY') p ON a.address_detail_pid = p.address_detail_pid
LEFT JOIN (SELECT * FROM mapping WHERE school_type = 'SECONDARY') s ON a.address_detail_pid = s.address_detail_pid
WHERE a.date_retired IS NULL"""))
def j18_primary_secondary(spark, d):
    """Every active address with its primary and its secondary catchment (left
    joins, so several of either fan out as in the reference).  The mapping is
    computed once: its rows are gathered per address (a handful of catchments
    at most) and unfolded into the same rows the two left joins would give."""
    t = Tables(spark, d)
    per = mapping(t).groupBy("address_detail_pid").agg(
        F.collect_list(F.when(F.col("school_type") == "PRIMARY", F.col("school_id"))).alias("_p"),
        F.collect_list(F.when(F.col("school_type") == "SECONDARY", F.col("school_id"))).alias("_s"))
    a = A.active(D.address(t), "date_retired").select("address_detail_pid").join(per, "address_detail_pid", "left")

    def or_null(c):
        return F.when(F.coalesce(F.size(c), F.lit(0)) > 0, c).otherwise(F.array(F.lit(None).cast("long")))
    return (a.withColumn("primary_school_id", F.explode(or_null(F.col("_p"))))
             .withColumn("secondary_school_id", F.explode(or_null(F.col("_s"))))
             .select("address_detail_pid", "primary_school_id", "secondary_school_id"))


@register("j16_addresses_of_named_catchment", sql(f"""SELECT p.address_detail_pid, p.school_id FROM (
  SELECT a.address_detail_pid, a.lon, a.lat, c.school_id FROM address a JOIN catchment c
  ON a.lon BETWEEN c.x0 AND c.x0 + c.d AND a.lat BETWEEN c.y0 AND c.y0 + c.d
  JOIN school_catchment_name n ON n.school_id = c.school_id WHERE a.date_retired IS NULL AND upper(n.school_name) LIKE '%{NAMED_CATCHMENT}%') p
JOIN catchment_edge e ON e.school_id = p.school_id GROUP BY p.address_detail_pid, p.school_id, p.lon, p.lat
HAVING sum(CASE WHEN ((e.ay > p.lat) <> (e.by > p.lat)) AND (p.lon < (e.bx - e.ax) * (p.lat - e.ay) / (e.by - e.ay) + e.ax) THEN 1 ELSE 0 END) % 2 = 1
 AND sum(CASE WHEN (e.bx - e.ax) * (p.lat - e.ay) - (e.by - e.ay) * (p.lon - e.ax) = 0 AND p.lon BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx)
   AND p.lat BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by) THEN 1 ELSE 0 END) = 0""",
                                                  "address", "catchment_edge", "school_catchment_name"))
def j16_addresses_of_named_catchment(spark, d):
    t = Tables(spark, d)
    names = D.school_catchment_name(t).filter(F.upper("school_name").like(f"%{NAMED_CATCHMENT}%")).select("school_id")
    return mapping(t).select("address_detail_pid", "school_id").join(names, "school_id", "left_semi")


_SCHOOL_PIP = """SELECT p.acara_sml_id, p.school_id, p.school_type FROM (
  SELECT s.acara_sml_id, s.longitude AS lon, s.latitude AS lat, c.school_id, c.school_type FROM school_profile s JOIN catchment c
  ON s.longitude BETWEEN c.x0 AND c.x0 + c.d AND s.latitude BETWEEN c.y0 AND c.y0 + c.d) p
JOIN catchment_edge e ON e.school_id = p.school_id GROUP BY p.acara_sml_id, p.school_id, p.school_type, p.lon, p.lat
HAVING sum(CASE WHEN ((e.ay > p.lat) <> (e.by > p.lat)) AND (p.lon < (e.bx - e.ax) * (p.lat - e.ay) / (e.by - e.ay) + e.ax) THEN 1 ELSE 0 END) % 2 = 1
 AND sum(CASE WHEN (e.bx - e.ax) * (p.lat - e.ay) - (e.by - e.ay) * (p.lon - e.ax) = 0 AND p.lon BETWEEN least(e.ax, e.bx) AND greatest(e.ax, e.bx)
   AND p.lat BETWEEN least(e.ay, e.by) AND greatest(e.ay, e.by) THEN 1 ELSE 0 END) = 0"""


@register("j17_catchments_of_school_points", sql(_SCHOOL_PIP, "school_profile", "catchment_edge"))
def j17_catchments_of_school_points(spark, d):
    t = Tables(spark, d)
    pts = D.school_profile(t).select("acara_sml_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    return (S.points_in_polygons(pts, D.catchment_polygons(t), "school_id", CELL, point_id="acara_sml_id")
             .select("acara_sml_id", "school_id", "school_type").distinct())


_HAV = ("2 * 6371000e0 * atan2(sqrt(pow(sin((radians({la2}) - radians({la1})) / 2), 2) + cos(radians({la1})) * cos(radians({la2})) * "
        "pow(sin((radians({lo2}) - radians({lo1})) / 2), 2)), sqrt(1 - (pow(sin((radians({la2}) - radians({la1})) / 2), 2) + "
        "cos(radians({la1})) * cos(radians({la2})) * pow(sin((radians({lo2}) - radians({lo1})) / 2), 2))))")


def hav_sql(la1, lo1, la2, lo2) -> str:
    return _HAV.format(la1=la1, lo1=lo1, la2=la2, lo2=lo2)


def _radius(t: Tables):
    schools = D.school_profile(t).select("acara_sml_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    addrs = A.active(D.address(t), "date_retired").select("address_detail_pid", F.col("lon").alias("r_lon"),
                                                          F.col("lat").alias("r_lat"))
    return S.within_distance(schools, addrs, RADIUS_M)


_RADIUS_SQL = f"""SELECT s.acara_sml_id, a.address_detail_pid, {hav_sql('s.latitude', 's.longitude', 'a.lat', 'a.lon')} AS distance_m
FROM school_profile s JOIN address a ON a.lat BETWEEN s.latitude - 0.01 AND s.latitude + 0.01 AND a.lon BETWEEN s.longitude - 0.02 AND s.longitude + 0.02
WHERE a.date_retired IS NULL AND s.latitude IS NOT NULL"""


@register("j19_addresses_within_1km", sql(f"""SELECT acara_sml_id, address_detail_pid, round(distance_m, 3) AS distance_m FROM r
WHERE distance_m <= {RADIUS_M}""", "school_profile", "address", extra={"r": _RADIUS_SQL}))
def j19_addresses_within_1km(spark, d):
    return _radius(Tables(spark, d)).select("acara_sml_id", "address_detail_pid", F.round("distance_m", 3).alias("distance_m"))


@register("ag26_radius_counts", sql(f"""SELECT acara_sml_id, count(*) AS address_count FROM r WHERE distance_m <= {RADIUS_M} GROUP BY acara_sml_id""",
                                    "school_profile", "address", extra={"r": _RADIUS_SQL}))
def ag26_radius_counts(spark, d):
    """AG26: counts of whole cells within 1 km are summed; only addresses of cells on the rim are measured."""
    schools, addrs = _schools_and_addresses(Tables(spark, d))
    _, reach_lon = S.degree_margins(RADIUS_M, F.col("_y"))
    counts = GR.disc_counts(schools, addrs, "acara_sml_id", math.degrees(RADIUS_M / G.EARTH_RADIUS_M) * 1.000001, {"address_count": (
        GR.surely_within_m(RADIUS_M), G.haversine_m("_y", "_x", "r_lat", "r_lon") <= RADIUS_M)}, reach_lon=reach_lon)
    return counts.filter("address_count > 0")


_J21_CTES, _J21_LAST = vincenty_sql("pairs", "slat", "slon", "alat", "alon")


@register("j21_nearest_address", sql(f"""SELECT acara_sml_id, address_detail_pid, round(sqrt(d2), 9) AS distance_deg, round(vd, 2) AS distance_m FROM {_J21_LAST}""",
                                     "school_profile", "address", extra={"pairs": """SELECT acara_sml_id, address_detail_pid, d2, slat, slon, alat, alon FROM (
 SELECT s.acara_sml_id, a.address_detail_pid, s.latitude AS slat, s.longitude AS slon, a.lat AS alat, a.lon AS alon, (a.lon - s.longitude) * (a.lon - s.longitude) + (a.lat - s.latitude) * (a.lat - s.latitude) AS d2,
  row_number() OVER (PARTITION BY s.acara_sml_id ORDER BY (a.lon - s.longitude) * (a.lon - s.longitude) + (a.lat - s.latitude) * (a.lat - s.latitude), a.address_detail_pid) AS rn
 FROM school_profile s JOIN address a ON a.date_retired IS NULL AND s.latitude IS NOT NULL) x WHERE rn = 1""", **_J21_CTES}))
def j21_nearest_address(spark, d):
    t = Tables(spark, d)
    schools = D.school_profile(t).select("acara_sml_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    addrs = A.active(D.address(t), "date_retired").select("address_detail_pid", F.col("lon").alias("r_lon"),
                                                          F.col("lat").alias("r_lat"))
    nn = S.nearest_neighbour(schools, addrs, "acara_sml_id", "address_detail_pid")
    return nn.select("acara_sml_id", "address_detail_pid", F.round("distance_deg", 9).alias("distance_deg"), F.round("distance_m", 2).alias("distance_m"))


@register("j21_nearest_other_school", sql("""SELECT acara_sml_id, other_id, round(sqrt(d2), 9) AS distance_deg FROM (
 SELECT s.acara_sml_id, o.acara_sml_id AS other_id, (o.longitude - s.longitude) * (o.longitude - s.longitude) + (o.latitude - s.latitude) * (o.latitude - s.latitude) AS d2,
  row_number() OVER (PARTITION BY s.acara_sml_id ORDER BY (o.longitude - s.longitude) * (o.longitude - s.longitude) + (o.latitude - s.latitude) * (o.latitude - s.latitude), o.acara_sml_id) AS rn
 FROM school_profile s JOIN school_profile o ON o.acara_sml_id <> s.acara_sml_id AND s.latitude IS NOT NULL AND o.latitude IS NOT NULL) x WHERE rn = 1""",
                                           "school_profile"))
def j21_nearest_other_school(spark, d):
    t = Tables(spark, d)
    s = D.school_profile(t).select("acara_sml_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    o = s.select(F.col("acara_sml_id").alias("other_id"), F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    nn = S.nearest_neighbour(s, o.withColumnRenamed("other_id", "acara_sml_id_o"), "acara_sml_id", "acara_sml_id_o",
                             report_metres=False, exclude_self=True)
    return nn.select("acara_sml_id", F.col("acara_sml_id_o").alias("other_id"), F.round("distance_deg", 9).alias("distance_deg"))


_J22_CTES, _J22_LAST = vincenty_sql("pairs", "flat", "flon", "llat", "llon")


@register("j22_street_span_distance", sql(f"""SELECT street_locality_pid, first_pid, last_pid, round(vd, 3) AS distance_m FROM {_J22_LAST}""", "address",
                                          extra={"pairs": """SELECT s.street_locality_pid, first_pid, last_pid, f.lat AS flat, f.lon AS flon, l.lat AS llat, l.lon AS llon
FROM (SELECT street_locality_pid, min(address_detail_pid) AS first_pid, max(address_detail_pid) AS last_pid FROM address GROUP BY 1) s
JOIN address f ON f.address_detail_pid = s.first_pid JOIN address l ON l.address_detail_pid = s.last_pid""", **_J22_CTES}))
def j22_street_span_distance(spark, d):
    """J22 in batch form: geodesic distance (WGS84) between two chosen addresses (here the first and
    last address of every street) - two key joins, no cross join."""
    a = D.address(Tables(spark, d))
    ends = a.groupBy("street_locality_pid").agg(F.min("address_detail_pid").alias("first_pid"),
                                                F.max("address_detail_pid").alias("last_pid"))
    f = a.select(F.col("address_detail_pid").alias("first_pid"), F.col("lon").alias("f_lon"), F.col("lat").alias("f_lat"))
    l = a.select(F.col("address_detail_pid").alias("last_pid"), F.col("lon").alias("l_lon"), F.col("lat").alias("l_lat"))
    j = ends.join(f, "first_pid").join(l, "last_pid")
    return G.with_vincenty(j, "f_lat", "f_lon", "l_lat", "l_lon", "distance_m").select(
        "street_locality_pid", "first_pid", "last_pid", F.round("distance_m", 3).alias("distance_m"))


@register("sp18_hazard_exposure", sql("""SELECT c.postcode, h.hazard_id FROM (
 SELECT postcode, avg(lon) AS clon, avg(lat) AS clat FROM address WHERE date_retired IS NULL GROUP BY postcode) c
JOIN hazard_zone h ON c.clon BETWEEN h.x0 - 0.05 AND h.x0 + h.d + 0.05 AND c.clat BETWEEN h.y0 - 0.05 AND h.y0 + h.d + 0.05""",
                                      "address", "hazard_zone"))
def sp18_hazard_exposure(spark, d):
    """SP18 (re-aimed): hazard zones whose box, grown by 0.05 degrees, holds a postcode centroid."""
    t = Tables(spark, d)
    cent = (A.postcode_centroids(A.active(D.address(t), "date_retired"), min_count=0)
             .select("postcode", F.col("centroid_lon").alias("lon"), F.col("centroid_lat").alias("lat")))
    hz = D.hazard_zone(t)
    m = F.lit(0.05)
    x0, y0, dd = F.col("x0"), F.col("y0"), F.col("d")

    def v(x, y):
        return F.struct(x.alias("x"), y.alias("y"))
    ring = F.array(v(x0 - m, y0 - m), v(x0 + dd + m, y0 - m), v(x0 + dd + m, y0 + dd + m), v(x0 - m, y0 + dd + m), v(x0 - m, y0 - m))
    boxes = hz.select("hazard_id", "x0", "y0", "d").withColumn("rings", F.array(ring))
    # A box test (edges included) rather than ST_Contains: grid join + bbox filter only.
    pts = cent.withColumn("_cx", G.square_cell("lon", 0.05)).withColumn("_cy", G.square_cell("lat", 0.05))
    cells = S.polygon_cells(boxes, "hazard_id", 0.05).withColumnRenamed("cx", "_cx").withColumnRenamed("cy", "_cy")
    j = pts.join(GR.exploded(cells), ["_cx", "_cy"]).join(boxes.select("hazard_id", "x0", "y0", "d").hint("merge"), "hazard_id")
    return j.filter(F.col("lon").between(x0 - m, x0 + dd + m) & F.col("lat").between(y0 - m, y0 + dd + m)) \
            .select("postcode", "hazard_id")


@register("sp8_school_bbox", sql("""SELECT acara_sml_id, round(longitude - (5e0 / 111e0) / greatest(1e-6, cos(radians(latitude))), 9) AS minx,
 round(latitude - 5e0 / 111e0, 9) AS miny, round(longitude + (5e0 / 111e0) / greatest(1e-6, cos(radians(latitude))), 9) AS maxx,
 round(latitude + 5e0 / 111e0, 9) AS maxy FROM school_profile WHERE latitude IS NOT NULL""", "school_profile"))
def sp8_school_bbox(spark, d):
    p = D.school_profile(Tables(spark, d)).filter(F.col("latitude").isNotNull())
    minx, miny, maxx, maxy = G.bbox_for_point("latitude", "longitude", 5.0)
    return p.select("acara_sml_id", F.round(minx, 9).alias("minx"), F.round(miny, 9).alias("miny"),
                    F.round(maxx, 9).alias("maxx"), F.round(maxy, 9).alias("maxy"))


@register("sp13_school_mercator", sql("""SELECT acara_sml_id, round(6378137e0 * radians(longitude), 3) AS x,
 round(6378137e0 * ln(tan(pi() / 4 + radians(latitude) / 2)), 3) AS y FROM school_profile WHERE latitude IS NOT NULL""", "school_profile"))
def sp13_school_mercator(spark, d):
    p = D.school_profile(Tables(spark, d)).filter(F.col("latitude").isNotNull())
    x, y = G.to_3857("longitude", "latitude")
    return p.select("acara_sml_id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"))


@register("sp4_schools_near_melbourne", sql("""SELECT acara_sml_id, school_name, round(6371e0 * acos(least(1e0, greatest(-1e0,
 cos(radians(-37.8136)) * cos(radians(latitude)) * cos(radians(longitude) - radians(144.9631)) + sin(radians(-37.8136)) * sin(radians(latitude))))), 2) AS distance_km
FROM school_location WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY distance_km, acara_sml_id LIMIT 20""", "school_location"))
def sp4_schools_near_melbourne(spark, d):
    """SP4 + O1: 20 nearest schools to a fixed point by the spherical law of cosines."""
    loc = D.school_location(Tables(spark, d)).filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    # Fixed value: the reference query's point (Melbourne CBD).
    dist = F.round(G.cosine_law_km(-37.8136, 144.9631, "latitude", "longitude"), 2)
    return loc.select("acara_sml_id", "school_name", dist.alias("distance_km")).orderBy("distance_km", "acara_sml_id").limit(20)


@register("sp11_catchment_centroid", sql("""SELECT e.school_id, round(sum((e.ax + e.bx) * (e.ax * e.by - e.bx * e.ay)) / (3 * sum(e.ax * e.by - e.bx * e.ay)), 9) AS cx,
 round(sum((e.ay + e.by) * (e.ax * e.by - e.bx * e.ay)) / (3 * sum(e.ax * e.by - e.bx * e.ay)), 9) AS cy FROM catchment_edge e GROUP BY e.school_id""", "catchment_edge"))
def sp11_catchment_centroid(spark, d):
    c = D.catchment_polygons(Tables(spark, d)).select("school_id", G.polygon_centroid("rings").alias("c"))
    return c.select("school_id", F.round("c.x", 9).alias("cx"), F.round("c.y", 9).alias("cy"))


@register("sp16_ring_validity", sql("""SELECT count(*) AS polygons, count(CASE WHEN school_id % 9 <> 0 AND school_id % 10 <> 0 THEN 1 END) AS valid_rings FROM catchment""", "catchment"))
def sp16_ring_validity(spark, d):
    """SP16: valid rings among the catchments, of which every ninth is left open and every tenth cut to three points."""
    c = D.catchment_polygons(Tables(spark, d))
    k = F.col("school_id")
    broken = F.when(k % 9 == 0, F.transform("rings", lambda r: F.slice(r, 1, 6))).when(k % 10 == 0, F.transform("rings", lambda r: F.concat(F.slice(r, 1, 2), F.slice(r, 1, 1))))
    c = c.withColumn("rings", broken.otherwise(F.col("rings")))
    return c.agg(F.count(F.lit(1)).alias("polygons"),
                 F.count_if(F.forall("rings", lambda r: G.ring_is_valid(r))).alias("valid_rings"))


@register("ag15_catchment_stats_per_type", _psql("""SELECT school_type, count(*) AS catchments, cast(sum(n) AS bigint) AS total_addresses,
 cast(floor(avg(n)) AS bigint) AS avg_addresses, max(n) AS max_addresses
FROM (SELECT school_id, school_type, address_count AS n FROM (""" + _PER_CATCHMENT_SQL + """) y) x GROUP BY school_type"""))
def ag15_catchment_stats_per_type(spark, d):
    """AG14 (its evident intent: mapped addresses per catchment) rolled up per type (AG15)."""
    per = addresses_per_catchment(Tables(spark, d)).withColumnRenamed("address_count", "n")
    return per.groupBy("school_type").agg(F.count(F.lit(1)).alias("catchments"), F.sum("n").alias("total_addresses"),
                                          F.floor(F.avg("n")).cast("long").alias("avg_addresses"), F.max("n").alias("max_addresses"))


_STREETS_SQL = """SELECT DISTINCT m.school_id, m.school_type, sl.street_name, st.name AS street_type, l.locality_name, a.postcode
FROM mapping m JOIN address a ON a.address_detail_pid = m.address_detail_pid
JOIN street_locality sl ON sl.street_locality_pid = a.street_locality_pid LEFT JOIN street_type_aut st ON st.code = sl.street_type_code
JOIN locality l ON l.locality_pid = a.locality_pid"""


def catchment_streets(t: Tables):
    """The distinct streets (with suburb and postcode) of every catchment, from their saved table."""
    return jobs.read(t.spark, saved(t), jobs.STREETS)


@register("j24_catchment_streets", _psql(_STREETS_SQL, "street_locality", "street_type_aut", "locality"))
def j24_catchment_streets(spark, d):
    return catchment_streets(Tables(spark, d))


CATCHMENT_FOR_STREETS, STREET_PREFIX = 5, "NAME 7"


@register("o6_catchment_street_autocomplete", _psql(f"""SELECT DISTINCT street_name, street_type FROM streets
WHERE school_id = {CATCHMENT_FOR_STREETS} AND upper(street_name) LIKE '{STREET_PREFIX}%' ORDER BY street_name, street_type LIMIT 20""",
                                                    "street_locality", "street_type_aut", "locality", extra={"streets": _STREETS_SQL}))
def o6_catchment_street_autocomplete(spark, d):
    """O6 on the catchment-streets table: streets of one catchment by prefix, top 20."""
    s = catchment_streets(Tables(spark, d)).filter(F.col("school_id") == CATCHMENT_FOR_STREETS)
    return (s.filter(F.upper("street_name").like(f"{STREET_PREFIX}%")).select("street_name", "street_type").distinct()
             .orderBy("street_name", "street_type").limit(20))


@register("ag29_catchments_per_type", sql("""SELECT school_type, count(*) AS catchment_count FROM catchment GROUP BY school_type""", "catchment"))
def ag29_catchments_per_type(spark, d):
    """AG29/U1: catchment count per type table (the type tables are one union here)."""
    return D.catchment(Tables(spark, d)).groupBy("school_type").agg(F.count(F.lit(1)).alias("catchment_count"))


BOUNDARY_M = 150.0


def _j20_sql() -> str:
    dist = _seg_sql("a.lon", "a.lat", "e.ax", "e.ay", "e.bx", "e.by")
    return sql(f"""SELECT a.address_detail_pid, e.school_id, round(min({dist}), 1) AS boundary_m
FROM address a JOIN catchment_edge e ON a.date_retired IS NULL
 AND a.lon BETWEEN least(e.ax, e.bx) - 0.01 AND greatest(e.ax, e.bx) + 0.01 AND a.lat BETWEEN least(e.ay, e.by) - 0.01 AND greatest(e.ay, e.by) + 0.01
GROUP BY a.address_detail_pid, e.school_id HAVING min({dist}) <= {BOUNDARY_M}""", "address", "catchment_edge")


def j20_near_catchment_boundary(spark, d):
    """Active addresses within 150 m of a catchment boundary (either side)."""
    t = Tables(spark, d)
    pts = A.active(D.address(t), "date_retired").select("address_detail_pid", "lon", "lat")
    near = S.near_polygon_boundary(pts, D.catchment_polygons(t), "school_id", BOUNDARY_M, point_id="address_detail_pid")
    return near.select("address_detail_pid", "school_id", F.round("boundary_m", 1).alias("boundary_m"))


# ----------------------------------------------------------------------------- radius page
PAGE_KM, DISC_DEG, PAGE_SIZE = 5.0, 0.045, 100


def _schools_and_addresses(t: Tables):
    schools = D.school_profile(t).select("acara_sml_id", F.col("longitude").alias("lon"), F.col("latitude").alias("lat"))
    addrs = A.active(D.address(t), "date_retired").select("address_detail_pid", F.col("lon").alias("r_lon"),
                                                          F.col("lat").alias("r_lat"))
    return schools, addrs


_DISC_SQL = f"""SELECT s.acara_sml_id, a.address_detail_pid,
 (a.lon - s.longitude) * (a.lon - s.longitude) + (a.lat - s.latitude) * (a.lat - s.latitude) AS d2,
 round({hav_sql('s.latitude', 's.longitude', 'a.lat', 'a.lon')} / 1000e0, 2) AS distance_km
FROM school_profile s JOIN address a ON a.date_retired IS NULL AND s.latitude IS NOT NULL
 AND a.lat BETWEEN s.latitude - 0.05 AND s.latitude + 0.05 AND a.lon BETWEEN s.longitude - 0.05 AND s.longitude + 0.05
WHERE (a.lon - s.longitude) * (a.lon - s.longitude) + (a.lat - s.latitude) * (a.lat - s.latitude) <= {DISC_DEG}e0 * {DISC_DEG}e0"""


@register("o3_radius_page", sql(f"""SELECT acara_sml_id, address_detail_pid, distance_km, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY acara_sml_id ORDER BY d2, address_detail_pid) AS rank FROM disc WHERE distance_km <= {PAGE_KM}) x
WHERE rank <= {PAGE_SIZE}""", "school_profile", "address", extra={"disc": _DISC_SQL}))
def o3_radius_page(spark, d):
    """O3 default mode: 5 km filter first, then the first page by KNN order, per school."""
    schools, addrs = _schools_and_addresses(Tables(spark, d))
    p = S.radius_page(schools, addrs, "acara_sml_id", "address_detail_pid", PAGE_KM, DISC_DEG, 1, PAGE_SIZE,
                      faithful=False, metric="haversine")
    return p.select("acara_sml_id", "address_detail_pid", "distance_km", "rank")


@register("o3_radius_page_faithful", sql(f"""SELECT acara_sml_id, address_detail_pid, distance_km, rank FROM (
 SELECT *, row_number() OVER (PARTITION BY acara_sml_id ORDER BY d2, address_detail_pid) AS rank FROM disc) x
WHERE rank <= {PAGE_SIZE} AND distance_km <= {PAGE_KM}""", "school_profile", "address", extra={"disc": _DISC_SQL}))
def o3_radius_page_faithful(spark, d):
    """O3 faithful mode: page by KNN order inside the 0.045-degree disc, then drop rows
    beyond 5 km (so pages can be short, as in the reference)."""
    schools, addrs = _schools_and_addresses(Tables(spark, d))
    p = S.radius_page(schools, addrs, "acara_sml_id", "address_detail_pid", PAGE_KM, DISC_DEG, 1, PAGE_SIZE,
                      faithful=True, metric="haversine")
    return p.select("acara_sml_id", "address_detail_pid", "distance_km", "rank")


_O3G_CTES, _O3G_LAST = vincenty_sql("pairs", "slat", "slon", "alat", "alon")


@register("o3_radius_page_geodesic", sql(f"""SELECT acara_sml_id, address_detail_pid, distance_km, rank, row_number() OVER (PARTITION BY acara_sml_id ORDER BY distance_km, address_detail_pid) AS position
FROM (SELECT *, row_number() OVER (PARTITION BY acara_sml_id ORDER BY d2, address_detail_pid) AS rank FROM (
 SELECT acara_sml_id, address_detail_pid, d2, round(vd / 1000e0, 2) AS distance_km FROM {_O3G_LAST}) z WHERE distance_km <= {PAGE_KM}) x WHERE rank <= {PAGE_SIZE}""",
                                          "school_profile", "address", extra={"pairs": f"""SELECT s.acara_sml_id, a.address_detail_pid, s.latitude AS slat, s.longitude AS slon, a.lat AS alat, a.lon AS alon,
 (a.lon - s.longitude) * (a.lon - s.longitude) + (a.lat - s.latitude) * (a.lat - s.latitude) AS d2 FROM school_profile s JOIN address a ON a.date_retired IS NULL AND s.latitude IS NOT NULL
 AND a.lat BETWEEN s.latitude - 0.05 AND s.latitude + 0.05 AND a.lon BETWEEN s.longitude - 0.05 AND s.longitude + 0.05
 WHERE (a.lon - s.longitude) * (a.lon - s.longitude) + (a.lat - s.latitude) * (a.lat - s.latitude) <= {DISC_DEG}e0 * {DISC_DEG}e0""", **_O3G_CTES}))
def o3_radius_page_geodesic(spark, d):
    """O3 as the reference measures it: kilometres on the spheroid, the page's rows in order of distance (``position``)."""
    schools, addrs = _schools_and_addresses(Tables(spark, d))
    p = S.radius_page(schools, addrs, "acara_sml_id", "address_detail_pid", PAGE_KM, DISC_DEG, 1, PAGE_SIZE)
    return p.select("acara_sml_id", "address_detail_pid", "distance_km", "rank", "position")


@register("ag26_disc_totals", sql(f"""SELECT acara_sml_id, count(*) AS disc_count, count(CASE WHEN distance_km <= {PAGE_KM} THEN 1 END) AS within_km_count
FROM disc GROUP BY acara_sml_id""", "school_profile", "address", extra={"disc": _DISC_SQL}))
def ag26_disc_totals(spark, d):
    """AG26 trap made visible: the page total counts the 0.045-degree disc
    (``disc_count``), not the addresses within 5 km (``within_km_count``)."""
    schools, addrs = _schools_and_addresses(Tables(spark, d))
    dx, dy = F.col("r_lon") - F.col("_x"), F.col("r_lat") - F.col("_y")
    in_disc = dx * dx + dy * dy <= F.lit(DISC_DEG ** 2)
    near = F.round(G.haversine_m("_y", "_x", "r_lat", "r_lon") / 1000.0, 2) <= PAGE_KM
    counts = GR.disc_counts(schools, addrs, "acara_sml_id", DISC_DEG, {
        "disc_count": (F.col("_far") < F.lit(DISC_DEG * 0.999999), in_disc),
        "within_km_count": ((F.col("_far") < F.lit(DISC_DEG * 0.999999)) & GR.surely_within_m(PAGE_KM * 1000.0), in_disc & near)})
    return counts.filter("disc_count > 0")


_SP6_CTES, _SP6_LAST = vincenty_sql("pairs", "slat", "slon", "alat", "alon")


@register("sp6_within_500m_geodesic", sql(f"""SELECT acara_sml_id, address_detail_pid, round(vd, 2) AS distance_m FROM {_SP6_LAST} WHERE vd <= 500""",
                                          "school_profile", "address", extra={"pairs": """SELECT s.acara_sml_id, a.address_detail_pid,
 s.latitude AS slat, s.longitude AS slon, a.lat AS alat, a.lon AS alon FROM school_profile s JOIN address a ON a.date_retired IS NULL
 AND s.latitude IS NOT NULL AND a.lat BETWEEN s.latitude - 0.006 AND s.latitude + 0.006 AND a.lon BETWEEN s.longitude - 0.008 AND s.longitude + 0.008""",
                                                                              **_SP6_CTES}))
def sp6_within_500m_geodesic(spark, d):
    """SP6: addresses within 500 m of each school on the WGS84 spheroid (Vincenty) -
    the reference's geography distance."""
    schools, addrs = _schools_and_addresses(Tables(spark, d))
    r = S.within_distance(schools, addrs, 500.0, metric="vincenty")
    return r.select("acara_sml_id", "address_detail_pid", F.round("distance_m", 2).alias("distance_m"))


# ----------------------------------------------------------------------------- corridor
# The reference's example route (lon, lat).
ROUTE = [(151.2100, -33.9900), (151.2150, -33.9850), (151.2200, -33.9800)]
CORRIDOR_M = 100.0


def _seg_sql(px: str, py: str, x1: str = "e.x1", y1: str = "e.y1", x2: str = "e.x2", y2: str = "e.y2") -> str:
    kx = f"(pi() / 180 * 6371000e0) * cos(radians({py}))"
    ky = "(pi() / 180 * 6371000e0)"
    ax, ay = f"(({x1} - {px}) * {kx})", f"(({y1} - {py}) * {ky})"
    bx, by = f"(({x2} - {px}) * {kx})", f"(({y2} - {py}) * {ky})"
    dx, dy = f"({bx} - {ax})", f"({by} - {ay})"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    tt = f"(CASE WHEN {len2} = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, -({ax} * {dx} + {ay} * {dy}) / {len2})) END)"
    qx, qy = f"({ax} + {tt} * {dx})", f"({ay} + {tt} * {dy})"
    return f"sqrt({qx} * {qx} + {qy} * {qy})"


_ROUTE_EDGES = "SELECT * FROM (VALUES " + ", ".join(
    f"({ROUTE[i][0]}e0, {ROUTE[i][1]}e0, {ROUTE[i + 1][0]}e0, {ROUTE[i + 1][1]}e0)" for i in range(len(ROUTE) - 1)) + \
    ") AS t(x1, y1, x2, y2)"


@register("j23_route_corridor", sql(f"""SELECT address_detail_pid, round(min({_seg_sql('a.lon', 'a.lat')}), 3) AS distance_m
FROM address a, route_edges e WHERE a.date_retired IS NULL GROUP BY address_detail_pid HAVING min({_seg_sql('a.lon', 'a.lat')}) <= {CORRIDOR_M}""",
                                    "address", extra={"route_edges": _ROUTE_EDGES}))
def j23_route_corridor(spark, d):
    """Active addresses within 100 m of a route polyline, with the distance."""
    t = Tables(spark, d)
    route = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ROUTE])], "route_id int, path array<struct<x:double,y:double>>")
    pts = A.active(D.address(t), "date_retired").select("address_detail_pid", "lon", "lat")
    near = S.near_polyline(pts, route, "route_id", CORRIDOR_M, point_id="address_detail_pid", few=True)
    return near.select("address_detail_pid", F.round("distance_m", 3).alias("distance_m"))


def _geodesic_seg_sql(px: str, py: str) -> str:
    """Distance in metres to a segment in the plane of the spheroid's radii of curvature at the point."""
    e2 = _num(G.WGS84_F * (2 - G.WGS84_F))
    w = f"(1e0 - {e2} * pow(sin(radians({py})), 2))"
    planar = _seg_sql(px, py)
    sphere_x, sphere_y = f"(pi() / 180 * 6371000e0) * cos(radians({py}))", "(pi() / 180 * 6371000e0)"
    return planar.replace(sphere_x, f"(pi() / 180 * {_num(G.WGS84_A)} * cos(radians({py})) / sqrt{w})").replace(
        sphere_y, f"(pi() / 180 * {_num(G.WGS84_A)} * (1e0 - {e2}) / ({w} * sqrt{w}))")


@register("j23_route_corridor_geodesic", sql(f"""SELECT address_detail_pid, round(min({_geodesic_seg_sql('a.lon', 'a.lat')}), 3) AS distance_m
FROM address a, route_edges e WHERE a.date_retired IS NULL GROUP BY address_detail_pid HAVING min({_geodesic_seg_sql('a.lon', 'a.lat')}) <= 2000""",
                                             "address", extra={"route_edges": _ROUTE_EDGES}))
def j23_route_corridor_geodesic(spark, d):
    """J23 on the spheroid: active addresses within 2 km of the route."""
    t = Tables(spark, d)
    route = spark.createDataFrame([(1, [{"x": x, "y": y} for x, y in ROUTE])], "route_id int, path array<struct<x:double,y:double>>")
    near = S.near_polyline(D.address_active(t).select("address_detail_pid", "lon", "lat"), route, "route_id", 2000.0, point_id="address_detail_pid", spheroid=True, few=True)
    return near.select("address_detail_pid", F.round("distance_m", 3).alias("distance_m"))


# ----------------------------------------------------------------------------- catchment page text, stats
@register("a5_catchment_page_address", _psql("""SELECT m.address_detail_pid, m.school_id,
 coalesce(cast(a.flat_number AS varchar) || '', '') || coalesce(cast(a.number_first AS varchar) || '', '') || coalesce('-' || NULL || '', '')
 || coalesce(cast(a.number_last AS varchar) || '', '') || coalesce(sl.street_name || ' ', '') || coalesce(st.name || ' ', '') AS full_address
FROM mapping m JOIN address a ON a.address_detail_pid = m.address_detail_pid
JOIN street_locality sl ON a.street_locality_pid = sl.street_locality_pid JOIN locality l ON sl.locality_pid = l.locality_pid
JOIN state s ON l.state_pid = s.state_pid LEFT JOIN street_type_aut st ON sl.street_type_code = st.code
WHERE a.date_retired IS NULL AND sl.date_retired IS NULL AND l.date_retired IS NULL""", "street_locality", "locality", "state", "street_type_aut"))
def a5_catchment_page_address(spark, d):
    """A5 + J7: the catchment page's address text for every mapped active address
    (inner star through the street, active streets and localities only)."""
    from wattle.functions.text import lot_address
    t = Tables(spark, d)
    s = A.star(D.address(t), D.street_locality(t), D.street_type_aut(t), D.locality(t), D.state(t),
               inner=True, locality_via_street=True)
    s = A.active(s, "date_retired", "street_date_retired", "locality_date_retired")
    parts = {c: F.col(c) for c in ("flat_number", "number_first", "number_last", "street_name", "street_type")}
    j = mapping(t).select("address_detail_pid", "school_id").join(s, "address_detail_pid")
    return j.select("address_detail_pid", "school_id", lot_address(parts).alias("full_address"))


@register("ag14_catchment_stats", _psql("""SELECT c.school_id, n.school_name, k.school_type, round(c.cx, 9) AS centroid_lon, round(c.cy, 9) AS centroid_lat,
 coalesce(m.n, 0) AS address_count
FROM (SELECT e.school_id, sum((e.ax + e.bx) * (e.ax * e.by - e.bx * e.ay)) / (3 * sum(e.ax * e.by - e.bx * e.ay)) AS cx,
  sum((e.ay + e.by) * (e.ax * e.by - e.bx * e.ay)) / (3 * sum(e.ax * e.by - e.bx * e.ay)) AS cy FROM catchment_edge e GROUP BY e.school_id) c
JOIN catchment k ON k.school_id = c.school_id LEFT JOIN school_catchment_name n ON n.school_id = c.school_id
LEFT JOIN (SELECT school_id, count(*) AS n FROM mapping GROUP BY school_id) m ON m.school_id = c.school_id""", "school_catchment_name"))
def ag14_catchment_stats(spark, d):
    s = jobs.read(spark, saved(Tables(spark, d)), jobs.STATISTICS)
    return s.select("school_id", "school_name", "school_type", F.round("centroid_lon", 9).alias("centroid_lon"),
                    F.round("centroid_lat", 9).alias("centroid_lat"), "address_count")


@register("ag30_catchment_rows", sql("""SELECT school_id, count(*) AS catchment_rows FROM catchment GROUP BY school_id""", "catchment"))
def ag30_catchment_rows(spark, d):
    from wattle.operators.schools import catchment_rows
    return catchment_rows(D.catchment(Tables(spark, d)))


register("j20_near_catchment_boundary", _j20_sql())(j20_near_catchment_boundary)


_CATCHMENT_ID = 3


@register("o6_catchment_suburbs", _psql(f"""SELECT DISTINCT l.locality_name, a.postcode FROM mapping m JOIN address a ON a.address_detail_pid = m.address_detail_pid
JOIN locality l ON l.locality_pid = a.locality_pid WHERE m.school_id = {_CATCHMENT_ID} ORDER BY l.locality_name, a.postcode LIMIT 20""", "locality"))
def o6_catchment_suburbs(spark, d):
    """O6 within one catchment: its suburbs and postcodes, from the saved mapping."""
    t = Tables(spark, d)
    inside = mapping(t).filter(F.col("school_id") == _CATCHMENT_ID).select("address_detail_pid").join(D.address(t).select("address_detail_pid", "locality_pid", "postcode"), "address_detail_pid")
    named = inside.join(D.locality(t).select("locality_pid", "locality_name"), "locality_pid")
    return named.select("locality_name", "postcode").distinct().orderBy("locality_name", "postcode").limit(20)


@register("s17_saved_catchment_tables", _psql(f"""SELECT 'streets' AS table_name, school_type, count(*) AS n FROM ({_STREETS_SQL}) s GROUP BY school_type
UNION ALL SELECT 'mapping', school_type, count(*) FROM mapping GROUP BY school_type
UNION ALL SELECT 'statistics', school_type, count(*) FROM catchment GROUP BY school_type""", "street_locality", "street_type_aut", "locality"))
def s17_saved_catchment_tables(spark, d):
    """The mapping and the tables derived from it, built once and read back: rows per type."""
    folder = saved(Tables(spark, d))
    per = lambda label, name: jobs.read(spark, folder, name).groupBy("school_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(label).alias("table_name"), "school_type", "n")
    return per("streets", jobs.STREETS).unionByName(per("mapping", jobs.MAPPING)).unionByName(per("statistics", jobs.STATISTICS))


@register("s17_saved_mapping", _psql("SELECT address_detail_pid, school_id, school_type FROM mapping"))
def s17_saved_mapping(spark, d):
    """The rows of the saved mapping."""
    return mapping(Tables(spark, d))


@register("s17_saved_summary", _psql("""SELECT school_type AS metric, count(*) AS mapping_rows, count(DISTINCT address_detail_pid) AS addresses,
 count(DISTINCT school_id) AS schools FROM mapping GROUP BY school_type
UNION ALL SELECT 'TOTAL', count(*), count(DISTINCT address_detail_pid), count(DISTINCT school_id) FROM mapping"""))
def s17_saved_summary(spark, d):
    return jobs.read(spark, saved(Tables(spark, d)), jobs.SUMMARY)


def _earlier(t: Tables) -> tuple:
    """The sources as they may have been before: some addresses elsewhere, missing or since retired, some catchments larger, missing or of the other type."""
    addresses, streets, kinds, localities, polygons, names = _sources(t)
    k = F.substring("address_detail_pid", 3, 20).cast("bigint")
    was = addresses.filter(k % 101 != 0).withColumn("lon", F.when(k % 97 == 0, F.col("lon") + 0.05).when(k % 89 == 0, F.lit(None)).otherwise(F.col("lon")))
    was = was.withColumn("postcode", F.when(k % 83 == 0, F.lit("0000")).otherwise(F.col("postcode")))
    was = was.unionByName(addresses.filter(k % 103 == 0).withColumn("address_detail_pid", F.concat(F.lit("OLD"), "address_detail_pid")))
    s = F.col("school_id")
    grown = F.transform("rings", lambda r: F.transform(r, lambda v: F.struct((v["x"] + F.lit(0.01)).alias("x"), v["y"].alias("y"))))
    then = polygons.filter(s % 31 != 3).select(s, F.when(s % 37 == 5, "OTHER").otherwise(F.col("school_type")).alias("school_type"),
                                               F.when(s % 29 == 4, grown).otherwise(F.col("rings")).alias("rings"))
    then = then.unionByName(polygons.filter(s % 41 == 6).withColumn("school_id", s + 10_000_000))
    return was, streets, kinds, localities, then, names


def refreshed(t: Tables) -> str:
    """A folder of tables built from an earlier state of the sources and then refreshed to the present one."""
    folder = scratch_path(t.spark, f"refreshed-{uuid.uuid4().hex}")
    jobs.build(*_earlier(t), folder)
    jobs.refresh(*_sources(t), folder)
    return folder


@register("s17_refreshed_mapping", _psql("SELECT address_detail_pid, school_id, school_type FROM mapping"))
def s17_refreshed_mapping(spark, d):
    """The mapping after a refresh that rebuilt only what changed."""
    return jobs.read(spark, refreshed(Tables(spark, d)), jobs.MAPPING)


@register("s17_refreshed_streets", _psql(_STREETS_SQL, "street_locality", "street_type_aut", "locality"))
def s17_refreshed_streets(spark, d):
    """The streets derived from the mapping, after the refresh."""
    return jobs.read(spark, refreshed(Tables(spark, d)), jobs.STREETS)


def _polygon_distance_sql() -> str:
    x = lambda c: f"6378137e0 * radians({c})"
    y = lambda c: f"6378137e0 * ln(tan(pi() / 4 + radians({c}) / 2))"
    dx, dy = "(e.bx - e.ax)", "(e.by - e.ay)"
    len2 = f"({dx} * {dx} + {dy} * {dy})"
    t = f"(CASE WHEN {len2} = 0 THEN 0e0 ELSE least(1e0, greatest(0e0, ((p.x - e.ax) * {dx} + (p.y - e.ay) * {dy}) / {len2})) END)"
    d = f"sqrt(pow(e.ax + {t} * {dx} - p.x, 2) + pow(e.ay + {t} * {dy} - p.y, 2))"
    m = BOUNDARY_M
    return _psql(f"""SELECT address_detail_pid, school_id, round(min(d), 3) AS distance FROM (
 SELECT p.address_detail_pid, e.school_id, {d} AS d FROM mp p JOIN me e ON p.x BETWEEN least(e.ax, e.bx) - {m} AND greatest(e.ax, e.bx) + {m} AND p.y BETWEEN least(e.ay, e.by) - {m} AND greatest(e.ay, e.by) + {m}
 UNION ALL SELECT address_detail_pid, school_id, 0e0 FROM mapping) z WHERE d <= {m} GROUP BY 1, 2""", extra={
        "me": f"SELECT school_id, {x('c.ax')} AS ax, {y('c.ay')} AS ay, {x('c.bx')} AS bx, {y('c.by')} AS by FROM catchment_edge c",
        "mp": f"SELECT address_detail_pid, {x('lon')} AS x, {y('lat')} AS y FROM address WHERE date_retired IS NULL"})


@register("j20_polygon_distance", _polygon_distance_sql())
def j20_polygon_distance(spark, d):
    """Active addresses within 150 Mercator units of a catchment, 0 inside."""
    t = Tables(spark, d)
    pts = A.active(D.address(t), "date_retired").select("address_detail_pid", "lon", "lat")
    near = S.within_polygon_distance(pts, D.catchment_polygons(t), "school_id", BOUNDARY_M, "address_detail_pid", inside_size=CELL)
    return near.select("address_detail_pid", "school_id", F.round("distance", 3).alias("distance"))
