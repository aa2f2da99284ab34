"""Registered address queries (search page E2 without the radius, statistics, autocomplete)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattle.functions import text as T
from wattle.operators import addresses as A
from wattle.plans import domain as D
from wattle.plans.oracle import sql
from wattle.plans.registry import register
from wattle.sources.tables import Tables

# Parameters of the registered queries.
SEARCH = dict(number="1", street="name 1", suburb="nation_1")
PAGE_NO, PAGE_SIZE = 2, 50
SUBURB_PREFIX = "nation_1"
POSTCODE = "2001"

STAR_SQL = """SELECT a.*, sl.street_name, sl.street_type_code, sl.date_retired AS street_date_retired, st.name AS street_type,
 l.locality_name, l.state_pid, l.date_retired AS locality_date_retired, s.state_name, s.state_abbreviation
FROM address a LEFT JOIN street_locality sl ON a.street_locality_pid = sl.street_locality_pid
LEFT JOIN street_type_aut st ON sl.street_type_code = st.code
LEFT JOIN locality l ON a.locality_pid = l.locality_pid
LEFT JOIN state s ON l.state_pid = s.state_pid"""
STAR_TABLES = ("address", "street_locality", "street_type_aut", "locality", "state")


def star(t: Tables):
    return A.star(D.address(t), D.street_locality(t), D.street_type_aut(t), D.locality(t), D.state(t))


def _sq(body: str, *more: str, extra: dict | None = None) -> str:
    ex = {"addr_star": STAR_SQL}
    ex.update(extra or {})
    return sql(body, *STAR_TABLES, *more, extra=ex)


@register("j6_address_text", _sq("""SELECT address_detail_pid,
 concat_ws(' ', NULL, flat_number) AS unit_part,
 concat_ws(' ', number_first, CASE WHEN number_last IS NOT NULL THEN concat('-', number_last) END) AS street_number,
 concat_ws(' ', street_name, street_type) AS street,
 concat_ws(', ', nullif(trim(concat_ws(' ', NULL, flat_number)), ''), nullif(trim(concat_ws(' ', NULL, NULL)), ''),
   trim(concat_ws(' ', number_first, CASE WHEN number_last IS NOT NULL THEN concat('-', number_last) END, street_name, street_type, NULL)),
   locality_name, concat(state_abbreviation, ' ', postcode)) AS full_address,
 concat_ws(' ', CASE WHEN flat_number IS NOT NULL THEN concat('Unit ', flat_number, ',') END, number_first, street_name, locality_name,
   state_abbreviation, postcode) AS simple_address,
 coalesce(NULL || '', '') || coalesce(cast(number_first AS varchar) || '', '') || coalesce(NULL || ' ', ' ') || coalesce(street_name || ' ', '')
   || coalesce(street_type || ', ', ', ') || coalesce(locality_name || ' ', ' ') || coalesce(state_abbreviation || ' ', ' ')
   || coalesce(postcode || '', '') AS search_address,
 concat_ws(' ', NULL, flat_number, concat(number_first, ''), CASE WHEN number_last IS NOT NULL THEN concat('-', number_last, '') END) AS street_number_label
FROM addr_star"""))
def j6_address_text(spark, d):
    df = A.with_address_text(star(Tables(spark, d)))
    return df.select("address_detail_pid", "unit_part", "street_number", "street", "full_address", "simple_address",
                     "search_address", "street_number_label")


def _dict_values(dct: dict) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in dct.items()) + ") AS t(k, v)"


_SLUG = "regexp_replace(regexp_replace(lower({0}), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g')"


def _display_sql() -> str:
    num = ("CASE WHEN number_last IS NOT NULL AND number_last <> 0 THEN cast(number_first AS varchar) || '-' || cast(number_last AS varchar) "
           "ELSE coalesce(nullif(cast(number_first AS varchar), ''), 'N/A') END")
    unit = "CASE WHEN flat_number IS NOT NULL AND flat_number <> 0 THEN cast(flat_number AS varchar) ELSE '' END"

    def street(alias):
        t = f"CASE WHEN nullif(street_type, '') IS NOT NULL THEN coalesce({alias}.v, lower(street_type)) ELSE '' END"
        return _SLUG.format(f"concat_ws(' ', nullif(street_name, ''), nullif({t}, ''))")

    def link(alias, prefix, unit_prefix, tail):
        s = street(alias)
        n = f"trim(replace({num}, 'N/A', ''))"
        sub = _SLUG.format("coalesce(locality_name, '')")
        st = "lower(coalesce(state_abbreviation, ''))"
        pc = "coalesce(postcode, '')"
        ok = f"{n} <> '' AND {s} <> '' AND {sub} <> '' AND {st} <> '' AND {pc} <> ''"
        body = f"concat_ws('-', {n}, {s}, {sub}, {st}, {pc})"
        return (f"CASE WHEN {ok} AND {unit} <> '' THEN '{prefix}{unit_prefix}' || {unit} || '-' || {body} || '{tail}' "
                f"WHEN {ok} THEN '{prefix}' || {body} || '{tail}' ELSE '' END")

    ok = "lat IS NOT NULL AND lon IS NOT NULL AND lat <> 0 AND lon <> 0"
    body = f"""SELECT address_detail_pid,
 trim(concat_ws(' ', nullif(street_name, ''), nullif(street_type, ''))) AS street_display,
 {num} AS number_display,
 CASE WHEN flat_number IS NOT NULL AND flat_number <> 0 THEN cast(flat_number AS varchar) ELSE '-' END AS unit_display,
 CASE WHEN {ok} THEN printf('%.6f, %.6f', lat, lon) ELSE 'N/A' END AS coords_display,
 CASE WHEN {ok} THEN printf('https://www.google.com/maps?q=%.6f,%.6f', lat, lon) ELSE '' END AS map_link,
 {link('ab', 'https://www.realestate.com.au/property/', 'unit-', '/')} AS realestate_link,
 {link('fu', 'https://www.domain.com.au/property-profile/', '', '')} AS domain_link
FROM addr_star a LEFT JOIN abbr ab ON ab.k = lower(a.street_type) LEFT JOIN fullt fu ON fu.k = lower(a.street_type)
WHERE a.date_retired IS NULL"""
    return _sq(body, extra={"abbr": _dict_values(T.STREET_TYPE_ABBREVIATED), "fullt": _dict_values(T.STREET_TYPE_FULL)})


@register("a8_address_display", _display_sql())
def a8_address_display(spark, d):
    df = A.with_display(A.active(star(Tables(spark, d)), "date_retired"))
    return df.select("address_detail_pid", "street_display", "number_display", "unit_display", "coords_display",
                     "map_link", "realestate_link", "domain_link")


@register("j7_inner_star_active", sql("""SELECT a.address_detail_pid, sl.street_name, l.locality_name, s.state_name
FROM address a JOIN street_locality sl ON a.street_locality_pid = sl.street_locality_pid
JOIN locality l ON sl.locality_pid = l.locality_pid JOIN state s ON l.state_pid = s.state_pid
WHERE a.date_retired IS NULL AND sl.date_retired IS NULL AND l.date_retired IS NULL""", *STAR_TABLES))
def j7_inner_star_active(spark, d):
    t = Tables(spark, d)
    df = A.star(D.address(t), D.street_locality(t), D.street_type_aut(t), D.locality(t), D.state(t),
                inner=True, locality_via_street=True)
    df = A.active(df, "date_retired", "street_date_retired", "locality_date_retired")
    return df.select("address_detail_pid", "street_name", "locality_name", "state_name")


def _search(t: Tables):
    return A.search_filter(A.active(star(t), "date_retired"), **SEARCH)


_ESC = chr(92)  # the LIKE escape character
_SEARCH_SQL_WHERE = (f"date_retired IS NULL AND cast(number_first AS varchar) LIKE '%{SEARCH['number']}%' "
                     f"AND upper(street_name) LIKE '%{SEARCH['street'].upper()}%' "
                     f"AND upper(locality_name) LIKE '%{SEARCH['suburb'].upper().replace('_', _ESC + '_')}%' ESCAPE '{_ESC}'")


@register("o2_search_page", _sq(f"""SELECT address_detail_pid, number_first, street_name, locality_name, postcode FROM addr_star
WHERE {_SEARCH_SQL_WHERE} ORDER BY address_detail_pid LIMIT {PAGE_SIZE} OFFSET {(PAGE_NO - 1) * PAGE_SIZE}"""))
def o2_search_page(spark, d):
    df = A.distinct_on(_search(Tables(spark, d)), "address_detail_pid", ["locality_name", "street_name", "number_first"])
    return A.page(df.select("address_detail_pid", "number_first", "street_name", "locality_name", "postcode"),
                  ["address_detail_pid"], PAGE_NO, PAGE_SIZE)


@register("ag26_search_total", _sq(f"""SELECT count(DISTINCT address_detail_pid) AS total_count FROM addr_star
WHERE {_SEARCH_SQL_WHERE}"""))
def ag26_search_total(spark, d):
    return A.distinct_address_count(_search(Tables(spark, d)))


@register("o6_suburb_autocomplete", _sq(f"""SELECT DISTINCT locality_name, state_abbreviation, postcode FROM addr_star
WHERE upper(locality_name) LIKE 'NATION{chr(92)}_1%' ESCAPE '{chr(92)}' ORDER BY locality_name, state_abbreviation, postcode LIMIT 20"""))
def o6_suburb_autocomplete(spark, d):
    return A.suburb_autocomplete(star(Tables(spark, d)), SUBURB_PREFIX)


@register("o6_street_autocomplete", _sq("""SELECT street_name, street_type FROM (
 SELECT DISTINCT street_name, street_type FROM addr_star WHERE upper(street_name) LIKE '%' ORDER BY street_name, street_type LIMIT 20) x
WHERE NOT (try_cast(trim(street_name) AS double) IS NOT NULL AND contains(street_name, '.') AND abs(try_cast(trim(street_name) AS double)) <= 180)"""))
def o6_street_autocomplete(spark, d):
    return A.street_autocomplete(star(Tables(spark, d)), "")


@register("o7_suburbs_by_postcode", sql(f"""SELECT DISTINCT locality_name, postcode, state_name FROM suburb_postcode
WHERE postcode = '{POSTCODE}'""", "suburb_postcode"))
def o7_suburbs_by_postcode(spark, d):
    sp = D.suburb_postcode(Tables(spark, d))
    return sp.filter(F.col("postcode") == POSTCODE).distinct().orderBy("locality_name")


@register("d5_street_name_counts", sql("""SELECT street_locality_pid, street_name, count(*) OVER (PARTITION BY street_name) AS name_count
FROM street_locality""", "street_locality"))
def d5_street_name_counts(spark, d):
    return A.street_name_counts(D.street_locality(Tables(spark, d))).select("street_locality_pid", "street_name", "name_count")


@register("t5_junk_streets", sql("""SELECT sl.street_locality_pid, sl.street_name, sl.locality_pid, coalesce(c.n, 0) AS address_count
FROM street_locality sl LEFT JOIN (SELECT street_locality_pid, count(*) AS n FROM address GROUP BY 1) c ON sl.street_locality_pid = c.street_locality_pid
WHERE regexp_full_match(sl.street_name, '[0-9]+\\.[0-9]+')""", "street_locality", "address"))
def t5_junk_streets(spark, d):
    t = Tables(spark, d)
    return A.coordinate_like_streets(D.street_locality(t), D.address(t))


@register("ag1_count_by_locality", _sq("""SELECT locality_name, state_name, postcode, count(*) AS address_count FROM addr_star
WHERE date_retired IS NULL GROUP BY locality_name, state_name, postcode"""))
def ag1_count_by_locality(spark, d):
    return A.count_by(A.active(star(Tables(spark, d)), "date_retired"), "locality_name", "state_name", "postcode")


@register("ag2_locality_stats", sql("""SELECT l.locality_pid, l.locality_name, coalesce(c.n, 0) AS address_count FROM locality l
LEFT JOIN (SELECT locality_pid, count(*) AS n FROM address GROUP BY 1) c ON l.locality_pid = c.locality_pid""", "locality", "address"))
def ag2_locality_stats(spark, d):
    t = Tables(spark, d)
    return A.locality_statistics(D.locality(t), D.address(t))


@register("ag3_suburb_summary_by_state", sql("""SELECT state_name, count(DISTINCT locality_name) AS suburb_count,
 count(DISTINCT postcode) AS postcode_count, count(*) AS row_count FROM suburb_postcode GROUP BY state_name""", "suburb_postcode"))
def ag3_suburb_summary_by_state(spark, d):
    return A.suburb_summary_by_state(D.suburb_postcode(Tables(spark, d)))


@register("ag5_localities_per_state", sql("""SELECT s.state_name, count(*) AS locality_count FROM locality l JOIN state s ON l.state_pid = s.state_pid
WHERE l.date_retired IS NULL GROUP BY s.state_name""", "locality", "state"))
def ag5_localities_per_state(spark, d):
    t = Tables(spark, d)
    loc = A.active(D.locality(t), "date_retired").join(D.state(t), "state_pid")
    return A.count_by(loc, "state_name", name="locality_count")


@register("ag6_state_stats", _sq("""SELECT state_name, count(DISTINCT street_locality_pid) AS street_count, count(DISTINCT locality_pid) AS locality_count,
 count(DISTINCT address_detail_pid) AS address_count FROM addr_star WHERE date_retired IS NULL GROUP BY state_name"""))
def ag6_state_stats(spark, d):
    return A.state_statistics(A.active(star(Tables(spark, d)), "date_retired"))


@register("ag7_multi_suburb_postcodes", sql("""SELECT postcode, count(*) AS suburb_count, string_agg(locality_name, ', ' ORDER BY locality_name) AS suburbs
FROM (SELECT DISTINCT postcode, locality_name FROM suburb_postcode) p GROUP BY postcode HAVING count(*) > 1""", "suburb_postcode"))
def ag7_multi_suburb_postcodes(spark, d):
    return A.multi_suburb_postcodes(D.suburb_postcode(Tables(spark, d)))


@register("ag8_geocode_coverage", sql("""SELECT 'address' AS table_name, count(*) AS total, count(lat) AS geocoded,
 round(count(lat) * 100e0 / count(*), 2) AS pct FROM address
UNION ALL SELECT 'school_profile', count(*), count(latitude), round(count(latitude) * 100e0 / count(*), 2) FROM school_profile""",
                                      "address", "school_profile"))
def ag8_geocode_coverage(spark, d):
    t = Tables(spark, d)
    return A.geocode_coverage({"address": D.address(t),
                               "school_profile": D.school_profile(t).withColumnRenamed("latitude", "lat")})


@register("ag9_coverage_by_suburb", _sq("""SELECT locality_name, count(DISTINCT address_detail_pid) AS total,
 count(DISTINCT CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN address_detail_pid END) AS geocoded,
 round(count(DISTINCT CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN address_detail_pid END) * 100e0 / count(DISTINCT address_detail_pid), 2) AS pct
FROM addr_star WHERE date_retired IS NULL GROUP BY locality_name HAVING count(DISTINCT address_detail_pid) > 100"""))
def ag9_coverage_by_suburb(spark, d):
    return A.coverage_by_suburb(A.active(star(Tables(spark, d)), "date_retired"))


@register("ag10_density_grid", sql("""SELECT round((cx + 0.5e0) * 0.01e0, 6) AS lon, round((cy + 0.5e0) * 0.01e0, 6) AS lat, count(*) AS address_count
FROM (SELECT lon, lat, cast(floor(lon / 0.01e0) AS bigint) AS cx, cast(floor(lat / 0.01e0) AS bigint) AS cy FROM address
 WHERE date_retired IS NULL AND lon IS NOT NULL AND lat IS NOT NULL AND lon BETWEEN 151.0 AND 151.3 AND lat BETWEEN -34.0 AND -33.7) x
WHERE lon NOT IN (cx * 0.01e0, (cx + 1) * 0.01e0) AND lat NOT IN (cy * 0.01e0, (cy + 1) * 0.01e0)
GROUP BY cx, cy ORDER BY address_count DESC, lon, lat LIMIT 20""", "address"))
def ag10_density_grid(spark, d):
    return A.density_grid(A.active(D.address(Tables(spark, d)), "date_retired"), 0.01, 20, (151.0, -34.0, 151.3, -33.7))


@register("ag11_postcode_centroids", sql("""SELECT postcode, round(avg(lon), 6) AS centroid_lon, round(avg(lat), 6) AS centroid_lat, count(*) AS address_count
FROM address WHERE date_retired IS NULL AND lon IS NOT NULL AND lat IS NOT NULL GROUP BY postcode HAVING count(*) > 10""", "address"))
def ag11_postcode_centroids(spark, d):
    c = A.postcode_centroids(A.active(D.address(Tables(spark, d)), "date_retired"))
    return c.select("postcode", F.round("centroid_lon", 6).alias("centroid_lon"), F.round("centroid_lat", 6).alias("centroid_lat"),
                    "address_count")


@register("a7_distinct_short_street", _sq("""SELECT DISTINCT street_name, street_type, locality_name, postcode FROM addr_star
WHERE date_retired IS NULL"""))
def a7_distinct_short_street(spark, d):
    return (A.active(star(Tables(spark, d)), "date_retired")
             .select("street_name", "street_type", "locality_name", "postcode").distinct())


@register("s18_locality_postcodes", _sq("""SELECT DISTINCT locality_pid, locality_name, postcode, state_name, state_abbreviation FROM addr_star"""))
def s18_locality_postcodes(spark, d):
    return (star(Tables(spark, d)).select("locality_pid", "locality_name", "postcode", "state_name", "state_abbreviation")
            .distinct())


@register("ag27_matching_suburb_count", sql(f"""SELECT count(DISTINCT locality_name) AS suburb_count FROM suburb_postcode
WHERE ('' = '' OR locality_name = '') AND ('{POSTCODE}' = '' OR postcode = '{POSTCODE}')""", "suburb_postcode"))
def ag27_matching_suburb_count(spark, d):
    sp = D.suburb_postcode(Tables(spark, d))
    suburb, postcode = "", POSTCODE
    cond = (F.lit(suburb) == "") | (F.col("locality_name") == suburb)
    cond = cond & ((F.lit(postcode) == "") | (F.col("postcode") == postcode))
    return sp.filter(cond).agg(F.count_distinct("locality_name").alias("suburb_count"))


def _hull_ctes(points: str) -> dict[str, str]:
    """``rings`` (k, ring): the hull of each key's points (k, lon, lat), by gift wrapping from the smallest
    point counter-clockwise; of points in line the farthest is the next vertex."""
    turn = "(b.x - cur.x) * (q.y - cur.y) - (b.y - cur.y) * (q.x - cur.x)"
    far = "(q.x - cur.x) * (q.x - cur.x) + (q.y - cur.y) * (q.y - cur.y) > (b.x - cur.x) * (b.x - cur.x) + (b.y - cur.y) * (b.y - cur.y)"
    return {
        "pts": points,
        "sets": "SELECT k, list(DISTINCT {'x': lon, 'y': lat}) AS p, min({'x': lon, 'y': lat}) AS s FROM pts GROUP BY k",
        "wrap": f"""SELECT k, p, s, s AS cur, [s] AS ring, 1 AS n FROM sets UNION ALL
 SELECT k, p, s, nxt, list_append(ring, nxt), n + 1 FROM (SELECT *, list_reduce(list_filter(p, lambda q: q <> cur),
  lambda b, q: CASE WHEN {turn} < 0 OR ({turn} = 0 AND {far}) THEN q ELSE b END) AS nxt FROM wrap WHERE len(p) > 1) w WHERE nxt <> s AND n < 100000""",
        "rings": "SELECT k, arg_max(ring, n) AS ring FROM wrap GROUP BY k",
    }


def _recursive(sql_text: str) -> str:
    return sql_text.replace("WITH ", "WITH RECURSIVE ", 1)


# WGS84 area: every edge's strip to the equator, by the spheroid's area function.
_E = "0.0818191908426214943348e0"
_Q = f"((1 - {_E} * {_E}) * (sin(radians(v.y)) / (1 - {_E} * {_E} * sin(radians(v.y)) * sin(radians(v.y))) - ln((1 - {_E} * sin(radians(v.y))) / (1 + {_E} * sin(radians(v.y)))) / (2 * {_E})))"
_HULL_AREA = f"""abs(list_sum(list_transform(range(1, len(ring) + 1), lambda i: radians(ring[i % len(ring) + 1].x - ring[i].x)
 * (qs[i] + qs[i % len(ring) + 1])))) * 6378137e0 * 6378137e0 / 4"""
_BIG_POSTCODES = """SELECT a.postcode || '|' || l.locality_name AS k, a.lon, a.lat FROM address a JOIN locality l ON a.locality_pid = l.locality_pid
 WHERE a.date_retired IS NULL AND a.lon IS NOT NULL AND a.lat IS NOT NULL
 AND (a.postcode, l.locality_name) IN (SELECT (b.postcode, m.locality_name) FROM address b JOIN locality m ON b.locality_pid = m.locality_pid
  WHERE b.date_retired IS NULL AND b.lon IS NOT NULL AND b.lat IS NOT NULL GROUP BY b.postcode, m.locality_name HAVING count(*) > 10)"""


@register("ag11_postcode_hull", _recursive(sql(f"""SELECT split_part(k, '|', 1) AS postcode, split_part(k, '|', 2) AS locality_name, cast(len(ring) AS integer) AS hull_vertices,
 round(CASE WHEN len(ring) < 3 THEN 0e0 ELSE {_HULL_AREA} END, 0) AS hull_area_m2 FROM (SELECT *, list_transform(ring, lambda v: {_Q}) AS qs FROM rings) r""",
                                                "address", "locality", extra=_hull_ctes(_BIG_POSTCODES))))
def ag11_postcode_hull(spark, d):
    """AG11 hull part (SP10): per postcode and locality with more than 10 active addresses, the
    convex hull's vertex count and area."""
    from wattle.operators.hull import convex_hulls
    t = Tables(spark, d)
    keys = ["postcode", "locality_name"]
    a = A.active(D.address(t), "date_retired").join(D.locality(t).select("locality_pid", "locality_name"), "locality_pid")
    big = A.postcode_centroids(a, keys=keys).select(*keys)
    h = convex_hulls(a.join(big, keys, "left_semi"), keys)
    return h.select(*keys, "hull_vertices", F.round("hull_area_m2", 0).alias("hull_area_m2"))


@register("ag12_suburb_hull_geojson", _recursive(_sq("""SELECT k AS locality_name, cast(len(ring) AS integer) AS hull_vertices,
 '{"type":"Polygon","coordinates":[[' || array_to_string(list_transform(list_append(ring, ring[1]), lambda v: '[' || cast(round(v.x, 9) AS varchar) || ',' || cast(round(v.y, 9) AS varchar) || ']'), ',') || ']]}' AS geojson
FROM rings""", extra=_hull_ctes("SELECT locality_name AS k, lon, lat FROM addr_star WHERE date_retired IS NULL AND lon IS NOT NULL AND lat IS NOT NULL"))))
def ag12_suburb_hull_geojson(spark, d):
    """AG12: each suburb's convex hull boundary as GeoJSON text."""
    from wattle.operators.hull import convex_hulls, hull_geojson
    s = star(Tables(spark, d)).filter(F.col("date_retired").isNull())
    return hull_geojson(convex_hulls(s, ["locality_name"])).select("locality_name", "hull_vertices", "geojson")


@register("j8_street_type_autocomplete", sql("""SELECT DISTINCT sl.street_name, st.name AS street_type FROM street_locality sl
LEFT JOIN street_type_aut st ON sl.street_type_code = st.code WHERE sl.date_retired IS NULL AND upper(sl.street_name) LIKE 'NAME 1%'
ORDER BY street_name, street_type LIMIT 20""", "street_locality", "street_type_aut"))
def j8_street_type_autocomplete(spark, d):
    t = Tables(spark, d)
    return A.street_type_autocomplete(D.street_locality(t), D.street_type_aut(t), "name 1")


@register("ag4_global_stats", sql("""SELECT (SELECT count(DISTINCT locality_pid) FROM locality WHERE date_retired IS NULL) AS total_localities,
 (SELECT count(DISTINCT address_detail_pid) FROM address WHERE date_retired IS NULL) AS total_addresses,
 (SELECT count(DISTINCT street_locality_pid) FROM street_locality WHERE date_retired IS NULL) AS total_streets""",
                                  "locality", "address", "street_locality"))
def ag4_global_stats(spark, d):
    t = Tables(spark, d)
    return A.global_statistics(D.locality(t), D.address(t), D.street_locality(t), with_refresh_time=False)


BOX = (151.1, -33.99, 151.15, -33.96)


@register("f7_address_box", sql(f"""SELECT address_detail_pid, lon, lat FROM address WHERE date_retired IS NULL
AND lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}""", "address"))
def f7_address_box(spark, d):
    """a latitude/longitude box (two BETWEENs, pushed to the scan when lon/lat are stored columns)."""
    a = A.active(D.address(Tables(spark, d)), "date_retired")
    return a.filter(F.col("lon").between(BOX[0], BOX[2]) & F.col("lat").between(BOX[1], BOX[3])).select(
        "address_detail_pid", "lon", "lat")


@register("o4_street_addresses_numeric", sql("""SELECT address_detail_pid, cast(number_first AS integer) AS number_first, number_last
FROM address WHERE street_locality_pid = 'ST7' AND date_retired IS NULL ORDER BY cast(number_first AS integer), address_detail_pid""", "address"))
def o4_street_addresses_numeric(spark, d):
    """F9 + O4: the addresses of one street, ordered by the house number as a number."""
    a = A.active(D.address(Tables(spark, d)), "date_retired").filter(F.col("street_locality_pid") == "ST7")
    return a.select("address_detail_pid", F.col("number_first").cast("int").alias("number_first"), "number_last") \
            .orderBy("number_first", "address_detail_pid")


@register("o7_suburbs_by_name", sql(f"""SELECT DISTINCT locality_name, postcode, state_name FROM suburb_postcode
WHERE upper(locality_name) LIKE 'NATION{chr(92)}_1%' ESCAPE '{chr(92)}' ORDER BY locality_name, postcode, state_name LIMIT 50""", "suburb_postcode"))
def o7_suburbs_by_name(spark, d):
    """Suburbs by name prefix (case-insensitive, wildcards escaped), first 50."""
    sp = D.suburb_postcode(Tables(spark, d))
    return (sp.filter(T.istarts("locality_name", SUBURB_PREFIX)).distinct()
              .orderBy("locality_name", "postcode", "state_name").limit(50))


@register("o7_suburbs_by_state", sql("""SELECT DISTINCT locality_name, postcode FROM suburb_postcode WHERE state_name = 'ASIA'""", "suburb_postcode"))
def o7_suburbs_by_state(spark, d):
    """The suburbs of one state (the state-view form), ordered."""
    sp = D.suburb_postcode(Tables(spark, d))
    return sp.filter(F.col("state_name") == "ASIA").select("locality_name", "postcode").distinct().orderBy("locality_name", "postcode")


@register("o2_search_page_with_totals", _sq(f"""SELECT address_detail_pid, number_first, street_name, locality_name, postcode, total_count, cast(ceil(total_count / {PAGE_SIZE}e0) AS bigint) AS total_pages,
 {PAGE_NO * PAGE_SIZE} < total_count AS has_more FROM (SELECT *, count(*) OVER () AS total_count FROM (SELECT DISTINCT ON (address_detail_pid) address_detail_pid, number_first, street_name, locality_name, postcode
 FROM addr_star WHERE {_SEARCH_SQL_WHERE} ORDER BY address_detail_pid, locality_name, street_name, number_first) x) y ORDER BY address_detail_pid LIMIT {PAGE_SIZE} OFFSET {(PAGE_NO - 1) * PAGE_SIZE}"""))
def o2_search_page_with_totals(spark, d):
    """O2: a page with the total number of rows and pages, and whether more pages follow."""
    found = A.distinct_on(_search(Tables(spark, d)), "address_detail_pid", ["locality_name", "street_name", "number_first"])
    return A.page_with_totals(found.select("address_detail_pid", "number_first", "street_name", "locality_name", "postcode"), ["address_detail_pid"], PAGE_NO, PAGE_SIZE)


AFTER_PID = "GA000001000"


@register("o2_search_page_keyset", _sq(f"""SELECT DISTINCT ON (address_detail_pid) address_detail_pid, number_first, street_name, locality_name, postcode FROM addr_star
WHERE {_SEARCH_SQL_WHERE} AND address_detail_pid > '{AFTER_PID}' ORDER BY address_detail_pid, locality_name, street_name, number_first LIMIT {PAGE_SIZE}"""))
def o2_search_page_keyset(spark, d):
    """O2, keyset form: the page after a given address, found by a filter on the key and not by an offset."""
    after = _search(Tables(spark, d)).filter(F.col("address_detail_pid") > AFTER_PID)
    found = A.distinct_on(after, "address_detail_pid", ["locality_name", "street_name", "number_first"])
    return A.page(found.select("address_detail_pid", "number_first", "street_name", "locality_name", "postcode"), ["address_detail_pid"], 1, PAGE_SIZE)


@register("o6_box_street_autocomplete", _sq(f"""SELECT DISTINCT street_name, street_type FROM addr_star WHERE date_retired IS NULL AND upper(street_name) LIKE 'NAME 3%'
AND lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]} ORDER BY street_name, street_type NULLS LAST LIMIT 20"""))
def o6_box_street_autocomplete(spark, d):
    """O6 within a box (F7): street names by prefix among the active addresses of the box."""
    a = A.active(star(Tables(spark, d)), "date_retired")
    inside = a.filter(F.col("lon").between(BOX[0], BOX[2]) & F.col("lat").between(BOX[1], BOX[3]))
    return A.street_autocomplete(inside, "name 3", drop_coordinate_like=False)


STREET_PREFIX, SUBURB_START = "name 11", "nation"


@register("o6_streets_by_prefix", sql(f"""SELECT DISTINCT street_name, st.name AS street_type FROM street_locality sl LEFT JOIN street_type_aut st ON st.code = sl.street_type_code
WHERE upper(street_name) LIKE '{STREET_PREFIX.upper()}%' ORDER BY street_name, street_type NULLS LAST LIMIT 20""", "street_locality", "street_type_aut"))
def o6_streets_by_prefix(spark, d):
    """O6 from the street table alone: the prefix is a range of its saved names, so the scan skips what cannot match."""
    from wattle.plans.q_schools import name_index
    t = Tables(spark, d)
    found = name_index(t, "streets", D.street_locality, "street_locality_pid", "street_name").starting(STREET_PREFIX).select(F.col("id").alias("street_locality_pid"))
    streets = D.street_locality(t).join(found, "street_locality_pid", "left_semi").join(
        D.street_type_aut(t).select(F.col("code").alias("street_type_code"), F.col("name").alias("street_type")), "street_type_code", "left")
    return A.street_autocomplete(streets, STREET_PREFIX, drop_coordinate_like=False)


@register("o6_suburbs_by_prefix", sql(f"""SELECT DISTINCT locality_name, state_name, postcode FROM suburb_postcode WHERE upper(locality_name) LIKE '{SUBURB_START.upper()}%'
ORDER BY locality_name, state_name, postcode LIMIT 20""", "suburb_postcode"))
def o6_suburbs_by_prefix(spark, d):
    """O6 from the suburb table alone."""
    sp = D.suburb_postcode(Tables(spark, d)).withColumnRenamed("state_name", "state_abbreviation")
    return A.suburb_autocomplete(sp, SUBURB_START).withColumnRenamed("state_abbreviation", "state_name")


# ----------------------------------------------------------------------------- J6 whole, A3, A9
def _codes_sql(kind: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in D.CODES[kind].items()) + ") AS t(code, name)"


_WHOLE = {
    "whole": """SELECT a.address_detail_pid, a.number_first, a.number_last, a.flat_number, a.street_locality_pid, a.locality_pid, a.postcode,
 CASE WHEN k % 10 = 0 THEN 'UNIT' WHEN k % 15 = 0 THEN 'APT' WHEN k % 25 = 0 THEN 'ZZ' END AS flat_type_code,
 CASE k % 6 WHEN 0 THEN 'L' WHEN 1 THEN 'B' WHEN 2 THEN 'ZZ' END AS level_type_code, CASE WHEN k % 6 < 3 THEN k % 12 END AS level_number,
 CASE WHEN k % 23 <> 0 THEN k % 6 - 1 END AS confidence FROM (SELECT *, cast(substr(address_detail_pid, 3) AS bigint) AS k FROM address) a""",
    "street_whole": """SELECT *, CASE cast(substr(street_locality_pid, 3) AS bigint) % 9 WHEN 0 THEN 'N' WHEN 1 THEN 'EX' WHEN 2 THEN 'ZZ' END AS street_suffix_code
 FROM street_locality""",
    "default_geocode": """SELECT address_detail_pid, CASE k % 4 WHEN 0 THEN 'BC' WHEN 1 THEN 'FC' WHEN 2 THEN 'GAP' ELSE 'PC' END AS geocode_type_code, lat AS latitude, lon AS longitude
 FROM (SELECT *, cast(substr(address_detail_pid, 3) AS bigint) AS k FROM address) g WHERE k % 10 <> 3""",
    **{f"{kind}_codes": _codes_sql(kind) for kind in D.CODES},
    "full_star": """SELECT w.*, ft.name AS flat_type, lt.name AS level_type, sl.street_name, st.name AS street_type, ss.name AS street_suffix, l.locality_name,
 s.state_abbreviation, g.geocode_type_code, gt.name AS geocode_type, g.latitude, g.longitude FROM whole w
LEFT JOIN flat_type_codes ft ON ft.code = w.flat_type_code LEFT JOIN level_type_codes lt ON lt.code = w.level_type_code
LEFT JOIN street_whole sl ON sl.street_locality_pid = w.street_locality_pid LEFT JOIN street_type_codes st ON st.code = sl.street_type_code
LEFT JOIN street_suffix_codes ss ON ss.code = sl.street_suffix_code LEFT JOIN locality l ON l.locality_pid = w.locality_pid LEFT JOIN state s ON s.state_pid = l.state_pid
LEFT JOIN default_geocode g ON g.address_detail_pid = w.address_detail_pid LEFT JOIN geocode_type_codes gt ON gt.code = g.geocode_type_code""",
}
_UNIT = "CASE WHEN flat_number IS NOT NULL THEN 'Unit ' || flat_number || ',' END"
_AREA = "locality_name, state_abbreviation, postcode"


def _whole(t: Tables):
    return A.full_star(D.address_whole(t), D.street_whole(t), D.locality(t), D.state(t), D.code_tables(t), D.default_geocode(t))


@register("j6_full_star", sql(f"""SELECT address_detail_pid, concat_ws(' ', flat_type, flat_number) AS unit_part, concat_ws(' ', street_name, street_type, street_suffix) AS street,
 concat_ws(', ', nullif(trim(concat_ws(' ', flat_type, flat_number)), ''), nullif(trim(concat_ws(' ', level_type, level_number)), ''),
  trim(concat_ws(' ', number_first, '-' || number_last, street_name, street_type, street_suffix)), locality_name, concat(state_abbreviation, ' ', postcode)) AS full_address,
 concat_ws(' ', {_UNIT}, number_first, street_name, {_AREA}) AS simple_address, concat_ws(' ', {_UNIT}, number_first, street_name, street_type) AS street_address,
 concat_ws(' ', {_UNIT}, number_first, street_name, street_type, {_AREA}) AS listed_address, geocode_type_code, geocode_type, latitude, longitude FROM full_star""",
                              "address", "street_locality", "locality", "state", extra=_WHOLE))
def j6_full_star(spark, d):
    area = ["locality_name", "state_abbreviation", "postcode"]
    return A.with_address_text(_whole(Tables(spark, d))).select(
        "address_detail_pid", "unit_part", "street", "full_address", "simple_address",
        T.plain_address("flat_number", "number_first", "street_name", "street_type").alias("street_address"),
        T.plain_address("flat_number", "number_first", "street_name", "street_type", *area).alias("listed_address"),
        "geocode_type_code", "geocode_type", "latitude", "longitude")


def _words_sql(column: str, words: dict[str, str], other: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in words.items()) + f" ELSE '{other}' END"


_WORD = "CASE confidence WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' WHEN 0 THEN 'VERY LOW' WHEN -1 THEN 'UNKNOWN' END"


@register("a9_geocode_details", sql(f"""SELECT geocode_detail, confidence_detail, count(*) AS address_count FROM (
 SELECT {_words_sql('geocode_type_code', T.GEOCODE_DETAIL, 'Unknown geocode type')} AS geocode_detail,
  {_words_sql(f'({_WORD})', T.CONFIDENCE_DETAIL, 'Unknown confidence level')} AS confidence_detail FROM full_star) x GROUP BY 1, 2""",
                                    "address", "street_locality", "locality", "state", extra=_WHOLE))
def a9_geocode_details(spark, d):
    t = Tables(spark, d)
    c = F.col("confidence")
    word = F.when(c == 3, "HIGH").when(c == 2, "MEDIUM").when(c == 1, "LOW").when(c == 0, "VERY LOW").when(c == -1, "UNKNOWN")
    a = D.address_whole(t).select("address_detail_pid", "confidence").join(D.default_geocode(t).select("address_detail_pid", "geocode_type_code"), "address_detail_pid", "left")
    return (a.groupBy(T.geocode_detail("geocode_type_code").alias("geocode_detail"), T.confidence_detail(word).alias("confidence_detail"))
             .agg(F.count(F.lit(1)).alias("address_count")))


@register("a9_geocode_labels", sql(f"""SELECT geocode_label, confidence_label, count(*) AS address_count FROM (
 SELECT {_words_sql('geocode_type_code', T.GEOCODE_TYPE_LABELS, 'N/A')} AS geocode_label,
  CASE confidence WHEN 3 THEN 'Very High' WHEN 2 THEN 'High' WHEN 1 THEN 'Medium' WHEN 0 THEN 'Low' WHEN -1 THEN 'None' ELSE 'Unknown' END AS confidence_label
 FROM full_star) x GROUP BY 1, 2""", "address", "street_locality", "locality", "state", extra=_WHOLE))
def a9_geocode_labels(spark, d):
    t = Tables(spark, d)
    a = D.address_whole(t).select("address_detail_pid", "confidence").join(D.default_geocode(t).select("address_detail_pid", "geocode_type_code"), "address_detail_pid", "left")
    return (a.groupBy(T.geocode_type_label("geocode_type_code").alias("geocode_label"), T.confidence_label("confidence").alias("confidence_label"))
             .agg(F.count(F.lit(1)).alias("address_count")))
