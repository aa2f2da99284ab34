"""Registered school queries: name resolution, lookup, search tiers, statistics."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wattle.functions import geo as G
from wattle.operators import schools as SC
from wattle.plans import domain as D
from wattle.plans.oracle import sql
from wattle.operators.text_index import NameIndex, build as build_index
from wattle.plans.registry import register
from wattle.session import scratch_path
from wattle.plans.q_spatial import PIP_SQL as _PIP_SQL, vincenty_sql
from wattle.sources.tables import Tables

T1_QUERY = "place1"
T2_QUERY, T2_STATE = "high", "NSW"
T4_QUERY, T4_STATE = "place2", "NSW"
T3_QUERY = "high schools"

_ABBR_CASE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SC.SCHOOL_TYPE_ABBREVIATIONS.items()) + " END"
PARTS_SQL = f"""SELECT school_id, school_name, len(string_split(school_name, ' ')) AS word_count,
 array_to_string(string_split(school_name, ' ')[1:len(string_split(school_name, ' ')) - 1], ' ') AS school_first,
 string_split(school_name, ' ')[-1] AS school_abbrev, {_ABBR_CASE.format("string_split(school_name, ' ')[-1]")} AS school_type_name
FROM school_catchment_name"""
LOOKUP_SQL = """SELECT p.*, k.school_id, k.school_name AS catchment_school_name, k.school_first, k.school_abbrev, k.school_type_name,
 p.school_name AS profile_school_name, 'https://myschool.edu.au/school/' || cast(p.acara_sml_id AS varchar) AS acara_url,
 'https://myschool.edu.au/school/' || cast(p.acara_sml_id AS varchar) || '/naplan/results' AS naplan_url
FROM school_profile p LEFT JOIN (SELECT * FROM parts WHERE school_type_name IS NOT NULL) k ON concat_ws(' ', k.school_first, k.school_type_name) = p.school_name
WHERE p.state = 'NSW' AND p.school_sector = 'Government'"""


def _lsql(body: str, *more: str, extra: dict | None = None) -> str:
    ex = {"parts": PARTS_SQL, "lookup": LOOKUP_SQL}
    ex.update(extra or {})
    return sql(body, "school_catchment_name", "school_profile", *more, extra=ex)


def lookup(t: Tables):
    return SC.build_lookup(D.school_catchment_name(t), D.school_profile(t), patches=SC.lookup_patches(t.spark))


@register("a14_school_name_parts", sql(f"SELECT school_id, word_count, school_first, school_abbrev, school_type_name FROM ({PARTS_SQL}) x",
                                       "school_catchment_name"))
def a14_school_name_parts(spark, d):
    return SC.with_name_parts(D.school_catchment_name(Tables(spark, d))).select(
        "school_id", "word_count", "school_first", "school_abbrev", "school_type_name")


_LOOKUP_COLS = ["school_id", "catchment_school_name", "acara_sml_id", "profile_school_name", "state", "school_sector",
                "school_type_name", "acara_url", "naplan_url"]


@register("j11_school_lookup", _lsql("SELECT " + ", ".join(_LOOKUP_COLS) + " FROM lookup"))
def j11_school_lookup(spark, d):
    return lookup(Tables(spark, d)).select(*_LOOKUP_COLS)


@register("j9_profile_location", sql("""SELECT p.acara_sml_id, p.school_name, l.abs_remoteness_area_name, p.icsea, p.total_enrolments
FROM school_profile p JOIN school_location l ON p.acara_sml_id = l.acara_sml_id""", "school_location"))
def j9_profile_location(spark, d):
    t = Tables(spark, d)
    loc = D.school_location(t).select("acara_sml_id", "abs_remoteness_area_name")
    return D.school_profile(t).join(loc, "acara_sml_id").select("acara_sml_id", "school_name", "abs_remoteness_area_name",
                                                                 "icsea", "total_enrolments")


@register("j10_profile_not_in_location", sql("""SELECT acara_sml_id, school_name FROM school_profile p
WHERE NOT EXISTS (SELECT 1 FROM school_location l WHERE l.acara_sml_id = p.acara_sml_id)""", "school_location"))
def j10_profile_not_in_location(spark, d):
    t = Tables(spark, d)
    return D.school_profile(t).join(D.school_location(t), "acara_sml_id", "left_anti").select("acara_sml_id", "school_name")


@register("j10_location_not_in_profile", sql("""SELECT acara_sml_id, school_name FROM school_location l
WHERE NOT EXISTS (SELECT 1 FROM school_profile p WHERE l.acara_sml_id = p.acara_sml_id)""", "school_location"))
def j10_location_not_in_profile(spark, d):
    t = Tables(spark, d)
    return D.school_location(t).join(D.school_profile(t), "acara_sml_id", "left_anti").select("acara_sml_id", "school_name")


@register("j26_coordinate_match", _lsql("""SELECT p.acara_sml_id, p.latitude = l.latitude AS lat_match, p.longitude = l.longitude AS lon_match,
 k.school_id IS NOT NULL AS in_lookup FROM school_profile p JOIN school_location l ON p.acara_sml_id = l.acara_sml_id
 LEFT JOIN (SELECT acara_sml_id, min(school_id) AS school_id FROM lookup GROUP BY 1) k ON k.acara_sml_id = p.acara_sml_id""",
                                        "school_location"))
def j26_coordinate_match(spark, d):
    t = Tables(spark, d)
    p = D.school_profile(t).select("acara_sml_id", "latitude", "longitude")
    l = D.school_location(t).select("acara_sml_id", F.col("latitude").alias("l_lat"), F.col("longitude").alias("l_lon"))
    k = lookup(t).groupBy("acara_sml_id").agg(F.min("school_id").alias("school_id"))
    j = p.join(l, "acara_sml_id").join(k, "acara_sml_id", "left")
    return j.select("acara_sml_id", (F.col("latitude") == F.col("l_lat")).alias("lat_match"),
                    (F.col("longitude") == F.col("l_lon")).alias("lon_match"), F.col("school_id").isNotNull().alias("in_lookup"))


@register("j27_catchment_icsea", _lsql("""SELECT c.school_id, c.school_name, lk.icsea, lk.acara_sml_id FROM school_catchment_name c
LEFT JOIN lookup lk ON lk.school_id = c.school_id AND lk.catchment_school_name = c.school_name"""))
def j27_catchment_icsea(spark, d):
    t = Tables(spark, d)
    lk = lookup(t).select("school_id", F.col("catchment_school_name").alias("school_name"), "icsea", "acara_sml_id")
    return D.school_catchment_name(t).join(lk, ["school_id", "school_name"], "left").select(
        "school_id", "school_name", "icsea", "acara_sml_id")


@register("j28_school_detail", _lsql("""SELECT p.acara_sml_id, p.school_name, lk.school_id, lk.catchment_school_name, lk.acara_url,
 coalesce(nullif(lk.profile_school_name, ''), lk.catchment_school_name) AS display_name
FROM school_profile p LEFT JOIN lookup lk ON lk.acara_sml_id = p.acara_sml_id"""))
def j28_school_detail(spark, d):
    t = Tables(spark, d)
    lk = lookup(t).select("acara_sml_id", "school_id", "catchment_school_name", "acara_url", "profile_school_name")
    j = D.school_profile(t).select("acara_sml_id", "school_name").join(lk, "acara_sml_id", "left")
    return j.select("acara_sml_id", "school_name", "school_id", "catchment_school_name", "acara_url",
                    SC.display_name("profile_school_name", "catchment_school_name").alias("display_name"))


@register("j29_school_point_fallback", _lsql("""SELECT e.school_id, round(coalesce(lk.latitude, sum((e.ay + e.by) * (e.ax * e.by - e.bx * e.ay)) / (3 * sum(e.ax * e.by - e.bx * e.ay))), 9) AS school_lat,
 round(coalesce(lk.longitude, sum((e.ax + e.bx) * (e.ax * e.by - e.bx * e.ay)) / (3 * sum(e.ax * e.by - e.bx * e.ay))), 9) AS school_lon
FROM catchment_edge e LEFT JOIN lookup lk ON lk.school_id = e.school_id GROUP BY e.school_id, lk.latitude, lk.longitude""", "catchment_edge"))
def j29_school_point_fallback(spark, d):
    t = Tables(spark, d)
    cent = D.catchment_polygons(t).select("school_id", G.polygon_centroid("rings").alias("c"))
    lk = lookup(t).filter(F.col("school_id").isNotNull()).select("school_id", "latitude", "longitude")
    j = cent.join(lk, "school_id", "left")
    return j.select("school_id", F.round(F.coalesce("latitude", "c.y"), 9).alias("school_lat"),
                    F.round(F.coalesce("longitude", "c.x"), 9).alias("school_lon"))


@register("ag20_coords_by_state", sql("""SELECT state, count(*) AS total, count(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1 END) AS with_coords,
 count(CASE WHEN latitude IS NULL OR longitude IS NULL THEN 1 END) AS missing_coords FROM school_location GROUP BY state""", "school_location"))
def ag20_coords_by_state(spark, d):
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return D.school_location(Tables(spark, d)).groupBy("state").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(has).alias("with_coords"), F.count_if(~has).alias("missing_coords"))


@register("ag21_schools_by_type_sector", sql("""SELECT school_type, school_sector, count(*) AS school_count FROM school_profile
GROUP BY school_type, school_sector""", "school_profile"))
def ag21_schools_by_type_sector(spark, d):
    return D.school_profile(Tables(spark, d)).groupBy("school_type", "school_sector").agg(F.count(F.lit(1)).alias("school_count"))


@register("ag21_special_per_state", sql("""SELECT state, count(*) AS special_count FROM school_location WHERE special_school = 1 GROUP BY state""",
                                        "school_location"))
def ag21_special_per_state(spark, d):
    return (D.school_location(Tables(spark, d)).filter(F.col("special_school") == 1)
            .groupBy("state").agg(F.count(F.lit(1)).alias("special_count")))


@register("ag22_icsea_by_remoteness", sql("""SELECT l.abs_remoteness_area_name, count(*) AS school_count, round(avg(p.icsea), 2) AS avg_icsea,
 round(avg(p.total_enrolments), 2) AS avg_enrolments FROM school_profile p JOIN school_location l ON p.acara_sml_id = l.acara_sml_id
GROUP BY l.abs_remoteness_area_name""", "school_location"))
def ag22_icsea_by_remoteness(spark, d):
    t = Tables(spark, d)
    j = D.school_profile(t).join(D.school_location(t).select("acara_sml_id", "abs_remoteness_area_name"), "acara_sml_id")
    return j.groupBy("abs_remoteness_area_name").agg(F.count(F.lit(1)).alias("school_count"),
                                                     F.round(F.avg("icsea"), 2).alias("avg_icsea"),
                                                     F.round(F.avg("total_enrolments"), 2).alias("avg_enrolments"))


@register("ag23_coord_range_by_state", sql("""SELECT state, min(latitude) AS min_lat, max(latitude) AS max_lat, min(longitude) AS min_lon,
 max(longitude) AS max_lon FROM school_location WHERE latitude IS NOT NULL GROUP BY state""", "school_location"))
def ag23_coord_range_by_state(spark, d):
    return (D.school_location(Tables(spark, d)).filter(F.col("latitude").isNotNull()).groupBy("state")
            .agg(F.min("latitude").alias("min_lat"), F.max("latitude").alias("max_lat"),
                 F.min("longitude").alias("min_lon"), F.max("longitude").alias("max_lon")))


@register("ag24_lookup_summary", _lsql("""SELECT count(*) AS total_records, count(DISTINCT school_id) AS unique_schools,
 count(acara_sml_id) AS matched_with_profile, count(DISTINCT state) AS states_covered FROM lookup"""))
def ag24_lookup_summary(spark, d):
    return lookup(Tables(spark, d)).agg(F.count(F.lit(1)).alias("total_records"), F.count_distinct("school_id").alias("unique_schools"),
                                        F.count("acara_sml_id").alias("matched_with_profile"),
                                        F.count_distinct("state").alias("states_covered"))


@register("ag25_profile_completeness", sql("""SELECT state, count(*) AS schools, count(DISTINCT school_sector) AS sectors,
 count(DISTINCT school_type) AS types, count(icsea) AS has_icsea, count(total_enrolments) AS has_enrolments,
 count(latitude) AS has_coords FROM school_profile GROUP BY state""", "school_profile"))
def ag25_profile_completeness(spark, d):
    return D.school_profile(Tables(spark, d)).groupBy("state").agg(
        F.count(F.lit(1)).alias("schools"), F.count_distinct("school_sector").alias("sectors"),
        F.count_distinct("school_type").alias("types"), F.count("icsea").alias("has_icsea"),
        F.count("total_enrolments").alias("has_enrolments"), F.count("latitude").alias("has_coords"))


_CATCH_NAMED = """SELECT c.school_id, n.school_name, c.school_type FROM catchment c JOIN school_catchment_name n ON c.school_id = n.school_id"""


def _catch_named(t: Tables):
    return D.catchment(t).select("school_id", "school_type").join(D.school_catchment_name(t), "school_id")


@register("t1_three_tier_match", sql(f"""SELECT school_id, school_name, school_type, rank_order FROM cand
WHERE rank_order = (SELECT min(rank_order) FROM cand) ORDER BY school_name, school_id
LIMIT CASE WHEN (SELECT min(rank_order) FROM cand) = 0 THEN 1000000000 ELSE 20 END""", "catchment", "school_catchment_name",
                                     extra={"cn": _CATCH_NAMED, "cand": f"""SELECT school_id, school_name, school_type,
 CASE WHEN upper(school_name) = '{T1_QUERY.upper()}' THEN 0 WHEN upper(school_name) LIKE '{T1_QUERY.upper()}%' THEN 1 ELSE 2 END AS rank_order
 FROM cn WHERE upper(school_name) LIKE '%{T1_QUERY.upper()}%'"""}))
def t1_three_tier_match(spark, d):
    """T1 from the index of catchment names: only names with the query in them are read."""
    t = Tables(spark, d)
    found = catchment_names(t).containing(T1_QUERY).select(F.col("id").alias("school_id"))
    return SC.three_tier_match(_catch_named(t).join(found, "school_id", "left_semi"), T1_QUERY)


@register("t2_ranked_search", sql(f"""SELECT acara_sml_id, school_name, state, school_sector,
 CASE WHEN upper(school_name) LIKE '{T2_QUERY.upper()}%' THEN 1 WHEN list_contains(string_split_regex(lower(school_name), '[^a-z0-9]+'), '{T2_QUERY}') THEN 2 ELSE 3 END AS rank
FROM school_profile WHERE (upper(school_name) LIKE '%{T2_QUERY.upper()}%' OR list_contains(string_split_regex(lower(school_name), '[^a-z0-9]+'), '{T2_QUERY}'))
 AND state = '{T2_STATE}' ORDER BY rank, school_name, acara_sml_id LIMIT 20""", "school_profile"))
def t2_ranked_search(spark, d):
    t = Tables(spark, d)
    return SC.ranked_search(D.school_profile(t), T2_QUERY, T2_STATE, index=profile_names(t))


@register("t4_name_search", _lsql(f"""SELECT acara_sml_id, school_id, coalesce(nullif(profile_school_name, ''), catchment_school_name) AS display_name, state
FROM lookup WHERE (upper(profile_school_name) LIKE '%{T4_QUERY.upper()}%' OR upper(catchment_school_name) LIKE '%{T4_QUERY.upper()}%'
 OR upper(school_first) LIKE '%{T4_QUERY.upper()}%') AND state = '{T4_STATE}' ORDER BY display_name, acara_sml_id LIMIT 50"""))
def t4_name_search(spark, d):
    return SC.name_search(lookup(Tables(spark, d)), T4_QUERY, T4_STATE)


#: Stems of the words of the fixture's names and the queries, as the stemmer's published vocabulary gives them; words without a row are stems.
_PUBLISHED = {"schools": "school", "girls": "girl", "technology": "technolog", "technologies": "technolog", "technological": "technolog", "publicly": "public"}


def _all_words_sql(query_words: str) -> str:
    """Schools with all the words by stem; ``query_words`` are those that are no stop words."""
    stems = "SELECT * FROM (VALUES " + ", ".join(f"('{w}', '{s}')" for w, s in _PUBLISHED.items()) + ") AS v(word, stem)"
    words = "SELECT acara_sml_id, school_name, unnest(string_split_regex(lower(school_name), '[^a-z0-9]+')) AS word FROM school_profile"
    return sql("""SELECT n.acara_sml_id, n.school_name FROM nw n LEFT JOIN stems s ON s.word = n.word JOIN wanted w ON w.stem = coalesce(s.stem, n.word)
GROUP BY n.acara_sml_id, n.school_name HAVING count(DISTINCT w.stem) = (SELECT count(*) FROM wanted)""", "school_profile", extra={
        "stems": stems, "nw": words,
        "wanted": f"SELECT DISTINCT coalesce(s.stem, q.word) AS stem FROM (SELECT unnest(string_split('{query_words}', ' ')) AS word) q LEFT JOIN stems s ON s.word = q.word"})


@register("t3_token_search", _all_words_sql("high schools"))
def t3_token_search(spark, d):
    """Schools whose name holds every word of the query by stem, from the postings."""
    return _by_words(Tables(spark, d), T3_QUERY)


@register("t3_technology_schools", _all_words_sql("technologies schools"))
def t3_technology_schools(spark, d):
    return _by_words(Tables(spark, d), "all the Technologies, and their schools")


@register("t3_girls_schools", _all_words_sql("girls school"))
def t3_girls_schools(spark, d):
    return _by_words(Tables(spark, d), "a school for the GIRLS")


def _by_words(t: Tables, query: str):
    ids = profile_names(t).matching(query).select(F.col("id").alias("acara_sml_id"))
    return D.school_profile(t).select("acara_sml_id", "school_name").join(ids, "acara_sml_id", "left_semi")


#: Index folders by session, data folder and kind.
_INDEXES: dict[tuple[str, str, str], str] = {}


def name_index(t: Tables, kind: str, names, id_col: str, text_col: str) -> NameIndex:
    """An index built by the session's first query that reads it."""
    key = (t.spark.sparkContext.applicationId, t.sf_dir, kind)
    if key not in _INDEXES:
        folder = scratch_path(t.spark, f"index-{kind}-{uuid.uuid4().hex}")
        build_index(names(t), id_col, text_col, folder)
        _INDEXES[key] = folder
    return NameIndex(t.spark, _INDEXES[key])


def profile_names(t: Tables) -> NameIndex:
    return name_index(t, "profiles", D.school_profile, "acara_sml_id", "school_name")


def catchment_names(t: Tables) -> NameIndex:
    return name_index(t, "catchments", D.school_catchment_name, "school_id", "school_name")


PART, PREFIX = "ace12", "place9"


@register("f3_names_containing", sql(f"""SELECT acara_sml_id, school_name FROM school_profile WHERE upper(school_name) LIKE '%{PART.upper()}%'""", "school_profile"))
def f3_names_containing(spark, d):
    """a substring by the rarest of its three-letter pieces."""
    return profile_names(Tables(spark, d)).containing(PART).select(F.col("id").alias("acara_sml_id"), F.col("name").alias("school_name"))


@register("f3_names_starting", sql(f"""SELECT acara_sml_id, school_name FROM school_profile WHERE upper(school_name) LIKE '{PREFIX.upper()}%'""", "school_profile"))
def f3_names_starting(spark, d):
    """a prefix, as a range of the sorted names."""
    return profile_names(Tables(spark, d)).starting(PREFIX).select(F.col("id").alias("acara_sml_id"), F.col("name").alias("school_name"))


@register("a23_school_cbd_distance", sql("""SELECT p.acara_sml_id, p.state, round(h / 1000, 3) AS cbd_km,
 CASE WHEN h / 1000 < 1 THEN printf('%d m', cast(round(h / 1000 * 1000) AS bigint)) ELSE printf('%.2f km', h / 1000) END AS cbd_label
FROM (SELECT p.*, """ + "2 * 6371000e0 * atan2(sqrt(pow(sin((radians(c.lat) - radians(p.latitude)) / 2), 2) + cos(radians(p.latitude)) * cos(radians(c.lat)) * pow(sin((radians(c.lon) - radians(p.longitude)) / 2), 2)), sqrt(1 - (pow(sin((radians(c.lat) - radians(p.latitude)) / 2), 2) + cos(radians(p.latitude)) * cos(radians(c.lat)) * pow(sin((radians(c.lon) - radians(p.longitude)) / 2), 2))))" + """ AS h
 FROM school_profile p JOIN cbd c ON c.state = p.state WHERE p.latitude IS NOT NULL) p""", "school_profile",
                                         extra={"cbd": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {la}, {lo})" for s, la, lo, _ in SC.STATE_CBDS)
                                                + ") AS t(state, lat, lon)"}))
def a23_school_cbd_distance(spark, d):
    p = D.school_profile(Tables(spark, d)).filter(F.col("latitude").isNotNull())
    return SC.with_cbd_distance(p).select("acara_sml_id", "state", "cbd_km", "cbd_label")


@register("m1_fill_profile_coordinates", sql("""SELECT p.acara_sml_id,
 CASE WHEN (p.latitude IS NULL OR p.longitude IS NULL) AND l.latitude IS NOT NULL THEN l.latitude ELSE p.latitude END AS latitude,
 CASE WHEN (p.latitude IS NULL OR p.longitude IS NULL) AND l.latitude IS NOT NULL THEN l.longitude ELSE p.longitude END AS longitude
FROM school_profile p LEFT JOIN school_location l ON p.acara_sml_id = l.acara_sml_id""", "school_location"))
def m1_fill_profile_coordinates(spark, d):
    t = Tables(spark, d)
    return SC.fill_coordinates(D.school_profile(t), D.school_location(t)).select("acara_sml_id", "latitude", "longitude")


@register("m4_coordinate_summary", sql("""SELECT state, count(*) AS total, count(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1 END) AS with_coords,
 count(CASE WHEN NOT (latitude IS NOT NULL AND longitude IS NOT NULL) THEN 1 END) AS without_coords,
 round(count(CASE WHEN latitude IS NOT NULL AND longitude IS NOT NULL THEN 1 END) * 100e0 / count(*), 2) AS pct_with
FROM school_profile GROUP BY state""", "school_profile"))
def m4_coordinate_summary(spark, d):
    return SC.coordinate_summary(D.school_profile(Tables(spark, d)), "state")


@register("sp12_school_geometry", _lsql("""SELECT p.acara_sml_id, k.school_id, CASE WHEN k.school_id IS NOT NULL THEN 'Y' ELSE 'N' END AS has_catchment,
 CASE WHEN p.latitude IS NOT NULL AND p.longitude IS NOT NULL THEN 'Y' ELSE 'N' END AS has_geom_buffer,
 CASE WHEN p.latitude IS NOT NULL AND p.longitude IS NOT NULL THEN 33 END AS buffer_vertices
FROM school_profile p LEFT JOIN lookup k ON k.acara_sml_id = p.acara_sml_id LEFT JOIN catchment c ON c.school_id = k.school_id""", "catchment"))
def sp12_school_geometry(spark, d):
    t = Tables(spark, d)
    g = SC.school_geometry(D.school_profile(t), lookup(t), D.catchment_polygons(t))
    return g.select("acara_sml_id", "school_id", "has_catchment", "has_geom_buffer",
                    F.size(F.col("geom_buffer_5km")[0]).alias("buffer_vertices"))


@register("d6_first_lookup_per_school", _lsql("""SELECT school_id, arg_min(acara_sml_id, acara_sml_id) AS acara_sml_id,
 arg_min(profile_school_name, acara_sml_id) AS profile_school_name, arg_min(icsea, acara_sml_id) AS icsea
FROM lookup WHERE school_id IS NOT NULL GROUP BY school_id"""))
def d6_first_lookup_per_school(spark, d):
    return SC.first_lookup_per_school(lookup(Tables(spark, d)))


@register("f11_schools_by_sector", sql("""SELECT acara_sml_id, school_name, state FROM school_profile WHERE school_sector = 'Independent'
ORDER BY school_name""", "school_profile"))
def f11_schools_by_sector(spark, d):
    """all schools of one sector (the documented browse-by-sector function)."""
    p = D.school_profile(Tables(spark, d))
    return p.filter(F.col("school_sector") == "Independent").select("acara_sml_id", "school_name", "state").orderBy("school_name")


@register("m2_rebuild_geometry", _lsql("""SELECT p.acara_sml_id, k.school_id, coalesce(l.latitude, p.latitude) AS latitude, coalesce(l.longitude, p.longitude) AS longitude,
 CASE WHEN c.school_id IS NOT NULL THEN 'Y' ELSE 'N' END AS has_catchment,
 CASE WHEN coalesce(l.latitude, p.latitude) IS NOT NULL AND coalesce(l.longitude, p.longitude) IS NOT NULL THEN 'Y' ELSE 'N' END AS has_geom_buffer
FROM school_profile p LEFT JOIN school_location l ON l.acara_sml_id = p.acara_sml_id
LEFT JOIN lookup k ON k.acara_sml_id = p.acara_sml_id LEFT JOIN catchment c ON c.school_id = k.school_id""", "school_location", "catchment"))
def m2_rebuild_geometry(spark, d):
    t = Tables(spark, d)
    g = SC.rebuild_geometry(D.school_profile(t), D.school_location(t), lookup(t), D.catchment_polygons(t))
    return g.select("acara_sml_id", "school_id", "latitude", "longitude", "has_catchment", "has_geom_buffer")


def _school_point_sql() -> str:
    return """SELECT c.school_id, coalesce(lk.latitude, c.cy) AS slat, coalesce(lk.longitude, c.cx) AS slon FROM
 (SELECT e.school_id, sum((e.ax + e.bx) * (e.ax * e.by - e.bx * e.ay)) / (3 * sum(e.ax * e.by - e.bx * e.ay)) AS cx,
  sum((e.ay + e.by) * (e.ax * e.by - e.bx * e.ay)) / (3 * sum(e.ax * e.by - e.bx * e.ay)) AS cy FROM catchment_edge e GROUP BY e.school_id) c
 LEFT JOIN (SELECT school_id, arg_min(latitude, acara_sml_id) AS latitude, arg_min(longitude, acara_sml_id) AS longitude
            FROM lookup WHERE school_id IS NOT NULL GROUP BY school_id) lk ON lk.school_id = c.school_id"""


_SP17_CTES, _SP17_LAST = vincenty_sql("pairs", "slat", "slon", "alat", "alon")


@register("sp17_catchment_address_distance", _lsql(
    f"SELECT address_detail_pid, school_id, round(vd / 1000e0, 2) AS distance_km FROM {_SP17_LAST}", "address", "catchment_edge",
    extra={"mapping": _PIP_SQL, "spoint": _school_point_sql(), "pairs": """SELECT m.address_detail_pid, m.school_id, p.slat, p.slon, a.lat AS alat, a.lon AS alon
 FROM mapping m JOIN address a ON a.address_detail_pid = m.address_detail_pid JOIN spoint p ON p.school_id = m.school_id""", **_SP17_CTES}))
def sp17_catchment_address_distance(spark, d):
    """SP17 + J29: geodesic distance (WGS84, km, 2 dp) from every mapped address to its school's point,
    the point being the lookup's coordinates, else the catchment centroid."""
    from wattle.plans.q_spatial import mapping
    t = Tables(spark, d)
    cent = D.catchment_polygons(t).select("school_id", G.polygon_centroid("rings").alias("c"))
    lk = SC.first_lookup_per_school(lookup(t)).join(D.school_profile(t).select("acara_sml_id", "latitude", "longitude"),
                                                    "acara_sml_id")
    pt = cent.join(lk.select("school_id", "latitude", "longitude"), "school_id", "left").select(
        "school_id", F.coalesce("latitude", "c.y").alias("slat"), F.coalesce("longitude", "c.x").alias("slon"))
    m = mapping(t).select("address_detail_pid", "school_id").join(D.address(t).select("address_detail_pid", "lon", "lat"), "address_detail_pid").join(pt, "school_id")
    return G.with_vincenty(m, "slat", "slon", "lat", "lon", "_m").select(
        "address_detail_pid", "school_id", F.round(F.col("_m") / 1000.0, 2).alias("distance_km"))


@register("f9_schools_by_remoteness", sql("""SELECT p.acara_sml_id, p.school_name, l.abs_remoteness_area_name FROM school_profile p JOIN school_location l ON l.acara_sml_id = p.acara_sml_id
WHERE l.abs_remoteness_area_name = 'Inner Regional Australia' ORDER BY p.school_name""", "school_profile", "school_location"))
def f9_schools_by_remoteness(spark, d):
    """the schools of one remoteness area."""
    t = Tables(spark, d)
    area = D.school_location(t).filter(F.col("abs_remoteness_area_name") == "Inner Regional Australia").select("acara_sml_id", "abs_remoteness_area_name")
    return D.school_profile(t).select("acara_sml_id", "school_name").join(area, "acara_sml_id").orderBy("school_name")


# ----------------------------------------------------------------------------- J12, J13: names that need repair or a patch
_MORE_NAMES = """SELECT * FROM school_catchment_name UNION ALL SELECT s_suppkey + 1000000, 'Ridge' || cast(s_suppkey AS varchar) || ' Hts PS' FROM supplier WHERE s_suppkey % 7 = 5
UNION ALL SELECT s_suppkey + 2000000, 'Ridge' || cast(s_suppkey AS varchar) || ' Hts PS North' FROM supplier WHERE s_suppkey % 14 = 5
UNION ALL SELECT s_suppkey + 3000000, 'Ridge' || cast(s_suppkey AS varchar) || ' Hts HS' FROM supplier WHERE s_suppkey % 7 = 5"""
_MORE_PROFILES = """SELECT acara_sml_id, school_name, state, school_sector, school_type FROM school_profile
UNION ALL SELECT 80000 + s_suppkey, 'Ridge' || cast(s_suppkey AS varchar) || ' Heights Public School', 'NSW', 'Government', CASE WHEN s_suppkey % 3 = 0 THEN 'Secondary' ELSE 'Primary' END FROM supplier WHERE s_suppkey % 7 = 5
UNION ALL SELECT 41350, 'Cherrybrook High School', 'NSW', 'Government', 'Secondary'"""


def _more_names(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("k")).filter(F.col("k") % 7 == 5)
    ridge = lambda df, add, tail: df.select((F.col("k") + add).alias("school_id"), F.concat(F.lit("Ridge"), F.col("k").cast("string"), F.lit(tail)).alias("school_name"))
    return (D.school_catchment_name(t).unionByName(ridge(s, 1_000_000, " Hts PS")).unionByName(ridge(s.filter(F.col("k") % 14 == 5), 2_000_000, " Hts PS North"))
            .unionByName(ridge(s, 3_000_000, " Hts HS")))


def _more_profiles(t: Tables):
    s = t.supplier.select(F.col("s_suppkey").alias("k")).filter(F.col("k") % 7 == 5)
    ridge = s.select((F.lit(80000) + F.col("k")).alias("acara_sml_id"), F.concat(F.lit("Ridge"), F.col("k").cast("string"), F.lit(" Heights Public School")).alias("school_name"),
                     F.lit("NSW").alias("state"), F.lit("Government").alias("school_sector"), F.when(F.col("k") % 3 == 0, "Secondary").otherwise("Primary").alias("school_type"))
    patched = t.spark.createDataFrame([(41350, "Cherrybrook High School", "NSW", "Government", "Secondary")], "acara_sml_id long, school_name string, state string, school_sector string, school_type string")
    return D.school_profile(t).select("acara_sml_id", "school_name", "state", "school_sector", "school_type").unionByName(ridge).unionByName(patched)


@register("j12_repaired_lookup", sql("""SELECT p.acara_sml_id, CASE WHEN p.acara_sml_id = 41350 THEN 'Cherrybrook Technology High School' ELSE p.school_name END AS school_name,
 CASE WHEN p.acara_sml_id = 41350 THEN 8592 ELSE coalesce(h.school_id, k.school_id) END AS school_id,
 CASE WHEN p.acara_sml_id = 41350 THEN 'Cherrybrook THS' ELSE coalesce(h.school_name, k.school_name) END AS catchment_school_name
FROM profiles p LEFT JOIN (SELECT school_id, school_name, replace(replace(school_name, ' PS', ' Public School'), ' GHS', ' Girls High School') AS long_name FROM names WHERE school_name LIKE '% PS' OR school_name LIKE '% GHS'
  UNION ALL SELECT school_id, school_name, replace(school_name, ' HS', ' High School') FROM names WHERE school_name LIKE '% HS') k ON k.long_name = p.school_name
LEFT JOIN (SELECT split_part(school_name, ' ', 1) AS word, min(school_id) AS school_id, arg_min(school_name, school_id) AS school_name FROM names
  WHERE split_part(school_name, ' ', 2) = 'Hts' AND split_part(school_name, ' ', 3) = 'PS' GROUP BY 1) h
 ON h.word = split_part(p.school_name, ' ', 1) AND split_part(p.school_name, ' ', 2) = 'Heights' AND p.school_type = 'Primary'
WHERE p.state = 'NSW' AND p.school_sector = 'Government'""", "school_catchment_name", "school_profile", extra={"names": _MORE_NAMES, "profiles": _MORE_PROFILES}))
def j12_repaired_lookup(spark, d):
    """J12 + J13: the lookup with '<X> Heights' primaries matched to '<X> Hts PS' (the smallest id of several) and the one patched school."""
    t = Tables(spark, d)
    out = SC.build_lookup(_more_names(t), _more_profiles(t), patches=SC.lookup_patches(spark))
    return out.select("acara_sml_id", "school_name", "school_id", "catchment_school_name")


@register("m3_merged_profiles", sql("""SELECT acara_sml_id, school_name, CASE WHEN acara_sml_id % 5 = 0 THEN total_enrolments + 2 ELSE total_enrolments END AS total_enrolments
FROM school_profile WHERE acara_sml_id % 9 <> 0 OR acara_sml_id % 5 = 0""", "school_profile"))
def m3_merged_profiles(spark, d):
    """A stored table with an upsert merged into it bucket by bucket; of a key's rows in the load the last line wins."""
    from wattle.operators import quality as Q
    p = D.school_profile(Tables(spark, d)).select("acara_sml_id", "school_name", "total_enrolments")
    key, folder = F.col("acara_sml_id"), scratch_path(spark, f"merged-{uuid.uuid4().hex}")
    Q.store(p.filter(key % 9 != 0), folder, "profiles", "acara_sml_id")
    line = lambda k: p.filter(key % 5 == 0).withColumn("total_enrolments", F.col("total_enrolments") + k).withColumn("line", F.lit(k))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema)
    Q.merge(line(1).unionByName(line(2)), folder, "profiles", schema, "acara_sml_id", ["line"])
    return Q.stored(spark, folder, "profiles", schema)
