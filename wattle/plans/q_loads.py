"""Registered queries of loads and merges (S8, S9, S11, M3, D3) and of the school page's records (A17, A18, A22, AG19)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattle.operators import addresses as A
from wattle.operators import quality as Q
from wattle.operators import schools as S
from wattle.plans import domain as D
from wattle.plans.oracle import sql
from wattle.plans.registry import register
from wattle.sources import files as SF
from wattle.sources.tables import Tables


# ----------------------------------------------------------------------------- S8 / S9
def _suburb_file(t: Tables):
    """One line per customer as a state's suburb file has it: other cases, blanks, broken postcodes, lines that are no suburb."""
    k = F.col("c_custkey")
    name = F.when(k % 31 == 0, " ").when(k % 37 == 0, F.concat("n_name", F.lit(f" {SF.SUBURB_JUNK_KEYWORDS[0]}"))).when(k % 2 == 0, F.lower("n_name")).otherwise(F.col("n_name"))
    return (t.customer.select("c_custkey", "c_nationkey").join(t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
             .select(name.alias("SUBURB "), F.when(k % 41 == 0, "20x").otherwise((2000 + k % 60).cast("string")).alias("Postcode")))


_SUBURBS = {
    "suburb_file": f"""SELECT CASE WHEN c_custkey % 31 = 0 THEN ' ' WHEN c_custkey % 37 = 0 THEN n_name || ' {SF.SUBURB_JUNK_KEYWORDS[0]}' WHEN c_custkey % 2 = 0 THEN lower(n_name) ELSE n_name END AS suburb,
 CASE WHEN c_custkey % 41 = 0 THEN '20x' ELSE cast(2000 + c_custkey % 60 AS varchar) END AS postcode FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "cleaned": """SELECT DISTINCT upper(trim(suburb)) AS suburb, postcode, 'NSW' AS state FROM suburb_file WHERE trim(suburb) <> '' AND regexp_full_match(postcode, '[0-9]{4}')"""
               + "".join(f" AND NOT contains(lower(suburb), '{w}')" for w in SF.SUBURB_JUNK_KEYWORDS),
}


@register("s8_new_suburbs", sql("""SELECT suburb, postcode, state FROM cleaned c
 WHERE NOT EXISTS (SELECT 1 FROM suburb_postcode e WHERE e.locality_name = c.suburb AND e.postcode = c.postcode)""", "suburb_postcode", extra=_SUBURBS))
def s8_new_suburbs(spark, d):
    t = Tables(spark, d)
    have = D.suburb_postcode(t).withColumnRenamed("locality_name", "suburb")
    return SF.new_suburb_rows(have, SF.clean_suburb_postcodes(_suburb_file(t), "NSW"))


@register("s9_new_localities", sql("""SELECT c.suburb AS locality_name, c.postcode, c.state FROM cleaned c
 WHERE NOT EXISTS (SELECT 1 FROM suburb_postcode e WHERE e.postcode < '2020' AND upper(e.locality_name) = c.suburb AND e.postcode = c.postcode)""", "suburb_postcode", extra=_SUBURBS))
def s9_new_localities(spark, d):
    t = Tables(spark, d)
    return SF.new_localities(SF.clean_suburb_postcodes(_suburb_file(t), "NSW"), D.suburb_postcode(t).filter("postcode < '2020'"))


# ----------------------------------------------------------------------------- S11 / M3
def _location_load(t: Tables):
    """A load of locations: every third known school, every second of these on two lines, and as many schools not known yet."""
    k = F.col("acara_sml_id")
    p = D.school_profile(t).filter(k % 3 == 0).withColumn("line", F.explode(F.when(k % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return p.withColumn("id", F.explode(F.array(k, k + 40000))).select(
        F.col("id").alias("acara_sml_id"), F.concat("school_name", F.lit(" v"), F.col("line").cast("string")).alias("school_name"), "state",
        F.lit(None).cast("string").alias("abs_remoteness_area_name"), "latitude", "longitude", F.lit(0).alias("special_school"), "line")


_LOAD = {"location_load": """SELECT p.acara_sml_id + x.more AS acara_sml_id, p.school_name || ' v' || cast(l.line AS varchar) AS school_name, p.state,
 cast(NULL AS varchar) AS abs_remoteness_area_name, p.latitude, p.longitude, 0 AS special_school, l.line
 FROM school_profile p, (VALUES (1), (2)) l(line), (VALUES (0), (40000)) x(more) WHERE p.acara_sml_id % 3 = 0 AND (l.line = 1 OR p.acara_sml_id % 2 = 0)"""}
_COLS = "acara_sml_id, school_name, state, abs_remoteness_area_name, latitude, longitude, special_school"


@register("s11_location_upsert", sql(f"""SELECT {_COLS} FROM school_location s WHERE NOT EXISTS (SELECT 1 FROM location_load n WHERE n.acara_sml_id = s.acara_sml_id)
UNION ALL SELECT {_COLS} FROM (SELECT *, row_number() OVER (PARTITION BY acara_sml_id ORDER BY line DESC) AS rn FROM location_load) x WHERE rn = 1""",
                                     "school_profile", "school_location", extra=_LOAD))
def s11_location_upsert(spark, d):
    t = Tables(spark, d)
    return Q.upsert_keep_last(D.school_location(t), _location_load(t), "acara_sml_id", ["line"])


@register("m3_insert_if_absent", sql(f"""SELECT {_COLS}, line FROM (SELECT *, row_number() OVER (PARTITION BY acara_sml_id ORDER BY line) AS rn FROM location_load) x
 WHERE rn = 1 AND acara_sml_id NOT IN (SELECT acara_sml_id FROM school_location)""", "school_profile", "school_location", extra=_LOAD))
def m3_insert_if_absent(spark, d):
    t = Tables(spark, d)
    return Q.insert_if_absent(D.school_location(t), _location_load(t), ["acara_sml_id"], ["line"])


# ----------------------------------------------------------------------------- D3
@register("d3_first_address_per_street_postcode", sql("""SELECT street_locality_pid, postcode, address_detail_pid, number_first, date_retired FROM (
 SELECT *, row_number() OVER (PARTITION BY street_locality_pid, postcode ORDER BY date_retired NULLS LAST, number_first, address_detail_pid) AS rn FROM address) x WHERE rn = 1""", "address"))
def d3_first_address_per_street_postcode(spark, d):
    a = D.address(Tables(spark, d)).select("street_locality_pid", "postcode", "address_detail_pid", "number_first", "date_retired")
    return A.distinct_on(a, ["street_locality_pid", "postcode"], ["date_retired", "number_first", "address_detail_pid"])


# ----------------------------------------------------------------------------- A17 / A18 / AG19 / A22
def _flags(t: Tables):
    """Year flags of each school: none for every eleventh."""
    k = F.col("s_suppkey")
    return t.supplier.select(k.alias("school_id"), *[F.when((k % 11 != 4) & ((k * (i + 2)) % 5 < 2), "Y").when(k % 2 == 0, "N").alias(c)
                                                     for i, (c, _) in enumerate(S.YEAR_LEVEL_FLAGS)])


_FLAGS = {"flags": "SELECT s_suppkey AS school_id, " + ", ".join(
    f"CASE WHEN s_suppkey % 11 <> 4 AND (s_suppkey * {i + 2}) % 5 < 2 THEN 'Y' WHEN s_suppkey % 2 = 0 THEN 'N' END AS {c}" for i, (c, _) in enumerate(S.YEAR_LEVEL_FLAGS)) + " FROM supplier"}
_FIRST, _LAST = S.YEAR_LEVEL_FLAGS[0][0], S.YEAR_LEVEL_FLAGS[-1][0]


@register("a17_year_levels", sql("SELECT school_id, coalesce(nullif(concat_ws(', ', " + ", ".join(f"CASE WHEN {c} = 'Y' THEN '{lbl}' END" for c, lbl in S.YEAR_LEVEL_FLAGS)
                                 + "), ''), 'N/A') AS year_levels, CASE " + " ".join(f"WHEN {c} = 'Y' THEN '{lbl}'" for c, lbl in S.YEAR_LEVEL_FLAGS)
                                 + " END AS first_level FROM flags", extra=_FLAGS))
def a17_year_levels(spark, d):
    f = _flags(Tables(spark, d))
    return f.select("school_id", S.year_levels(f).alias("year_levels"), S.first_year_level(f).alias("first_level"))


@register("ag19_year_flag_sums", sql("\nUNION ALL ".join(
    f"SELECT '{cat}' AS category, count(*) AS total_schools, {a} AS stat1, {b} AS stat2 FROM flags WHERE school_id % 3 = {m}" for m, cat, a, b in (
        (0, "SECONDARY", "0::bigint", f"(count(*) FILTER (WHERE {_LAST} = 'Y'))::bigint"),
        (1, "PRIMARY", f"(count(*) FILTER (WHERE {_FIRST} = 'Y'))::bigint", f"(count(*) FILTER (WHERE {_LAST} = 'Y'))::bigint"),
        (2, "FUTURE", "0::bigint", "0::bigint"))), extra=_FLAGS))
def ag19_year_flag_sums(spark, d):
    f = _flags(Tables(spark, d))
    part = lambda m: f.filter(F.col("school_id") % 3 == m)
    return S.year_flag_summary({"SECONDARY": (part(0), None, _LAST), "PRIMARY": (part(1), _FIRST, _LAST), "FUTURE": (part(2), None, None)})


@register("a22_nested_profile", sql("""SELECT acara_sml_id, school_name, state, latitude, longitude, cast(NULL AS varchar) AS website, icsea, total_enrolments FROM school_profile""", "school_profile"))
def a22_nested_profile(spark, d):
    p = D.school_profile(Tables(spark, d))
    return p.select(S.nested_profile(p).alias("p")).select("p.acara_sml_id", "p.school_name", "p.location.state", "p.location.latitude", "p.location.longitude",
                                                           "p.contact.website", "p.icsea", "p.total_enrolments")
