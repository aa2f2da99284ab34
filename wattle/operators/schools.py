"""School name resolution, lookup table, search and school statistics
(A14-A23, J9-J14, J26-J29, T1-T4, M1-M4, AG20-AG25).

All joins are keyed (school id, ACARA id or constructed name); school tables
hold thousands of rows, so AQE normally broadcasts them, but nothing here
forces a broadcast of a table that grows with the data.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from wattle.functions import geo as G
from wattle.functions.stemming import STOP_WORDS, stem
from wattle.operators.text_index import NameIndex, query_stems
from wattle.functions.text import escape_like

# School-name abbreviations and their expansions.
SCHOOL_TYPE_ABBREVIATIONS = {
    "PS": "Public School",
    "HS": "High School",
    "GHS": "Girls High School",
    "BHS": "Boys High School",
    "NPS": "North Public School",
    "SPS": "South Public School",
    "WPS": "West Public School",
    "EPS": "East Public School",
    "CS": "Central School",
    "SC": "Secondary College",
    "WIS": "West Infants School",
    "SIS": "South Infants School",
    "EIS": "East Infants School",
    "NIS": "North Infants School",
    "IS": "Infants School",
}

# State capital CBD points.
STATE_CBDS = [
    ("NSW", -33.8688, 151.2093, "Sydney"),
    ("VIC", -37.8136, 144.9631, "Melbourne"),
    ("QLD", -27.4698, 153.0251, "Brisbane"),
    ("SA", -34.9285, 138.6007, "Adelaide"),
    ("WA", -31.9505, 115.8605, "Perth"),
    ("TAS", -42.8821, 147.3272, "Hobart"),
    ("NT", -12.4634, 130.8456, "Darwin"),
    ("ACT", -35.2809, 149.1300, "Canberra"),
]

# Year-level flag columns and their labels.
YEAR_LEVEL_FLAGS = [("kindergart", "K")] + [(f"year{i}", str(i)) for i in range(1, 13)]

# Profile page templates.
PROFILE_URL = "https://myschool.edu.au/school/{id}"
NAPLAN_URL = "https://myschool.edu.au/school/{id}/naplan/results"


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


# ----------------------------------------------------------------------------- A14 / A15
def name_parts(name) -> tuple[Column, Column, Column]:
    """(all words but the last, last word, word count) of a space-separated name."""
    words = F.split(_c(name), " ")
    n = F.size(words)
    first = F.array_join(F.slice(words, 1, n - 1), " ")
    return first, F.element_at(words, -1), n


def expand_school_type(abbrev) -> Column:
    """Abbreviation -> type name, null when unknown."""
    m = F.create_map(*[F.lit(x) for kv in SCHOOL_TYPE_ABBREVIATIONS.items() for x in kv])
    return F.element_at(m, _c(abbrev))


def with_name_parts(catchment_names: DataFrame, name: str = "school_name") -> DataFrame:
    first, abbrev, n = name_parts(name)
    return catchment_names.select("*", n.cast("long").alias("word_count"), first.alias("school_first"), abbrev.alias("school_abbrev"),
                                  expand_school_type(abbrev).alias("school_type_name"))


# ----------------------------------------------------------------------------- J11-J13, A16
def build_lookup(catchment_names: DataFrame, profile: DataFrame, state: str = "NSW",
                 sector: str = "Government", patches: DataFrame | None = None) -> DataFrame:
    """Profile (of one state and sector) LEFT JOIN catchment names on
    ``school_first || ' ' || type name = profile name``; then the Heights repair
    (J12), literal patches (J13) and the profile / NAPLAN links (A16).

    Output carries both column lists the reference reads (see SURVEY section 1):
    school_id, catchment_school_name, school_first, school_abbrev,
    school_type_name, profile_school_name, plus the profile columns.
    """
    parts = with_name_parts(catchment_names).filter(F.col("school_type_name").isNotNull())
    keyed = parts.select("school_id", F.col("school_name").alias("catchment_school_name"), "school_first",
                         "school_abbrev", "school_type_name",
                         F.concat_ws(" ", "school_first", "school_type_name").alias("_constructed"))
    p = profile.filter((F.col("state") == state) & (F.col("school_sector") == sector))
    j = p.join(keyed, p.school_name == keyed._constructed, "left").drop("_constructed")
    j = heights_repair(j, catchment_names)
    if patches is not None:
        j = apply_patches(j, patches)
    aid = F.col("acara_sml_id").cast("string")
    return j.select("*", F.col("school_name").alias("profile_school_name"),
                    F.when(aid.isNotNull(), F.concat(F.lit("https://myschool.edu.au/school/"), aid)).alias("acara_url"),
                    F.when(aid.isNotNull(), F.concat(F.lit("https://myschool.edu.au/school/"), aid,
                                                     F.lit("/naplan/results"))).alias("naplan_url"))


def heights_repair(lookup: DataFrame, catchment_names: DataFrame) -> DataFrame:
    """Primary profiles named '<X> Heights ...' take the catchment '<X> Hts PS'.
    An ambiguous match keeps the smallest school id (the reference's UPDATE..FROM
    picks an arbitrary one)."""
    w = F.split(F.col("school_name"), " ")
    c = (catchment_names
         .filter((F.split("school_name", " ").getItem(1) == "Hts") & (F.split("school_name", " ").getItem(2) == "PS"))
         .select(F.split("school_name", " ").getItem(0).alias("_w1"),
                 F.struct("school_id", F.col("school_name").alias("name")).alias("_c"))
         .groupBy("_w1").agg(F.min("_c").alias("_fix")))
    cand = lookup.withColumn("_w1", F.when((F.element_at(w, 2) == "Heights") & (F.col("school_type") == "Primary"),
                                           F.element_at(w, 1)))
    j = cand.join(c, "_w1", "left")
    return (j.withColumn("school_id", F.coalesce(F.col("_fix.school_id"), F.col("school_id")))
             .withColumn("catchment_school_name", F.coalesce(F.col("_fix.name"), F.col("catchment_school_name")))
             .drop("_w1", "_fix"))


def apply_patches(lookup: DataFrame, patches: DataFrame) -> DataFrame:
    """Per-ACARA-id corrections (school_id, school_name, catchment_school_name)."""
    p = patches.select("acara_sml_id", F.col("school_id").alias("_p_id"), F.col("school_name").alias("_p_name"),
                       F.col("catchment_school_name").alias("_p_cname"))
    j = lookup.join(p, "acara_sml_id", "left")
    return (j.withColumn("school_id", F.coalesce("_p_id", "school_id"))
             .withColumn("school_name", F.coalesce("_p_name", "school_name"))
             .withColumn("catchment_school_name", F.coalesce("_p_cname", "catchment_school_name"))
             .drop("_p_id", "_p_name", "_p_cname"))


def lookup_patches(spark) -> DataFrame:
    # The reference's one literal correction.
    return spark.createDataFrame([(41350, 8592, "Cherrybrook Technology High School", "Cherrybrook THS")],
                                 "acara_sml_id long, school_id long, school_name string, catchment_school_name string")


# ----------------------------------------------------------------------------- A17-A23
def year_levels(df: DataFrame, yes: str = "Y") -> Column:
    """``K, 1, 2, ...`` from the 13 flags (value ``yes``), 'N/A' when none."""
    parts = [F.when(F.col(c) == yes, F.lit(lbl)) for c, lbl in YEAR_LEVEL_FLAGS if c in df.columns]
    if not parts:
        return F.lit("N/A")
    return F.coalesce(F.nullif(F.array_join(F.array_compact(F.array(*parts)), ", "), F.lit("")), F.lit("N/A"))


def first_year_level(df: DataFrame, yes: str = "Y") -> Column:
    """The CASE inside ARRAY_AGG - only the first matching level of a row."""
    expr = None
    for c, lbl in YEAR_LEVEL_FLAGS:
        if c in df.columns:
            expr = F.when(F.col(c) == yes, F.lit(lbl)) if expr is None else expr.when(F.col(c) == yes, F.lit(lbl))
    return expr if expr is not None else F.lit(None).cast("string")


def yn_flag(c) -> Column:
    """A19: 'Y' when present else 'N'."""
    return F.when(_c(c).isNotNull(), F.lit("Y")).otherwise(F.lit("N"))


def display_name(profile_name, catchment_name) -> Column:
    """Profile name, else the catchment name."""
    return F.coalesce(F.nullif(_c(profile_name), F.lit("")), _c(catchment_name))


def nested_profile(df: DataFrame) -> Column:
    """Nested record with location and contact parts."""
    cols = set(df.columns)

    def opt(n):
        return F.col(n) if n in cols else F.lit(None).cast("string")
    return F.struct(opt("acara_sml_id").alias("acara_sml_id"), opt("school_name").alias("school_name"),
                    F.struct(opt("suburb").alias("suburb"), opt("state").alias("state"), opt("postcode").alias("postcode"),
                             opt("latitude").alias("latitude"), opt("longitude").alias("longitude")).alias("location"),
                    F.struct(opt("school_url").alias("website"), opt("phone").alias("phone")).alias("contact"),
                    opt("icsea").alias("icsea"), opt("total_enrolments").alias("total_enrolments"))


def cbd_table(spark) -> DataFrame:
    """The 8 state CBD points (a fixed code list: broadcast is safe)."""
    return spark.createDataFrame(STATE_CBDS, "state string, cbd_lat double, cbd_lon double, city string")


def with_cbd_distance(df: DataFrame, state: str = "state", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Haversine distance to the CBD of the row's state; label in m below 1 km, else km."""
    j = df.join(F.broadcast(cbd_table(df.sparkSession)), state, "left")
    km = G.haversine_m(lat, lon, "cbd_lat", "cbd_lon") / 1000
    label = F.when(km < 1, F.format_string("%d m", F.round(km * 1000).cast("long"))) \
             .otherwise(F.format_string("%.2f km", km))
    return j.withColumn("cbd_km", F.round(km, 3)).withColumn(
        "cbd_label", F.when(F.col("cbd_lat").isNotNull() & F.col(lat).isNotNull(), label)).drop("cbd_lat", "cbd_lon")


# ----------------------------------------------------------------------------- geometry table
def school_geometry(profile: DataFrame, lookup: DataFrame, catchments: DataFrame, buffer_units: float = 5000.0) -> DataFrame:
    """sgeom: profile LEFT lookup LEFT catchments (fans out like the reference),
    5,000-unit Mercator buffer ring (SP12), Y/N flags (A19) and search tokens (T3)."""
    lk = lookup.select("acara_sml_id", "school_id")
    c = catchments.select("school_id", F.col("rings").alias("catchment_zone"))
    j = profile.join(lk, "acara_sml_id", "left").join(c, "school_id", "left")
    ring = G.buffer_ring_3857("longitude", "latitude", buffer_units)
    return j.select("*", F.when(ring.isNotNull(), F.array(ring)).alias("geom_buffer_5km"),
                    yn_flag("catchment_zone").alias("has_catchment"),
                    yn_flag(ring).alias("has_geom_buffer"),
                    search_tokens("school_name").alias("search_vector"))


def search_tokens(c) -> Column:
    """The distinct stems of a text's words, stop words aside (the vector of the 'english' configuration without positions)."""
    words = F.filter(F.split(F.lower(_c(c)), r"[^\p{L}\p{N}]+"), lambda t: (t != "") & ~t.isin(*sorted(STOP_WORDS)))
    return F.array_distinct(_stems(words))


@F.pandas_udf(ArrayType(StringType()))
def _stems(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda ws: None if ws is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in ws])


def tokens_match(doc_tokens: Column, query: str) -> Column:
    """``search_vector @@ plainto_tsquery(query)`` - every query token is present; false if the query has none."""
    wanted = query_stems(query)
    return F.size(F.array_intersect(doc_tokens, F.array(*(F.lit(w) for w in wanted)))) == len(wanted) if wanted else F.lit(False)


# ----------------------------------------------------------------------------- T1 / T2 / T4
def three_tier_match(catchments: DataFrame, query: str, school_type: str | None = None, limit: int = 20) -> DataFrame:
    """Exact (all rows, unordered), else prefix, else substring (ordered by name,
    first ``limit``); the first tier with rows wins.  No action: the winning tier is
    an aggregate of the matches, joined back as one row."""
    up, q = F.upper("school_name"), query.upper()
    esc = escape_like(q)
    cand = catchments.filter(up.like(f"%{esc}%"))
    if school_type and school_type.upper() != "ALL":
        cand = cand.filter(F.col("school_type") == school_type.upper())
    cand = cand.select("school_id", "school_name", "school_type",
                       F.when(up == q, 0).when(up.like(f"{esc}%"), 1).otherwise(2).alias("rank_order"))
    best = cand.agg(F.min("rank_order").alias("rank_order"))  # one row
    tier = cand.join(F.broadcast(best), "rank_order", "left_semi")
    exact = tier.filter(F.col("rank_order") == 0)
    return exact.unionByName(tier.filter(F.col("rank_order") > 0).orderBy("school_name", "school_id").limit(limit))


def ranked_search(schools: DataFrame, query: str, state: str | None = None, limit: int = 20, index: NameIndex | None = None) -> DataFrame:
    """Prefix 1, token match 2, substring 3; ordered by rank then name, first ``limit``.  With an index over the
    names (ids are ``acara_sml_id``), the schools are those of its postings; without one every name is read."""
    up, esc = F.upper("school_name"), escape_like(query.upper())
    if index is not None:
        by_token = index.matching(query).select(F.col("id").alias("acara_sml_id"), F.lit(True).alias("_token"))
        by_part = index.containing(query).select(F.col("id").alias("acara_sml_id"), F.lit(False).alias("_token"))
        found = by_token.unionByName(by_part).groupBy("acara_sml_id").agg(F.max("_token").alias("_token"))
        cand, has_token = schools.join(found, "acara_sml_id"), F.col("_token")
    else:
        cand = schools.withColumn("_token", tokens_match(search_tokens("school_name"), query))
        has_token = F.col("_token")
        cand = cand.filter(up.like(f"%{esc}%") | has_token)
    if state:
        cand = cand.filter(F.col("state") == state)
    rank = F.when(up.like(f"{esc}%"), 1).when(has_token, 2).otherwise(3)
    return (cand.select("acara_sml_id", "school_name", "state", "school_sector", rank.alias("rank"))
                .orderBy("rank", "school_name", "acara_sml_id").limit(limit))


def name_search(lookup: DataFrame, query: str, state: str | None = None, limit: int = 50) -> DataFrame:
    """T4: case-insensitive contains over profile, catchment and first-name columns; cap 50."""
    esc = escape_like(query.upper())
    pred = (F.upper("profile_school_name").like(f"%{esc}%") | F.upper("catchment_school_name").like(f"%{esc}%")
            | F.upper("school_first").like(f"%{esc}%"))
    c = lookup.filter(pred)
    if state:
        c = c.filter(F.col("state") == state)
    return (c.select("acara_sml_id", "school_id", display_name("profile_school_name", "catchment_school_name").alias("display_name"),
                     "state").orderBy("display_name", "acara_sml_id").limit(min(limit, 50)))


# ----------------------------------------------------------------------------- M1 / M4
def fill_coordinates(target: DataFrame, source: DataFrame, key: str = "acara_sml_id", only_missing: bool = True) -> DataFrame:
    """M1: coordinates from ``source`` into ``target`` - only where missing (migration),
    or always (the location importer)."""
    s = source.select(key, F.col("latitude").alias("_slat"), F.col("longitude").alias("_slon"))
    j = target.join(s, key, "left")
    if only_missing:
        miss = F.col("latitude").isNull() | F.col("longitude").isNull()
        lat = F.when(miss & F.col("_slat").isNotNull(), F.col("_slat")).otherwise(F.col("latitude"))
        lon = F.when(miss & F.col("_slat").isNotNull(), F.col("_slon")).otherwise(F.col("longitude"))
    else:
        lat = F.coalesce("_slat", "latitude")
        lon = F.coalesce("_slon", "longitude")
    return j.withColumn("latitude", lat).withColumn("longitude", lon).drop("_slat", "_slon")


def coordinate_summary(df: DataFrame, by: str | None = None) -> DataFrame:
    """M4: total, with and without coordinates, % with (2 dp)."""
    has = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    aggs = [F.count(F.lit(1)).alias("total"), F.count_if(has).alias("with_coords"), F.count_if(~has).alias("without_coords")]
    g = df.groupBy(by).agg(*aggs) if by else df.agg(*aggs)
    return g.withColumn("pct_with", F.round(F.try_divide(F.col("with_coords") * F.lit(100.0), F.col("total")), 2))


# ----------------------------------------------------------------------------- M2 / AG14 / AG19 / AG30 / D6
def rebuild_geometry(profile: DataFrame, location: DataFrame, lookup: DataFrame, catchments: DataFrame) -> DataFrame:
    """M2: coordinates refreshed from the location table (always overwritten, as the
    migration does), then buffers and Y/N flags rebuilt from the new points."""
    return school_geometry(fill_coordinates(profile, location, only_missing=False), lookup, catchments)


def catchment_stats(catchments: DataFrame, names: DataFrame, mapping: DataFrame) -> DataFrame:
    """AG14 (evident intent): per catchment its name, type, area-weighted centroid and the
    number of addresses mapped to it (0 when none).  The mapping is pre-aggregated
    before the join, so only one row per catchment meets the polygon table."""
    counts = mapping.groupBy("school_id").agg(F.count(F.lit(1)).alias("address_count"))
    c = catchments.select("school_id", "school_type", G.polygon_centroid("rings").alias("c"))
    return (c.join(names.select("school_id", "school_name"), "school_id", "left").join(counts, "school_id", "left")
             .select("school_id", "school_name", "school_type", F.col("c.x").alias("centroid_lon"),
                     F.col("c.y").alias("centroid_lat"), F.coalesce("address_count", F.lit(0)).alias("address_count")))


def year_flag_summary(tables: dict[str, tuple[DataFrame, str | None, str | None]], yes: str = "Y") -> DataFrame:
    """AG19: per category (one table each): schools, and the sums of two chosen year
    flags (0 when a category has no such flag)."""
    parts = []
    for cat, (df, f1, f2) in tables.items():
        def s(f):
            return F.sum(F.when(F.col(f) == yes, 1).otherwise(0)) if f else F.lit(0).cast("long")
        parts.append(df.agg(F.lit(cat).alias("category"), F.count(F.lit(1)).alias("total_schools"),
                            s(f1).alias("stat1"), s(f2).alias("stat2")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def catchment_rows(catchments: DataFrame) -> DataFrame:
    """AG30: what the school page calls "address_count" - the number of catchment rows
    carrying the school id."""
    return catchments.groupBy("school_id").agg(F.count(F.lit(1)).alias("catchment_rows"))


def first_lookup_per_school(lookup: DataFrame) -> DataFrame:
    """D6 in batch form: for every school id, the lookup row with the smallest ACARA id
    (the page's ``LIMIT 1``, made deterministic), via ``min(struct)``."""
    best = (lookup.filter(F.col("school_id").isNotNull())
                  .groupBy("school_id")
                  .agg(F.min(F.struct("acara_sml_id", "profile_school_name", "icsea")).alias("b")))
    return best.select("school_id", "b.acara_sml_id", "b.profile_school_name", "b.icsea")
