"""Address star joins, search, autocomplete, paging and statistics
(J6-J8, A1-A8, F3-F9, D2, D5, O1-O7, AG1-AG12, AG26-AG27, T5).

Join strategy: nothing is broadcast by hint.  Code tables (street/flat types, states),
streets and localities all arrive as parameters, so the planner chooses: AQE turns the
sort-merge join into a broadcast hash join only when the measured side is under
``spark.sql.adaptive.autoBroadcastJoinThreshold`` and keeps the shuffle join
beyond it.  The address table is never broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.functions import text as T
from wattle.functions.geo import square_cell


def _opt(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def star(address: DataFrame, streets: DataFrame, street_types: DataFrame, localities: DataFrame,
         states: DataFrame, flat_types: DataFrame | None = None, inner: bool = False,
         locality_via_street: bool = False) -> DataFrame:
    """J6 (left joins) / J7 (``inner=True``: streets, localities, states inner, and the
    locality reached through the street when ``locality_via_street``).

    Output: address columns + street_name, street_type (name), street_date_retired,
    locality_name, locality_date_retired, state_name, state_abbreviation, flat_type.
    """
    how = "inner" if inner else "left"
    a = address
    st = streets.select("street_locality_pid", "street_name", "street_type_code",
                        F.col("locality_pid").alias("_street_locality_pid"),
                        F.col("date_retired").alias("street_date_retired"))
    a = a.join(st, "street_locality_pid", how)
    a = a.join(street_types.select(F.col("code").alias("street_type_code"),
                                   F.col("name").alias("street_type")), "street_type_code", "left")
    if flat_types is not None:
        a = a.join(flat_types.select(F.col("code").alias("flat_type_code"),
                                     F.col("name").alias("flat_type")), "flat_type_code", "left")
    loc_key = "_street_locality_pid" if locality_via_street else "locality_pid"
    loc = localities.select(F.col("locality_pid").alias(loc_key), "locality_name", "state_pid",
                            F.col("date_retired").alias("locality_date_retired"))
    a = a.join(loc, loc_key, how)
    a = a.join(states.select("state_pid", "state_name", "state_abbreviation"), "state_pid", how)
    return a.drop("_street_locality_pid") if not locality_via_street else a


def full_star(address: DataFrame, streets: DataFrame, localities: DataFrame, states: DataFrame, codes: dict[str, DataFrame],
              geocodes: DataFrame | None = None) -> DataFrame:
    """J6 whole: ``star`` with the names of flat type, level type and street suffix, and the default geocode with its type's name.

    ``codes`` holds the code tables ``flat_type``, ``level_type``, ``street_type``, ``street_suffix`` and ``geocode_type``.  All joins are
    left joins: a code that its table lacks leaves the name null.  An address without a geocode stays; one with two comes twice.
    The streets' suffix names are joined to the streets, before these meet the addresses.
    """
    suffixed = streets.select("street_locality_pid", "street_suffix_code").join(_names(codes, "street_suffix"), "street_suffix_code", "left")
    a = star(address, streets, codes["street_type"], localities, states, codes["flat_type"]).join(suffixed, "street_locality_pid", "left")
    a = a.join(_names(codes, "level_type"), "level_type_code", "left")
    if geocodes is not None:
        g = geocodes.join(_names(codes, "geocode_type"), "geocode_type_code", "left")
        a = a.join(g.select("address_detail_pid", "geocode_type_code", "geocode_type", "latitude", "longitude"), "address_detail_pid", "left")
    return a


def _names(codes: dict[str, DataFrame], kind: str) -> DataFrame:
    return codes[kind].select(F.col("code").alias(f"{kind}_code"), F.col("name").alias(kind))


def with_address_text(df: DataFrame) -> DataFrame:
    """Component parts, full address, simple and search forms, street number label."""
    c = lambda n: _opt(df, n)
    return df.select(
        "*",
        T.unit_part(c("flat_type"), c("flat_number")).alias("unit_part"),
        T.street_number_part(c("number_first"), c("number_last")).alias("street_number"),
        T.street_part(c("street_name"), c("street_type"), c("street_suffix")).alias("street"),
        T.full_address(c("flat_type"), c("flat_number"), c("level_type"), c("level_number"), c("number_first"),
                       c("number_last"), c("street_name"), c("street_type"), c("street_suffix"),
                       c("locality_name"), c("state_abbreviation"), c("postcode")).alias("full_address"),
        T.simple_address(c("flat_number"), c("number_first"), c("street_name"), c("locality_name"),
                         c("state_abbreviation"), c("postcode")).alias("simple_address"),
        T.search_address(c("number_first_prefix"), c("number_first"), c("number_first_suffix"), c("street_name"),
                         c("street_type"), c("locality_name"), c("state_abbreviation"),
                         c("postcode")).alias("search_address"),
        T.street_number_label(c("flat_type"), c("flat_number"), c("number_first"), c("number_first_suffix"),
                              c("number_last"), c("number_last_suffix")).alias("street_number_label"),
    )


def with_display(df: DataFrame) -> DataFrame:
    """Display number/unit/coordinates, map link and the two property links."""
    c = lambda n: _opt(df, n)
    re_link, dom_link = T.property_links(c("flat_number"), c("number_first"), c("number_first_suffix"),
                                         c("number_last"), c("number_last_suffix"), c("street_name"),
                                         c("street_type"), c("locality_name"), c("state_abbreviation"), c("postcode"))
    return df.select(
        "*",
        F.trim(F.concat_ws(" ", T.nullif_empty(c("street_name")), T.nullif_empty(c("street_type")))).alias("street_display"),
        T.display_number(c("number_first"), c("number_first_suffix"), c("number_last"),
                         c("number_last_suffix")).alias("number_display"),
        T.display_unit(c("flat_type"), c("flat_number")).alias("unit_display"),
        T.display_coords(c("lat"), c("lon")).alias("coords_display"),
        T.map_link(c("lat"), c("lon")).alias("map_link"),
        re_link.alias("realestate_link"), dom_link.alias("domain_link"),
    )


# ----------------------------------------------------------------------------- filters
def active(df: DataFrame, *cols: str) -> DataFrame:
    """rows whose listed ``date_retired`` columns are all null."""
    return df.filter(reduce(lambda a, b: a & b, [F.col(c).isNull() for c in cols]))


def search_filter(df: DataFrame, number: str | None = None, street: str | None = None,
                  suburb: str | None = None, postcode: str | None = None, state: str | None = None,
                  escape: bool = True) -> DataFrame:
    """optional AND of number-contains, street/suburb contains (case-insensitive),
    exact postcode and state.  Empty parameters add no predicate."""
    preds = []
    if number:
        preds.append(T.number_contains("number_first", str(number)))
    if street:
        preds.append(T.icontains("street_name", street, escape))
    if suburb:
        preds.append(T.icontains("locality_name", suburb, escape))
    if postcode:
        preds.append(F.col("postcode") == postcode)
    if state:
        preds.append(F.col("state_abbreviation") == state)
    return df.filter(reduce(lambda a, b: a & b, preds)) if preds else df


def distinct_on(df: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """``DISTINCT ON (key) ORDER BY key, order...`` as an aggregate.

    ``min(struct(order..., row))`` keeps the first row per key; unlike a
    ``row_number`` window it is combined map-side, so a key with a huge number of
    duplicates never lands whole in one task.  Nulls come last, as in the database;
    ties go by the rest of the row.  ``key`` is one column or several (D3).
    """
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in df.columns if c not in keys]
    ordered = [x.alias(f"_o{i}_{k}") for i, c in enumerate(order) for k, x in enumerate((F.col(c).isNull(), F.col(c)))]
    packed = F.struct(*ordered, F.struct(*rest).alias("_row"))
    return df.groupBy(*keys).agg(F.min(packed).alias("_m")).select(*keys, "_m._row.*")


def page(df: DataFrame, order: list, page_no: int, page_size: int) -> DataFrame:
    """O2: ``ORDER BY .. LIMIT page_size OFFSET (page_no-1)*page_size``."""
    return df.orderBy(*order).offset((page_no - 1) * page_size).limit(page_size)


def page_with_totals(df: DataFrame, order: list, page_no: int, page_size: int) -> DataFrame:
    """O2: a page whose rows carry total_count, total_pages and has_more.

    The count is one aggregate over ``df``; its one row is stacked on the page's rows, and a window over
    these (a page and one row) hands it to each.
    """
    total = df.agg(F.count(F.lit(1)).alias("total_count"))
    stacked = page(df, order, page_no, page_size).withColumn("_row", F.lit(True)).unionByName(total, allowMissingColumns=True)
    rows = stacked.withColumn("total_count", F.max("total_count").over(Window.partitionBy())).filter("_row").drop("_row")
    return rows.select("*", F.ceil(F.col("total_count") / F.lit(page_size)).cast("bigint").alias("total_pages"),
                       (F.lit(page_no * page_size) < F.col("total_count")).alias("has_more"))


# ----------------------------------------------------------------------------- autocomplete
def suburb_autocomplete(df: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """Distinct suburbs starting with the prefix (case-insensitive), ordered, top ``limit``."""
    return (df.filter(T.istarts("locality_name", prefix))
              .select("locality_name", "state_abbreviation", "postcode").distinct()
              .orderBy(*[F.asc_nulls_last(c) for c in ("locality_name", "state_abbreviation", "postcode")]).limit(limit))


def street_autocomplete(df: DataFrame, prefix: str, limit: int = 20, drop_coordinate_like: bool = True) -> DataFrame:
    """Distinct street names with the prefix, top ``limit``; coordinate-like names
    (A20) are removed *after* the limit as in the reference page."""
    top = (df.filter(T.istarts("street_name", prefix)).select("street_name", "street_type").distinct()
             .orderBy(F.asc_nulls_last("street_name"), F.asc_nulls_last("street_type")).limit(limit))
    return top.filter(~T.is_coordinate_like("street_name")) if drop_coordinate_like else top


def street_name_counts(streets: DataFrame) -> DataFrame:
    """``COUNT(*) OVER (PARTITION BY street_name)`` per street row.

    Written as a count per name (combined map-side) joined back on the name
    rather than a window, so a very common name is never sorted whole in one
    task; the join of a hot name is split by AQE's skew handling.  Null names
    form one group, as in the window.
    """
    counts = streets.groupBy("street_name").agg(F.count(F.lit(1)).alias("name_count"))
    return streets.join(counts, streets.street_name.eqNullSafe(counts.street_name)).drop(counts.street_name)


def coordinate_like_streets(streets: DataFrame, addresses: DataFrame) -> DataFrame:
    """T5: streets named like ``151.123`` with the number of addresses using each."""
    junk = streets.filter(F.col("street_name").rlike(r"^[0-9]+\.[0-9]+$"))
    used = addresses.groupBy("street_locality_pid").agg(F.count(F.lit(1)).alias("address_count"))
    return (junk.join(used, "street_locality_pid", "left")
                .select("street_locality_pid", "street_name", "locality_pid",
                        F.coalesce("address_count", F.lit(0)).alias("address_count")))


# ----------------------------------------------------------------------------- statistics
def count_by(df: DataFrame, *keys: str, name: str = "address_count") -> DataFrame:
    """AG1/AG5/AG21: ``groupBy(keys).count``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def locality_statistics(localities: DataFrame, addresses: DataFrame) -> DataFrame:
    """AG2: every locality with its address count (0 when none): pre-aggregate, then join."""
    counts = addresses.groupBy("locality_pid").agg(F.count(F.lit(1)).alias("address_count"))
    return (localities.join(counts, "locality_pid", "left")
                      .select("locality_pid", "locality_name", F.coalesce("address_count", F.lit(0)).alias("address_count")))


def _first_of(group: str, column: str, *order: str) -> Column:
    """1 for one row of each (group, column) with a value, else 0; a sum over these counts distinct values."""
    first = F.row_number().over(Window.partitionBy(group, column).orderBy(*order)) == 1
    return F.when(first & F.col(column).isNotNull(), 1).otherwise(0)


def suburb_summary_by_state(sp: DataFrame) -> DataFrame:
    """AG3: per state: distinct suburbs, distinct postcodes, rows.

    Rows are counted per (state, suburb, postcode) first; of these few, one for each suburb and one for
    each postcode is marked and the marks are summed.  (Several distinct counts at once would
    copy every row once for each of them before the shuffle.)
    """
    g = sp.groupBy("state_name", "locality_name", "postcode").agg(F.count(F.lit(1)).alias("_n"))
    g = g.select("state_name", "_n", _first_of("state_name", "locality_name", "postcode").alias("_l"), _first_of("state_name", "postcode", "locality_name").alias("_p"))
    return g.groupBy("state_name").agg(F.sum("_l").alias("suburb_count"), F.sum("_p").alias("postcode_count"), F.sum("_n").alias("row_count"))


def street_counts(df: DataFrame) -> DataFrame:
    """(state_name, locality_pid, street_locality_pid, address_count): distinct addresses, from one row for each address.

    The table from which counts per suburb, state or country follow without reading the addresses again.
    """
    one = df.select("state_name", "locality_pid", "street_locality_pid", "address_detail_pid").distinct()
    return one.groupBy("state_name", "locality_pid", "street_locality_pid").agg(F.count("address_detail_pid").alias("address_count"))


def state_statistics(df: DataFrame) -> DataFrame:
    """AG6: per state: distinct streets, localities and addresses (``address_detail_pid`` is the key of the address
    table, so an address has one street and one locality), rolled up from ``street_counts``."""
    g = street_counts(df).select("state_name", "address_count", _first_of("state_name", "street_locality_pid", "locality_pid").alias("_s"),
                                 _first_of("state_name", "locality_pid", "street_locality_pid").alias("_l"))
    return g.groupBy("state_name").agg(F.sum("_s").alias("street_count"), F.sum("_l").alias("locality_count"), F.sum("address_count").alias("address_count"))


def multi_suburb_postcodes(sp: DataFrame) -> DataFrame:
    """AG7: postcodes shared by more than one suburb, with the ordered suburb list.

    The list is per postcode (a postcode spans a handful of suburbs), built from
    the distinct pairs so duplicates do not inflate it.
    """
    pairs = sp.select("postcode", "locality_name").distinct()
    g = pairs.groupBy("postcode").agg(F.count(F.lit(1)).alias("suburb_count"),
                                      F.array_join(F.array_sort(F.collect_list("locality_name")), ", ").alias("suburbs"))
    return g.filter(F.col("suburb_count") > 1)


def geocode_coverage(tables: dict[str, DataFrame], coord: str = "lat") -> DataFrame:
    """AG8/U4: per table: total rows, rows with coordinates, percentage (2 dp)."""
    parts = [df.agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("total"),
                    F.count(coord).alias("geocoded")) for name, df in tables.items()]
    u = reduce(lambda a, b: a.unionByName(b), parts)
    return u.withColumn("pct", F.round(F.try_divide(F.col("geocoded") * F.lit(100.0), F.col("total")), 2))


def coverage_by_suburb(df: DataFrame, min_addresses: int = 100) -> DataFrame:
    """AG9: per suburb: distinct addresses, geocoded ones and %, HAVING > min_addresses."""
    has_point = (F.col("lat").isNotNull() & F.col("lon").isNotNull()).cast("int")
    one = df.filter(F.col("address_detail_pid").isNotNull()).groupBy("locality_name", "address_detail_pid").agg(F.max(has_point).alias("_g"))
    g = one.groupBy("locality_name").agg(F.count(F.lit(1)).alias("total"), F.sum("_g").alias("geocoded"))
    return (g.filter(F.col("total") > min_addresses)
             .withColumn("pct", F.round(F.try_divide(F.col("geocoded") * F.lit(100.0), F.col("total")), 2)))


def density_grid(df: DataFrame, size: float = 0.01, top: int = 20,
                 extent: tuple[float, float, float, float] | None = None) -> DataFrame:
    """AG10: address count per square cell (cell centre reported), top ``top``.

    ``ST_Contains(cell, point)`` excludes points exactly on a cell edge, so such
    points are dropped (not moved to the next cell).  ``extent`` (minx, miny,
    maxx, maxy) restricts to the grid's envelope.
    """
    cx, cy = square_cell("lon", size), square_cell("lat", size)
    # an edge is a multiple of the size as a number, whatever the quotient rounds to
    edge = lambda c, cell: (F.col(c) == cell * F.lit(size)) | (F.col(c) == (cell + 1) * F.lit(size))
    on_edge = edge("lon", cx) | edge("lat", cy)
    d = df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull() & ~on_edge)
    if extent:
        d = d.filter(F.col("lon").between(extent[0], extent[2]) & F.col("lat").between(extent[1], extent[3]))
    g = d.groupBy(cx.alias("cx"), cy.alias("cy")).agg(F.count(F.lit(1)).alias("address_count"))
    return (g.select(F.round((F.col("cx") + F.lit(0.5)) * F.lit(size), 6).alias("lon"),
                     F.round((F.col("cy") + F.lit(0.5)) * F.lit(size), 6).alias("lat"), "address_count")
             .orderBy(F.desc("address_count"), "lon", "lat").limit(top))


def postcode_centroids(df: DataFrame, min_count: int = 10, keys: list[str] | None = None) -> DataFrame:
    """AG11 (without hull): per postcode (or the given keys, say postcode and locality): centroid of
    the points and count, HAVING > min_count."""
    return (df.filter(F.col("lon").isNotNull() & F.col("lat").isNotNull())
              .groupBy(*(keys or ["postcode"])).agg(F.avg("lon").alias("centroid_lon"), F.avg("lat").alias("centroid_lat"),
                                                    F.count(F.lit(1)).alias("address_count"))
              .filter(F.col("address_count") > min_count))


def distinct_address_count(df: DataFrame) -> DataFrame:
    """AG26: pagination total - distinct addresses after the filters."""
    return df.agg(F.count_distinct("address_detail_pid").alias("total_count"))


def global_statistics(localities: DataFrame, addresses: DataFrame, streets: DataFrame,
                      with_refresh_time: bool = True) -> DataFrame:
    """AG4: distinct active localities, addresses and streets (+ refresh time).

    Three one-row aggregates are stacked and folded with ``max`` - an aggregate,
    not a cross join of the three rows.
    """
    def one(df, key, name):
        others = [n for n in ("total_localities", "total_addresses", "total_streets") if n != name]
        return (df.filter(F.col("date_retired").isNull()).agg(F.count_distinct(key).alias(name))
                  .select(name, *[F.lit(None).cast("long").alias(o) for o in others]))
    u = one(localities, "locality_pid", "total_localities").unionByName(
        one(addresses, "address_detail_pid", "total_addresses")).unionByName(
        one(streets, "street_locality_pid", "total_streets"))
    out = u.agg(*[F.max(c).alias(c) for c in ("total_localities", "total_addresses", "total_streets")])
    return out.withColumn("last_refreshed", F.current_timestamp()) if with_refresh_time else out


def street_type_autocomplete(streets: DataFrame, street_types: DataFrame, prefix: str, limit: int = 20) -> DataFrame:
    """J8 + O6: active streets LEFT JOIN their type, by case-insensitive prefix, distinct,
    ordered by name; equal names go by type, a missing type last."""
    st = street_types.select(F.col("code").alias("street_type_code"), F.col("name").alias("street_type"))
    j = streets.filter(F.col("date_retired").isNull()).join(st, "street_type_code", "left")
    return (j.filter(T.istarts("street_name", prefix)).select("street_name", "street_type").distinct()
             .orderBy(F.asc_nulls_last("street_name"), F.asc_nulls_last("street_type")).limit(limit))
