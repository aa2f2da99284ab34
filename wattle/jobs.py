"""Saved tables (S17, E3): the catchment mapping and what is derived from it, kept up to date by what changed.

``build`` writes everything as version 1 of a folder (or the next version of an existing one); ``refresh`` compares the
addresses and polygons with those the saved version was made from and rebuilds only what they touch:

* the mapping lies in tiles of TILE degrees.  Addresses that are new, gone or moved touch their tiles, polygons that are
  new, gone or changed the tiles of their cover, before and after.  In a touched tile, saved rows of unchanged addresses and unchanged
  polygons stay; changed addresses meet all polygons, unchanged ones near a changed polygon the changed polygons alone;
* streets and statistics lie in buckets of schools; the buckets of schools whose rows differ are derived again.

Readers take the newest version (``sources.snapshots``) and never see a half-written one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.functions.geo import rings_bbox, square_cell
from wattle.operators import schools
from wattle.operators import spatial_join as S
from wattle.operators.grid import Cover
from wattle.sources import snapshots
from wattle.sources.scratch import written

MAPPING, STREETS, STATISTICS, SUMMARY = "address_catchment_mapping", "catchment_streets", "catchment_statistics", "catchment_summary"
#: What the saved version was made from.
ADDRESSES, POLYGONS = "source_addresses", "source_polygons"
#: Width of a tile in degrees, buckets of schools, and the smallest cell of the polygon covers.
TILE, BUCKETS, CELL = 0.25, 32, 0.0025

_ADDRESS = "address_detail_pid string, lon double, lat double, street_locality_pid string, locality_pid string, postcode string"
_POLYGON = "school_id bigint, school_type string, rings array<array<struct<x:double,y:double>>>"
SCHEMAS = {
    MAPPING: "address_detail_pid string, school_id bigint, school_type string",
    STREETS: "school_id bigint, school_type string, street_name string, street_type string, locality_name string, postcode string",
    STATISTICS: "school_id bigint, school_name string, school_type string, centroid_lon double, centroid_lat double, address_count bigint",
    SUMMARY: "metric string, mapping_rows bigint, addresses bigint, schools bigint",
    ADDRESSES: _ADDRESS,
    POLYGONS: _POLYGON,
}


def read(spark: SparkSession, folder: str, name: str, version: int | None = None) -> DataFrame:
    return snapshots.read(spark, folder, name, SCHEMAS[name], version).drop("part")


def _tile(lon, lat) -> Column:
    """Name of a point's tile; points without coordinates share one."""
    name = F.concat_ws("_", square_cell(lat, TILE).cast("string"), square_cell(lon, TILE).cast("string"))
    return F.when(F.col(lon).isNotNull() & F.col(lat).isNotNull(), name).otherwise("none")


def _tiles_of(polygons: DataFrame) -> DataFrame:
    """(school_id, part): the tiles that each polygon's box meets."""
    minx, miny, maxx, maxy = rings_bbox("rings")
    b = polygons.select("school_id", minx.alias("x0"), miny.alias("y0"), maxx.alias("x1"), maxy.alias("y1"))
    b = b.select("school_id", "y0", "y1", F.explode(F.sequence(square_cell("x0", TILE), square_cell("x1", TILE))).alias("cx"))
    b = b.select("school_id", "cx", F.explode(F.sequence(square_cell("y0", TILE), square_cell("y1", TILE))).alias("cy"))
    return b.select("school_id", F.concat_ws("_", F.col("cy").cast("string"), F.col("cx").cast("string")).alias("part"))


def _bucket(school_id: str = "school_id") -> Column:
    return F.pmod(F.hash(school_id), F.lit(BUCKETS)).cast("string")


def _placed(addresses: DataFrame) -> DataFrame:
    names = [f.split()[0] for f in _ADDRESS.split(", ")]
    # a point without one coordinate has none
    both = F.col("lon").isNotNull() & F.col("lat").isNotNull()
    a = addresses.select(*names).withColumn("lon", F.when(both, F.col("lon"))).withColumn("lat", F.when(both, F.col("lat")))
    return a.withColumn("part", _tile("lon", "lat"))


def _mapped(addresses: DataFrame, polygons: DataFrame, cover: Cover | None = None) -> DataFrame:
    """(mapping columns, part) of addresses that lie in polygons; ``cover`` is that of the polygons, if there is one."""
    points = addresses.select("address_detail_pid", "lon", "lat", "part")
    found = S.points_in_polygons(points, polygons, "school_id", CELL, point_id="address_detail_pid", once=True, cover=cover)
    return found.select("address_detail_pid", "school_id", "school_type", "part")


def _derive(spark: SparkSession, mapping: DataFrame, addresses: DataFrame, streets: DataFrame, street_types: DataFrame, localities: DataFrame,
            polygons: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    derived = catchment_streets(mapping, addresses, streets, street_types, localities).withColumn("part", _bucket())
    return derived, schools.catchment_stats(polygons, names, mapping).withColumn("part", _bucket())


def build(addresses: DataFrame, streets: DataFrame, street_types: DataFrame, localities: DataFrame, polygons: DataFrame, names: DataFrame, folder: str) -> int:
    """Write all tables as the folder's next version and show it; returns the version.

    What later steps need is written once more without parts: tiles grow in number with the data, and each is a folder
    to list and a small file to open at every reading.
    """
    spark = addresses.sparkSession
    version = snapshots.current(spark, folder) + 1
    held = {}

    def put(df: DataFrame, table: str) -> None:
        held[table] = dict.fromkeys(snapshots.write(df, folder, table, version), version)

    a = written(_placed(addresses), "addresses")
    put(a, ADDRESSES)
    p = written(polygons.select("school_id", "school_type", "rings").withColumn("part", _bucket()), "polygons")
    put(p, POLYGONS)
    m = written(_mapped(a, p.drop("part")), "mapping")
    put(m, MAPPING)
    m = m.drop("part")
    derived, statistics = _derive(spark, m, a, streets, street_types, localities, p, names)
    put(derived, STREETS)
    put(statistics, STATISTICS)
    put(mapping_counts(m).withColumn("part", F.lit("all")), SUMMARY)
    snapshots.commit(spark, folder, version, held)
    return version


def refresh(addresses: DataFrame, streets: DataFrame, street_types: DataFrame, localities: DataFrame, polygons: DataFrame, names: DataFrame, folder: str) -> int:
    """Bring the saved tables up to the given addresses and polygons; returns the version shown, the old one if nothing differs.

    Changes of ``streets``, ``street_types``, ``localities`` and ``names`` alone are not looked for: ``build`` follows them.
    """
    spark = addresses.sparkSession
    old = snapshots.current(spark, folder)
    if not old:
        return build(addresses, streets, street_types, localities, polygons, names, folder)
    version = old + 1
    held = {table: snapshots.parts(spark, folder, table, old) for table in SCHEMAS}
    was_a, was_p = snapshots.read(spark, folder, ADDRESSES, _ADDRESS, old), snapshots.read(spark, folder, POLYGONS, _POLYGON, old)
    now_a = written(_placed(addresses), "addresses")
    now_p = written(polygons.select("school_id", "school_type", "rings").withColumn("part", _bucket()), "polygons")

    # rows that differ: address by address and polygon by polygon, each with the tiles it touches, before or after
    cells = lambda df, key: [x for c in df.columns if c not in (key, "part") for x in (F.col(c), F.col(c).isNull())]
    row = lambda df, key, side: df.select(key, F.xxhash64(*cells(df, key)).alias("h"), F.col("part").alias(side))

    def differ(now: DataFrame, was: DataFrame, key: str) -> DataFrame:
        both = row(now, key, "_now").join(row(was, key, "_was"), [key, "h"], "full_outer").filter(F.col("_now").isNull() | F.col("_was").isNull())
        return both.select(key, F.coalesce("_now", "_was").alias("part"), F.col("_now").isNotNull().alias("now"))

    changed_a = written(differ(now_a, was_a, "address_detail_pid"), "changed-addresses")
    changed_p = written(differ(now_p, was_p, "school_id").select("school_id", "part").distinct(), "changed-polygons")
    ids = written(changed_p.select("school_id").distinct(), "changed-schools")
    tiles_p = _tiles_of(was_p.join(ids, "school_id", "left_semi")).unionByName(_tiles_of(now_p.join(ids, "school_id", "left_semi"))).select("part").distinct()
    # tiles by the thousand: joined as small tables, as a list of names would be part of every row's condition
    moved_parts = written(changed_a.select("part").distinct(), "moved-tiles")
    touched_parts = written(moved_parts.unionByName(tiles_p).distinct(), "touched-tiles")
    touched = {r["part"] for r in touched_parts.collect()}
    if not touched:
        return old

    def put(df: DataFrame, table: str, replaced: set[str]) -> None:
        new = snapshots.write(df, folder, table, version)
        held[table] = {k: v for k, v in held[table].items() if k not in replaced} | dict.fromkeys(new, version)

    was_m = snapshots.read(spark, folder, MAPPING, SCHEMAS[MAPPING], old, touched)
    beside = snapshots.read(spark, folder, MAPPING, SCHEMAS[MAPPING], old, held[MAPPING].keys() - touched)
    kept = was_m.join(changed_a.select("address_detail_pid"), "address_detail_pid", "left_anti").join(ids, "school_id", "left_anti")
    now_pids = changed_a.filter("now").select("address_detail_pid")
    cover = Cover(now_p, "school_id", CELL)
    redrawn_cover = cover.of(ids)
    # what lies in a changed polygon is in a touched tile
    settled = redrawn_cover.near(now_a, "lon", "lat").join(now_pids, "address_detail_pid", "left_anti")
    fresh = now_a.join(now_pids, "address_detail_pid", "left_semi").join(touched_parts, "part", "left_semi")
    moved_in = _mapped(fresh, now_p.drop("part"), cover)
    redrawn = _mapped(settled, now_p.join(ids, "school_id", "left_semi").drop("part"), redrawn_cover)
    now_m = written(kept.select(*was_m.columns).unionByName(moved_in).unionByName(redrawn), "touched-mapping")
    put(now_m, MAPPING, touched)
    moved = {r["part"] for r in moved_parts.collect()}
    if moved:  # where polygons alone differ, the addresses are those saved
        put(now_a.join(moved_parts, "part", "left_semi"), ADDRESSES, moved)
    buckets_p = {r["part"] for r in changed_p.select("part").distinct().collect()}
    if buckets_p:
        put(now_p.filter(F.col("part").isin(buckets_p)), POLYGONS, buckets_p)

    # schools whose mapping rows, or the addresses behind them, differ; those in buckets of changed polygons are known to
    stale = buckets_p
    if len(stale) < BUCKETS:
        open_m, open_was = (df.filter(~_bucket().isin(buckets_p)).select("address_detail_pid", "school_id") for df in (now_m, was_m))
        either = (open_m.withColumn("_now", F.lit(True)).join(open_was.withColumn("_was", F.lit(True)), ["address_detail_pid", "school_id"], "full_outer")
                  .filter(F.col("_now").isNull() | F.col("_was").isNull()).select("school_id"))
        behind = open_m.join(changed_a.select("address_detail_pid"), "address_detail_pid", "left_semi").select("school_id")
        stale = stale | {r["part"] for r in either.unionByName(behind).select(_bucket().alias("part")).distinct().collect()}
    m = now_m.unionByName(beside).drop("part")
    if stale:
        of_stale = m.filter(_bucket().isin(stale))
        derived, statistics = _derive(spark, of_stale, now_a, streets, street_types, localities,
                                      _listed(spark, folder, POLYGONS, held[POLYGONS]).filter(_bucket().isin(stale)), names)
        put(derived, STREETS, stale)
        put(statistics, STATISTICS, stale)
    put(mapping_counts(m).withColumn("part", F.lit("all")), SUMMARY, {"all"})
    snapshots.commit(spark, folder, version, held)
    return version


def _listed(spark: SparkSession, folder: str, table: str, held: dict[str, int]) -> DataFrame:
    """A table of the version that is being made."""
    return snapshots.opened(spark, folder, table, SCHEMAS[table], held).drop("part")


def catchment_streets(mapping: DataFrame, addresses: DataFrame, streets: DataFrame, street_types: DataFrame, localities: DataFrame) -> DataFrame:
    """The distinct streets (with suburb and postcode) of every catchment."""
    a = addresses.select("address_detail_pid", "street_locality_pid", "locality_pid", "postcode")
    # streets grow with the addresses: by sort-merge, however small their file
    s = streets.select("street_locality_pid", "street_name", "street_type_code").hint("merge")
    kinds = street_types.select(F.col("code").alias("street_type_code"), F.col("name").alias("street_type"))
    j = (mapping.join(a, "address_detail_pid").join(s, "street_locality_pid").join(kinds, "street_type_code", "left")
         .join(localities.select("locality_pid", "locality_name"), "locality_pid"))
    return j.select("school_id", "school_type", "street_name", "street_type", "locality_name", "postcode").distinct()


def mapping_counts(mapping: DataFrame) -> DataFrame:
    """AG16: rows, addresses and schools per type and in total, from one pass."""
    r = mapping.rollup("school_type").agg(F.count(F.lit(1)).alias("mapping_rows"), F.count_distinct("address_detail_pid").alias("addresses"),
                                          F.count_distinct("school_id").alias("schools"), F.grouping("school_type").alias("_g"))
    return r.select(F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("school_type")).alias("metric"), "mapping_rows", "addresses", "schools")
