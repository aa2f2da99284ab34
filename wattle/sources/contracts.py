"""Contracts of the 35 tables of the national address file: columns, key and references of each.

The contracts drive the loads (S5-S7, Q5, Q6): a file is routed to its table by name, refused where its
columns are not the table's, and read with the declared types.  They drive the checks too (Q1, Q2): the
keys of all tables are counted in one shuffle, and so are all references.
"""

from __future__ import annotations

import re
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import CharType, DateType, DecimalType, StructField, StructType, VarcharType

from wattle.sources.files import read_psv, table_name_from_file

# The published file's tables, types and references.
#: Code tables: type of the code, longest name, longest description.
CODE_TABLES = {
    "address_alias_type_aut": ("VARCHAR(10)", 50, 30), "address_change_type_aut": ("VARCHAR(50)", 100, 500), "address_type_aut": ("VARCHAR(8)", 50, 30),
    "flat_type_aut": ("VARCHAR(7)", 50, 30), "geocoded_level_type_aut": ("DECIMAL(2)", 50, 70), "geocode_reliability_aut": ("DECIMAL(1)", 50, 100),
    "geocode_type_aut": ("VARCHAR(4)", 50, 250), "level_type_aut": ("VARCHAR(4)", 50, 30), "locality_alias_type_aut": ("VARCHAR(10)", 50, 100),
    "locality_class_aut": ("CHAR(1)", 50, 200), "mb_match_code_aut": ("VARCHAR(15)", 100, 250), "ps_join_type_aut": ("DECIMAL(2)", 50, 500),
    "street_class_aut": ("CHAR(1)", 50, 200), "street_locality_alias_type_aut": ("VARCHAR(10)", 50, 15), "street_suffix_aut": ("VARCHAR(15)", 50, 30),
    "street_type_aut": ("VARCHAR(15)", 50, 15),
}

_DATES = "date_created DATE NOT NULL, date_retired DATE"
_POINT = "longitude DECIMAL(11,8), latitude DECIMAL(10,8)"
_STREET = "street_name VARCHAR(100) NOT NULL, street_type_code VARCHAR(15), street_suffix_code VARCHAR(15)"

#: Entity tables: columns after the key and the two dates.
ENTITY_TABLES = {
    "address_alias": "principal_pid VARCHAR(15) NOT NULL, alias_pid VARCHAR(15) NOT NULL, alias_type_code VARCHAR(10) NOT NULL, alias_comment VARCHAR(200)",
    "address_default_geocode": f"address_detail_pid VARCHAR(15) NOT NULL, geocode_type_code VARCHAR(4) NOT NULL, {_POINT}",
    **{f"address_mesh_block_{year}": f"address_detail_pid VARCHAR(15) NOT NULL, mb_match_code VARCHAR(15) NOT NULL, mb_{year}_pid VARCHAR(15) NOT NULL" for year in (2016, 2021)},
    "address_site": "address_type VARCHAR(8), address_site_name VARCHAR(200)",
    "address_site_geocode": "address_site_pid VARCHAR(15), geocode_site_name VARCHAR(200), geocode_site_description VARCHAR(45), geocode_type_code VARCHAR(4),"
                            f" reliability_code DECIMAL(1) NOT NULL, boundary_extent DECIMAL(7), planimetric_accuracy DECIMAL(12), elevation DECIMAL(7), {_POINT}",
    "locality": "locality_name VARCHAR(100) NOT NULL, primary_postcode VARCHAR(4), locality_class_code CHAR(1) NOT NULL, state_pid VARCHAR(15) NOT NULL,"
                " gnaf_locality_pid VARCHAR(15), gnaf_reliability_code DECIMAL(1) NOT NULL",
    "locality_alias": "locality_pid VARCHAR(15) NOT NULL, name VARCHAR(100) NOT NULL, postcode VARCHAR(4), alias_type_code VARCHAR(10) NOT NULL, state_pid VARCHAR(15) NOT NULL",
    "locality_neighbour": "locality_pid VARCHAR(15) NOT NULL, neighbour_locality_pid VARCHAR(15) NOT NULL",
    "locality_point": f"locality_pid VARCHAR(15) NOT NULL, planimetric_accuracy DECIMAL(12), {_POINT}",
    **{f"mb_{year}": f"mb_{year}_code VARCHAR(15) NOT NULL" for year in (2016, 2021)},
    "state": "state_name VARCHAR(50) NOT NULL, state_abbreviation VARCHAR(3) NOT NULL",
    "street_locality": f"street_class_code CHAR(1) NOT NULL, {_STREET}, locality_pid VARCHAR(15) NOT NULL, gnaf_street_pid VARCHAR(15),"
                       " gnaf_street_confidence DECIMAL(1), gnaf_reliability_code DECIMAL(1) NOT NULL",
    "street_locality_alias": f"street_locality_pid VARCHAR(15) NOT NULL, {_STREET}, alias_type_code VARCHAR(10) NOT NULL",
    "street_locality_point": f"street_locality_pid VARCHAR(15) NOT NULL, boundary_extent DECIMAL(7), planimetric_accuracy DECIMAL(12), {_POINT}",
}

#: Tables that do not begin with the key and the two dates.
OTHER_TABLES = {
    "address_detail": "address_detail_pid VARCHAR(15) NOT NULL, date_created DATE NOT NULL, date_last_modified DATE, date_retired DATE, building_name VARCHAR(200),"
                      " lot_number_prefix VARCHAR(2), lot_number VARCHAR(5), lot_number_suffix VARCHAR(2),"
                      " flat_type_code VARCHAR(7), flat_number_prefix VARCHAR(2), flat_number DECIMAL(5), flat_number_suffix VARCHAR(2),"
                      " level_type_code VARCHAR(4), level_number_prefix VARCHAR(2), level_number DECIMAL(3), level_number_suffix VARCHAR(2),"
                      " number_first_prefix VARCHAR(3), number_first DECIMAL(6), number_first_suffix VARCHAR(2),"
                      " number_last_prefix VARCHAR(3), number_last DECIMAL(6), number_last_suffix VARCHAR(2),"
                      " street_locality_pid VARCHAR(15), location_description VARCHAR(45), locality_pid VARCHAR(15) NOT NULL, alias_principal CHAR(1),"
                      " postcode VARCHAR(4), private_street VARCHAR(75), legal_parcel_id VARCHAR(20), confidence DECIMAL(1), address_site_pid VARCHAR(15) NOT NULL,"
                      " level_geocoded_code DECIMAL(2) NOT NULL, property_pid VARCHAR(15), gnaf_property_pid VARCHAR(15), primary_secondary VARCHAR(1)",
    "address_feature": "address_feature_id VARCHAR(16) NOT NULL, address_feature_pid VARCHAR(16) NOT NULL, address_detail_pid VARCHAR(15) NOT NULL,"
                       " date_address_detail_created DATE NOT NULL, date_address_detail_retired DATE, address_change_type_code VARCHAR(50)",
    "primary_secondary": f"primary_secondary_pid VARCHAR(15) NOT NULL, primary_pid VARCHAR(15) NOT NULL, secondary_pid VARCHAR(15) NOT NULL, {_DATES},"
                         " ps_join_type_code DECIMAL(2) NOT NULL, ps_join_comment VARCHAR(500)",
}

#: References: child table -> its column -> parent table, whose key it holds.
REFERENCES = {
    "address_alias": {"alias_pid": "address_detail", "alias_type_code": "address_alias_type_aut", "principal_pid": "address_detail"},
    "address_default_geocode": {"address_detail_pid": "address_detail", "geocode_type_code": "geocode_type_aut"},
    "address_detail": {"address_site_pid": "address_site", "flat_type_code": "flat_type_aut", "level_geocoded_code": "geocoded_level_type_aut",
                       "level_type_code": "level_type_aut", "locality_pid": "locality", "street_locality_pid": "street_locality"},
    "address_feature": {"address_change_type_code": "address_change_type_aut", "address_detail_pid": "address_detail"},
    "address_mesh_block_2016": {"address_detail_pid": "address_detail", "mb_2016_pid": "mb_2016", "mb_match_code": "mb_match_code_aut"},
    "address_mesh_block_2021": {"address_detail_pid": "address_detail", "mb_2021_pid": "mb_2021", "mb_match_code": "mb_match_code_aut"},
    "address_site": {"address_type": "address_type_aut"},
    "address_site_geocode": {"address_site_pid": "address_site", "geocode_type_code": "geocode_type_aut", "reliability_code": "geocode_reliability_aut"},
    "locality": {"gnaf_reliability_code": "geocode_reliability_aut", "locality_class_code": "locality_class_aut", "state_pid": "state"},
    "locality_alias": {"alias_type_code": "locality_alias_type_aut", "locality_pid": "locality"},
    "locality_neighbour": {"locality_pid": "locality", "neighbour_locality_pid": "locality"},
    "locality_point": {"locality_pid": "locality"},
    "primary_secondary": {"primary_pid": "address_detail", "ps_join_type_code": "ps_join_type_aut", "secondary_pid": "address_detail"},
    "street_locality": {"gnaf_reliability_code": "geocode_reliability_aut", "locality_pid": "locality", "street_class_code": "street_class_aut",
                        "street_suffix_code": "street_suffix_aut", "street_type_code": "street_type_aut"},
    "street_locality_alias": {"alias_type_code": "street_locality_alias_type_aut", "street_locality_pid": "street_locality",
                              "street_suffix_code": "street_suffix_aut", "street_type_code": "street_type_aut"},
    "street_locality_point": {"street_locality_pid": "street_locality"},
}


def key_of(table: str) -> str:
    """Code tables are keyed by their code, features by an id of their own, the others by the table's persistent id."""
    if table in CODE_TABLES:
        return "code"
    return "address_feature_id" if table == "address_feature" else f"{table}_pid"


def _fields(ddl: str) -> StructType:
    """Columns written as in ``CREATE TABLE``, with ``, `` between them."""
    kinds = {"VARCHAR": VarcharType, "CHAR": CharType, "DECIMAL": lambda p, s=0: DecimalType(p, s), "DATE": DateType}
    out = []
    for part in ddl.split(", "):
        name, kind, *required = part.split(" ", 2)
        word, *sizes = re.findall(r"\w+", kind)
        out.append(StructField(name, kinds[word](*map(int, sizes)), not required))
    return StructType(out)


@cache
def contracts() -> dict[str, StructType]:
    """Table -> declared columns (types, lengths, which may be null), by name of table."""
    ddl = {t: f"code {code} NOT NULL, name VARCHAR({name}) NOT NULL, description VARCHAR({text})" for t, (code, name, text) in CODE_TABLES.items()}
    ddl |= {t: f"{t}_pid VARCHAR(15) NOT NULL, {_DATES}, {rest}" for t, rest in ENTITY_TABLES.items()}
    ddl |= OTHER_TABLES
    return {t: _fields(ddl[t]) for t in sorted(ddl)}


# ----------------------------------------------------------------------------- loads
def route(file_names: list[str], spark: SparkSession) -> dict[str, str]:
    """File name -> contract table; a name that leads to none, or to several, is refused."""
    df = spark.createDataFrame([(n,) for n in file_names], "file string")
    out = {}
    for file, name in df.select("file", table_name_from_file("file")).collect():
        hits = [name] if name in contracts() else [t for t in contracts() if name in t]
        if len(hits) != 1:
            raise ValueError(f"no unique table for file {file!r}: {hits}")
        out[file] = hits[0]
    return out


def check_columns(columns: list[str], table: str) -> None:
    """Q5/Q6: refuse a file whose columns are not the table's, in any order or case."""
    want, have = [f.name for f in contracts()[table].fields], [c.lower() for c in columns]
    if sorted(want) != sorted(have):
        raise ValueError(f"{table}: missing columns {sorted(set(want) - set(have))}, unknown {sorted(set(have) - set(want))}, {len(have)} for {len(want)}")


def plain_type(f) -> str:
    """The type a load gives the column: texts keep their length unchecked (``cell_report`` counts the long ones)."""
    return "string" if isinstance(f.dataType, (VarcharType, CharType)) else f.dataType.simpleString()


def typed(df: DataFrame, table: str) -> DataFrame:
    """Text columns as the contract's types, in its order; a cell that cannot be read is null (``cell_report`` counts them)."""
    return df.select(*[F.col(f.name).try_cast(plain_type(f)).alias(f.name) for f in contracts()[table].fields])


def load(spark: SparkSession, path: str, table: str) -> DataFrame:
    """One table's pipe-separated files with its declared types; files of other columns are refused."""
    raw = read_psv(spark, path).drop("_file_name")
    check_columns(raw.columns, table)
    return typed(raw, table)


# ----------------------------------------------------------------------------- checks
def cell_report(df: DataFrame, table: str) -> DataFrame:
    """Q5: per declared column of a text load: rows, empty cells where the contract asks for a value, cells that
    its type cannot read, and texts over its length.  One aggregate over the table, whatever its width."""
    fields = contracts()[table].fields
    aggs = []
    for i, f in enumerate(fields):
        c = F.col(f.name)
        length = getattr(f.dataType, "length", None)
        aggs += [(F.lit(0) if f.nullable else F.count_if(c.isNull())).cast("long").alias(f"e{i}"),
                 (F.lit(0) if length else F.count_if(c.isNotNull() & c.try_cast(plain_type(f)).isNull())).cast("long").alias(f"u{i}"),
                 (F.count_if(F.char_length(c) > length) if length else F.lit(0)).cast("long").alias(f"l{i}")]
    one = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    cells = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col("n").alias("row_count"), F.col(f"e{i}").alias("empty_required"),
                               F.col(f"u{i}").alias("unreadable"), F.col(f"l{i}").alias("too_long")) for i, f in enumerate(fields)])
    return one.select(F.lit(table).alias("table_name"), F.inline(cells))


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def all_cells(tables: dict[str, DataFrame]) -> DataFrame:
    """Q5: ``cell_report`` of every table."""
    return _union([cell_report(df, t) for t, df in tables.items()])


def _key(column: str) -> Column:
    return F.col(column).cast("string")


def key_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Q1 for all tables at once: rows, keys that occur more than once, rows without a key.

    The tables' keys go through one shuffle by (table, key), combined before it; an empty table is listed with zeros.
    """
    spark = next(iter(tables.values())).sparkSession
    keys = _union([df.select(F.lit(t).alias("table_name"), _key(key_of(t)).alias("k")) for t, df in tables.items()])
    per = keys.groupBy("table_name", "k").agg(F.count(F.lit(1)).alias("n"))
    found = per.groupBy("table_name").agg(F.sum("n").alias("row_count"), F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("duplicate_keys"),
                                          F.sum(F.when(F.col("k").isNull(), F.col("n")).otherwise(0)).alias("null_keys"))
    listed = spark.createDataFrame([(t, key_of(t)) for t in tables], "table_name string, pk string")
    return listed.join(found, "table_name", "left").fillna(0, ["row_count", "duplicate_keys", "null_keys"])


def reference_report(tables: dict[str, DataFrame]) -> DataFrame:
    """Q2 for all references among ``tables`` at once: rows whose value is no key of the parent, and how many values these are.

    Each child is read once for all its references, each parent once for all its children; both sides meet in one
    shuffle by (parent, key).  A value's rows are counted before it, so a value that most rows hold is one row there.
    """
    spark = next(iter(tables.values())).sparkSession
    wanted = [(f"{c}.{col}", c, col, p) for c, cols in REFERENCES.items() for col, p in cols.items() if c in tables and p in tables]
    held = []
    for child in dict.fromkeys(c for _, c, _, _ in wanted):
        cells = F.array(*[F.struct(F.lit(fk).alias("fk_name"), F.lit(p).alias("parent"), _key(col).alias("k")) for fk, c, col, p in wanted if c == child])
        held.append(tables[child].select(F.inline(cells)).filter("k is not null"))
    values = _union(held).groupBy("parent", "k", "fk_name").agg(F.count(F.lit(1)).alias("n"))
    keys = _union([tables[p].select(F.lit(p).alias("parent"), _key(key_of(p)).alias("k")) for p in dict.fromkeys(p for *_, p in wanted)])
    orphans = values.join(keys, ["parent", "k"], "left_anti").groupBy("fk_name").agg(F.sum("n").alias("orphan_rows"), F.count(F.lit(1)).alias("orphan_values"))
    listed = spark.createDataFrame([(fk, p) for fk, _, _, p in wanted], "fk_name string, parent string")
    return listed.join(orphans, "fk_name", "left").fillna(0, ["orphan_rows", "orphan_values"])
