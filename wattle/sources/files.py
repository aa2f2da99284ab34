"""File sources and sinks.

Every reader returns a lazy DataFrame; partitioned reads and writes are done by
Spark.  Only single rows (lines that may be a header, a chosen file name) ever reach the
driver.
"""

from __future__ import annotations

import csv

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wattle.functions.geo import from_3857

# The two header labels that mark the ledger's header row.
LEDGER_HEADER_LABELS = ("Opportunity ID", "Engagement ID")

# Words that mark web-scraping junk in suburb files.
SUBURB_JUNK_KEYWORDS = [
    "search", "home", "territory", "urban centres", "time zones",
    "postcode lists", "hotels", "faq", "contact", "recently viewed",
    "sign in", "register", "menu",
]


# ----------------------------------------------------------------------------- S1-S3
def read_ledger_csv(spark: SparkSession, path: str, header_row_index: int | None = None) -> DataFrame:
    """Headerless sheet export; the header is the first row holding both labels
    (or the given 0-based row); later rows become the data, named by the header.

    Lines are read as text with a row-order id; the driver looks through those that hold both
    labels, partition by partition and up to the header, however many come before it.  The later lines are parsed with as many columns as it has, so a title line of
    one cell does not narrow the table.  Use one file per ledger.
    """
    raw = spark.read.text(path).select("value", F.monotonically_increasing_id().alias("_row"))
    if header_row_index is None:
        labels = [F.col("value").contains(x) for x in LEDGER_HEADER_LABELS]
        # lines that may be the header, in row order; which cells they have is decided one by one
        found = raw.filter(labels[0] & labels[1]).toLocalIterator()
    else:
        found = raw.orderBy("_row").offset(header_row_index).limit(1).collect()
    for line in found:
        cells = next(csv.reader([line["value"]]))
        trimmed = [c.strip() for c in cells]
        if header_row_index is not None or all(x in trimmed for x in LEDGER_HEADER_LABELS):
            break
    else:
        raise ValueError(f"no row of {path} has the cells {' and '.join(LEDGER_HEADER_LABELS)}; give its index instead")
    names = [c or f"_c{i}" for i, c in enumerate(trimmed)]
    wide = StructType([StructField(f"_c{i}", StringType()) for i in range(len(names))])
    rows = raw.filter((F.col("_row") > F.lit(line["_row"])) & (F.trim("value") != "")).select(F.from_csv("value", wide.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " ")).alias("r"))
    return rows.select(*[F.col(f"r._c{i}").alias(n) for i, n in enumerate(names)])


def read_sheet_csv(spark: SparkSession, path: str) -> DataFrame:
    """Sheet export with a header row; column names trimmed."""
    df = spark.read.option("header", True).csv(path)
    return df.toDF(*[c.strip() for c in df.columns])


def read_partner_mapping(spark: SparkSession, primary: str, fallback: str) -> DataFrame | None:
    """S3: 'Engagement Partners' export, else the 'Billing' export; ``Billing Partner``
    becomes ``Engagement Partner``.  None when neither has the columns."""
    for path in (primary, fallback):
        try:
            df = read_sheet_csv(spark, path)
        except AnalysisException as exc:
            # a missing sheet means "try the next"; anything else is an error
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        if "Engagement ID" not in df.columns:
            continue
        if "Billing Partner" in df.columns and "Engagement Partner" not in df.columns:
            df = df.withColumnRenamed("Billing Partner", "Engagement Partner")
        if "Engagement Partner" in df.columns:
            return df
    return None


# ----------------------------------------------------------------------------- S4
def latest_files(spark: SparkSession, folder: str, patterns: list[str]) -> DataFrame:
    """Per pattern, the newest file whose name contains it (case-insensitive).

    File listing comes from the ``binaryFile`` source's metadata columns (the
    content column is never selected, so no bytes are read).
    """
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
                  .select("path", "modificationTime"))
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    # Each file is tagged with the patterns its name contains (the pattern list is
    # the caller's handful of literals), so no join is needed.
    tags = F.array_compact(F.array(*[F.when(name.contains(p.lower()), F.lit(p)) for p in patterns]))
    j = files.select("path", "modificationTime", F.explode(tags).alias("pattern"))
    return j.groupBy("pattern").agg(F.max_by("path", "modificationTime").alias("path"),
                                    F.max("modificationTime").alias("modified"))


# ----------------------------------------------------------------------------- S5-S7
def read_psv(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Pipe-separated text, every column a string, empty or blank -> null,
    plus the source file name (S6 input)."""
    reader = spark.read.option("sep", "|").option("header", True)
    if columns:
        reader = reader.schema(StructType([StructField(c, StringType()) for c in columns]))
    df = reader.csv(path)
    return df.select(*[F.when(F.trim(F.col(f"`{c}`")) == "", None).otherwise(F.col(f"`{c}`")).alias(c.lower())
                       for c in df.columns], F.col("_metadata.file_name").alias("_file_name"))


def table_name_from_file(file_name) -> "F.Column":
    """``<STATE>_<table>_psv.psv`` -> table, ``Authority_Code_<table>_psv.psv`` ->
    table, else the stem; lower case."""
    stem = F.regexp_replace(F.col(file_name) if isinstance(file_name, str) else file_name, r"\.[^.]*$", "")
    auth = F.regexp_extract(stem, r"(?i)^Authority_Code_(.+)_psv$", 1)
    state = F.regexp_extract(stem, r"(?i)^[A-Z]{2,3}_(.+)_psv$", 1)
    return F.lower(F.when(auth != "", auth).when(state != "", state).otherwise(stem))


def match_table(spark: SparkSession, name: str, database: str | None = None) -> str:
    """Exact catalogue match, else the one table whose name contains ``name``."""
    tables = [t.name.lower() for t in spark.catalog.listTables(database)]
    n = name.lower()
    if n in tables:
        return n
    hits = [t for t in tables if n in t]
    if len(hits) == 1:
        return hits[0]
    raise ValueError(f"no unique table for {name!r}: {hits}")


# ----------------------------------------------------------------------------- S8-S11
def clean_suburb_postcodes(df: DataFrame, state: str) -> DataFrame:
    """suburb/postcode rows with the header matched case-insensitively; blank,
    non-4-digit and junk rows dropped; suburbs upper-cased; distinct pairs."""
    low = {c.lower().strip(): c for c in df.columns}
    if "suburb" not in low or "postcode" not in low:
        raise ValueError(f"suburb and postcode columns required, found {df.columns}")
    s, p = F.trim(F.col(f"`{low['suburb']}`")), F.trim(F.col(f"`{low['postcode']}`"))
    junk = F.lit(False)
    for k in SUBURB_JUNK_KEYWORDS:
        junk = junk | F.lower(s).contains(k)
    return (df.filter((s != "") & (p != "") & p.rlike(r"^[0-9]{4}$") & ~junk)
              .select(F.upper(s).alias("suburb"), p.alias("postcode"), F.lit(state).alias("state"))
              .dropDuplicates(["suburb", "postcode"]))


def new_suburb_rows(existing: DataFrame, cleaned: DataFrame) -> DataFrame:
    """Insert-if-absent on (suburb, postcode)."""
    return cleaned.join(existing.select("suburb", "postcode"), ["suburb", "postcode"], "left_anti")


def new_localities(suburbs: DataFrame, localities: DataFrame) -> DataFrame:
    """Localities from suburb rows where no (upper name, postcode) exists yet."""
    cand = suburbs.select(F.upper("suburb").alias("locality_name"), "postcode", "state").distinct()
    have = localities.select(F.upper("locality_name").alias("locality_name"), "postcode")
    return cand.join(have, ["locality_name", "postcode"], "left_anti")


def rename_and_null(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Rename source columns, blank / 'nan' text -> null."""
    out = []
    for src, dst in mapping.items():
        c = F.col(f"`{src}`")
        t = F.trim(c.cast("string"))
        out.append(F.when(t.isNull() | (t == "") | (F.lower(t) == "nan"), None).otherwise(c).alias(dst))
    return df.select(*out)


# ----------------------------------------------------------------------------- S12 / S13
_RING_TYPES = {"Polygon": "array<array<array<double>>>", "MultiPolygon": "array<array<array<array<double>>>>"}


def read_geojson_polygons(spark: SparkSession, path: str, id_field: str, source_srid: int = 4326,
                          properties: list[str] | None = None) -> DataFrame:
    """GeoJSON features (one per line) -> (id, properties..., rings) in EPSG:4326.

    Polygon and MultiPolygon both become one ring array (all parts' rings);
    EPSG:3857 input is converted with the closed-form inverse; any other reference system is
    refused.  A feature without a readable polygon stops the job with its id.
    """
    if source_srid not in (4326, 3857):
        raise ValueError(f"unsupported reference system EPSG:{source_srid}; convert to 4326 or 3857 first")
    raw = spark.read.text(path).select(F.col("value").alias("j"))
    gtype = F.get_json_object("j", "$.geometry.type")
    coords = F.get_json_object("j", "$.geometry.coordinates")
    poly = F.from_json(coords, _RING_TYPES["Polygon"])
    multi = F.flatten(F.from_json(coords, _RING_TYPES["MultiPolygon"]))
    rings = F.when(gtype == "Polygon", poly).when(gtype == "MultiPolygon", multi)

    def to_struct(p):
        if source_srid == 3857:
            lon, lat = from_3857(p[0], p[1])
            return F.struct(lon.alias("x"), lat.alias("y"))
        return F.struct(p[0].alias("x"), p[1].alias("y"))

    props = [F.get_json_object("j", f"$.properties.{p}").alias(p.lower()) for p in (properties or [])]
    fid = F.get_json_object("j", f"$.properties.{id_field}")
    bad = F.raise_error(F.concat(F.lit("no readable polygon in feature "), F.coalesce(fid, F.lit("without id"))))
    usable = rings.isNotNull() & F.forall(rings, lambda r: r.isNotNull() & F.forall(r, lambda p: F.size(p) >= 2))
    return raw.filter(F.trim("j") != "").select(
        fid.alias(id_field.lower()), *props,
        F.when(F.coalesce(usable, F.lit(False)), F.transform(rings, lambda r: F.transform(r, to_struct))).otherwise(bad).alias("rings"))


# ----------------------------------------------------------------------------- S14-S17
def write_reports(results: dict[str, DataFrame], out_dir: str, fmt: str = "parquet") -> None:
    """One output dataset per report sheet."""
    for name, df in results.items():
        w = df.write.mode("overwrite")
        (w.option("header", True).csv(f"{out_dir}/{name}") if fmt == "csv" else w.format(fmt).save(f"{out_dir}/{name}"))


def export_suburbs_csv(suburbs: DataFrame, out_dir: str, state: str | None = None) -> None:
    """Suburbs (optionally of one state) ordered by state, locality, postcode."""
    df = suburbs if state is None else suburbs.filter(F.col("state_name") == state)
    df.orderBy("state_name", "locality_name", "postcode").write.mode("overwrite").option("header", True).csv(out_dir)


def geojson_features(df: DataFrame, geometry_json: str, props: list[str]) -> DataFrame:
    """One GeoJSON Feature text per row (write with ``.write.text``); a whole
    FeatureCollection is never assembled in one place."""
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"),
                                        F.parse_json(F.col(geometry_json)).alias("geometry"),
                                        F.struct(*props).alias("properties"))).alias("value"))


def write_materialized(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Build / refresh a derived table: an idempotent overwrite, optionally partitioned."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
