"""Versioned tables in parts: written beside what readers see, shown by one small file, changed part by part.

A folder holds ``<table>/snapshot=<version>/part=<part>/`` and ``manifest/``, an append-only table with a row for each part of each
version: (version, table, part, made), where ``made`` is the version whose folder holds the part.  A version exists once its
rows are in the manifest, which one task writes as one file; until then readers see the version before, and after
that the new one, never a mixture.  Parts that did not change are listed again and not written again.

One writer at a time; a writer that dies leaves folders that no version lists, and the next one writes under a fresh number.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_MANIFEST = "version bigint, table string, part string, made bigint"
#: Spark's bound on the tasks that list folders, and how many of them a core gets here.
_LISTING, LISTING_TASKS = "spark.sql.sources.parallelPartitionDiscovery.parallelism", 4


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def current(spark: SparkSession, folder: str) -> int:
    """The newest version, 0 if there is none."""
    if not _exists(spark, f"{folder}/manifest"):
        return 0
    return _manifest(spark, folder).agg(F.max("version")).first()[0] or 0


def parts(spark: SparkSession, folder: str, table: str, version: int) -> dict[str, int]:
    """part -> version that holds it; a few thousand parts, so the driver lists them."""
    if not version:
        return {}
    rows = _manifest(spark, folder).filter((F.col("version") == version) & (F.col("table") == table))
    return {r["part"]: r["made"] for r in rows.select("part", "made").collect()}


def read(spark: SparkSession, folder: str, table: str, schema: str, version: int | None = None, only: Collection[str] | None = None) -> DataFrame:
    """A table of a version (the newest if none is given), with its ``part`` column; ``only`` reads those parts alone."""
    version = current(spark, folder) if version is None else version
    held, only = parts(spark, folder, table, version), None if only is None else {*only}
    return opened(spark, folder, table, schema, {part: made for part, made in held.items() if only is None or part in only})


def opened(spark: SparkSession, folder: str, table: str, schema: str, held: dict[str, int]) -> DataFrame:
    """The given parts (part -> version that holds it) of a table, with its ``part`` column.  They are listed by a few tasks a
    core: Spark's own choice is a task for each folder, and there are thousands."""
    paths = [f"{folder}/{table}/snapshot={made}/part={part}" for part, made in held.items()]
    if not paths:
        return spark.createDataFrame([], f"{schema}, part string")
    most = spark.conf.get(_LISTING)
    spark.conf.set(_LISTING, str(min(int(most), LISTING_TASKS * spark.sparkContext.defaultParallelism)))
    try:
        rows = spark.read.option("basePath", f"{folder}/{table}").schema(f"{schema}, snapshot bigint, part string").parquet(*paths)
    finally:
        spark.conf.set(_LISTING, most)
    return rows.drop("snapshot")


def write(df: DataFrame, folder: str, table: str, version: int) -> list[str]:
    """Write the parts of ``df`` (column ``part``) under ``version``; returns the parts that have rows.  Large parts are spread over
    tasks and small ones share them (rebalancing by part).  The parts written are the folder's names: reading them back
    would list every part's files.  Names of parts must need no escaping in a path."""
    path = f"{folder}/{table}/snapshot={version}"
    df.hint("rebalance", F.col("part")).write.mode("overwrite").partitionBy("part").parquet(path)
    spark = df.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    names = [made.getPath().getName() for made in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)]
    return [name.removeprefix("part=") for name in names if name.startswith("part=")]


def commit(spark: SparkSession, folder: str, version: int, tables: dict[str, dict[str, int]]) -> None:
    """Show ``version``: for each table its parts and the versions that hold them."""
    rows = [(version, table, part, made) for table, held in tables.items() for part, made in held.items()]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("append").parquet(f"{folder}/manifest")


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete the folders that the newest version does not list; returns how many.  For use when no reader holds an older version."""
    version = current(spark, folder)
    rows = _manifest(spark, folder).filter(F.col("version") == version)
    listed = {(r["table"], f"snapshot={r['made']}", f"part={r['part']}") for r in rows.collect()}
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for table in files.listStatus(root):
        if not table.isDirectory() or table.getPath().getName() == "manifest":
            continue
        for made in files.listStatus(table.getPath()):
            for part in files.listStatus(made.getPath()) if made.isDirectory() else ():
                if part.isDirectory() and (table.getPath().getName(), made.getPath().getName(), part.getPath().getName()) not in listed:
                    files.delete(part.getPath(), True)
                    gone += 1
    return gone
