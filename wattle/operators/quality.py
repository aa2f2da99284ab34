"""Data-quality checks and table maintenance (Q1-Q6, M3).

Each check is one aggregate per table (combined map-side) and the per-table
results are unioned - no check collects a table to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.sources import snapshots
from wattle.sources.scratch import written
from pyspark.sql.types import StructType


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def primary_key_report(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """Q1: per table: rows, keys occurring more than once, rows with a null key part.

    One aggregate per table: the per-key counts (combined map-side) carry
    everything the three numbers need.
    """
    parts = []
    for name, (df, pk) in tables.items():
        any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in pk])
        per_key = df.groupBy(*pk).agg(F.count(F.lit(1)).alias("_n"), F.max(any_null).alias("_null"))
        parts.append(per_key.agg(F.sum("_n").cast("long").alias("row_count"),
                                 F.count_if(F.col("_n") > 1).alias("duplicate_keys"),
                                 F.coalesce(F.sum(F.when(F.col("_null"), F.col("_n"))), F.lit(0)).cast("long").alias("null_keys"))
                     .select(F.lit(name).alias("table_name"), F.lit(",".join(pk)).alias("pk"),
                             "row_count", "duplicate_keys", "null_keys"))
    return _union(parts)


def orphan_report(fks: list[tuple[str, DataFrame, str, DataFrame, str]]) -> DataFrame:
    """Q2: per foreign key (name, child, child column, parent, parent column): child rows
    whose non-null key has no parent (a left-anti join, then a count)."""
    parts = []
    for name, child, ccol, parent, pcol in fks:
        c = child.select(F.col(ccol).alias("_k")).filter(F.col("_k").isNotNull())
        p = parent.select(F.col(pcol).alias("_k"))
        parts.append(c.join(p, "_k", "left_anti").agg(F.count(F.lit(1)).alias("orphan_rows"))
                      .select(F.lit(name).alias("fk_name"), "orphan_rows"))
    return _union(parts)


def postcode_format_report(df: DataFrame, postcode: str = "postcode", suburb: str = "locality_name") -> DataFrame:
    """Q3: postcodes not matching ``^[0-9]{4}$``, null postcodes/suburbs, and
    (suburb, postcode) pairs occurring more than once - one aggregate over the
    per-pair counts."""
    bad = F.col(postcode).isNotNull() & ~F.col(postcode).rlike(r"^[0-9]{4}$")
    per = df.groupBy(suburb, postcode).agg(F.count(F.lit(1)).alias("_n"), F.count_if(bad).alias("_bad"))
    return per.agg(F.sum("_bad").cast("long").alias("bad_postcodes"),
                   F.coalesce(F.sum(F.when(F.col(postcode).isNull(), F.col("_n"))), F.lit(0)).cast("long").alias("null_postcodes"),
                   F.coalesce(F.sum(F.when(F.col(suburb).isNull(), F.col("_n"))), F.lit(0)).cast("long").alias("null_suburbs"),
                   F.count_if(F.col("_n") > 1).alias("duplicate_pairs"))


def column_population(df: DataFrame) -> DataFrame:
    """Q4: per column: non-null count and total rows (one aggregate, then unpivot)."""
    aggs = [F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(df.columns)]
    one = df.agg(F.count(F.lit(1)).alias("total"), *aggs)
    st = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("populated"))
                            for i, c in enumerate(df.columns)]))
    return one.select("total", st).select("column_name", "populated", "total")


def schema_differences(df: DataFrame, contract: StructType | dict[str, str]) -> list[str]:
    """Q5: names of contract columns missing from ``df`` or of another type (driver-side schema check)."""
    want = {f.name: f.dataType.simpleString() for f in contract.fields} if isinstance(contract, StructType) else dict(contract)
    have = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    out = [f"missing:{c}" for c in want if c not in have]
    out += [f"type:{c}:{have[c]}!={t}" for c, t in want.items() if c in have and have[c] != t]
    return out


def check_column_count(df: DataFrame, target: DataFrame) -> None:
    """Q6: refuse a load whose column count differs from the target table's."""
    if len(df.columns) != len(target.columns):
        raise ValueError(f"column count mismatch: file has {len(df.columns)}, table has {len(target.columns)}")


def insert_if_absent(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """M3: rows of ``new`` whose key is not in ``existing`` (append these); of rows that
    share a key the first by ``order`` (without it, by all their columns)."""
    return _one_per_key(new, keys, order or [c for c in new.columns if c not in keys], F.min_by).join(existing.select(*keys), keys, "left_anti")


def upsert_keep_last(existing: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The table after an upsert on ``key``: new rows replace existing ones, and the last
    one by ``order`` wins (columns that the load carries, such as file and line; ones that
    ``existing`` does not have are left out of the result)."""
    last = _one_per_key(new, [key], order, F.max_by).select(*existing.columns)
    return existing.join(last.select(key), key, "left_anti").unionByName(last)


#: Buckets of a stored table that is merged into by key.
MERGE_BUCKETS = 64


def _bucketed(df: DataFrame, key: str) -> DataFrame:
    return df.withColumn("part", F.pmod(F.hash(F.col(key)), F.lit(MERGE_BUCKETS)).cast("string"))


def store(df: DataFrame, folder: str, table: str, key: str) -> int:
    """Write ``df`` as the stored table's next version, in buckets of its key."""
    spark = df.sparkSession
    version = snapshots.current(spark, folder) + 1
    snapshots.commit(spark, folder, version, {table: dict.fromkeys(snapshots.write(_bucketed(df, key), folder, table, version), version)})
    return version


def stored(spark, folder: str, table: str, schema: str, version: int | None = None) -> DataFrame:
    return snapshots.read(spark, folder, table, schema, version).drop("part")


def merge(new: DataFrame, folder: str, table: str, schema: str, key: str, order: list[str], keep_existing: bool = False) -> int:
    """M3/S11 on a stored table: upsert ``new`` by ``key``, the last row by ``order`` winning, or with
    ``keep_existing`` insert only keys that the table lacks, the first row winning; returns the version shown.

    Only the buckets that hold a key of ``new`` are read and written again; the others are listed again as they are.  Readers see
    the old version until the new one is whole.
    """
    spark = new.sparkSession
    old = snapshots.current(spark, folder)
    held = snapshots.parts(spark, folder, table, old)
    new = written(_bucketed(new, key), "merge-rows")
    touched = [r["part"] for r in new.select("part").distinct().collect()]  # MERGE_BUCKETS at most
    if not touched:
        return old
    existing = snapshots.read(spark, folder, table, schema, old, touched)
    columns = existing.columns
    if keep_existing:
        rows = existing.unionByName(insert_if_absent(existing, new, [key], order).select(*columns))
    else:
        rows = upsert_keep_last(existing, new, key, order)
    made = snapshots.write(rows.select(*columns), folder, table, old + 1)
    snapshots.commit(spark, folder, old + 1, {table: {k: v for k, v in held.items() if k not in touched} | dict.fromkeys(made, old + 1)})
    return old + 1


def _one_per_key(df: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    """One row of each key, picked by an ordinary aggregate (combined map-side)."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(pick(row, F.struct(*order) if order else F.lit(0)).alias("_row")).select("_row.*")
