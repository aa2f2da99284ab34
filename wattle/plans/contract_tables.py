"""The 35 contract tables as a load finds them (all text, some cells faulty), derived from the driver's tables.

A table's rows are those of one driver table; each column is one expression that Spark and DuckDB both read, so
the fixture is the same on both sides while the checks are not.  Key faults: every 1009th is missing and every
503rd repeats its neighbour's; references run past the parents' keys; some dates and numbers cannot be read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import CharType, DateType, VarcharType

from wattle.sources.contracts import CODE_TABLES, REFERENCES, contracts, key_of
from wattle.sources.tables import Tables


def base(table: str) -> tuple[str, str]:
    """Driver table whose rows are the contract table's, and its key."""
    if table in CODE_TABLES:
        return "nation", "n_nationkey"
    if table == "state":
        return "region", "r_regionkey"
    if table.startswith("locality"):
        return "supplier", "s_suppkey"
    if table.startswith(("street", "address_site")):
        return "customer", "c_custkey"
    if table.startswith("mb"):
        return "part", "p_partkey"
    return "orders", "o_orderkey"


def _value(table: str, number: str) -> str:
    """Text of a table's key by number: codes of number type as such, others behind a letter."""
    field = contracts()[table][key_of(table)]
    text = f"cast({number} AS varchar(20))"
    return f"concat('K', {text})" if isinstance(field.dataType, (VarcharType, CharType)) else text


def _reference(child: str, parent: str, k: str) -> str:
    """Number of the parent that row ``k`` names: past the last one for some rows."""
    rows = base(parent)[0]
    if rows in ("nation", "region"):
        return f"{k} % {26 if rows == 'nation' else 6}"
    if rows == base(child)[0]:
        return f"({k} - {k} % 3)"
    size = {"supplier": 150, "customer": 10, "part": 8}.get(rows, 1)
    return f"cast(({k} - {k} % {size}) / {size} AS bigint)"


def columns(table: str) -> dict[str, str]:
    """Column -> expression over the driver table."""
    k = base(table)[1]
    out = {}
    for j, f in enumerate(contracts()[table].fields):
        parent = REFERENCES.get(table, {}).get(f.name)
        if f.name == key_of(table):
            e = f"CASE WHEN {k} % 1009 = 7 THEN NULL WHEN {k} % 503 = 5 THEN {_value(table, f'({k} - 1)')} ELSE {_value(table, k)} END"
        elif parent:
            e = _value(parent, _reference(table, parent, k))
        elif isinstance(f.dataType, DateType):
            e = f"CASE WHEN {k} % 97 = 0 THEN 'n/a' WHEN {k} % 101 = 3 THEN NULL ELSE concat('20', cast(10 + {k} % 15 AS varchar(2)), '-01-31') END"
        elif isinstance(f.dataType, (VarcharType, CharType)):
            e = f"concat('T', cast({k} % {10 ** (j % 5)} AS varchar(20)))"
        else:
            e = f"cast({k} % 1000 AS varchar(20))" if f.dataType.scale == 0 else f"concat(cast({k} % 180 AS varchar(20)), '.5')"
        if f.nullable:
            e = f"CASE WHEN {k} % 7 <> {j % 7} THEN {e} END"
        out[f.name] = e
    return out


def raw(t: Tables, table: str) -> DataFrame:
    return getattr(t, base(table)[0]).selectExpr(*[f"{e} AS {c}" for c, e in columns(table).items()])


def raw_sql(table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in columns(table).items()) + f" FROM {base(table)[0]}"
