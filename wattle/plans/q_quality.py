"""Registered data-quality queries."""

from __future__ import annotations

from wattle.operators import quality as Q
from wattle.plans import contract_tables as CT
from wattle.plans import domain as D
from wattle.plans.oracle import sql
from wattle.plans.registry import register
from wattle.sources import contracts as C
from wattle.sources.tables import Tables


@register("q1_primary_keys", sql("""SELECT 'address' AS table_name, 'address_detail_pid' AS pk, (SELECT count(*) FROM address) AS row_count,
 (SELECT count(*) FROM (SELECT address_detail_pid FROM address GROUP BY 1 HAVING count(*) > 1) x) AS duplicate_keys,
 (SELECT count(*) FROM address WHERE address_detail_pid IS NULL) AS null_keys
UNION ALL SELECT 'street_locality', 'street_locality_pid', (SELECT count(*) FROM street_locality),
 (SELECT count(*) FROM (SELECT street_locality_pid FROM street_locality GROUP BY 1 HAVING count(*) > 1) x),
 (SELECT count(*) FROM street_locality WHERE street_locality_pid IS NULL)
UNION ALL SELECT 'suburb_postcode', 'locality_name,postcode', (SELECT count(*) FROM suburb_postcode),
 (SELECT count(*) FROM (SELECT locality_name, postcode FROM suburb_postcode GROUP BY 1, 2 HAVING count(*) > 1) x),
 (SELECT count(*) FROM suburb_postcode WHERE locality_name IS NULL OR postcode IS NULL)""", "address", "street_locality", "suburb_postcode"))
def q1_primary_keys(spark, d):
    t = Tables(spark, d)
    return Q.primary_key_report({"address": (D.address(t), ["address_detail_pid"]),
                                 "street_locality": (D.street_locality(t), ["street_locality_pid"]),
                                 "suburb_postcode": (D.suburb_postcode(t), ["locality_name", "postcode"])})


@register("q2_orphans", sql("""SELECT 'address.street_locality_pid' AS fk_name, count(*) AS orphan_rows FROM address a
 WHERE a.street_locality_pid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM street_locality s WHERE s.street_locality_pid = a.street_locality_pid)
UNION ALL SELECT 'address.locality_pid', count(*) FROM address a
 WHERE a.locality_pid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM locality l WHERE l.locality_pid = a.locality_pid)
UNION ALL SELECT 'street_locality.locality_pid', count(*) FROM street_locality a
 WHERE a.locality_pid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM locality l WHERE l.locality_pid = a.locality_pid)
UNION ALL SELECT 'locality.state_pid', count(*) FROM locality a
 WHERE a.state_pid IS NOT NULL AND NOT EXISTS (SELECT 1 FROM state s WHERE s.state_pid = a.state_pid)""",
                            "address", "street_locality", "locality", "state"))
def q2_orphans(spark, d):
    t = Tables(spark, d)
    a, s, l, st = D.address(t), D.street_locality(t), D.locality(t), D.state(t)
    return Q.orphan_report([("address.street_locality_pid", a, "street_locality_pid", s, "street_locality_pid"),
                            ("address.locality_pid", a, "locality_pid", l, "locality_pid"),
                            ("street_locality.locality_pid", s, "locality_pid", l, "locality_pid"),
                            ("locality.state_pid", l, "state_pid", st, "state_pid")])


@register("q3_postcode_format", sql("""SELECT (SELECT count(*) FROM address WHERE postcode IS NOT NULL AND NOT regexp_full_match(postcode, '[0-9]{4}')) AS bad_postcodes,
 (SELECT count(*) FROM address WHERE postcode IS NULL) AS null_postcodes, (SELECT count(*) FROM address WHERE locality_pid IS NULL) AS null_suburbs,
 (SELECT count(*) FROM (SELECT locality_pid, postcode FROM address GROUP BY 1, 2 HAVING count(*) > 1) x) AS duplicate_pairs""", "address"))
def q3_postcode_format(spark, d):
    return Q.postcode_format_report(D.address(Tables(spark, d)), "postcode", "locality_pid")


@register("q4_column_population", sql("""SELECT column_name, populated, total FROM (
 SELECT 'engagement' AS column_name, count(engagement) AS populated, count(*) AS total FROM bob
 UNION ALL SELECT 'nui_etd', count(nui_etd), count(*) FROM bob
 UNION ALL SELECT 'engagement_manager', count(engagement_manager), count(*) FROM bob
 UNION ALL SELECT 'engagement_status', count(engagement_status), count(*) FROM bob) x""", "bob"))
def q4_column_population(spark, d):
    return Q.column_population(D.bob(Tables(spark, d)))


# ----------------------------------------------------------------------------- all 35 tables
def _loaded_sql(table: str) -> str:
    kinds = {f.name: C.plain_type(f) for f in C.contracts()[table].fields}
    cells = ", ".join(f"{c} AS {c}" if kinds[c] == "string" else f"TRY_CAST({c} AS {kinds[c]}) AS {c}" for c in kinds)
    return f"SELECT {cells} FROM ({CT.raw_sql(table)}) r"


def _loaded(t: Tables) -> dict:
    return {name: C.typed(CT.raw(t, name), name) for name in C.contracts()}


def _keys_sql(name: str) -> str:
    key = C.key_of(name)
    return f"""SELECT '{name}' AS table_name, '{key}' AS pk, (SELECT count(*) FROM {name}_c) AS row_count,
 (SELECT count(*) FROM (SELECT {key} FROM {name}_c WHERE {key} IS NOT NULL GROUP BY 1 HAVING count(*) > 1) x) AS duplicate_keys,
 (SELECT count(*) FROM {name}_c WHERE {key} IS NULL) AS null_keys"""


def _references_sql(child: str, column: str, parent: str) -> str:
    return f"""SELECT '{child}.{column}' AS fk_name, '{parent}' AS parent, count(*) AS orphan_rows, count(DISTINCT c.{column}) AS orphan_values FROM {child}_c c
 WHERE c.{column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {parent}_c p WHERE p.{C.key_of(parent)} = c.{column})"""


def _cells_sql(name: str) -> str:
    parts = []
    for f in C.contracts()[name].fields:
        kind, length = C.plain_type(f), getattr(f.dataType, "length", None)
        parts.append(f"""SELECT '{name}' AS table_name, '{f.name}' AS column_name, count(*) AS row_count,
 {0 if f.nullable else f'count(*) FILTER (WHERE {f.name} IS NULL)'}::bigint AS empty_required,
 {0 if length else f'count(*) FILTER (WHERE {f.name} IS NOT NULL AND TRY_CAST({f.name} AS {kind}) IS NULL)'}::bigint AS unreadable,
 {f'count(*) FILTER (WHERE length({f.name}) > {length})' if length else 0}::bigint AS too_long FROM {name}_r""")
    return "\nUNION ALL ".join(parts)


_TYPED = {f"{name}_c": _loaded_sql(name) for name in C.contracts()}


@register("q1_contract_keys", sql("\nUNION ALL ".join(map(_keys_sql, C.contracts())), extra=_TYPED))
def q1_contract_keys(spark, d):
    return C.key_report(_loaded(Tables(spark, d)))


@register("q2_contract_references", sql("\nUNION ALL ".join(_references_sql(c, col, p) for c, cols in C.REFERENCES.items() for col, p in cols.items()), extra=_TYPED))
def q2_contract_references(spark, d):
    return C.reference_report(_loaded(Tables(spark, d)))


@register("q5_contract_cells", sql("\nUNION ALL ".join(map(_cells_sql, C.contracts())), extra={f"{name}_r": CT.raw_sql(name) for name in C.contracts()}))
def q5_contract_cells(spark, d):
    t = Tables(spark, d)
    return C.all_cells({name: CT.raw(t, name) for name in C.contracts()})
