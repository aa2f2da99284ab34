"""The contract catalogue: routing, typed loads, key, reference and cell checks on small files."""

import pytest

from wattle.plans import contract_tables as CT
from wattle.sources import contracts as C


def test_catalogue_is_whole():
    assert len(C.contracts()) == 35 and len(C.CODE_TABLES) == 16
    assert sum(len(cols) for cols in C.REFERENCES.values()) == 44
    for table, schema in C.contracts().items():
        assert not schema[C.key_of(table)].nullable
        assert len(set(schema.names)) == len(schema.names)
        # A reference has the type of the key it holds (its length may be wider).
        for column, parent in C.REFERENCES.get(table, {}).items():
            assert type(schema[column].dataType) is type(C.contracts()[parent][C.key_of(parent)].dataType), (table, column)
    assert len(C.contracts()["address_detail"].names) == 35


def test_every_table_has_fixture_columns():
    for table, schema in C.contracts().items():
        assert list(CT.columns(table)) == schema.names


def test_routes(spark):
    assert C.route(["NSW_ADDRESS_DETAIL_psv.psv", "Authority_Code_FLAT_TYPE_AUT_psv.psv", "neighbour.psv"], spark) == {
        "NSW_ADDRESS_DETAIL_psv.psv": "address_detail", "Authority_Code_FLAT_TYPE_AUT_psv.psv": "flat_type_aut", "neighbour.psv": "locality_neighbour"}
    for name in ("NSW_NOTHING_psv.psv", "alias.psv"):
        with pytest.raises(ValueError, match="no unique table"):
            C.route([name], spark)


def test_load_is_typed_and_refuses_other_columns(spark, tmp_path):
    good = tmp_path / "NSW_STATE_psv.psv"
    good.write_text("STATE_PID|DATE_CREATED|DATE_RETIRED|STATE_NAME|STATE_ABBREVIATION\nS1|2020-01-31||NEW SOUTH WALES|NSW\nS2|soon| |VICTORIA|VICT\n||||\n")
    df = C.load(spark, str(good), "state")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema.fields][:3] == [("state_pid", "string"), ("date_created", "date"), ("date_retired", "date")]
    assert [(r.state_pid, str(r.date_created), r.date_retired) for r in df.orderBy("state_pid").collect() if r.state_pid] == [("S1", "2020-01-31", None), ("S2", "None", None)]
    with pytest.raises(ValueError, match="missing columns"):
        C.load(spark, str(good), "locality")
    narrow = tmp_path / "narrow.psv"
    narrow.write_text("STATE_PID|DATE_CREATED|DATE_RETIRED|STATE_NAME\nS1|2020-01-31||X\n")
    with pytest.raises(ValueError, match="state_abbreviation"):
        C.load(spark, str(narrow), "state")


def test_cells(spark):
    df = spark.createDataFrame([("S1", "2020-01-31", None, "NSW", "NSW"), ("S2", "soon", None, None, "VICT"), (None, None, "x", "A", "B")],
                               "state_pid string, date_created string, date_retired string, state_name string, state_abbreviation string")
    got = {r.column_name: (r.row_count, r.empty_required, r.unreadable, r.too_long) for r in C.cell_report(df, "state").collect()}
    assert got == {"state_pid": (3, 1, 0, 0), "date_created": (3, 1, 1, 0), "date_retired": (3, 0, 1, 0), "state_name": (3, 1, 0, 0), "state_abbreviation": (3, 0, 0, 1)}


def _tables(spark, localities, states):
    loc = spark.createDataFrame(localities, "locality_pid string, state_pid string")
    return {"locality": loc.selectExpr("*", "cast(null as string) locality_class_code", "cast(null as decimal(1)) gnaf_reliability_code"),
            "state": spark.createDataFrame(states, "state_pid string")}


def test_keys_and_references(spark):
    tables = _tables(spark, [("L1", "S1"), ("L1", "S9"), ("L2", "S9"), (None, None), (None, "S1")], [("S1",), ("S1",), (None,)])
    keys = {r.table_name: (r.pk, r.row_count, r.duplicate_keys, r.null_keys) for r in C.key_report(tables).collect()}
    assert keys == {"locality": ("locality_pid", 5, 1, 2), "state": ("state_pid", 3, 1, 1)}
    refs = [tuple(r) for r in C.reference_report(tables).collect()]
    assert refs == [("locality.state_pid", "state", 2, 1)]


def test_empty_tables_are_listed(spark):
    tables = _tables(spark, [], [])
    assert sorted(tuple(r) for r in C.key_report(tables).collect()) == [("locality", "locality_pid", 0, 0, 0), ("state", "state_pid", 0, 0, 0)]
    assert [tuple(r) for r in C.reference_report(tables).collect()] == [("locality.state_pid", "state", 0, 0)]


def test_one_shuffle_for_all_keys(spark):
    tables = {t: spark.createDataFrame([("a",)], f"{C.key_of(t)} string") for t in list(C.contracts())[:6]}
    plan = C.key_report(tables)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [table_name") == 2
