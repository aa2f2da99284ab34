"""Hand-made edge rows for the ledger traps (FIXTURES.md section 4)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from wattle.functions.ledger_cols import employee_level, parse_billings
from wattle.operators import ledger as L

SCHEMA = ("engagement_id string, engagement_name string, opportunity_id string, accounting_date timestamp, "
          "transaction_date timestamp, hours decimal(12,2), nsr decimal(12,2), ansr decimal(12,2), "
          "margin_cost decimal(12,2), expense decimal(12,2)")


def _row(eid, name, acc=None, txn=None, ansr="100.00", nsr="100.00", mc="60.00", exp="10.00", hours="1.00", opp="O-1"):
    return (eid, name, opp, acc, txn, Decimal(hours), Decimal(nsr), Decimal(ansr), Decimal(mc), Decimal(exp))


def test_fiscal_window_edges(spark):
    d = dt.datetime
    rows = [
        _row("E-1", "in end midnight", acc=d(2024, 6, 30)),
        _row("E-2", "out end 00:01", acc=d(2024, 6, 30, 0, 1)),
        _row("E-3", "null acc, txn in", txn=d(2024, 1, 5)),
        _row("E-4", "acc out, txn in", acc=d(2025, 1, 1), txn=d(2024, 1, 5)),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.engagement_id for r in L.fiscal_window(df, "2023-07-01", "2024-06-30").collect()}
    assert got == {"E-1", "E-3"}


def test_null_key_dropped_from_summary_but_in_totals(spark):
    df = spark.createDataFrame([_row("E-1", "A"), _row("E-2", None)], SCHEMA)
    s = L.engagement_summary(df).collect()
    assert [r.engagement_id for r in s] == ["E-1"]
    tot = L.kpi_totals(df).first()
    assert tot.ansr_total == 200.0


def test_month_nat_and_global_date_choice(spark):
    d = dt.datetime
    df = spark.createDataFrame([_row("E-1", "A", acc=d(2024, 2, 3), txn=d(2024, 1, 1)),
                                _row("E-2", "B", acc=None, txn=d(2024, 1, 9))], SCHEMA)
    got = {r.month for r in L.monthly_summary(df).collect()}
    assert got == {"2024-02", "NaT"}
    df2 = spark.createDataFrame([_row("E-2", "B", acc=None, txn=d(2024, 1, 9))], SCHEMA)
    assert {r.month for r in L.monthly_summary(df2).collect()} == {"2024-01"}


def test_zero_ansr_nsr_give_null_ratios(spark):
    df = spark.createDataFrame([_row("E-1", "A", ansr="0.00", nsr="0.00")], SCHEMA).withColumn(
        "employee_id", F.lit(1)).withColumn("rank_name", F.lit("Manager")).withColumn("grade", F.lit("0"))
    r = L.engagement_summary(df).first()
    assert r.margin_pct is None
    e = L.employee_summary(df).first()
    assert e.eaf is None and e.margin_pct is None and e.level == 3


@pytest.mark.parametrize("rank,grade,level", [
    ("Partner", "", 7), ("Senior Manager", "2", 5), ("Senior Manager", "1", 4), ("Senior Manager", "3", None),
    (" manager ", "", 3), ("Staff/Assistant", "0", 1), ("Executive Director", None, 6), (None, None, None),
])
def test_employee_level(spark, rank, grade, level):
    r = spark.createDataFrame([(rank, grade)], "r string, g string").select(employee_level("r", "g").alias("l")).first()
    assert r.l == level


def _summary(spark, rows):
    df = spark.createDataFrame(rows, "engagement_id string, engagement_name string, engagement_partner string")
    return {r.engagement_id: r.engagement_partner for r in L.backfill_swapped_partner(df).collect()}


def test_swap_fill_sequential_semantics(spark):
    # 1 Offshore blank, 2 Onshore 'P', 3 Onshore blank: 1 and 3 get 'P' (3 through 1).
    got = _summary(spark, [("1", "X Offshore", None), ("2", "X Onshore", "P"), ("3", "X Onshore", None)])
    assert got == {"1": "P", "2": "P", "3": "P"}
    # Order 3, 1, 2 instead (the first Onshore row is blank): both stay blank.
    got = _summary(spark, [("3", "X Offshore", None), ("1", "X Onshore", None), ("2", "X Onshore", "P")])
    assert got == {"3": None, "1": None, "2": "P"}


def test_bob_duplicates_fan_out(spark):
    df = spark.createDataFrame([_row("E-1", "A")], SCHEMA)
    book = spark.createDataFrame([("E-1", Decimal("5.00"), "M", "Open"), ("E-1", Decimal("6.00"), "N", "Open")],
                                 "engagement_id string, nui_etd decimal(12,2), engagement_manager string, engagement_status string")
    assert L.engagement_summary(df, book=book).count() == 2


def test_bridge_branches_and_target_100(spark):
    tot = spark.createDataFrame([(1000.0, 1100.0, 400.0)], "ansr_total double, ter_total double, margin_amount_total double")
    above = L.kpi_bridge(tot, "2,000", 50).first()
    assert above.write_on == 900.0 and above.writeon_remaining is not None and above.writeoff_plus_additional_revenue_required is None
    assert above.revised_margin_pct == 50.0
    below = L.kpi_bridge(tot, "0.001M", 50).first()
    assert below.write_on == -100.0 and below.writeoff_plus_additional_revenue_required is not None
    with pytest.raises(ValueError):
        L.kpi_bridge(tot, "1M", 100)


@pytest.mark.parametrize("text,value", [("20.11M", 20_110_000.0), ("1,234.5", 1234.5), (" 17m ", 17_000_000.0)])
def test_parse_billings(spark, text, value):
    r = spark.range(1).select(parse_billings(F.lit(text)).alias("v")).first()
    assert abs(r.v - value) < 1e-6


def test_recon_blocks_partition_the_union(spark):
    w = spark.createDataFrame([("E-1", "A"), ("E-2", "B")], "engagement_id string, engagement_name string")
    b = spark.createDataFrame([("E-2",), ("E-3",)], "engagement_id string")
    rows = L.reconciliation(w, b).collect()
    detail = {r.engagement_id: r.status for r in rows if r.block > 0}
    assert detail == {"E-1": "Missing in BoB", "E-2": "Matched", "E-3": "Missing in WIP"}
    assert [r.engagement_id for r in rows if r.block == 0][:4] == ["SUMMARY", "Total in WIP: 2", "Total in BoB: 2", "Matched: 1"]
