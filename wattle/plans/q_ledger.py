"""Registered ledger queries (FY report entry point E1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattle.operators import ledger as L
from wattle.operators import report as R
from wattle.plans import domain as D
from wattle.plans.oracle import sql
from wattle.plans.registry import register
from wattle.sources.tables import Tables

# Report parameters used by the registered queries.
FY_START, FY_END = "1997-07-01", "1998-06-30"
INVOICE_MONTH_FROM = "1997-01"
BILLINGS_TEXT = "350.25M"
TARGET_MARGIN_PCT = 38.0

_FY = f"((accounting_date IS NOT NULL AND accounting_date >= DATE '{FY_START}' AND accounting_date <= DATE '{FY_END}') OR (accounting_date IS NULL AND transaction_date IS NOT NULL AND transaction_date >= DATE '{FY_START}' AND transaction_date <= DATE '{FY_END}'))"
_R = "cast(round_even({0}, 2) AS double)"


def _r(expr: str) -> str:
    return _R.format(expr)


def _fy(t: Tables):
    return L.fiscal_window(D.wip(t), FY_START, FY_END)


_ENG_SQL = (
    "SELECT engagement_id, engagement_name, {ansr} AS ansr, {mc} AS margin_cost, {ma} AS margin_amount, {ter} AS ter, "
    "round_even(CASE WHEN cast(ansr AS double) <> 0 THEN cast(ansr - margin_cost AS double) / cast(ansr AS double) * 100e0 END, 2) AS margin_pct, "
    "{hours} AS hours FROM (SELECT engagement_id, engagement_name, sum(ansr) AS ansr, sum(margin_cost) AS margin_cost, "
    "sum(expense) AS expense, sum(hours) AS hours FROM {src} WHERE engagement_id IS NOT NULL AND engagement_name IS NOT NULL "
    "GROUP BY engagement_id, engagement_name) g"
).format(ansr=_r("ansr"), mc=_r("margin_cost"), ma=_r("ansr - margin_cost"), ter=_r("ansr + expense"),
         hours=_r("hours"), src="{src}")


@register("lg1_engagement_fytd", sql(_ENG_SQL.format(src=f"(SELECT * FROM wip WHERE {_FY})"), "wip"))
def lg1_engagement_fytd(spark, d):
    return L.engagement_summary(_fy(Tables(spark, d)))


@register("lg1_engagement_etd", sql(_ENG_SQL.format(src="wip"), "wip"))
def lg1_engagement_etd(spark, d):
    return L.engagement_summary(D.wip(Tables(spark, d)))


_EMP_SQL = sql(f"""SELECT employee_id, rank_name, grade, {_r('hours')} AS hours, {_r('nsr')} AS nsr, {_r('ansr')} AS ansr,
 {_r('margin_cost')} AS margin_cost, {_r('expense')} AS expense, n_engagements, n_opportunities, {_r('ansr + expense')} AS ter,
 {_r('ansr - margin_cost')} AS margin_amount,
 round_even(CASE WHEN cast(ansr AS double) <> 0 THEN cast(ansr - margin_cost AS double) / cast(ansr AS double) * 100e0 END, 2) AS margin_pct,
 round_even(CASE WHEN cast(nsr AS double) <> 0 THEN cast(ansr AS double) / cast(nsr AS double) END, 2) AS eaf,
 CASE WHEN lower(trim(rank_name)) IN ('partner/principal','partner') THEN 7 WHEN lower(trim(rank_name)) = 'executive director' THEN 6
  WHEN lower(trim(rank_name)) = 'senior manager' AND trim(grade) = '2' THEN 5 WHEN lower(trim(rank_name)) = 'senior manager' AND trim(grade) = '1' THEN 4
  WHEN lower(trim(rank_name)) = 'manager' THEN 3 WHEN lower(trim(rank_name)) = 'senior' THEN 2
  WHEN lower(trim(rank_name)) IN ('staff','assistant','staff/assistant') THEN 1 END AS level
FROM (SELECT employee_id, rank_name, grade, sum(hours) AS hours, sum(nsr) AS nsr, sum(ansr) AS ansr, sum(margin_cost) AS margin_cost,
 sum(expense) AS expense, count(DISTINCT engagement_id) AS n_engagements, count(DISTINCT opportunity_id) AS n_opportunities
 FROM wip WHERE {_FY} GROUP BY employee_id, rank_name, grade) g""", "wip")


@register("lg2_employee_summary", _EMP_SQL)
def lg2_employee_summary(spark, d):
    return L.employee_summary(_fy(Tables(spark, d)))


_MONTH_SQL = sql(f"""SELECT month, {_r('hours')} AS hours, {_r('ansr')} AS ansr, {_r('margin_cost')} AS margin_cost, {_r('expense')} AS expense,
 {_r('ansr - margin_cost')} AS margin_amount, {_r('ansr + expense')} AS ter,
 round_even(CASE WHEN cast(ansr AS double) <> 0 THEN cast(ansr - margin_cost AS double) / cast(ansr AS double) * 100e0 END, 2) AS margin_pct
FROM (SELECT coalesce(strftime(CASE WHEN (SELECT count(accounting_date) FROM fy) > 0 THEN accounting_date ELSE transaction_date END, '%Y-%m'), 'NaT') AS month,
 sum(hours) AS hours, sum(ansr) AS ansr, sum(margin_cost) AS margin_cost, sum(expense) AS expense FROM fy GROUP BY 1) g""",
                 "wip", extra={"fy": f"SELECT * FROM wip WHERE {_FY}"})


@register("lg3_monthly_summary", _MONTH_SQL)
def lg3_monthly_summary(spark, d):
    return L.monthly_summary(_fy(Tables(spark, d)))


_KPI_BODY = f"""SELECT {_r('h')} AS hours_total, {_r('a')} AS ansr_total, {_r('e')} AS expense_total, {_r('a + e')} AS ter_total,
 {_r('m')} AS margin_cost_total, {_r('a - m')} AS margin_amount_total,
 round_even(CASE WHEN cast(a AS double) <> 0 THEN cast(a - m AS double) / cast(a AS double) * 100e0 END, 2) AS margin_pct_overall
FROM (SELECT sum(hours) AS h, sum(ansr) AS a, sum(expense) AS e, sum(margin_cost) AS m FROM wip WHERE {_FY}) g"""


@register("lg4_kpi_totals", sql(_KPI_BODY, "wip"))
def lg4_kpi_totals(spark, d):
    return L.kpi_totals(_fy(Tables(spark, d)))


def _bridge_sql() -> str:
    b = f"""(CASE WHEN upper(trim('{BILLINGS_TEXT}')) LIKE '%M' THEN cast(rtrim(replace(upper(trim('{BILLINGS_TEXT}')), ',', ''), 'M') AS double) * 1000000e0
        ELSE cast(replace(upper(trim('{BILLINGS_TEXT}')), ',', '') AS double) END)"""
    t = f"({TARGET_MARGIN_PCT}e0 / 100e0)"
    return sql(f"""SELECT round(billings, 2) AS billings, round(write_on, 2) AS write_on,
 round(margin_amount_total + add_rev, 2) AS revised_margin_amount, round(ansr_total + add_rev, 2) AS revised_revenue,
 round(CASE WHEN ansr_total + add_rev <> 0 THEN (margin_amount_total + add_rev) / (ansr_total + add_rev) * 100e0 END, 2) AS revised_margin_pct,
 round(add_rev, 2) AS additional_revenue_needed,
 round(CASE WHEN ansr_total + add_rev <> 0 THEN add_rev / (ansr_total + add_rev) * 100e0 END, 2) AS gap_pct_of_revised_revenue,
 round(CASE WHEN write_on > 0 THEN write_on - add_rev END, 2) AS writeon_remaining,
 round(CASE WHEN write_on <= 0 THEN abs(write_on) + add_rev END, 2) AS writeoff_plus_additional_revenue_required
FROM (SELECT {b} AS billings, {b} - ter_total AS write_on, ({t} * ansr_total - margin_amount_total) / (1e0 - {t}) AS add_rev,
 ansr_total, margin_amount_total FROM kpi) x""", "wip", extra={"kpi": _KPI_BODY})


@register("lg5_kpi_bridge", _bridge_sql())
def lg5_kpi_bridge(spark, d):
    return L.kpi_bridge(L.kpi_totals(_fy(Tables(spark, d))), BILLINGS_TEXT, TARGET_MARGIN_PCT)


_PREP_BILLS = r"""SELECT *, coalesce(try_cast(total_incl_tax AS decimal(26,10)), 0) - coalesce(try_cast(tax AS decimal(26,10)), 0) AS billing_amount, strftime(invoice_date, '%Y-%m') AS invoice_month,
 nullif(regexp_extract(lead_engagement, '\(([A-Z]-\d+)\)', 1), '') AS engagement_id FROM bills"""
_PIVOT_BODY = f"""SELECT engagement_id, billing_partner, {_r('sum(total_incl_tax)')} AS total_incl_tax, {_r('sum(tax)')} AS tax,
 {_r('sum(billing_amount)')} AS billing_amount FROM pbills WHERE engagement_id IS NOT NULL AND billing_partner IS NOT NULL
 AND invoice_month >= '{INVOICE_MONTH_FROM}' GROUP BY engagement_id, billing_partner"""


def _pivot(t: Tables):
    return L.billing_pivot(L.prepare_bills(D.bills(t)), INVOICE_MONTH_FROM)


@register("lg6_billing_pivot", sql(_PIVOT_BODY, "bills", extra={"pbills": _PREP_BILLS}))
def lg6_billing_pivot(spark, d):
    return _pivot(Tables(spark, d))


@register("lg6_billing_total", sql(f"""SELECT cast(sum(cast(billing_amount AS decimal(38,2))) AS double) AS billing_total,
 printf('%.2f', cast(sum(cast(billing_amount AS decimal(38,2))) / 1000000 AS double)) || 'M' AS billings_text FROM bpivot""",
                                   "bills", extra={"pbills": _PREP_BILLS, "bpivot": _PIVOT_BODY}))
def lg6_billing_total(spark, d):
    return L.billing_total(_pivot(Tables(spark, d)))


_D1_BODY = """SELECT engagement_id, arg_min(billing_partner, struct_pack(neg := -billing_amount, p := billing_partner)) AS engagement_partner
FROM bpivot WHERE billing_partner IS NOT NULL GROUP BY engagement_id"""


@register("d1_partner_per_engagement", sql(_D1_BODY, "bills", extra={"pbills": _PREP_BILLS, "bpivot": _PIVOT_BODY}))
def d1_partner_per_engagement(spark, d):
    return L.partner_per_engagement(_pivot(Tables(spark, d)))


_PREP_BOB = r"""SELECT *, nullif(regexp_extract(engagement, '\(([A-Z]-\d+)\)', 1), '') AS engagement_id FROM bob"""


def _enriched_sql() -> str:
    eng = _ENG_SQL.replace("FROM (SELECT engagement_id", "FROM (SELECT engagement_id").format(
        src=f"(SELECT * FROM wip WHERE {_FY})")
    body = f"""SELECT e.engagement_id, e.engagement_name, e.ansr, e.margin_cost, e.margin_amount, e.ter, e.margin_pct, e.hours,
  CASE WHEN p.engagement_partner IS NOT NULL THEN p.engagement_partner
       WHEN f.p IS NOT NULL THEN f.p
       WHEN f.id IS NOT NULL AND (f.id < e.engagement_id OR (f.id = e.engagement_id AND f.engagement_name < e.engagement_name))
            AND e.engagement_name <> '' THEN s.p END AS engagement_partner,
  b.engagement_manager, b.engagement_status, {_r('b.nui_etd')} AS nui_etd
FROM eng e LEFT JOIN d1 p ON e.engagement_id = p.engagement_id
LEFT JOIN firsts f ON f.engagement_name = CASE WHEN e.engagement_name LIKE '%Offshore%' THEN replace(e.engagement_name, 'Offshore', 'Onshore')
                                               WHEN e.engagement_name LIKE '%Onshore%' THEN replace(e.engagement_name, 'Onshore', 'Offshore') END
LEFT JOIN firsts s ON s.engagement_name = CASE WHEN e.engagement_name LIKE '%Offshore%' THEN replace(replace(e.engagement_name, 'Offshore', 'Onshore'), 'Onshore', 'Offshore')
                                               WHEN e.engagement_name LIKE '%Onshore%' THEN replace(replace(e.engagement_name, 'Onshore', 'Offshore'), 'Offshore', 'Onshore') END
LEFT JOIN pbob b ON e.engagement_id = b.engagement_id"""
    firsts = """SELECT engagement_name, min(engagement_id) AS id, arg_min(engagement_partner, engagement_id) AS p FROM
 (SELECT e.engagement_id, e.engagement_name, p.engagement_partner FROM eng e LEFT JOIN d1 p ON e.engagement_id = p.engagement_id) x
 GROUP BY engagement_name"""
    return sql(body, "wip", "bills", "bob", extra={"pbills": _PREP_BILLS, "bpivot": _PIVOT_BODY, "d1": _D1_BODY,
                                                   "pbob": _PREP_BOB, "eng": eng, "firsts": firsts})


@register("j3_engagement_enriched", _enriched_sql())
def j3_engagement_enriched(spark, d):
    t = Tables(spark, d)
    partners = L.partner_per_engagement(_pivot(t))
    return L.engagement_summary(_fy(t), partners=partners, book=L.prepare_book(D.bob(t)))


_TOT_SQL = sql(f"""SELECT engagement_id, engagement_name, ansr, margin_cost, margin_amount, ter, margin_pct, hours FROM eng
UNION ALL SELECT 'TOTAL', NULL, round(sum(ansr), 2), round(sum(margin_cost), 2), round(sum(margin_amount), 2), round(sum(ter), 2), NULL,
 round(sum(hours), 2) FROM eng""", "wip", extra={"eng": _ENG_SQL.format(src=f"(SELECT * FROM wip WHERE {_FY})")})


@register("lg7_engagement_with_totals", _TOT_SQL)
def lg7_engagement_with_totals(spark, d):
    s = L.engagement_summary(_fy(Tables(spark, d)), order=False)
    return L.with_totals_row(s, "engagement_id", ["ansr", "margin_cost", "margin_amount", "ter", "hours"])


_RECON_SQL = sql("""SELECT block, seq, engagement_id, engagement_name, in_wip, in_bob, status FROM (
SELECT CASE WHEN w.id IS NOT NULL AND b.id IS NOT NULL THEN 1 WHEN w.id IS NOT NULL THEN 2 ELSE 3 END AS block, 0 AS seq,
 coalesce(w.id, b.id) AS engagement_id, CASE WHEN w.id IS NOT NULL THEN coalesce(w.name, '') ELSE '' END AS engagement_name,
 CASE WHEN w.id IS NOT NULL THEN 'Yes' ELSE 'No' END AS in_wip, CASE WHEN b.id IS NOT NULL THEN 'Yes' ELSE 'No' END AS in_bob,
 CASE WHEN w.id IS NOT NULL AND b.id IS NOT NULL THEN 'Matched' WHEN w.id IS NOT NULL THEN 'Missing in BoB' ELSE 'Missing in WIP' END AS status
FROM (SELECT engagement_id AS id, min(engagement_name) AS name FROM wip WHERE engagement_id IS NOT NULL GROUP BY 1) w
FULL OUTER JOIN (SELECT DISTINCT engagement_id AS id FROM pbob WHERE engagement_id IS NOT NULL) b ON w.id = b.id) d
UNION ALL SELECT 0, seq, txt, '', '', '', '' FROM (
 SELECT 0 AS seq, 'SUMMARY' AS txt UNION ALL SELECT 1, 'Total in WIP: ' || cast(count(DISTINCT engagement_id) AS varchar) FROM wip
 UNION ALL SELECT 2, 'Total in BoB: ' || cast(count(DISTINCT engagement_id) AS varchar) FROM pbob
 UNION ALL SELECT 3, 'Matched: ' || cast(count(*) AS varchar) FROM (SELECT DISTINCT engagement_id FROM wip WHERE engagement_id IN (SELECT engagement_id FROM pbob)) x
 UNION ALL SELECT 4, 'Only in WIP: ' || cast(count(*) AS varchar) FROM (SELECT DISTINCT engagement_id FROM wip WHERE engagement_id IS NOT NULL AND engagement_id NOT IN (SELECT engagement_id FROM pbob WHERE engagement_id IS NOT NULL)) x
 UNION ALL SELECT 5, 'Only in BoB: ' || cast(count(*) AS varchar) FROM (SELECT DISTINCT engagement_id FROM pbob WHERE engagement_id IS NOT NULL AND engagement_id NOT IN (SELECT engagement_id FROM wip WHERE engagement_id IS NOT NULL)) x
 UNION ALL SELECT 6, '') s""", "wip", "bob", extra={"pbob": _PREP_BOB})


@register("j5_wip_bob_reconciliation", _RECON_SQL)
def j5_wip_bob_reconciliation(spark, d):
    t = Tables(spark, d)
    return L.reconciliation(D.wip(t), L.prepare_book(D.bob(t)))


@register("o5_top25_engagements", sql(_ENG_SQL.format(src=f"(SELECT * FROM wip WHERE {_FY})") + " ORDER BY ter DESC, engagement_id LIMIT 25", "wip"))
def o5_top25_engagements(spark, d):
    """The 25 engagements with the highest TER (the printed summary)."""
    s = L.engagement_summary(_fy(Tables(spark, d)), order=False)
    return s.orderBy(F.desc("ter"), "engagement_id").limit(25)


# ----------------------------------------------------------------------------- E1: raw text to sheets
@register("e1_clean_ledger", sql(f"""SELECT strftime(accounting_date, '%Y-%m') AS acc_month, country_region, count(*) AS n, {_r('sum(hours)')} AS hours, {_r('sum(nsr)')} AS nsr,
 {_r('sum(ansr)')} AS ansr, {_r('sum(margin_cost)')} AS margin_cost, {_r('sum(expense)')} AS expense, count(transaction_date) AS n_transaction_dates
FROM clean_ledger GROUP BY 1, 2""", "clean_ledger"))
def e1_clean_ledger(spark, d):
    """What the cleaned raw sheet holds, per accounting month and country."""
    c = R.clean_ledger(D.raw_ledger(Tables(spark, d)))
    sums = [L.round2(F.sum(x)).alias(x) for x in ("hours", "nsr", "ansr", "margin_cost", "expense")]
    return c.groupBy(F.date_format("accounting_date", "yyyy-MM").alias("acc_month"), "country_region").agg(
        F.count(F.lit(1)).alias("n"), *sums, F.count("transaction_date").alias("n_transaction_dates"))


_E1_FY = f"SELECT * FROM clean_ledger WHERE {_FY}"
_SEVEN = ", ".join(R.EMPLOYEE_KEYS)


def _employee_sheet_sql() -> str:
    level = _EMP_SQL[_EMP_SQL.index(" CASE WHEN lower(trim(rank_name))"):_EMP_SQL.index(" AS level")]
    body = f"""SELECT {_SEVEN}, {_r('hours')} AS hours, {_r('nsr')} AS nsr, {_r('ansr')} AS ansr, {_r('margin_cost')} AS margin_cost, {_r('expense')} AS expense,
 n_engagements, n_opportunities, {_r('ansr + expense')} AS ter, {_r('ansr - margin_cost')} AS margin_amount,
 round_even(CASE WHEN cast(ansr AS double) <> 0 THEN cast(ansr - margin_cost AS double) / cast(ansr AS double) * 100e0 END, 2) AS margin_pct,
 round_even(CASE WHEN cast(nsr AS double) <> 0 THEN cast(ansr AS double) / cast(nsr AS double) END, 2) AS eaf, {level} AS level
FROM (SELECT {_SEVEN}, sum(hours) AS hours, sum(nsr) AS nsr, sum(ansr) AS ansr, sum(margin_cost) AS margin_cost, sum(expense) AS expense,
 count(DISTINCT engagement_id) AS n_engagements, count(DISTINCT opportunity_id) AS n_opportunities FROM fy WHERE {' AND '.join(f'{k} IS NOT NULL' for k in R.EMPLOYEE_KEYS)} GROUP BY {_SEVEN}) g"""
    sums = ", ".join(f"round(sum({c}), 2)" for c in ("hours", "nsr", "ansr", "margin_cost", "expense")) + ", cast(sum(n_engagements) AS bigint), cast(sum(n_opportunities) AS bigint), round(sum(ter), 2), round(sum(margin_amount), 2)"
    return sql(f"SELECT * FROM emp UNION ALL SELECT 'TOTAL', NULL, NULL, NULL, NULL, NULL, NULL, {sums}, NULL, NULL, NULL FROM emp", "clean_ledger", extra={"fy": _E1_FY, "emp": body})


@register("e1_employee_sheet", _employee_sheet_sql())
def e1_employee_sheet(spark, d):
    """LG2 and LG7 on the cleaned sheet, all seven keys."""
    return R.employee_sheet(L.fiscal_window(R.clean_ledger(D.raw_ledger(Tables(spark, d))), FY_START, FY_END))


_MONTH_BODY = _MONTH_SQL[_MONTH_SQL.rindex("SELECT month, "):]


@register("e1_month_sheet", sql("SELECT * FROM months UNION ALL SELECT 'TOTAL', round(sum(hours), 2), round(sum(ansr), 2), round(sum(margin_cost), 2), round(sum(expense), 2), round(sum(margin_amount), 2), round(sum(ter), 2), NULL FROM months",
                                "clean_ledger", extra={"fy": _E1_FY, "months": _MONTH_BODY}))
def e1_month_sheet(spark, d):
    """LG3 and LG7 on the cleaned sheet."""
    return R.month_sheet(L.fiscal_window(R.clean_ledger(D.raw_ledger(Tables(spark, d))), FY_START, FY_END))


# A book with a partner column and, for every eighth engagement, a second row.
_BOOK_WITH_PARTNERS = r"""SELECT engagement_id, nui_etd, engagement_manager, CASE WHEN n % 3 <> 0 THEN 'Book partner ' || cast(n % 7 AS varchar) END AS engagement_partner_bob FROM
 (SELECT *, cast(substr(engagement_id, 3) AS bigint) AS n FROM pbob) b
UNION ALL SELECT engagement_id, nui_etd + 1, 'Second', 'Book partner X' FROM (SELECT *, cast(substr(engagement_id, 3) AS bigint) AS n FROM pbob) b WHERE n % 8 = 0"""


@register("j4_book_partners", sql(f"""SELECT e.engagement_id, e.engagement_name, e.ansr, b.engagement_partner_bob AS engagement_partner, b.engagement_manager, {_r('b.nui_etd')} AS nui_etd
FROM eng e LEFT JOIN book b ON b.engagement_id = e.engagement_id""", "wip", "bob", extra={
    "pbob": _PREP_BOB, "book": _BOOK_WITH_PARTNERS, "eng": _ENG_SQL.format(src=f"(SELECT * FROM wip WHERE {_FY})")}))
def j4_book_partners(spark, d):
    """J2 + J4: without a partner table the book's partner column makes the summary's; a second book row repeats the engagement."""
    t = Tables(spark, d)
    b = L.prepare_book(D.bob(t))
    n = F.substring("engagement_id", 3, 20).cast("bigint")
    named = b.withColumn("engagement_partner_bob", F.when(n % 3 != 0, F.concat(F.lit("Book partner "), (n % 7).cast("string"))))
    second = b.filter(n % 8 == 0).withColumn("nui_etd", (F.col("nui_etd") + 1).cast(b.schema["nui_etd"].dataType)).withColumn("engagement_manager", F.lit("Second")).withColumn("engagement_partner_bob", F.lit("Book partner X"))
    out = L.engagement_summary(_fy(t), book=named.unionByName(second))
    return out.select("engagement_id", "engagement_name", "ansr", "engagement_partner", "engagement_manager", "nui_etd")


@register("j4_partner_fill", sql("""SELECT e.engagement_id, e.engagement_name, e.engagement_manager, coalesce(e.engagement_partner, b.p) AS engagement_partner
FROM enriched e LEFT JOIN (SELECT engagement_id, CASE WHEN cast(substr(engagement_id, 3) AS bigint) % 3 <> 0 THEN 'Book partner' END AS p FROM pbob2) b ON b.engagement_id = e.engagement_id""", "bob", extra={
    "pbob2": _PREP_BOB, "enriched": _enriched_sql()}))
def j4_partner_fill(spark, d):
    """Partners that the billings and the swapped names leave blank come from the book."""
    t = Tables(spark, d)
    b = L.prepare_book(D.bob(t))
    n = F.substring("engagement_id", 3, 20).cast("bigint")
    out = L.engagement_summary(_fy(t), partners=L.partner_per_engagement(_pivot(t)), book=b.withColumn("engagement_partner_bob", F.when(n % 3 != 0, F.lit("Book partner"))))
    return out.select("engagement_id", "engagement_name", "engagement_manager", "engagement_partner")
