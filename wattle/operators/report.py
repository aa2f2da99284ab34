"""The engagement report (E1): raw ledger text to seven sheets.

``clean_ledger`` names and types the raw columns once (P1, P2, P13); every sheet is then one of
the ledger jobs on that table, with its totals row where the report has one (LG7).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattle.functions.ledger_cols import coerce_date, pick_engagement_name_column
from wattle.operators import ledger as L

# Column labels of the raw sheet and the names used here.
KEY_COLUMNS = {
    "Engagement ID": "engagement_id", "Opportunity ID": "opportunity_id",
    "Employee / Product Name": "employee_name", "Employee GUI / Product ID": "employee_id", "Rank / Method": "rank_name", "Grade": "grade",
    "Employee Region": "employee_region", "Country / Region": "country_region", "Service Line": "service_line",
}
NUMBER_COLUMNS = {
    "Charged Hours / Quantity": "hours", "NSR / Tech Revenue": "nsr", "ANSR / Tech Revenue": "ansr", "Margin Cost": "margin_cost", "Expense Amount": "expense",
}
DATE_COLUMNS = {"Accounting Date": "accounting_date", "Transaction Date": "transaction_date"}
EMPLOYEE_KEYS = ("employee_name", "employee_id", "rank_name", "grade", "employee_region", "country_region", "service_line")


def clean_ledger(raw: DataFrame) -> DataFrame:
    """The raw sheet's columns under the library's names and types.

    Numbers that are missing or no number are 0 (decimals, so that sums stay exact), dates that
    cannot be read are null; a number column that is absent is 0, any other absent column null.
    """
    have = set(raw.columns)
    text = lambda label: F.col(f"`{label}`").cast("string") if label in have else F.lit(None).cast("string")
    name = pick_engagement_name_column(raw, "Engagement Name")
    return raw.select(
        *[text(label).alias(c) for label, c in KEY_COLUMNS.items()],
        (F.col(f"`{name}`").cast("string") if name else F.lit(None).cast("string")).alias("engagement_name"),
        *[F.coalesce(F.trim(text(label)).try_cast("decimal(20,6)"), F.lit(0).cast("decimal(20,6)")).alias(c) for label, c in NUMBER_COLUMNS.items()],
        *[coerce_date(text(label)).alias(c) for label, c in DATE_COLUMNS.items()],
    )


def engagement_report(raw: DataFrame, bills: DataFrame, book: DataFrame, fy_start: str, fy_end: str,
                      billings_text: str | None = None, target_margin_pct: float | None = None, month_from: str | None = None) -> dict[str, DataFrame]:
    """The report's sheets by name; the bridge only with billings and a target margin.  Nothing runs until they are written."""
    ledger = clean_ledger(raw)
    fy = L.fiscal_window(ledger, fy_start, fy_end)
    partners = L.partner_per_engagement(L.billing_pivot(L.prepare_bills(bills), month_from))
    prepared = L.prepare_book(book)
    money = ["ansr", "margin_cost", "margin_amount", "ter", "hours"]
    totals = L.kpi_totals(fy)
    sheets = {
        "engagement_summary_fytd": L.with_totals_row(L.engagement_summary(fy, partners, prepared, order=False), "engagement_id", [*money, "nui_etd"]),
        "engagement_summary_etd": L.with_totals_row(L.engagement_summary(ledger, partners, prepared, order=False), "engagement_id", [*money, "nui_etd"]),
        "employee_summary": employee_sheet(fy),
        "monthly_summary": month_sheet(fy),
        "wip_vs_bob_recon": L.reconciliation(ledger, prepared),
        "kpi_totals": totals,
    }
    if billings_text is not None and target_margin_pct is not None:
        sheets["kpi_bridge"] = L.kpi_bridge(totals, billings_text, target_margin_pct)
    return sheets


def employee_sheet(fy: DataFrame) -> DataFrame:
    """LG2 on all seven keys, with its totals row."""
    return L.with_totals_row(L.employee_summary(fy, EMPLOYEE_KEYS, order=False), "employee_name",
                             ["hours", "nsr", "ansr", "margin_cost", "expense", "n_engagements", "n_opportunities", "ter", "margin_amount"])


def month_sheet(fy: DataFrame) -> DataFrame:
    """LG3 with its totals row."""
    return L.with_totals_row(L.monthly_summary(fy, order=False), "month", ["hours", "ansr", "margin_cost", "expense", "margin_amount", "ter"])
