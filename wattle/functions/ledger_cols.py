"""Scalar column expressions of the engagement ledger.

All are native Catalyst expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def coerce_date(c) -> Column:
    """Text or timestamp -> timestamp, unparseable -> null (never throws under ANSI)."""
    return F.try_to_timestamp(_c(c).cast("string"))


def coerce_number(c) -> Column:
    """Bad or missing -> 0."""
    return F.coalesce(_c(c).cast("string").try_cast("double"), F.lit(0.0))


def parse_billings(text) -> Column:
    """Trim, upper, drop commas; an ``M`` suffix multiplies by one million."""
    t = F.regexp_replace(F.upper(F.trim(_c(text))), ",", "")
    num = F.when(t.endswith("M"), t.substr(F.lit(1), F.length(t) - 1)).otherwise(t)
    val = num.try_cast("double")
    return F.when(t.endswith("M"), val * F.lit(1_000_000.0)).otherwise(val)


# Fixed value: the engagement-id pattern inside "Name (E-123) CUR" text.
ENGAGEMENT_ID_PATTERN = r"\(([A-Z]-\d+)\)"


def extract_engagement_id(c) -> Column:
    """First ``(X-digits)`` group, else null (``regexp_extract`` gives '' on no match)."""
    return F.nullif(F.regexp_extract(_c(c), ENGAGEMENT_ID_PATTERN, 1), F.lit(""))


def pick_engagement_name_column(df: DataFrame, preferred: str) -> str | None:
    """P5: the preferred column, else the first whose name contains 'engagement' and 'name'."""
    if preferred in df.columns:
        return preferred
    for c in df.columns:
        low = c.lower()
        if "engagement" in low and "name" in low:
            return c
    return None


def invoice_month(c) -> Column:
    """``yyyy-MM``."""
    return F.date_format(_c(c), "yyyy-MM")


def margin_pct(ansr, margin_amount) -> Column:
    """Margin / ANSR * 100, null when ANSR is 0."""
    a = _c(ansr).cast("double")
    return F.when(a != 0, _c(margin_amount).cast("double") / a * F.lit(100.0))


def ratio_guarded(num, den) -> Column:
    """P10: EAF = ANSR / NSR, null when NSR is 0."""
    d = _c(den).cast("double")
    return F.when(d != 0, _c(num).cast("double") / d)


def employee_level(rank, grade) -> Column:
    """Level 7..1 from rank (and grade for senior managers), else null."""
    r = F.lower(F.trim(F.coalesce(_c(rank), F.lit(""))))
    g = F.trim(F.coalesce(_c(grade), F.lit("")))
    # Rank words and the grades that split senior managers.
    return (F.when(r.isin("partner/principal", "partner"), 7)
            .when(r == "executive director", 6)
            .when((r == "senior manager") & (g == "2"), 5)
            .when((r == "senior manager") & (g == "1"), 4)
            .when(r == "manager", 3)
            .when(r == "senior", 2)
            .when(r.isin("staff", "assistant", "staff/assistant"), 1)
            .cast("int"))


def round2(c) -> Column:
    """Two decimals, half-even (pandas ``round``); result as double."""
    return F.bround(_c(c), 2).cast("double")


def keep_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    """Select the listed columns that exist, in the listed order."""
    return df.select([c for c in columns if c in df.columns])
