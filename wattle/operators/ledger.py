"""Engagement-ledger jobs: fiscal filter, summaries, KPI bridge, billing pivot,
partner back-filling and ledger-to-book reconciliation (F1-F2, LG1-LG8, D1, J1-J5).

Scale notes
-----------
* Every summary is one ``groupBy`` with partial (map-side) aggregation, so a
  hot engagement or employee is pre-aggregated per task before the shuffle.
* "Keep the best row per key" (D1) is a ``min(struct(...))`` aggregate rather
  than a ``row_number`` window: a key holding a third of the rows is still
  combined map-side instead of being sorted inside one task.
* Money stays DECIMAL until the final ``bround`` so that sums do not depend on
  summation order (and therefore not on partitioning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattle.functions.ledger_cols import (
    employee_level, extract_engagement_id, invoice_month, margin_pct, parse_billings,
    ratio_guarded, round2,
)

ENGAGEMENT_KEYS = ["engagement_id", "engagement_name"]


# ----------------------------------------------------------------------------- F1 / F2
def fiscal_window(df: DataFrame, start: str, end: str,
                  acc: str = "accounting_date", txn: str = "transaction_date") -> DataFrame:
    """Accounting Date in [start, end]; Transaction Date only where Accounting is null.

    ``end`` is midnight of the last day (a later time that day is out), and an
    out-of-range Accounting Date never falls back to the Transaction Date.  The
    predicate is written as an OR of plain range tests so Parquet can use
    min/max statistics of both columns.
    """
    s = F.lit(start).cast("timestamp")
    e = F.lit(end).cast("timestamp")
    a, t = F.col(acc).cast("timestamp"), F.col(txn).cast("timestamp")
    return df.filter((a.isNotNull() & (a >= s) & (a <= e)) |
                     (a.isNull() & t.isNotNull() & (t >= s) & (t <= e)))


# ----------------------------------------------------------------------------- LG1
def _engagement_measures(df: DataFrame) -> DataFrame:
    keys = [F.col(k) for k in ENGAGEMENT_KEYS]
    # pandas drops groups whose key is null; Spark would keep them.
    return (df.filter(keys[0].isNotNull() & keys[1].isNotNull())
              .groupBy(*ENGAGEMENT_KEYS)
              .agg(F.sum("ansr").alias("ansr"), F.sum("margin_cost").alias("margin_cost"),
                   F.sum("expense").alias("expense"), F.sum("hours").alias("hours")))


def _finish_engagement(g: DataFrame, extra: list[str]) -> DataFrame:
    ter = F.col("ansr") + F.col("expense")
    ma = F.col("ansr") - F.col("margin_cost")
    out = g.select(
        *ENGAGEMENT_KEYS,
        round2("ansr").alias("ansr"), round2("margin_cost").alias("margin_cost"),
        round2(ma).alias("margin_amount"), round2(ter).alias("ter"),
        round2(margin_pct("ansr", ma)).alias("margin_pct"), round2("hours").alias("hours"),
        *[round2(c).alias(c) if c == "nui_etd" else F.col(c) for c in extra],
    )
    return out


def engagement_summary(df: DataFrame, partners: DataFrame | None = None,
                       book: DataFrame | None = None, order: bool = True) -> DataFrame:
    """LG1: per (engagement id, name): ANSR, margin cost, margin, TER, margin %, hours.

    ``partners`` (engagement_id, engagement_partner) is left-joined (J1) and blank
    partners are back-filled from the swapped Onshore/Offshore name (J3);
    ``book`` (prepared BoB rows) is left-joined without de-duplication (J2, so
    duplicates fan out) and its partner fills remaining blanks (J4).
    """
    g = _engagement_measures(df)
    extra: list[str] = []
    if partners is not None:
        g = g.join(partners.select("engagement_id", "engagement_partner"), "engagement_id", "left")
        g = backfill_swapped_partner(g)
        extra.append("engagement_partner")
    if book is not None:
        cols = [c for c in ("nui_etd", "engagement_manager", "engagement_status", "engagement_partner_bob")
                if c in book.columns]
        g = g.join(book.select("engagement_id", *cols), "engagement_id", "left")
        if "engagement_partner_bob" in cols:
            if "engagement_partner" in g.columns:
                g = g.withColumn("engagement_partner",
                                 F.coalesce("engagement_partner", "engagement_partner_bob"))
            else:
                g = g.withColumn("engagement_partner", F.col("engagement_partner_bob"))
                extra.append("engagement_partner")
        extra += [c for c in ("engagement_manager", "engagement_status", "nui_etd") if c in cols]
    out = _finish_engagement(g, extra)
    return out.orderBy(F.desc("ter")) if order else out


def swapped_name(name: Column) -> Column:
    """'Offshore' -> 'Onshore' (checked first), else 'Onshore' -> 'Offshore', else null."""
    # The two words the reference swaps.
    return (F.when(name.contains("Offshore"), F.replace(name, F.lit("Offshore"), F.lit("Onshore")))
             .when(name.contains("Onshore"), F.replace(name, F.lit("Onshore"), F.lit("Offshore"))))


def backfill_swapped_partner(g: DataFrame, partner: str = "engagement_partner") -> DataFrame:
    """Blank partner copied from the first row (by id, name) with the swapped name.

    The reference walks the rows in key order and a fill made earlier is seen
    later.  Closed form (F = first row with the swapped name, S = first row with
    the name swapped twice, partners as loaded): F.partner if set; otherwise, when F
    comes before this row, S.partner, with which F was filled; otherwise blank.  F could
    not be filled from anything else, since S, if it came earlier, met F still blank.  Two
    joins against a per-name "first row" aggregate replace the sequential loop.  For a name
    with one of the two words, swapping twice gives the name back; for a name with
    both it gives the all-Offshore form.
    """
    name = F.col("engagement_name")
    first = (g.groupBy("engagement_name")
               .agg(F.min(F.struct(F.col("engagement_id").alias("id"), F.col(partner).alias("p"))).alias("f")))
    f_side = first.select(F.col("engagement_name").alias("_swap"), F.col("f.id").alias("_f_id"),
                          F.col("f.p").alias("_f_p"))
    s_side = first.select(F.col("engagement_name").alias("_twice"), F.col("f.p").alias("_s_p"))
    j = (g.withColumn("_swap", swapped_name(name)).withColumn("_twice", swapped_name(F.col("_swap")))
          .join(f_side, "_swap", "left")
          .join(s_side, "_twice", "left"))
    f_before = (F.col("_f_id") < F.col("engagement_id")) | \
               ((F.col("_f_id") == F.col("engagement_id")) & (F.col("_swap") < name))
    filled = F.when(F.col(partner).isNotNull(), F.col(partner)) \
              .when(F.col("_f_p").isNotNull(), F.col("_f_p")) \
              .when(F.col("_f_id").isNotNull() & f_before & (name != ""), F.col("_s_p"))
    return j.withColumn(partner, filled).drop("_swap", "_twice", "_f_id", "_f_p", "_s_p")


# ----------------------------------------------------------------------------- LG2
def employee_summary(df: DataFrame,
                     keys: tuple[str, ...] = ("employee_id", "rank_name", "grade"),
                     rank: str = "rank_name", grade: str = "grade", order: bool = True) -> DataFrame:
    """LG2: per employee: hours, NSR, ANSR, margin cost, expense, distinct engagements
    and opportunities, TER, margin, margin %, EAF and level; sorted level desc
    (nulls last), TER desc.  Groups with a null key are dropped (pandas).

    The lines are first summed per (keys, engagement, opportunity), so the two distinct counts
    triple that small table and not the ledger."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    sums = [F.sum(c).alias(c) for c in ("hours", "nsr", "ansr", "margin_cost", "expense")]
    per = df.filter(cond).groupBy(*keys, "engagement_id", "opportunity_id").agg(*sums)
    g = (per.groupBy(*keys)
           .agg(*sums,
                F.count_distinct("engagement_id").alias("n_engagements"),
                F.count_distinct("opportunity_id").alias("n_opportunities")))
    ter = F.col("ansr") + F.col("expense")
    ma = F.col("ansr") - F.col("margin_cost")
    out = g.select(
        *keys, round2("hours").alias("hours"), round2("nsr").alias("nsr"), round2("ansr").alias("ansr"),
        round2("margin_cost").alias("margin_cost"), round2("expense").alias("expense"),
        "n_engagements", "n_opportunities", round2(ter).alias("ter"), round2(ma).alias("margin_amount"),
        round2(margin_pct("ansr", ma)).alias("margin_pct"), round2(ratio_guarded("ansr", "nsr")).alias("eaf"),
        employee_level(rank, grade).alias("level"))
    return out.orderBy(F.desc_nulls_last("level"), F.desc("ter")) if order else out


# ----------------------------------------------------------------------------- LG3
def monthly_summary(df: DataFrame, acc: str = "accounting_date", txn: str = "transaction_date",
                    order: bool = True) -> DataFrame:
    """LG3: per month of the FY rows.

    The month column is chosen once for the whole input: Accounting Date if any
    row has one, else Transaction Date; a null date forms the group 'NaT'.  One
    shuffle pre-aggregates on the (accounting month, transaction month) pair -
    a set bounded by months squared - and the choice is made on that small table.
    """
    am = F.coalesce(F.date_format(acc, "yyyy-MM"), F.lit("NaT"))
    tm = F.coalesce(F.date_format(txn, "yyyy-MM"), F.lit("NaT"))
    pairs = (df.groupBy(am.alias("_am"), tm.alias("_tm"))
               .agg(F.sum("hours").alias("hours"), F.sum("ansr").alias("ansr"),
                    F.sum("margin_cost").alias("margin_cost"), F.sum("expense").alias("expense"),
                    F.count(acc).alias("_n_acc")))
    use_acc = F.sum("_n_acc").over(Window.partitionBy()) > 0
    g = (pairs.withColumn("month", F.when(use_acc, F.col("_am")).otherwise(F.col("_tm")))
              .groupBy("month")
              .agg(F.sum("hours").alias("hours"), F.sum("ansr").alias("ansr"),
                   F.sum("margin_cost").alias("margin_cost"), F.sum("expense").alias("expense")))
    ma = F.col("ansr") - F.col("margin_cost")
    out = g.select("month", round2("hours").alias("hours"), round2("ansr").alias("ansr"),
                   round2("margin_cost").alias("margin_cost"), round2("expense").alias("expense"),
                   round2(ma).alias("margin_amount"), round2(F.col("ansr") + F.col("expense")).alias("ter"),
                   round2(margin_pct("ansr", ma)).alias("margin_pct"))
    return out.orderBy("month") if order else out


# ----------------------------------------------------------------------------- LG4 / LG5
def kpi_totals(df: DataFrame) -> DataFrame:
    """LG4: one row of rounded totals (a global aggregate, combined map-side)."""
    g = df.agg(F.sum("hours").alias("h"), F.sum("ansr").alias("a"), F.sum("expense").alias("e"),
               F.sum("margin_cost").alias("m"))
    return g.select(
        round2("h").alias("hours_total"), round2("a").alias("ansr_total"), round2("e").alias("expense_total"),
        round2(F.col("a") + F.col("e")).alias("ter_total"), round2("m").alias("margin_cost_total"),
        round2(F.col("a") - F.col("m")).alias("margin_amount_total"),
        round2(margin_pct("a", F.col("a") - F.col("m"))).alias("margin_pct_overall"))


def kpi_bridge(totals: DataFrame, billings_text: str, target_margin_pct: float,
               form: str = "code") -> DataFrame:
    """LG5: billing bridge on the *rounded* KPI totals.

    ``form='code'`` follows the reference program (revised values use the
    additional revenue needed); ``form='spec'`` uses the write-on as its
    written specification does.  A 100 % target divides by zero and is refused.
    """
    if target_margin_pct is None or float(target_margin_pct) == 100.0:
        raise ValueError("target margin of 100% has no bridge (division by zero)")
    t = F.lit(float(target_margin_pct)) / F.lit(100.0)
    billings = parse_billings(F.lit(billings_text))
    ansr, ter, ma = F.col("ansr_total"), F.col("ter_total"), F.col("margin_amount_total")
    b = totals.select(billings.alias("billings"), (billings - ter).alias("write_on"),
                      ((t * ansr - ma) / (F.lit(1.0) - t)).alias("add_rev"), ansr, ma)
    lift = F.col("add_rev") if form == "code" else F.col("write_on")
    rev_ma = F.col("margin_amount_total") + lift
    rev_rev = F.col("ansr_total") + lift
    wo, add = F.col("write_on"), F.col("add_rev")
    return b.select(
        F.round("billings", 2).alias("billings"), F.round(wo, 2).alias("write_on"),
        F.round(rev_ma, 2).alias("revised_margin_amount"), F.round(rev_rev, 2).alias("revised_revenue"),
        F.round(F.when(rev_rev != 0, rev_ma / rev_rev * F.lit(100.0)), 2).alias("revised_margin_pct"),
        F.round(add, 2).alias("additional_revenue_needed"),
        F.round(F.when(rev_rev != 0, add / rev_rev * F.lit(100.0)), 2).alias("gap_pct_of_revised_revenue"),
        F.round(F.when(wo > 0, wo - add), 2).alias("writeon_remaining"),
        F.round(F.when(wo <= 0, F.abs(wo) + add), 2).alias("writeoff_plus_additional_revenue_required"),
    )


# ----------------------------------------------------------------------------- LG6 / D1
def prepare_bills(df: DataFrame, text_col: str = "lead_engagement") -> DataFrame:
    """Engagement id from the name text, billing amount, invoice month.

    An amount that is missing or no number counts as 0, and none is rounded before the sums.
    """
    amount = lambda c: F.coalesce(F.col(c).try_cast("decimal(26,10)"), F.lit(0).cast("decimal(26,10)"))
    return df.select(
        "*",
        (amount("total_incl_tax") - amount("tax")).alias("billing_amount"),
        invoice_month("invoice_date").alias("invoice_month"),
        extract_engagement_id(text_col).alias("engagement_id"),
    )


def billing_pivot(prepared: DataFrame, month_from: str | None = None) -> DataFrame:
    """LG6: per (engagement id, billing partner): total incl. tax, tax, billing amount,
    rounded; rows with a null id or partner do not form groups.  ``F2``: an
    optional ``invoice_month >= month_from`` text filter (null months drop out)."""
    df = prepared.filter(F.col("engagement_id").isNotNull() & F.col("billing_partner").isNotNull())
    if month_from:
        df = df.filter(F.col("invoice_month") >= F.lit(month_from))
    g = (df.groupBy("engagement_id", "billing_partner")
           .agg(F.sum("total_incl_tax").alias("t"), F.sum("tax").alias("x"), F.sum("billing_amount").alias("b")))
    return g.select("engagement_id", "billing_partner", round2("t").alias("total_incl_tax"),
                    round2("x").alias("tax"), round2("b").alias("billing_amount"))


def billing_total(pivot: DataFrame) -> DataFrame:
    """Exact billing total and its ``x.xxM`` text (the hint the reference prints)."""
    tot = pivot.agg(F.sum(F.col("billing_amount").cast("decimal(38,2)")).alias("s"))
    return tot.select(F.col("s").cast("double").alias("billing_total"),
                      F.concat(F.format_string("%.2f", (F.col("s") / F.lit(1_000_000)).cast("double")),
                               F.lit("M")).alias("billings_text"))


def partner_per_engagement(pivot: DataFrame) -> DataFrame:
    """Partner with the highest billing amount per engagement, non-null only.

    Ties go to the alphabetically first partner (the reference's sort is not
    stable).  ``min(struct(-amount, partner))`` is an ordinary aggregate, so it
    is combined map-side even for an engagement with a huge number of rows.
    """
    best = (pivot.filter(F.col("billing_partner").isNotNull())
                 .groupBy("engagement_id")
                 .agg(F.min(F.struct((-F.col("billing_amount")).alias("neg"),
                                     F.col("billing_partner").alias("p"))).alias("b")))
    return best.select("engagement_id", F.col("b.p").alias("engagement_partner"))


def prepare_book(df: DataFrame, text_col: str = "engagement") -> DataFrame:
    """BoB rows with their engagement id."""
    return df.withColumn("engagement_id", extract_engagement_id(text_col))


# ----------------------------------------------------------------------------- LG7
def with_totals_row(df: DataFrame, label_col: str, numeric_cols: list[str],
                    label: str = "TOTAL") -> DataFrame:
    """LG7: append a TOTAL row summing the (already rounded) numeric columns.

    One pass over ``df``: grouping sets (every row by itself, told by a row id, so that
    equal rows stay apart) and () give the rows themselves plus the grand total in a single
    aggregate, instead of a union that would evaluate ``df`` - and the ledger behind it - twice.
    """
    keys = [c for c in df.columns if c not in numeric_cols]
    g = (df.withColumn("_row", F.monotonically_increasing_id())
           .groupingSets([[F.col("_row"), *(F.col(c) for c in keys)], []], "_row", *keys)
           .agg(*[F.sum(c).alias(c) for c in numeric_cols], F.grouping_id().alias("_gid")))
    total = F.col("_gid") != 0
    return g.select(*[F.when(total, F.lit(label)).otherwise(F.col(c)).alias(c) if c == label_col else F.col(c)
                      for c in keys],
                    *[F.when(total, F.round(c, 2)).otherwise(F.col(c)).alias(c) for c in numeric_cols]) \
            .select(*df.columns)


# ----------------------------------------------------------------------------- J5 / LG8
def reconciliation(ledger: DataFrame, book: DataFrame, order: list[str] | None = None) -> DataFrame:
    """J5 + LG8: WIP vs BoB engagement ids.

    Distinct ids of both sides meet in one full outer join; each id is Matched,
    Missing in BoB or Missing in WIP; the WIP name is that of the first row by the ``order``
    columns (say path and row number), or, where the caller has none, the alphabetically
    first one, since a distributed read has no row order of its own.  Counter
    rows (block 0) come first, then the three blocks each sorted by id.
    """
    named = ledger.filter(F.col("engagement_id").isNotNull())
    if order:
        pick = F.min_by("engagement_name", F.struct(*order))
    else:
        # Distinct (id, name) pairs first: a hash aggregate combined map-side, so the
        # string ``min`` (a sort-based aggregate) only sees the small distinct set.
        named, pick = named.select("engagement_id", "engagement_name").distinct(), F.min("engagement_name")
    w = named.groupBy("engagement_id").agg(pick.alias("engagement_name")).withColumn("_w", F.lit(True))
    b = (book.filter(F.col("engagement_id").isNotNull()).select("engagement_id").distinct()
             .withColumn("_b", F.lit(True)))
    j = w.join(b, "engagement_id", "full_outer")
    in_w, in_b = F.col("_w").isNotNull(), F.col("_b").isNotNull()
    detail = j.select(
        F.when(in_w & in_b, 1).when(in_w, 2).otherwise(3).alias("block"),
        "engagement_id",
        F.when(in_w, F.coalesce("engagement_name", F.lit(""))).otherwise(F.lit("")).alias("engagement_name"),
        F.when(in_w, "Yes").otherwise("No").alias("in_wip"),
        F.when(in_b, "Yes").otherwise("No").alias("in_bob"),
        F.when(in_w & in_b, "Matched").when(in_w, "Missing in BoB").otherwise("Missing in WIP").alias("status"),
    )
    # One pass over the detail: grouping sets give every detail row and the grand
    # total (the counters) from one aggregate; the total row then unfolds into
    # the seven counter rows.  A union of detail and counters would evaluate the
    # ledger side twice.
    cols = ["block", "engagement_id", "engagement_name", "in_wip", "in_bob", "status"]
    g = (detail.groupingSets([[F.col(c) for c in cols], []], *cols)
               .agg(F.count_if(F.col("in_wip") == "Yes").alias("w"), F.count_if(F.col("in_bob") == "Yes").alias("b"),
                    F.count_if(F.col("block") == 1).alias("m"), F.count_if(F.col("block") == 2).alias("ow"),
                    F.count_if(F.col("block") == 3).alias("ob"), F.grouping_id().alias("_gid")))
    texts = [F.lit("SUMMARY"),
             F.concat(F.lit("Total in WIP: "), F.col("w").cast("string")),
             F.concat(F.lit("Total in BoB: "), F.col("b").cast("string")),
             F.concat(F.lit("Matched: "), F.col("m").cast("string")),
             F.concat(F.lit("Only in WIP: "), F.col("ow").cast("string")),
             F.concat(F.lit("Only in BoB: "), F.col("ob").cast("string")),
             F.lit("")]

    def row(block, seq, eid, name, iw, ib, st):
        return F.struct(block.alias("block"), seq.alias("seq"), eid.alias("engagement_id"), name.alias("engagement_name"),
                        iw.alias("in_wip"), ib.alias("in_bob"), st.alias("status"))
    empty = F.lit("")
    counters = F.array(*[row(F.lit(0), F.lit(i), txt, empty, empty, empty, empty) for i, txt in enumerate(texts)])
    own = F.array(row(F.col("block"), F.lit(0), F.col("engagement_id"), F.col("engagement_name"), F.col("in_wip"),
                      F.col("in_bob"), F.col("status")))
    return (g.select(F.inline(F.when(F.col("_gid") != 0, counters).otherwise(own)))
             .orderBy("block", "seq", "engagement_id"))
