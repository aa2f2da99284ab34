"""Domain tables of the two applications, derived from the driver's tables.

The reference ships no data.  FIXTURES.md section 3 fixes how its ledger,
billing, book-of-business, address, catchment, school and usage tables are
derived from the TPC-H-like driver tables; this module builds exactly those
tables with the DataFrame API (lazily - nothing is computed here).  The SQL twin
of every derivation lives in ``wattle.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattle.sources.tables import Tables


def _s(c) -> Column:
    return (c if isinstance(c, Column) else F.col(c)).cast("string")


def _lattice(i: Column) -> tuple[Column, Column]:
    """South-west corner of the i-th place: 400 columns of 0.05 degrees, then the next row north.
    Places grow in number with the data and do not stack up."""
    row = ((i - i % 400) / 400).cast("bigint")
    return F.lit(151.0) + (i % 400) * 5 / F.lit(100.0), F.lit(-34.0) + row * 5 / F.lit(100.0)


def _dec(c, p, s) -> Column:
    return F.col(c).cast(f"decimal({p},{s})") if isinstance(c, str) else c.cast(f"decimal({p},{s})")


# ----------------------------------------------------------------------------- ledger
def wip(t: Tables) -> DataFrame:
    """WIP time-and-cost ledger: one posting per lineitem."""
    l = t.lineitem.select("l_orderkey", "l_suppkey", "l_linenumber", "l_quantity",
                          "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    j = l.join(o, l.l_orderkey == o.o_orderkey)
    cust = F.col("o_custkey")
    nsr = _dec("l_extendedprice", 12, 2)
    rank = F.col("l_suppkey") % 8
    return j.select(
        F.concat(F.lit("E-"), _s(cust)).alias("engagement_id"),
        F.concat(F.lit("Project "), ((cust - cust % 2) / 2).cast("bigint").cast("string"),
                 F.when(cust % 2 == 0, F.lit(" Onshore")).otherwise(F.lit(" Offshore"))).alias("engagement_name"),
        F.concat(F.lit("O-"), _s("o_orderkey")).alias("opportunity_id"),
        F.when(F.col("l_linenumber") == 1, F.lit(None).cast("date"))
         .otherwise(F.col("l_shipdate").cast("date")).alias("accounting_date"),
        F.col("o_orderdate").cast("date").alias("transaction_date"),
        _dec("l_quantity", 12, 2).alias("hours"),
        nsr.alias("nsr"),
        (nsr * (F.lit(1) - _dec("l_discount", 4, 2))).alias("ansr"),
        (nsr * F.lit(0.65).cast("decimal(4,2)")).alias("margin_cost"),
        (nsr * _dec("l_tax", 4, 2)).alias("expense"),
        F.col("l_suppkey").alias("employee_id"),
        F.when(rank == 0, "Partner/Principal").when(rank == 1, "Executive Director")
         .when(rank.isin(2, 3), "Senior Manager").when(rank == 4, "Manager")
         .when(rank == 5, "Senior").when(rank == 6, "Staff/Assistant")
         .otherwise("Contractor").alias("rank_name"),
        F.when(rank == 2, "2").when(rank == 3, "1").otherwise("0").alias("grade"),
    )


def raw_ledger(t: Tables) -> DataFrame:
    """The WIP ledger as the raw sheet has it: text under its own labels, with some unreadable cells."""
    w = wip(t)
    k = F.substring("opportunity_id", 3, 20).cast("bigint")
    emp = F.col("employee_id")
    text = lambda c: _s(c)
    return w.select(
        F.col("opportunity_id").alias("Opportunity ID"), F.col("engagement_id").alias("Engagement ID"), F.col("engagement_name").alias("Engagement Long Name"),
        F.when(k % 89 == 0, "TBC").otherwise(text("accounting_date")).alias("Accounting Date"), text("transaction_date").alias("Transaction Date"),
        F.when(k % 97 == 0, "n/a").otherwise(text("hours")).alias("Charged Hours / Quantity"), text("nsr").alias("NSR / Tech Revenue"),
        F.when(k % 101 == 0, " ").otherwise(text("ansr")).alias("ANSR / Tech Revenue"), text("margin_cost").alias("Margin Cost"), text("expense").alias("Expense Amount"),
        F.concat(F.lit("Emp "), _s(emp)).alias("Employee / Product Name"), _s(emp).alias("Employee GUI / Product ID"), F.col("rank_name").alias("Rank / Method"),
        F.col("grade").alias("Grade"), F.concat(F.lit("Region "), _s(emp % 3)).alias("Employee Region"),
        F.when(emp % 11 != 0, F.concat(F.lit("Country "), _s(emp % 5))).alias("Country / Region"), F.concat(F.lit("Line "), _s(emp % 4)).alias("Service Line"),
    )


def bills(t: Tables) -> DataFrame:
    """Billing export rows: one invoice per order."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    total = _dec("o_totalprice", 14, 2)
    return o.select(
        F.concat(F.lit("Client "), _s(cust),
                 F.when(key % 11 == 0, F.lit(""))
                  .otherwise(F.concat(F.lit(" (E-"), _s(cust), F.lit(") AUD")))).alias("lead_engagement"),
        F.when(cust % 4 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("Partner "), _s(key % 9))).alias("billing_partner"),
        total.alias("total_incl_tax"),
        (total * F.lit(0.10).cast("decimal(4,2)")).alias("tax"),
        F.col("o_orderdate").cast("date").alias("invoice_date"),
    )


def bob(t: Tables) -> DataFrame:
    """Book-of-business export rows."""
    c = t.customer.select("c_custkey", "c_acctbal").filter(F.col("c_custkey") % 10 != 7)
    key = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("Client "), _s(key), F.lit(" (E-"), _s(key), F.lit(") AUD")).alias("engagement"),
        _dec("c_acctbal", 12, 2).alias("nui_etd"),
        F.concat(F.lit("Manager "), _s(key % 13)).alias("engagement_manager"),
        F.when(key % 3 == 0, "Closed").otherwise("Open").alias("engagement_status"),
    )


# ----------------------------------------------------------------------------- addresses
def address(t: Tables) -> DataFrame:
    """Address detail joined with its default geocode (lon/lat doubles)."""
    o = t.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # 15 customers to a place, as many places as there are suppliers (schools)
    x0, y0 = _lattice(((c - c % 15) / 15).cast("bigint"))
    return o.select(
        F.concat(F.lit("GA"), F.lpad(_s(k), 9, "0")).alias("address_detail_pid"),
        (k % 200 + 1).alias("number_first"),
        F.when(k % 7 == 0, k % 200 + 3).alias("number_last"),
        F.when(k % 5 == 0, k % 30 + 1).alias("flat_number"),
        F.when(k % 5 == 0, F.lit("UNIT")).alias("flat_type_code"),
        F.concat(F.lit("ST"), _s(c)).alias("street_locality_pid"),
        F.concat(F.lit("LOC"), _s(c % 25)).alias("locality_pid"),
        _s(F.lit(2000) + c % 25).alias("postcode"),
        F.when(k % 17 == 0, F.col("o_orderdate").cast("date")).alias("date_retired"),
        (x0 + ((k * 7919) % 3001) / F.lit(60020.0)).alias("lon"),
        (y0 + ((k * 104729) % 2999) / F.lit(59980.0)).alias("lat"),
    )


def address_active(t: Tables) -> DataFrame:
    """Addresses that are not retired."""
    return address(t).filter(F.col("date_retired").isNull())


def state(t: Tables) -> DataFrame:
    return t.region.select(
        F.concat(F.lit("S"), _s("r_regionkey")).alias("state_pid"),
        F.col("r_name").alias("state_name"),
        F.substring("r_name", 1, 3).alias("state_abbreviation"),
    )


def locality(t: Tables) -> DataFrame:
    return t.nation.select(
        F.concat(F.lit("LOC"), _s("n_nationkey")).alias("locality_pid"),
        F.col("n_name").alias("locality_name"),
        F.concat(F.lit("S"), _s("n_regionkey")).alias("state_pid"),
        F.when(F.col("n_nationkey") == 24, F.lit("2020-01-01").cast("date")).alias("date_retired"),
    )


def street_type_aut(t: Tables) -> DataFrame:
    """Street-type code table (a fixed code list)."""
    # Fixed values of the fixture's code table.
    rows = [("ST", "STREET"), ("RD", "ROAD"), ("AVE", "AVENUE")]
    return t.spark.createDataFrame(rows, "code string, name string")


def street_locality(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("ST"), _s(k)).alias("street_locality_pid"),
        F.when(k % 50 == 0, F.concat(F.lit("151.1"), _s(k % 7)))
         .otherwise(F.concat(F.lit("NAME "), _s(k % 120))).alias("street_name"),
        F.when(k % 4 == 0, "ST").when(k % 4 == 1, "RD").when(k % 4 == 2, "AVE").alias("street_type_code"),
        F.concat(F.lit("LOC"), _s(k % 25)).alias("locality_pid"),
        F.when(k % 61 == 0, F.lit("2020-01-01").cast("date")).alias("date_retired"),
    )


# Fixed values of the fixture's code tables.
CODES = {
    "flat_type": {"UNIT": "UNIT", "APT": "APARTMENT"},
    "level_type": {"L": "LEVEL", "B": "BASEMENT"},
    "street_type": {"ST": "STREET", "RD": "ROAD", "AVE": "AVENUE"},
    "street_suffix": {"N": "NORTH", "EX": "EXTENSION"},
    "geocode_type": {"BC": "BUILDING CENTROID", "FC": "FRONTAGE CENTRE", "PC": "PROPERTY CENTROID"},
}


def code_tables(t: Tables) -> dict[str, DataFrame]:
    return {kind: t.spark.createDataFrame(list(rows.items()), "code string, name string") for kind, rows in CODES.items()}


def address_whole(t: Tables) -> DataFrame:
    """Addresses with level, confidence, and flats of known, unknown and no type."""
    k = F.substring("address_detail_pid", 3, 9).cast("bigint")
    return address(t).drop("lon", "lat").withColumns({
        "flat_type_code": F.when(k % 10 == 0, "UNIT").when(k % 15 == 0, "APT").when(k % 25 == 0, "ZZ"),
        "level_type_code": F.when(k % 6 == 0, "L").when(k % 6 == 1, "B").when(k % 6 == 2, "ZZ"),
        "level_number": F.when(k % 6 < 3, k % 12),
        "confidence": F.when(k % 23 != 0, k % 6 - 1),
    })


def street_whole(t: Tables) -> DataFrame:
    k = F.substring("street_locality_pid", 3, 20).cast("bigint")
    return street_locality(t).withColumn("street_suffix_code", F.when(k % 9 == 0, "N").when(k % 9 == 1, "EX").when(k % 9 == 2, "ZZ"))


def default_geocode(t: Tables) -> DataFrame:
    """Default geocodes of most addresses, some of a type without a name."""
    k = F.substring("address_detail_pid", 3, 9).cast("bigint")
    return address(t).filter(k % 10 != 3).select(
        "address_detail_pid", F.when(k % 4 == 0, "BC").when(k % 4 == 1, "FC").when(k % 4 == 2, "GAP").otherwise("PC").alias("geocode_type_code"),
        F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))


def suburb_postcode(t: Tables) -> DataFrame:
    c = t.customer.select("c_custkey", "c_nationkey")
    n = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    r = t.region.select("r_regionkey", "r_name")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, F.col("n_regionkey") == r.r_regionkey)
    return j.select(
        F.col("n_name").alias("locality_name"),
        _s(F.lit(2000) + F.col("c_custkey") % 40).alias("postcode"),
        F.col("r_name").alias("state_name"),
    ).distinct()


# ----------------------------------------------------------------------------- schools
def catchment(t: Tables) -> DataFrame:
    """Catchment polygons: a concave 6-edge ring inside [x0,x0+d] x [y0,y0+d]; every fifth one
    reaches into its neighbours' places, every seventh one is too small to hold addresses."""
    k = F.col("s_suppkey")
    x0, y0 = _lattice(k)
    return t.supplier.select("s_suppkey").select(
        k.alias("school_id"),
        F.when(k % 3 == 0, "SECONDARY").otherwise("PRIMARY").alias("school_type"),
        (x0 + F.lit(0.00005)).alias("x0"),
        (y0 + F.lit(0.00005)).alias("y0"),
        F.when(k % 5 == 0, F.lit(0.07)).when(k % 7 == 0, F.lit(0.0001)).otherwise(F.lit(0.04)).alias("d"),
    )


def catchment_polygons(t: Tables) -> DataFrame:
    """Catchments as polygon ring arrays: ``rings array<array<struct<x,y>>>`` (shell first)."""
    c = catchment(t)
    x0, y0, d = F.col("x0"), F.col("y0"), F.col("d")

    def v(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(v(x0, y0), v(x0 + d, y0), v(x0 + d, y0 + d / 2), v(x0 + d / 2, y0 + d / 2),
                   v(x0 + d / 2, y0 + d), v(x0, y0 + d), v(x0, y0))
    return c.select("school_id", "school_type", F.array(ring).alias("rings"))


def school_catchment_name(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    suffix = F.when(k % 4 == 0, " PS").when(k % 4 == 1, " HS").when(k % 4 == 2, " GHS").otherwise(" THS")
    return t.supplier.select("s_suppkey").select(
        k.alias("school_id"), F.concat(F.lit("Place"), _s(k), suffix).alias("school_name"))


def school_profile(t: Tables) -> DataFrame:
    k = F.col("s_suppkey")
    suffix = (F.when(k % 4 == 0, " Public School").when(k % 4 == 1, " High School")
              .when(k % 4 == 2, " Girls High School").otherwise(" Technology High School"))
    x0, y0 = _lattice(k)
    return t.supplier.select("s_suppkey").select(
        (F.lit(40000) + k).alias("acara_sml_id"),
        F.concat(F.lit("Place"), _s(k), suffix).alias("school_name"),
        F.when(k % 5 == 0, "VIC").otherwise("NSW").alias("state"),
        F.when(k % 6 == 5, "Independent").otherwise("Government").alias("school_sector"),
        F.when(k % 4 == 0, "Primary").otherwise("Secondary").alias("school_type"),
        F.when(k % 9 != 0, F.lit(900) + (k * 31) % 250).alias("icsea"),
        ((k * 97) % 1500).alias("total_enrolments"),
        F.when(k % 13 != 0, y0 + F.lit(0.01)).alias("latitude"),
        F.when(k % 13 != 0, x0 + F.lit(0.01)).alias("longitude"),
    )


def school_location(t: Tables) -> DataFrame:
    """Locations of most profiles, some a little off the profile's point or without one, some with a point
    that the profile lacks; and a few of schools that have no profile."""
    k = F.col("acara_sml_id")
    i = k - 40000
    x0, y0 = _lattice(i)
    off = F.when(k % 4 == 1, F.lit(0.001)).otherwise(F.lit(0.0))
    known = school_profile(t).filter(k % 11 != 3).select(
        "acara_sml_id", "school_name", "state",
        F.when(k % 4 == 0, "Major Cities of Australia").when(k % 4 == 1, "Inner Regional Australia")
         .when(k % 4 == 2, "Remote Australia").alias("abs_remoteness_area_name"),
        F.when(i % 17 != 0, y0 + F.lit(0.01) + off).alias("latitude"), F.when(i % 17 != 0, x0 + F.lit(0.01)).alias("longitude"),
        F.when(k % 10 == 0, 1).otherwise(0).alias("special_school"),
    )
    s = F.col("s_suppkey")
    gone = t.supplier.filter(s % 20 == 0).select(
        (F.lit(60000) + s).alias("acara_sml_id"), F.concat(F.lit("Gone"), _s(s), F.lit(" School")).alias("school_name"), F.lit("NSW").alias("state"),
        F.lit(None).cast("string").alias("abs_remoteness_area_name"), F.lit(-34.0).alias("latitude"), F.lit(151.0).alias("longitude"), F.lit(0).alias("special_school"))
    return known.unionByName(gone)


def hazard_zone(t: Tables) -> DataFrame:
    k = F.col("p_partkey")
    # 20 zones to a place, side by side
    x0, y0 = _lattice(((k - k % 20) / 20).cast("bigint"))
    within = k % 20
    return t.part.select("p_partkey").select(
        k.alias("hazard_id"),
        (x0 + (within % 5) / F.lit(100.0)).alias("x0"),
        (y0 + ((within - within % 5) / 5).cast("bigint") / F.lit(100.0)).alias("y0"),
        F.lit(0.005).alias("d"),
    )


# ----------------------------------------------------------------------------- usage
def usage_log(t: Tables) -> DataFrame:
    return t.events.select("user_id", F.col("event_type").alias("search_type"),
                           F.col("ts").alias("request_timestamp"), F.col("event_id").alias("usage_id"))


def subscription_event(t: Tables) -> DataFrame:
    et = F.col("event_type")
    return t.events.select(
        "event_id", F.col("user_id").alias("customer_id"), "ts",
        F.when(et.isin("signup", "purchase"), "checkout.session.completed")
         .when(et == "error", "customer.subscription.deleted")
         .otherwise("customer.subscription.updated").alias("type"),
        F.when(F.col("event_id") % 2 == 0, "active").otherwise("past_due").alias("status"),
    )
