"""SQL twins of ``wattle.plans.domain`` for the DuckDB oracle.

The oracle only sees the driver's views, so each oracle query inlines the
domain tables it reads as CTEs.  ``sql(body, *names)`` prepends the CTEs (and
their dependencies) in dependency order.
"""

from __future__ import annotations

CTE = {
    "wip": """SELECT 'E-' || cast(o.o_custkey AS varchar) AS engagement_id,
 'Project ' || cast(cast((o.o_custkey - o.o_custkey % 2) / 2 AS bigint) AS varchar) || CASE WHEN o.o_custkey % 2 = 0 THEN ' Onshore' ELSE ' Offshore' END AS engagement_name,
 'O-' || cast(o.o_orderkey AS varchar) AS opportunity_id,
 CASE WHEN l.l_linenumber = 1 THEN NULL ELSE cast(l.l_shipdate AS date) END AS accounting_date,
 cast(o.o_orderdate AS date) AS transaction_date,
 cast(l.l_quantity AS decimal(12,2)) AS hours,
 cast(l.l_extendedprice AS decimal(12,2)) AS nsr,
 cast(l.l_extendedprice AS decimal(12,2)) * (1 - cast(l.l_discount AS decimal(4,2))) AS ansr,
 cast(l.l_extendedprice AS decimal(12,2)) * cast(0.65 AS decimal(4,2)) AS margin_cost,
 cast(l.l_extendedprice AS decimal(12,2)) * cast(l.l_tax AS decimal(4,2)) AS expense,
 l.l_suppkey AS employee_id,
 CASE l.l_suppkey % 8 WHEN 0 THEN 'Partner/Principal' WHEN 1 THEN 'Executive Director' WHEN 2 THEN 'Senior Manager' WHEN 3 THEN 'Senior Manager' WHEN 4 THEN 'Manager' WHEN 5 THEN 'Senior' WHEN 6 THEN 'Staff/Assistant' ELSE 'Contractor' END AS rank_name,
 CASE l.l_suppkey % 8 WHEN 2 THEN '2' WHEN 3 THEN '1' ELSE '0' END AS grade
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey""",
    "raw_ledger": """SELECT opportunity_id AS "Opportunity ID", engagement_id AS "Engagement ID", engagement_name AS "Engagement Long Name",
 CASE WHEN cast(substr(opportunity_id, 3) AS bigint) % 89 = 0 THEN 'TBC' ELSE cast(accounting_date AS varchar) END AS "Accounting Date", cast(transaction_date AS varchar) AS "Transaction Date",
 CASE WHEN cast(substr(opportunity_id, 3) AS bigint) % 97 = 0 THEN 'n/a' ELSE cast(hours AS varchar) END AS "Charged Hours / Quantity", cast(nsr AS varchar) AS "NSR / Tech Revenue",
 CASE WHEN cast(substr(opportunity_id, 3) AS bigint) % 101 = 0 THEN ' ' ELSE cast(ansr AS varchar) END AS "ANSR / Tech Revenue", cast(margin_cost AS varchar) AS "Margin Cost", cast(expense AS varchar) AS "Expense Amount",
 'Emp ' || cast(employee_id AS varchar) AS "Employee / Product Name", cast(employee_id AS varchar) AS "Employee GUI / Product ID", rank_name AS "Rank / Method", grade AS "Grade",
 'Region ' || cast(employee_id % 3 AS varchar) AS "Employee Region", CASE WHEN employee_id % 11 <> 0 THEN 'Country ' || cast(employee_id % 5 AS varchar) END AS "Country / Region",
 'Line ' || cast(employee_id % 4 AS varchar) AS "Service Line" FROM wip""",
    "clean_ledger": """SELECT "Opportunity ID" AS opportunity_id, "Engagement ID" AS engagement_id, "Engagement Long Name" AS engagement_name, "Employee / Product Name" AS employee_name,
 "Employee GUI / Product ID" AS employee_id, "Rank / Method" AS rank_name, "Grade" AS grade, "Employee Region" AS employee_region, "Country / Region" AS country_region, "Service Line" AS service_line,
 coalesce(try_cast(trim("Charged Hours / Quantity") AS decimal(20,6)), 0) AS hours, coalesce(try_cast(trim("NSR / Tech Revenue") AS decimal(20,6)), 0) AS nsr, coalesce(try_cast(trim("ANSR / Tech Revenue") AS decimal(20,6)), 0) AS ansr,
 coalesce(try_cast(trim("Margin Cost") AS decimal(20,6)), 0) AS margin_cost, coalesce(try_cast(trim("Expense Amount") AS decimal(20,6)), 0) AS expense,
 try_cast("Accounting Date" AS timestamp) AS accounting_date, try_cast("Transaction Date" AS timestamp) AS transaction_date FROM raw_ledger""",
    "bills": """SELECT 'Client ' || cast(o_custkey AS varchar) || CASE WHEN o_orderkey % 11 = 0 THEN '' ELSE ' (E-' || cast(o_custkey AS varchar) || ') AUD' END AS lead_engagement,
 CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 'Partner ' || cast(o_orderkey % 9 AS varchar) END AS billing_partner,
 cast(o_totalprice AS decimal(14,2)) AS total_incl_tax, cast(o_totalprice AS decimal(14,2)) * cast(0.10 AS decimal(4,2)) AS tax, cast(o_orderdate AS date) AS invoice_date FROM orders""",
    "bob": """SELECT 'Client ' || cast(c_custkey AS varchar) || ' (E-' || cast(c_custkey AS varchar) || ') AUD' AS engagement,
 cast(c_acctbal AS decimal(12,2)) AS nui_etd, 'Manager ' || cast(c_custkey % 13 AS varchar) AS engagement_manager, CASE WHEN c_custkey % 3 = 0 THEN 'Closed' ELSE 'Open' END AS engagement_status FROM customer WHERE c_custkey % 10 <> 7""",
    "address": """SELECT 'GA' || lpad(cast(o_orderkey AS varchar), 9, '0') AS address_detail_pid, o_orderkey % 200 + 1 AS number_first,
 CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 200 + 3 END AS number_last, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 30 + 1 END AS flat_number,
 CASE WHEN o_orderkey % 5 = 0 THEN 'UNIT' END AS flat_type_code, 'ST' || cast(o_custkey AS varchar) AS street_locality_pid, 'LOC' || cast(o_custkey % 25 AS varchar) AS locality_pid,
 cast(2000 + o_custkey % 25 AS varchar) AS postcode, CASE WHEN o_orderkey % 17 = 0 THEN cast(o_orderdate AS date) END AS date_retired,
 151e0 + ((o_custkey // 15) % 400) * 5 / 100e0 + ((o_orderkey * 7919) % 3001) / 60020e0 AS lon, -34e0 + ((o_custkey // 15) // 400) * 5 / 100e0 + ((o_orderkey * 104729) % 2999) / 59980e0 AS lat FROM orders""",
    "catchment": """SELECT s_suppkey AS school_id, CASE WHEN s_suppkey % 3 = 0 THEN 'SECONDARY' ELSE 'PRIMARY' END AS school_type,
 151e0 + ((s_suppkey) % 400) * 5 / 100e0 + 0.00005e0 AS x0, -34e0 + ((s_suppkey) // 400) * 5 / 100e0 + 0.00005e0 AS y0, CASE WHEN s_suppkey % 5 = 0 THEN 0.07e0 WHEN s_suppkey % 7 = 0 THEN 0.0001e0 ELSE 0.04e0 END AS d FROM supplier""",
    "catchment_vertex": """SELECT school_id, 0 AS i, x0 AS x, y0 AS y FROM catchment UNION ALL SELECT school_id,1,x0+d,y0 FROM catchment UNION ALL SELECT school_id,2,x0+d,y0+d/2 FROM catchment
 UNION ALL SELECT school_id,3,x0+d/2,y0+d/2 FROM catchment UNION ALL SELECT school_id,4,x0+d/2,y0+d FROM catchment UNION ALL SELECT school_id,5,x0,y0+d FROM catchment UNION ALL SELECT school_id,6,x0,y0 FROM catchment""",
    "catchment_edge": """SELECT a.school_id, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by FROM catchment_vertex a JOIN catchment_vertex b ON a.school_id = b.school_id AND b.i = a.i + 1""",
    "usage_log": """SELECT user_id, event_type AS search_type, ts AS request_timestamp, event_id AS usage_id FROM events""",
    "state": """SELECT 'S' || cast(r_regionkey AS varchar) AS state_pid, r_name AS state_name, substr(r_name, 1, 3) AS state_abbreviation FROM region""",
    "locality": """SELECT 'LOC' || cast(n_nationkey AS varchar) AS locality_pid, n_name AS locality_name, 'S' || cast(n_regionkey AS varchar) AS state_pid,
 CASE WHEN n_nationkey = 24 THEN date '2020-01-01' END AS date_retired FROM nation""",
    "street_type_aut": """SELECT * FROM (VALUES ('ST','STREET'),('RD','ROAD'),('AVE','AVENUE')) AS t(code, name)""",
    "street_locality": """SELECT 'ST' || cast(c_custkey AS varchar) AS street_locality_pid, CASE WHEN c_custkey % 50 = 0 THEN '151.1' || cast(c_custkey % 7 AS varchar) ELSE 'NAME ' || cast(c_custkey % 120 AS varchar) END AS street_name,
 CASE c_custkey % 4 WHEN 0 THEN 'ST' WHEN 1 THEN 'RD' WHEN 2 THEN 'AVE' END AS street_type_code, 'LOC' || cast(c_custkey % 25 AS varchar) AS locality_pid, CASE WHEN c_custkey % 61 = 0 THEN date '2020-01-01' END AS date_retired FROM customer""",
    "suburb_postcode": """SELECT DISTINCT n.n_name AS locality_name, cast(2000 + c.c_custkey % 40 AS varchar) AS postcode, r.r_name AS state_name FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "school_catchment_name": """SELECT s_suppkey AS school_id, 'Place' || cast(s_suppkey AS varchar) || CASE s_suppkey % 4 WHEN 0 THEN ' PS' WHEN 1 THEN ' HS' WHEN 2 THEN ' GHS' ELSE ' THS' END AS school_name FROM supplier""",
    "school_profile": """SELECT 40000 + s_suppkey AS acara_sml_id, 'Place' || cast(s_suppkey AS varchar) || CASE s_suppkey % 4 WHEN 0 THEN ' Public School' WHEN 1 THEN ' High School' WHEN 2 THEN ' Girls High School' ELSE ' Technology High School' END AS school_name,
 CASE WHEN s_suppkey % 5 = 0 THEN 'VIC' ELSE 'NSW' END AS state, CASE WHEN s_suppkey % 6 = 5 THEN 'Independent' ELSE 'Government' END AS school_sector, CASE WHEN s_suppkey % 4 = 0 THEN 'Primary' ELSE 'Secondary' END AS school_type,
 CASE WHEN s_suppkey % 9 <> 0 THEN 900 + (s_suppkey * 31) % 250 END AS icsea, (s_suppkey * 97) % 1500 AS total_enrolments,
 CASE WHEN s_suppkey % 13 <> 0 THEN -34e0 + ((s_suppkey) // 400) * 5 / 100e0 + 0.01e0 END AS latitude, CASE WHEN s_suppkey % 13 <> 0 THEN 151e0 + ((s_suppkey) % 400) * 5 / 100e0 + 0.01e0 END AS longitude FROM supplier""",
    "school_location": """SELECT acara_sml_id, school_name, state, CASE acara_sml_id % 4 WHEN 0 THEN 'Major Cities of Australia' WHEN 1 THEN 'Inner Regional Australia' WHEN 2 THEN 'Remote Australia' END AS abs_remoteness_area_name,
 CASE WHEN (acara_sml_id - 40000) % 17 <> 0 THEN -34e0 + ((acara_sml_id - 40000) // 400) * 5 / 100e0 + 0.01e0 + CASE WHEN acara_sml_id % 4 = 1 THEN 0.001e0 ELSE 0e0 END END AS latitude, CASE WHEN (acara_sml_id - 40000) % 17 <> 0 THEN 151e0 + ((acara_sml_id - 40000) % 400) * 5 / 100e0 + 0.01e0 END AS longitude, CASE WHEN acara_sml_id % 10 = 0 THEN 1 ELSE 0 END AS special_school FROM school_profile WHERE acara_sml_id % 11 <> 3
UNION ALL SELECT 60000 + s_suppkey, 'Gone' || cast(s_suppkey AS varchar) || ' School', 'NSW', NULL, -34e0, 151e0, 0 FROM supplier WHERE s_suppkey % 20 = 0""",
    "hazard_zone": """SELECT p_partkey AS hazard_id, 151e0 + ((p_partkey // 20) % 400) * 5 / 100e0 + (p_partkey % 20 % 5) / 100e0 AS x0, -34e0 + ((p_partkey // 20) // 400) * 5 / 100e0 + (p_partkey % 20 // 5) / 100e0 AS y0, 0.005e0 AS d FROM part""",
    "subscription_event": """SELECT event_id, user_id AS customer_id, ts, CASE WHEN event_type IN ('signup','purchase') THEN 'checkout.session.completed' WHEN event_type = 'error' THEN 'customer.subscription.deleted' ELSE 'customer.subscription.updated' END AS type,
 CASE WHEN event_id % 2 = 0 THEN 'active' ELSE 'past_due' END AS status FROM events""",
}

DEPS = {
    "raw_ledger": ["wip"],
    "clean_ledger": ["raw_ledger"],
    "catchment_vertex": ["catchment"],
    "catchment_edge": ["catchment_vertex"],
    "school_location": ["school_profile"],
}


def _order(names) -> list[str]:
    out: list[str] = []

    def visit(n):
        for d in DEPS.get(n, []):
            visit(d)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """``WITH <domain CTEs>, <extra CTEs> <body>``."""
    parts = [f"{n} AS ({CTE[n]})" for n in _order(names)]
    parts += [f"{k} AS ({v})" for k, v in (extra or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body
