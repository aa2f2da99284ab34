"""Registered usage and subscription queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from wattle.operators import usage as U
from wattle.plans import domain as D
from wattle.plans.oracle import sql
from wattle.plans.registry import register
from wattle.sources.tables import Tables

_STATE_SQL = """SELECT customer_id,
 arg_max(CASE WHEN type = 'checkout.session.completed' THEN 2 WHEN type = 'customer.subscription.deleted' THEN 1 END, (ts, event_id))
   FILTER (WHERE type IN ('checkout.session.completed', 'customer.subscription.deleted')) AS tier_id,
 arg_max(CASE WHEN type = 'checkout.session.completed' THEN 'active' WHEN type = 'customer.subscription.deleted' THEN 'cancelled' ELSE status END, (ts, event_id))
   AS subscription_status
FROM subscription_event GROUP BY customer_id"""


@register("ag28_monthly_usage", sql("""SELECT user_id, cast(date_trunc('month', request_timestamp) AS date) AS month, count(*) AS search_count,
 count(DISTINCT search_type) AS unique_search_types FROM usage_log GROUP BY user_id, cast(date_trunc('month', request_timestamp) AS date)""", "usage_log"))
def ag28_monthly_usage(spark, d):
    return U.monthly_usage(D.usage_log(Tables(spark, d)))


@register("n3_subscription_state", sql(_STATE_SQL, "subscription_event"))
def n3_subscription_state(spark, d):
    return U.subscription_state(D.subscription_event(Tables(spark, d)))


@register("n1_quota_decisions", sql("""SELECT usage_id, l.user_id, cast(date_trunc('month', request_timestamp) AS date) AS month, lim,
 CASE WHEN lim IS NULL THEN true WHEN lim <= 0 THEN false
  ELSE row_number() OVER (PARTITION BY l.user_id, cast(date_trunc('month', request_timestamp) AS date) ORDER BY request_timestamp, usage_id) <= lim END AS allowed
FROM (SELECT u.*, CASE WHEN s.customer_id IS NULL THEN 10 ELSE t.lim END AS lim FROM usage_log u
      LEFT JOIN st s ON s.customer_id = u.user_id LEFT JOIN tiers t ON t.tier_id = coalesce(s.tier_id, 1)) l""", "usage_log", "subscription_event",
                                    extra={"st": _STATE_SQL, "tiers": "SELECT * FROM (VALUES (1, 10), (2, NULL)) AS t(tier_id, lim)"}))
def n1_quota_decisions(spark, d):
    """N1 with each user's tier taken from the subscription state (N3); no state -> Free."""
    t = Tables(spark, d)
    st = U.subscription_state(D.subscription_event(t))
    tiers = U.tiers_table(spark)
    limits = (st.select(F.col("customer_id").alias("user_id"), F.coalesce("tier_id", F.lit(1)).alias("tier_id"))
                .join(tiers, "tier_id").select("user_id", "searches_per_month"))
    return U.quota_decisions(D.usage_log(t), limits)


@register("f10_premium_users", sql("""SELECT s.customer_id AS user_id, t.tier_name, s.subscription_status FROM st s
JOIN (SELECT * FROM (VALUES (1, 'Free'), (2, 'Premium')) AS t(tier_id, tier_name)) t ON t.tier_id = s.tier_id
WHERE t.tier_name = 'Premium' AND s.subscription_status = 'active'""", "subscription_event", extra={"st": _STATE_SQL}))
def f10_premium_users(spark, d):
    t = Tables(spark, d)
    return U.premium_users(U.subscription_state(D.subscription_event(t)), U.tiers_table(spark))
