"""Usage log and subscription jobs (N1-N3, AG28).

The reference checks a monthly quota per request; here it is re-aimed at the
usage log as a batch job.  "First N calls of a user in a month" is a
``row_number() <= N`` filter with a literal N on the raw log, which Spark
executes with a map-side group limit, so no user-month is ever sorted whole in
one task; the N-th call's key is then compared with every call (a keyed join
AQE can split when one user-month is huge).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# The seeded tiers (tier_id, name, monthly searches; null = unlimited).
TIERS = [(1, "Free", 10), (2, "Premium", None)]

# Billing event types and the state they set.
EVENT_COMPLETED = "checkout.session.completed"
EVENT_UPDATED = "customer.subscription.updated"
EVENT_DELETED = "customer.subscription.deleted"


def calendar_month(ts: str):
    """First day of the calendar month as a DATE (time-zone independent for
    TIMESTAMP_NTZ input; the session zone's calendar for zoned timestamps)."""
    return F.trunc(F.col(ts).cast("date"), "month")


def tiers_table(spark) -> DataFrame:
    return spark.createDataFrame(TIERS, "tier_id int, tier_name string, searches_per_month int")


def monthly_usage(log: DataFrame) -> DataFrame:
    """AG28: per user and calendar month: searches and distinct search types."""
    return (log.groupBy("user_id", calendar_month("request_timestamp").alias("month"))
               .agg(F.count(F.lit(1)).alias("search_count"), F.count_distinct("search_type").alias("unique_search_types")))


def subscription_state(events: DataFrame) -> DataFrame:
    """Per customer, the state after folding the billing events in time order:
    completed -> tier 2 'active'; updated -> its status; deleted -> tier 1
    'cancelled'.  Last tier event and last status event by ``max_by`` (an
    aggregate, so a customer with many events is combined map-side)."""
    t = F.col("type")
    order = F.struct("ts", "event_id")
    tier = F.when(t == EVENT_COMPLETED, 2).when(t == EVENT_DELETED, 1)
    status = F.when(t == EVENT_COMPLETED, "active").when(t == EVENT_DELETED, "cancelled") \
              .when(t == EVENT_UPDATED, F.col("status"))
    e = events.select("customer_id", order.alias("o"), tier.alias("tier"), status.alias("st"))
    return (e.groupBy("customer_id")
             .agg(F.max_by("tier", F.when(F.col("tier").isNotNull(), F.col("o"))).alias("tier_id"),
                  F.max_by("st", F.when(F.col("st").isNotNull(), F.col("o"))).alias("subscription_status")))


def quota_decisions(log: DataFrame, user_limits: DataFrame) -> DataFrame:
    """Every logged call with ``allowed`` - true while the user's tracked calls in
    that calendar month are below the tier limit (null limit = unlimited).
    Refused calls are not tracked, so the allowed calls are exactly the first
    ``limit`` calls of the month ordered by (timestamp, id).

    ``user_limits``: (user_id, searches_per_month); users missing from it get the
    first tier's limit.

    Plan: the raw log is ranked per user-month with ``row_number() <= K`` (K =
    the largest finite limit, a literal), which Spark cuts map-side before the
    shuffle, so a user-month holding a third of the log reaches no task whole.
    Limits are attached to that small top-K set, giving one threshold per
    user-month, and the log meets the thresholds in a single join on
    (user, month), which AQE may split for a hot key.
    """
    default = TIERS[0][2]  # the first (free) tier's limit
    limits = user_limits.select("user_id", F.col("searches_per_month").cast("int").alias("_l"), F.lit(True).alias("_known"))
    k_max = max(1, default, limits.agg(F.max("_l")).first()[0] or 0)
    base = log.select("usage_id", "user_id", "request_timestamp", calendar_month("request_timestamp").alias("month"))
    key = F.struct("request_timestamp", "usage_id")
    w = Window.partitionBy("user_id", "month").orderBy("request_timestamp", "usage_id")
    top = base.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k_max)
    top = (top.join(limits, "user_id", "left")
              .withColumn("lim", F.when(F.col("_known").isNull(), F.lit(default)).otherwise(F.col("_l"))))
    thr = top.groupBy("user_id", "month").agg(
        F.max("lim").alias("lim"), F.max(F.when(F.col("_r") == F.col("lim"), key)).alias("_thr"))
    out = base.join(thr, ["user_id", "month"], "left")
    allowed = F.when(F.col("lim").isNull(), F.lit(True)) \
               .when(F.col("lim") <= 0, F.lit(False)) \
               .when(F.col("_thr").isNull(), F.lit(True)) \
               .otherwise(key <= F.col("_thr"))
    return out.select("usage_id", "user_id", "month", "lim", allowed.alias("allowed"))


def premium_users(state: DataFrame, tiers: DataFrame) -> DataFrame:
    """users whose tier is 'Premium' and whose subscription is 'active'."""
    j = state.join(tiers.select("tier_id", "tier_name"), "tier_id")
    return j.filter((F.col("tier_name") == "Premium") & (F.col("subscription_status") == "active")) \
            .select(F.col("customer_id").alias("user_id"), "tier_name", "subscription_status")
