"""Streaming form of the usage log (N2 + AG28).

The usage log is the reference's only append-only table.  Here it is a file
stream: new Parquet files in a folder are picked up incrementally, a watermark
bounds the state, and per-user daily counts are emitted once their day can no
longer change (append mode).  ``availableNow`` processes what is there and stops,
which suits scheduled batch runs; checkpoints go to the shared checkpoint folder
so a restarted job resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattle.session import scratch_path


def usage_stream(spark: SparkSession, folder: str, schema: str | None = None) -> DataFrame:
    """Read an events folder as a stream, shaped as the usage log."""
    sch = schema or "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ev = spark.readStream.schema(sch).parquet(folder)
    return ev.select("user_id", F.col("event_type").alias("search_type"),
                     F.col("ts").cast("timestamp").alias("request_timestamp"), F.col("event_id").alias("usage_id"))


def daily_usage(log: DataFrame, lateness: str = "1 day") -> DataFrame:
    """AG28 per day: tumbling one-day windows per user, final once the watermark passes."""
    return (log.withWatermark("request_timestamp", lateness)
               .groupBy("user_id", F.window("request_timestamp", "1 day").alias("day"))
               .agg(F.count(F.lit(1)).alias("search_count"),
                    # Streaming forbids count(DISTINCT); the set of search types is
                    # tiny, so an exact set per user-day is cheap state.
                    F.size(F.collect_set("search_type")).alias("unique_search_types")))


def run_daily_usage(spark: SparkSession, source_folder: str, sink_path: str, name: str = "daily_usage") -> StreamingQuery:
    """Run the daily aggregation once over everything available into Parquet."""
    out = daily_usage(usage_stream(spark, source_folder)).select(
        "user_id", F.col("day.start").alias("day_start"), "search_count", "unique_search_types")
    return (out.writeStream.outputMode("append").format("parquet")
               .option("checkpointLocation", scratch_path(spark, f"stream-{name}"))
               .trigger(availableNow=True).start(sink_path))


# ----------------------------------------------------------------------------- N3 as a stateful stream
_STATE_SCHEMA = "tier_ts timestamp, tier_eid long, tier_id int, st_ts timestamp, st_eid long, status string"
_OUT_SCHEMA = "customer_id long, tier_id int, subscription_status string"


def _fold_subscription(key, batches, state):
    """Per customer: keep the latest (ts, event_id) tier event and status event.

    The state holds only those two keys and values, so events may arrive late or
    out of order: an older event never overrides a newer one.  This is the same
    fold as the batch ``subscription_state`` (N3).
    """
    import pandas as pd

    from wattle.operators.usage import EVENT_COMPLETED, EVENT_DELETED, EVENT_UPDATED

    if state.exists:
        t_ts, t_eid, tier, s_ts, s_eid, status = state.get
    else:
        t_ts = t_eid = tier = s_ts = s_eid = status = None

    def newer(ts, eid, cur_ts, cur_eid):
        return cur_ts is None or (ts, eid) > (cur_ts, cur_eid)

    for pdf in batches:
        pdf = pdf.sort_values(["ts", "event_id"])
        typ = pdf["type"]
        tiers = pdf[typ.isin([EVENT_COMPLETED, EVENT_DELETED])]
        if len(tiers):
            last = tiers.iloc[-1]
            ts, eid = pd.Timestamp(last["ts"]).to_pydatetime(), int(last["event_id"])
            if newer(ts, eid, t_ts, t_eid):
                t_ts, t_eid, tier = ts, eid, 2 if last["type"] == EVENT_COMPLETED else 1
        stat = pdf[typ.isin([EVENT_COMPLETED, EVENT_DELETED, EVENT_UPDATED])]
        if len(stat):
            last = stat.iloc[-1]
            ts, eid = pd.Timestamp(last["ts"]).to_pydatetime(), int(last["event_id"])
            if newer(ts, eid, s_ts, s_eid):
                s_ts, s_eid = ts, eid
                status = ("active" if last["type"] == EVENT_COMPLETED else
                          "cancelled" if last["type"] == EVENT_DELETED else last["status"])
    state.update((t_ts, t_eid, tier, s_ts, s_eid, status))
    yield pd.DataFrame({"customer_id": [int(key[0])], "tier_id": [tier], "subscription_status": [status]})


def subscription_state_stream(events: DataFrame) -> DataFrame:
    """N3 on a stream of billing events (customer_id, ts, event_id, type, status):
    ``applyInPandasWithState`` keyed by customer, emitting the updated state of
    every customer seen in a micro-batch (update mode)."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    ev = events.select("customer_id", F.col("ts").cast("timestamp").alias("ts"), "event_id", "type", "status")
    return ev.groupBy("customer_id").applyInPandasWithState(
        _fold_subscription, _OUT_SCHEMA, _STATE_SCHEMA, "update", GroupStateTimeout.NoTimeout)


def subscription_events_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The driver's events folder read as a stream and shaped as billing events."""
    sch = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    ev = spark.readStream.schema(sch).option("maxFilesPerTrigger", 1).parquet(folder)
    et = F.col("event_type")
    return ev.select(
        "event_id", F.col("user_id").alias("customer_id"), "ts",
        F.when(et.isin("signup", "purchase"), "checkout.session.completed")
         .when(et == "error", "customer.subscription.deleted")
         .otherwise("customer.subscription.updated").alias("type"),
        F.when(F.col("event_id") % 2 == 0, "active").otherwise("past_due").alias("status"))


# ----------------------------------------------------------------------------- N1 as a live quota
_QUOTA_STATE = "months array<string>, used array<int>"
_QUOTA_OUT = "usage_id long, user_id long, month date, allowed boolean"


def _decide(user_id: int, batches, used: dict[str, int]):
    """Frames of decided calls; ``used`` (month -> calls tracked) is brought up to date.

    Of each month the earliest calls are allowed, as many as its limit leaves, whatever Arrow batches they came in.  Only the
    calls that may still be allowed are held, so a user's micro-batch is never in memory whole: a call that earlier
    ones push out is refused at once.
    """
    import pandas as pd

    def frame(g, allowed):
        return pd.DataFrame({"usage_id": g["usage_id"].astype("int64"), "user_id": user_id, "month": g["month"], "allowed": allowed})

    open_calls = {}
    for batch in batches:
        for m, g in batch.groupby("month", sort=True):
            lim, name = g["lim"].iloc[0], str(m)
            if pd.isna(lim):
                used[name] = used.get(name, 0) + len(g)
                yield frame(g, True)
                continue
            room = max(int(lim) - used.get(name, 0), 0)
            held = [open_calls[name], g] if name in open_calls else [g]
            held = pd.concat(held, ignore_index=True).sort_values(["request_timestamp", "usage_id"])
            open_calls[name] = held.iloc[:room]
            if len(held) > room:
                yield frame(held.iloc[room:], False)
    for name, g in open_calls.items():
        used[name] = used.get(name, 0) + len(g)
        if len(g):
            yield frame(g, True)


def _closes(month: str):
    """The first instant after a month (``YYYY-MM-01``), in milliseconds."""
    import pandas as pd

    return int((pd.Timestamp(month) + pd.offsets.MonthBegin(1)).value // 1_000_000)


def _quota_fold(key, batches, state):
    """Per user: a call is allowed while the calls tracked in its calendar month are below the limit, and only
    allowed calls are tracked.  Every month has a count of its own, so a late call of an earlier month leaves
    the current month's count alone.  Months that the watermark has passed are forgotten, by a timer if no call comes."""
    used = dict(zip(*state.get)) if state.exists else {}
    if not state.hasTimedOut:
        yield from _decide(int(key[0]), batches, used)
    now = state.getCurrentWatermarkMs()
    used = {m: n for m, n in used.items() if _closes(m) > now}
    if used:
        state.update((list(used), list(used.values())))
        state.setTimeoutTimestamp(min(map(_closes, used)))
    elif state.exists:
        state.remove()


def quota_stream(log: DataFrame, user_limits: DataFrame, late: str = "7 days") -> DataFrame:
    """N1 live: decide each call of a streamed usage log as it arrives (append mode).

    ``user_limits`` (user_id, searches_per_month) is a static table joined to the
    stream; users missing from it get the first tier's limit, a null limit is
    unlimited.  State per user is one number for each calendar month that is open: calls more than ``late`` behind the
    newest one are dropped, and a month is closed ``late`` after its end.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    from wattle.operators.usage import TIERS, calendar_month

    limits = user_limits.select("user_id", F.col("searches_per_month").cast("int").alias("_l"), F.lit(True).alias("_known"))
    ev = (log.select("usage_id", "user_id", F.col("request_timestamp").cast("timestamp").alias("request_timestamp"), calendar_month("request_timestamp").alias("month"))
             .withWatermark("request_timestamp", late)
             .join(limits, "user_id", "left")
             .withColumn("lim", F.when(F.col("_known").isNull(), F.lit(TIERS[0][2])).otherwise(F.col("_l")))
             .drop("_l", "_known"))
    return ev.groupBy("user_id").applyInPandasWithState(
        _quota_fold, _QUOTA_OUT, _QUOTA_STATE, "append", GroupStateTimeout.EventTimeTimeout)
