"""File round trips for the sources/sinks and the usage stream."""

import os

from pyspark.sql import functions as F

from wattle.operators import quality as Q
from wattle.operators import usage as U
from wattle.sources import files as S
from wattle.streaming.usage_stream import run_daily_usage


def test_ledger_header_detection(spark, tmp_path):
    p = tmp_path / "ledger.csv"
    p.write_text("Report,,\nGenerated,today,\nOpportunity ID,Engagement ID,ANSR / Tech Revenue\nO-1,E-1,10\nO-2,E-2,x\n")
    df = S.read_ledger_csv(spark, str(p))
    assert df.columns == ["Opportunity ID", "Engagement ID", "ANSR / Tech Revenue"]
    assert [r["Engagement ID"] for r in df.orderBy("Opportunity ID").collect()] == ["E-1", "E-2"]
    p2 = tmp_path / "bad.csv"
    p2.write_text("a,b\n1,2\n")
    try:
        S.read_ledger_csv(spark, str(p2))
        raise AssertionError("expected a missing-header error")
    except ValueError:
        pass


def test_partner_mapping_fallback(spark, tmp_path):
    b = tmp_path / "billing.csv"
    b.write_text(" Engagement ID ,Billing Partner\nE-1,P1\n")
    df = S.read_partner_mapping(spark, str(tmp_path / "missing.csv"), str(b))
    assert "Engagement Partner" in df.columns and df.first()["Engagement Partner"] == "P1"


def test_psv_blank_to_null_and_table_names(spark, tmp_path):
    p = tmp_path / "NSW_ADDRESS_DETAIL_psv.psv"
    p.write_text("ADDRESS_DETAIL_PID|FLAT_NUMBER\nGA1| \nGA2|3\n")
    df = S.read_psv(spark, str(p))
    rows = {r.address_detail_pid: r.flat_number for r in df.collect()}
    assert rows == {"GA1": None, "GA2": "3"}
    names = spark.createDataFrame([("NSW_ADDRESS_DETAIL_psv.psv",), ("Authority_Code_FLAT_TYPE_AUT_psv.psv",), ("other.psv",)], "f string")
    got = [r.t for r in names.select(S.table_name_from_file("f").alias("t")).collect()]
    assert got == ["address_detail", "flat_type_aut", "other"]


def test_suburb_cleaning_and_insert_if_absent(spark):
    raw = spark.createDataFrame([("Sydney", "2000"), ("Home page", "2001"), ("X", "20a1"), ("", "2002"), ("sydney", "2000"),
                                 ("Parramatta", "2150")], "SUBURB string, Postcode string")
    clean = S.clean_suburb_postcodes(raw, "NSW")
    assert sorted((r.suburb, r.postcode) for r in clean.collect()) == [("PARRAMATTA", "2150"), ("SYDNEY", "2000")]
    existing = spark.createDataFrame([("SYDNEY", "2000", "NSW")], "suburb string, postcode string, state string")
    assert [r.suburb for r in S.new_suburb_rows(existing, clean).collect()] == ["PARRAMATTA"]


def test_geojson_polygons(spark, tmp_path):
    p = tmp_path / "c.geojson"
    p.write_text('{"type":"Feature","properties":{"USE_ID":"7","USE_DESC":"A PS"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[1,0],[1,1],[0,0]]]}}\n'
                 '{"type":"Feature","properties":{"USE_ID":"8","USE_DESC":"B HS"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,5]]]]}}\n')
    df = S.read_geojson_polygons(spark, str(p), "USE_ID", properties=["USE_DESC"])
    rows = {r.use_id: len(r.rings) for r in df.collect()}
    assert rows == {"7": 1, "8": 2}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("NSW", "B", "2000"), ("NSW", "A", "2001")], "state_name string, locality_name string, postcode string")
    S.export_suburbs_csv(df, str(tmp_path / "sub"))
    back = spark.read.option("header", True).csv(str(tmp_path / "sub"))
    assert back.count() == 2
    S.write_materialized(df, str(tmp_path / "mv"), ["state_name"])
    assert spark.read.parquet(str(tmp_path / "mv")).count() == 2


def test_latest_file(spark, tmp_path):
    d = tmp_path / "drop"
    d.mkdir()
    (d / "WIP_old.csv").write_text("a\n")
    (d / "wip_new.csv").write_text("b\n")
    os.utime(d / "WIP_old.csv", (1_000_000, 1_000_000))
    got = S.latest_files(spark, str(d), ["wip"]).first()
    assert got.path.endswith("wip_new.csv")


def test_usage_stream_available_now(spark, tmp_path):
    src = tmp_path / "events"
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(str(src))
    q = run_daily_usage(spark, str(src), str(tmp_path / "out"), name=f"t{os.getpid()}")
    q.awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out"))
    total = out.agg(F.sum("search_count")).first()[0]
    # Append mode emits a day once the watermark passes it; the last day stays open.
    assert 0 < total <= 1000
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    batch = {(r.user_id, str(r.d)): (r.n, r.k) for r in ev.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_type").alias("k")).collect()}
    for r in out.collect():
        assert batch[(r.user_id, str(r.day_start.date()))] == (r.search_count, r.unique_search_types)


def test_quota_limit_and_reset(spark):
    import datetime as dt
    rows = [(i, 1, "a", dt.datetime(2024, 1, 1, 0, i)) for i in range(12)] + [(100, 1, "a", dt.datetime(2024, 2, 1))]
    log = spark.createDataFrame(rows, "usage_id long, user_id long, search_type string, request_timestamp timestamp")
    limits = spark.createDataFrame([(1, 10)], "user_id long, searches_per_month int")
    got = {r.usage_id: r.allowed for r in U.quota_decisions(log, limits).collect()}
    assert [got[i] for i in range(12)] == [True] * 10 + [False] * 2
    assert got[100] is True
    unlimited = spark.createDataFrame([(1, None)], "user_id long, searches_per_month int")
    assert all(r.allowed for r in U.quota_decisions(log, unlimited).collect())


def test_schema_and_column_count_checks(spark):
    df = spark.createDataFrame([(1, "a")], "id long, name string")
    assert Q.schema_differences(df, {"id": "bigint", "name": "string", "x": "int"}) == ["missing:x"]
    try:
        Q.check_column_count(df, df.select("id"))
        raise AssertionError("expected mismatch")
    except ValueError:
        pass


def test_subscription_state_stream_equals_batch(spark, tmp_path):
    from wattle.plans import domain as D
    from wattle.sources.tables import Tables
    from wattle.streaming.usage_stream import subscription_events_stream, subscription_state_stream
    from wattle.session import scratch_path

    src = tmp_path / "events"
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    # Several files, written newest-first, so the stream sees events out of time order.
    ev.orderBy(F.desc("ts")).repartition(4, "event_id").write.parquet(str(src))
    name = f"subs{os.getpid()}"
    q = (subscription_state_stream(subscription_events_stream(spark, str(src)))
         .writeStream.outputMode("update").format("memory").queryName(name)
         .option("checkpointLocation", scratch_path(spark, f"stream-{name}"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    # The memory sink keeps every update; the last one per customer is the final state.
    got_rows = spark.sql(f"SELECT * FROM {name}").collect()
    assert got_rows
    batch = {r.customer_id: (r.tier_id, r.subscription_status)
             for r in U.subscription_state(D.subscription_event(Tables(spark, "/root/testdata/sf0.001"))).collect()}
    final = {}
    for r in got_rows:
        final[r.customer_id] = (r.tier_id, r.subscription_status)
    assert final == batch


def test_live_quota_equals_batch(spark, tmp_path):
    import pyarrow.parquet as pq

    from wattle.streaming.usage_stream import quota_stream
    from wattle.session import scratch_path

    src = tmp_path / "events"
    src.mkdir()
    table = pq.read_table("/root/testdata/sf0.001/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    n = table.num_rows
    for i, start in enumerate(range(0, n, 250)):  # arrival order = time order, several micro-batches
        pq.write_table(table.slice(start, 250), str(src / f"part-{i:03d}.parquet"))
        os.utime(src / f"part-{i:03d}.parquet", (1_000_000 + i, 1_000_000 + i))
    limits = spark.createDataFrame([(u, 3 if u % 2 else None) for u in range(0, 300, 5)], "user_id long, searches_per_month int")
    name = f"quota{os.getpid()}"
    log = (spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
                .option("maxFilesPerTrigger", 1).parquet(str(src))
                .select("user_id", F.col("event_type").alias("search_type"), F.col("ts").alias("request_timestamp"),
                        F.col("event_id").alias("usage_id")))
    q = (quota_stream(log, limits).writeStream.outputMode("append").format("memory").queryName(name)
         .option("checkpointLocation", scratch_path(spark, f"stream-{name}")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    live = {r.usage_id: r.allowed for r in spark.sql(f"SELECT * FROM {name}").collect()}
    batch_log = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(
        "user_id", F.col("event_type").alias("search_type"), F.col("ts").alias("request_timestamp"), F.col("event_id").alias("usage_id"))
    batch = {r.usage_id: r.allowed for r in U.quota_decisions(batch_log, limits).collect()}
    assert live == batch and not all(batch.values())
