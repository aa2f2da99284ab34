"""Unit checks for the helpers that no driver-table column exercises."""

import json

from pyspark.sql import functions as F
from wattle.functions import geo as G
from wattle.functions import ledger_cols as P
from wattle.functions import text as T
from wattle.operators import ledger as L
from wattle.operators import quality as Q
from wattle.operators import schools as SC
from wattle.sources import files as S


def test_coercions_and_optional_columns(spark):
    df = spark.createDataFrame([("2024-01-05", "12.5", "x"), ("not a date", "abc", None)], "d string, n string, o string")
    r = df.select(P.coerce_date("d").alias("d"), P.coerce_number("n").alias("n")).collect()
    assert str(r[0].d)[:10] == "2024-01-05" and r[1].d is None
    assert r[0].n == 12.5 and r[1].n == 0.0
    assert P.keep_existing(df, ["o", "missing", "d"]).columns == ["o", "d"]
    names = spark.createDataFrame([(1, 2)], "`Engagement Name (ID) Currency` int, other int")
    assert P.pick_engagement_name_column(names, "Engagement Name") == "Engagement Name (ID) Currency"


def test_labels_point_and_profile_record(spark):
    df = spark.createDataFrame([("PC", 3, 151.0, -34.0), ("ZZ", 7, None, -34.0)], "g string, c int, lon double, lat double")
    r = df.select(T.geocode_type_label("g").alias("g"), T.confidence_label("c").alias("c"),
                  G.point("lon", "lat").alias("p")).collect()
    assert (r[0].g, r[0].c) == ("Property Centroid", "Very High") and (r[1].g, r[1].c) == ("N/A", "Unknown")
    assert r[0].p.x == 151.0 and r[1].p is None
    prof = spark.createDataFrame([(1, "A PS", "NSW", 980)], "acara_sml_id int, school_name string, state string, icsea int")
    rec = prof.select(SC.nested_profile(prof).alias("r")).first().r
    assert rec.location.state == "NSW" and rec.icsea == 980 and rec.contact.phone is None


def test_rename_null_upsert_insert(spark):
    raw = spark.createDataFrame([("1", "nan", " "), ("2", "x", "y")], "a string, b string, c string")
    ren = S.rename_and_null(raw, {"a": "id", "b": "name", "c": "sector"}).collect()
    assert ren[0].name is None and ren[0].sector is None and ren[1].name == "x"
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "first", 1), (2, "B", 2), (3, "c", 3)], "k int, v string, line int").repartition(3, "v")
    assert sorted((r.k, r.v) for r in Q.upsert_keep_last(old, new, "k", ["line"]).collect()) == [(1, "a"), (2, "B"), (3, "c")]
    again = new.union(spark.createDataFrame([(3, "d", 2)], new.schema))
    assert [(r.k, r.v) for r in Q.insert_if_absent(old, again, ["k"], ["line"]).collect()] == [(3, "d")]


def test_new_localities_and_match_table(spark):
    subs = spark.createDataFrame([("sydney", "2000", "NSW"), ("Parramatta", "2150", "NSW")], "suburb string, postcode string, state string")
    locs = spark.createDataFrame([("SYDNEY", "2000")], "locality_name string, postcode string")
    assert [r.locality_name for r in S.new_localities(subs, locs).collect()] == ["PARRAMATTA"]
    spark.createDataFrame([(1,)], "a int").createOrReplaceTempView("loaded_address_detail_tmp")
    assert S.match_table(spark, "address_detail") == "loaded_address_detail_tmp"


def test_geojson_features_and_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 151.0, -34.0)], "id int, lon double, lat double")
    feats = S.geojson_features(df.withColumn("g", G.geojson_point("lon", "lat")), "g", ["id"])
    f = json.loads(feats.first().value)
    assert f["type"] == "Feature" and f["geometry"]["coordinates"] == [151.0, -34.0] and f["properties"]["id"] == 1
    S.write_reports({"a": df, "b": df}, str(tmp_path), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "a")).count() == 1


def test_bridge_spec_form_and_totals_row(spark):
    tot = spark.createDataFrame([(1000.0, 1100.0, 400.0)], "ansr_total double, ter_total double, margin_amount_total double")
    spec = L.kpi_bridge(tot, "2000", 50, form="spec").first()
    assert spec.revised_revenue == 1000.0 + 900.0 and spec.revised_margin_amount == 400.0 + 900.0
    s = spark.createDataFrame([("E-1", 1.25, 2.0), ("E-2", 2.0, None)], "engagement_id string, ansr double, hours double")
    rows = {r.engagement_id: r for r in L.with_totals_row(s, "engagement_id", ["ansr", "hours"]).collect()}
    assert rows["TOTAL"].ansr == 3.25 and rows["TOTAL"].hours == 2.0


def test_address_text_with_missing_parts(spark):
    df = spark.createDataFrame([
        (None, None, 12, None, "SMITH", "STREET", "TOWN", None, None),      # null state and postcode
        (None, None, None, None, "SMITH", "STREET", "TOWN", "NSW", "2000"),  # null number
        ("UNIT", 3, 7, 9, "SMITH", None, "TOWN", "NSW", "2000"),             # flat, range, no type
    ], "ft string, fn int, nf int, nl int, sn string, st string, loc string, sa string, pc string")
    none = F.lit(None).cast("string")
    got = [r.a for r in df.select(T.full_address("ft", "fn", none, none, "nf", "nl", "sn", "st", none, "loc", "sa", "pc")
                                  .alias("a")).collect()]
    assert got == ["12 SMITH STREET, TOWN,  ", "SMITH STREET, TOWN, NSW 2000", "UNIT 3, 7 -9 SMITH, TOWN, NSW 2000"]
    simple = [r.s for r in df.select(T.simple_address("fn", "nf", "sn", "loc", "sa", "pc").alias("s")).collect()]
    assert simple == ["12 SMITH TOWN", "SMITH TOWN NSW 2000", "Unit 3, 7 SMITH TOWN NSW 2000"]


def test_search_text_wildcards_are_literal(spark):
    df = spark.createDataFrame([("100% PURE",), ("1000 PURE",), ("A_B",), ("AXB",)], "name string")
    assert [r.name for r in df.filter(T.icontains("name", "100%")).collect()] == ["100% PURE"]
    assert [r.name for r in df.filter(T.icontains("name", "a_b")).collect()] == ["A_B"]
    assert sorted(r.name for r in df.filter(T.icontains("name", "a_b", escape=False)).collect()) == ["AXB", "A_B"]
