"""The whole address star, address shapes and the two sets of geocode words, on rows written out."""

from pyspark.sql import functions as F

from wattle.functions import text as T
from wattle.operators import addresses as A


def test_full_star_names_every_code(spark):
    code = lambda *rows: spark.createDataFrame(rows, "code string, name string")
    address = spark.createDataFrame([("A1", "SL1", "L1", "UNIT", "L", 3), ("A2", "SL2", "L1", "ZZ", None, None), ("A3", None, None, None, "ZZ", 1)],
                                    "address_detail_pid string, street_locality_pid string, locality_pid string, flat_type_code string, level_type_code string, level_number int")
    streets = spark.createDataFrame([("SL1", "GEORGE", "ST", "N", "L1", None), ("SL2", "PITT", "ZZ", None, "L1", None)],
                                    "street_locality_pid string, street_name string, street_type_code string, street_suffix_code string, locality_pid string, date_retired date")
    localities = spark.createDataFrame([("L1", "SYDNEY", "S1", None)], "locality_pid string, locality_name string, state_pid string, date_retired date")
    states = spark.createDataFrame([("S1", "NEW SOUTH WALES", "NSW")], "state_pid string, state_name string, state_abbreviation string")
    codes = {"flat_type": code(("UNIT", "UNIT")), "level_type": code(("L", "LEVEL")), "street_type": code(("ST", "STREET")), "street_suffix": code(("N", "NORTH")),
             "geocode_type": code(("BC", "BUILDING CENTROID"))}
    geocodes = spark.createDataFrame([("A1", "BC", -33.0, 151.0), ("A2", "ZZ", -34.0, 150.0)], "address_detail_pid string, geocode_type_code string, latitude double, longitude double")
    got = A.full_star(address, streets, localities, states, codes, geocodes)
    rows = {r.address_detail_pid: (r.flat_type, r.level_type, r.street_type, r.street_suffix, r.locality_name, r.geocode_type, r.latitude) for r in got.collect()}
    assert rows == {"A1": ("UNIT", "LEVEL", "STREET", "NORTH", "SYDNEY", "BUILDING CENTROID", -33.0), "A2": (None, None, None, None, "SYDNEY", None, -34.0),
                    "A3": (None, None, None, None, None, None, None)}
    assert "geocode_type" not in A.full_star(address, streets, localities, states, codes).columns


def test_shapes(spark):
    df = spark.createDataFrame([(4, 12, "GEORGE", "STREET", "SYDNEY", "NSW", "2000"), (None, None, None, None, None, None, None)],
                               "flat int, n int, street string, type string, loc string, st string, pc string")
    got = df.select(T.simple_address("flat", "n", "street", "loc", "st", "pc"), T.plain_address("flat", "n", "street", "type"),
                    T.plain_address("flat", "n", "street", "type", "loc", "st", "pc")).collect()
    assert tuple(got[0]) == ("Unit 4, 12 GEORGE SYDNEY NSW 2000", "Unit 4, 12 GEORGE STREET", "Unit 4, 12 GEORGE STREET SYDNEY NSW 2000")
    assert tuple(got[1]) == ("", "", "")


def test_words(spark):
    df = spark.createDataFrame([("BC", "LOW"), ("zz", "low"), (None, None)], "code string, word string")
    got = [tuple(r) for r in df.select(T.geocode_detail("code"), T.confidence_detail("word"), T.geocode_type_label("code"), T.confidence_label(F.lit(None))).collect()]
    assert got == [("Building Centroid - Centre of building footprint", "Low confidence in coordinate accuracy", "Building Centroid", "Unknown"),
                   ("Unknown geocode type", "Unknown confidence level", "N/A", "Unknown"), ("Unknown geocode type", "Unknown confidence level", "N/A", "Unknown")]
