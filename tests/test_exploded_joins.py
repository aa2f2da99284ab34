"""Tables multiplied by ``explode`` are joined by sort-merge: their size is unknown to the planner, which would broadcast them."""

import uuid

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from wattle import jobs
from wattle.operators import grid as GR
from wattle.operators import spatial_join as S

_RINGS = "pid int, rings array<array<struct<x:double,y:double>>>"


def _plan(df) -> str:
    return df._jdf.queryExecution().sparkPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    """Rows as a file, whose size the planner knows."""
    def put(rows, schema):
        path = str(tmp_path / uuid.uuid4().hex)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
        return spark.read.parquet(path)
    return put


def _points(stored):
    return stored([(1, 151.0, -34.0), (2, 151.02, -33.98), (3, None, None)], "id int, lon double, lat double")


def _squares(stored):
    ring = lambda x, y, d: [[{"x": x, "y": y}, {"x": x + d, "y": y}, {"x": x + d, "y": y + d}, {"x": x, "y": y + d}, {"x": x, "y": y}]]
    return stored([(7, ring(150.99, -34.01, 0.02)), (8, ring(151.0, -34.0, 0.04))], _RINGS)


def test_disc_counts_broadcast_nothing(stored):
    dots = _points(stored).select(F.col("lon").alias("r_lon"), F.col("lat").alias("r_lat"))
    near = F.col("r_lon") - F.col("_x") < 0.045
    counts = GR.disc_counts(_points(stored), dots, "id", 0.045, {"n": (F.col("_far") < 0.04, near)})
    assert "Broadcast" not in _plan(counts)
    assert {r.id: r.n for r in counts.collect()} == {1: 2, 2: 2}


def test_hazard_boxes_broadcast_nothing(spark):
    assert "Broadcast" not in _plan(E.queries()["sp18_hazard_exposure"](spark, SF_SMALL))


def test_boundary_distances_broadcast_nothing(stored):
    near = S.near_polygon_boundary(_points(stored), _squares(stored), "pid", 150.0, point_id="id")
    assert "Broadcast" not in _plan(near)
    assert {(r.id, r.pid) for r in near.collect()} == {(1, 8)}
    few = S.near_polygon_boundary(_points(stored), _squares(stored), "pid", 150.0, point_id="id", few=True)
    assert "Broadcast" in _plan(few) and few.collect() == near.collect()


def test_polygon_distances_broadcast_nothing(stored):
    near = S.within_polygon_distance(_points(stored), _squares(stored), "pid", 150.0, "id")
    assert "Broadcast" not in _plan(near)
    assert {(r.id, r.pid, r.distance) for r in near.collect()} == {(1, 7, 0.0), (1, 8, 0.0), (2, 8, 0.0)}


def test_cover_and_its_points_broadcast_nothing(stored, monkeypatch):
    kept, write = [], GR.written
    monkeypatch.setattr(GR, "written", lambda df, name: kept.append(_plan(df)) or write(df, name))
    inside = S.points_in_polygons(_points(stored), _squares(stored), "pid", 0.0025, point_id="id")
    assert len(kept) == 3 and "Broadcast" not in "".join(kept) + _plan(inside)
    assert {(r.id, r.pid) for r in inside.collect()} == {(1, 7), (2, 8)}


def test_streets_are_not_broadcast(stored):
    t = stored
    streets = jobs.catchment_streets(
        t([("A1", 5, "PRIMARY")], "address_detail_pid string, school_id long, school_type string"),
        t([("A1", "S1", "L1", "2000")], "address_detail_pid string, street_locality_pid string, locality_pid string, postcode string"),
        t([("S1", "HILL", "ST")], "street_locality_pid string, street_name string, street_type_code string"),
        t([("ST", "STREET")], "code string, name string"), t([("L1", "TOWN")], "locality_pid string, locality_name string"))
    assert "SortMergeJoin [street_locality_pid" in _plan(streets)
    assert [tuple(r) for r in streets.collect()] == [(5, "PRIMARY", "HILL", "STREET", "TOWN", "2000")]
