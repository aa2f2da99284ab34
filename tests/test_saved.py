"""Saved tables: a refresh equals a build, touches only what changed, and readers see one version or the other."""

import os
import random

import pytest

from wattle import jobs
from wattle.sources import snapshots


def sources(spark, addresses, polygons):
    a = spark.createDataFrame(addresses, "address_detail_pid string, lon double, lat double, street_locality_pid string, locality_pid string, postcode string")
    p = spark.createDataFrame([(i, kind, [[{"x": x, "y": y} for x, y in ring]]) for i, kind, ring in polygons],
                              "school_id bigint, school_type string, rings array<array<struct<x:double,y:double>>>")
    streets = spark.createDataFrame([(f"S{i}", f"NAME {i}", "ST") for i in range(5)], "street_locality_pid string, street_name string, street_type_code string")
    kinds = spark.createDataFrame([("ST", "STREET")], "code string, name string")
    places = spark.createDataFrame([("L0", "HERE"), ("L1", "THERE")], "locality_pid string, locality_name string")
    names = spark.createDataFrame([(i, f"School {i}") for i, *_ in polygons], "school_id bigint, school_name string")
    return a, streets, kinds, places, p, names


def box(x, y, w):
    return [(x, y), (x + w, y), (x + w, y + w), (x, y + w), (x, y)]


def fixture():
    rng = random.Random(6)
    addresses = [(f"A{i}", rng.uniform(150, 150.6), rng.uniform(-35, -34.4), f"S{i % 5}", f"L{i % 2}", str(i % 7)) for i in range(400)] + [("N1", None, None, "S0", "L0", "1"), ("N2", 150.5, None, "S0", "L0", "1")]
    polygons = [(i, "PRIMARY" if i % 3 else "SECONDARY", box(rng.uniform(150, 150.5), rng.uniform(-35, -34.5), rng.choice([0.01, 0.05, 0.1]))) for i in range(25)]
    return addresses, polygons


def tables(spark, folder):
    return {name: sorted(map(str, jobs.read(spark, folder, name).select(*sorted(jobs.read(spark, folder, name).columns)).collect())) for name in jobs.SCHEMAS}


def files(folder):
    return {os.path.join(d, f) for d, _, found in os.walk(folder) for f in found if f.endswith(".parquet")}


def test_refresh_equals_build(spark, tmp_path):
    addresses, polygons = fixture()
    folder, other = str(tmp_path / "a"), str(tmp_path / "b")
    assert jobs.build(*sources(spark, addresses, polygons), folder) == 1
    assert jobs.refresh(*sources(spark, addresses, polygons), folder) == 1  # nothing differs
    was, before = files(folder), tables(spark, folder)
    changed = addresses[:200] + [(p, x + 0.3 if x else x, y, s, l, c) for p, x, y, s, l, c in addresses[201:203]] + addresses[203:] + [("B1", 150.6, -34.2, "S1", "L1", "9"), ("A200", 151.0, None, "S2", "L0", "3")]
    redrawn = polygons[1:7] + [(7, "OTHER", polygons[7][2]), (8, polygons[8][1], box(150.2, -34.9, 0.1))] + polygons[9:] + [(60, "PRIMARY", box(150.4, -34.6, 0.1))]
    now = sources(spark, changed, redrawn)
    assert jobs.refresh(*now, folder) == 2
    jobs.build(*now, other)
    assert tables(spark, folder) == tables(spark, other)
    assert was <= files(folder)  # nothing was overwritten, and most parts are listed again
    held = snapshots.parts(spark, folder, jobs.ADDRESSES, 2)
    assert 1 in held.values() and 2 in held.values()
    # the version before is still there
    assert sorted(map(str, jobs.read(spark, folder, jobs.MAPPING, 1).collect())) != sorted(map(str, jobs.read(spark, folder, jobs.MAPPING).collect()))
    assert len(before[jobs.MAPPING]) == jobs.read(spark, folder, jobs.MAPPING, 1).count()
    assert snapshots.vacuum(spark, folder) > 0 and tables(spark, folder) == tables(spark, other)


def test_build_reads_no_parts_back(spark, tmp_path, monkeypatch):
    """Tiles grow in number with the data, each a folder with a small file: later steps read copies without parts."""
    read, written, write = {}, {}, snapshots.write

    def kept(df, folder, table, version):
        read[table] = df.inputFiles()
        written[table] = write(df, folder, table, version)
        return written[table]

    monkeypatch.setattr(snapshots, "write", kept)
    folder = str(tmp_path / "a")
    jobs.build(*sources(spark, *fixture()), folder)
    assert set(read) == set(jobs.SCHEMAS) and not [f for found in read.values() for f in found if "snapshot=" in f]
    for table, parts in written.items():
        assert sorted(parts) == sorted(r[0] for r in snapshots.read(spark, folder, table, jobs.SCHEMAS[table]).select("part").distinct().collect())


def test_refresh_opens_each_part_once(spark, tmp_path, monkeypatch):
    """Nor are tiles named in a condition on every row, and what is written anew comes from copies without parts."""
    from pyspark.sql.readwriter import DataFrameReader

    addresses, polygons = fixture()
    folder = str(tmp_path / "a")
    jobs.build(*sources(spark, addresses, polygons), folder)
    opened, plans, parquet, write = [], {}, DataFrameReader.parquet, snapshots.write

    def listed(reader, *paths, **more):
        opened.extend(p for p in paths if "/part=" in p)
        return parquet(reader, *paths, **more)

    def kept(df, folder, table, version):
        plans[table] = (df.inputFiles(), df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, folder, table, version)

    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    most = spark.conf.get(key)
    with monkeypatch.context() as m:
        m.setattr(DataFrameReader, "parquet", listed)
        m.setattr(snapshots, "write", kept)
        changed = [(p, x + 0.02 if x and i % 3 == 0 else x, y, s, l, c) for i, (p, x, y, s, l, c) in enumerate(addresses)]
        assert jobs.refresh(*sources(spark, changed, polygons[2:]), folder) == 2
    tiles = [p for p in opened if f"/{jobs.ADDRESSES}/" in p or f"/{jobs.MAPPING}/" in p]
    assert tiles and len(tiles) == len(set(tiles)) and not [p for p in tiles if "snapshot=2" in p]
    assert not [f for f in plans[jobs.ADDRESSES][0] if "snapshot=" in f]
    assert " IN " not in plans[jobs.ADDRESSES][1] and "INSET" not in plans[jobs.ADDRESSES][1]
    assert spark.conf.get(key) == most
    jobs.build(*sources(spark, changed, polygons[2:]), str(tmp_path / "b"))
    assert tables(spark, folder) == tables(spark, str(tmp_path / "b"))


def test_refresh_of_repeated_addresses(spark, tmp_path):
    """An address in two places: one of them moves, the other's tile is not touched; and one whose coordinates go."""
    polygons = [(i, "PRIMARY", box(150 + 0.3 * i, -35.0, 0.1)) for i in range(3)]
    at = lambda i, dx: (150 + 0.3 * i + dx, -34.95, "S1", "L1", "1")
    addresses = [("A", *at(0, 0.05)), ("A", *at(2, 0.05)), ("B", *at(0, 0.06)), ("C", *at(0, 0.07)), ("D", *at(2, 0.01))]
    folder = str(tmp_path / "a")
    jobs.build(*sources(spark, addresses, polygons), folder)
    now = sources(spark, [("A", *at(1, 0.05)), *addresses[1:3], ("C", None, None, "S1", "L1", "1"), addresses[4]], polygons)
    assert jobs.refresh(*now, folder) == 2
    jobs.build(*now, str(tmp_path / "b"))
    assert tables(spark, folder) == tables(spark, str(tmp_path / "b"))
    assert sorted((r[0], r[1]) for r in jobs.read(spark, folder, jobs.MAPPING).collect()) == [("A", 1), ("A", 2), ("B", 0), ("D", 2)]


def test_readers_see_one_version(spark, tmp_path, monkeypatch):
    addresses, polygons = fixture()
    folder = str(tmp_path / "a")
    jobs.build(*sources(spark, addresses, polygons), folder)
    before = tables(spark, folder)
    reader = jobs.read(spark, folder, jobs.MAPPING)  # opened before the refresh

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(snapshots, "commit", dies)
        with pytest.raises(RuntimeError):
            jobs.refresh(*sources(spark, addresses[:300], polygons[3:]), folder)
    assert tables(spark, folder) == before  # all written, nothing shown
    assert jobs.refresh(*sources(spark, addresses[:300], polygons[3:]), folder) == 2
    assert sorted(map(str, reader.select(*sorted(reader.columns)).collect())) == before[jobs.MAPPING]
    jobs.build(*sources(spark, addresses[:300], polygons[3:]), str(tmp_path / "b"))
    assert tables(spark, folder) == tables(spark, str(tmp_path / "b"))


def test_empty(spark, tmp_path):
    folder = str(tmp_path / "a")
    jobs.refresh(*sources(spark, [], []), folder)
    assert all(not rows for name, rows in tables(spark, folder).items() if name != jobs.SUMMARY)


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    from wattle.operators import quality as Q
    folder, schema = str(tmp_path / "m"), "k bigint, v string"
    Q.store(spark.createDataFrame([(i, f"v{i}") for i in range(500)], schema), folder, "t", "k")
    was = files(folder)
    new = spark.createDataFrame([(3, "x", 1), (3, "y", 2), (900, "z", 1)], "k bigint, v string, line int")
    assert Q.merge(new, folder, "t", schema, "k", ["line"]) == 2
    got = {r.k: r.v for r in Q.stored(spark, folder, "t", schema).collect()}
    assert len(got) == 501 and (got[3], got[900], got[4]) == ("y", "z", "v4")
    held = snapshots.parts(spark, folder, "t", 2)
    assert was <= files(folder) and sum(v == 2 for v in held.values()) <= 2 and sum(v == 1 for v in held.values()) > 40
    assert Q.merge(new, folder, "t", schema, "k", ["line"], keep_existing=True) == 3
    assert {r.k: r.v for r in Q.stored(spark, folder, "t", schema).collect()} == got
    assert {r.k: r.v for r in Q.stored(spark, folder, "t", schema, 1).collect()}[3] == "v3"
