import random
import zlib
from collections import Counter, defaultdict

from hypothesis import given
from hypothesis import strategies as st

from wattle.llm import lpt_shards as L


@given(st.lists(st.integers(1, 100), max_size=60), st.integers(1, 8))
def test_heap_picks_the_least_loaded(sizes, shards):
    items = [(f"g{i}", s) for i, s in enumerate(sizes)]
    loads, want = [0] * shards, {}
    for name, size in sorted(items, key=lambda x: (-x[1], x[0])):
        k = loads.index(min(loads))
        loads[k] += size
        want[name] = k
    assert L.lpt(items, shards) == want
    if sizes:
        # the classic bound: no load is above the mean and the item that ended it
        assert max(loads) <= sum(sizes) / shards + max(sizes)


def rows():
    rng = random.Random(4)
    out = [(0, None), (1, ""), (2, None), (None, "null id"), (3, "é😀"), (3, "é😀")]
    out += [(10 + i, "x" * rng.randrange(200)) for i in range(900)] + [(2000 + i, "hot") for i in range(300)] + [(3000, "long " * 20_000)]
    return out


def test_shards(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    out = L.number(L.assign(L.measure(df), 5)).collect()
    assert len(out) == len(data)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in data)
    assert Counter((r.id, r["size"], r.crc) for r in out) == want
    shard_of, slots, load = {}, defaultdict(list), Counter()
    for r in out:
        assert shard_of.setdefault(r.group, r.shard) == r.shard
        slots[r.shard].append(r.slot)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(5))
    rest = sorted(load.values())[:-1]  # one holds the long text
    assert max(rest) - min(rest) <= 0.05 * max(rest)


def test_same_plan_however_partitioned(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string")
    plan = lambda d: {r.group: r.shard for r in L.assign(L.measure(d), 5).collect()}
    assert plan(df.repartition(2)) == plan(df.repartition(7))


def test_empty_and_query(spark):
    df = spark.createDataFrame([], "doc_id long, text string, shard int")
    assert L.shard(df, 5).count() == 0
    out = L.op9_lpt_shards(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and out.count() == 200


def one_by_one(sizes, shards):
    """group -> shard by a plain heap over all groups."""
    import heapq

    heap = [(0, k) for k in range(shards)]
    out = {}
    for group, size in sorted(sizes.items(), key=lambda x: (-x[1], x[0])):
        load, k = heap[0]
        heapq.heapreplace(heap, (load + size, k))
        out[group] = k
    return out


@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 40)), max_size=8), st.integers(1, 6), st.integers(0, 400))
def test_runs_of_equal_sizes(runs, shards, giant):
    sizes = {f"{s:03d}-{k}-{i:03d}": s for k, (s, n) in enumerate(runs) for i in range(n)}
    sizes["giant"] = giant + 1
    assert L.lpt(sizes.items(), shards) == one_by_one(sizes, shards)


def test_every_group_is_scheduled(spark):
    """100,000 distinct texts: the shards are those of a heap over all groups."""
    df = spark.range(100_000).selectExpr("id AS doc_id", "concat(repeat('x', cast(pmod(id * id, 997) AS int)), id) AS text")
    df = df.unionAll(spark.range(500).selectExpr("-id AS doc_id", "'hot' AS text"))
    out = L.assign(L.measure(df), 40)
    sizes, shard_of = Counter(), {}
    for r in out.select("group", "size", "shard").collect():
        sizes[r.group] += r["size"]
        assert shard_of.setdefault(r.group, r.shard) == r.shard
    assert len(sizes) == 100_001 and shard_of == one_by_one(sizes, 40)
