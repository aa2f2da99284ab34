"""Sharding by longest-processing-time scheduling.

Rows of equal text form a group that must stay together.  Groups go to shards in order of
size, largest first (ties by the group's hash), each to the least-loaded shard of a heap (ties to the lowest): every group at any number of
groups.  Groups of one size are interchangeable, so the heap runs over the histogram of sizes:
(size, number of groups), and a run of equal sizes is dealt in rounds in which every shard that takes part gets one group.
``deal`` writes each run as stretches of ranks (first rank, number, shards in turn); a group finds its shard by its rank
among the groups of its size.  All but the ranking is as large as the histogram: with d different sizes the data hold at
least d^2 / 2 bytes, so there are at most 1.5e7 sizes in 100 TB, and some 1e5 in practice.

The law is ``bytes``: a row's size is its text's UTF-8 bytes plus 16.  Slots number a shard's rows
from 0 without gaps, in the order of reading: each input partition numbers its own rows of a shard, after
those of the partitions before it.

Defined results: null text counts as empty (size 16) and forms one group with empty texts; a null id
passes through; repeated rows stay together and get slots of their own; a group above a shard's share makes that shard larger; an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattle.llm.common import materialize, text_or_empty
from wattle.llm.registry import register, table

#: Groups of one size are ranked in pieces by so many leading hexadecimal digits of their hash.
RANK_DIGITS = 3
#: Histogram rows held on the driver at once while dealing.
HISTOGRAM_ROWS = 100_000


class Loads:
    """Loads of the shards while groups are dealt by falling size."""

    def __init__(self, shards: int):
        self.loads = [0] * shards

    def deal(self, size: int, number: int) -> Iterator[tuple[int, int, list[int]]]:
        """(first rank, number, shards in turn): where ``number`` groups of ``size`` go, as the heap would send them one by one.

        A shard that is served ends above all that are less than ``size`` over the least one, so those are served once each,
        by load, and then again in the same order, until the next shard comes within reach.
        """
        first = 0
        while first < number:
            order = sorted(range(len(self.loads)), key=lambda k: (self.loads[k], k))
            least = self.loads[order[0]]
            within = [k for k in order if self.loads[k] < least + size]
            rounds = (number - first) // len(within)
            if len(within) < len(order):
                # rounds that start before the next shard is within reach of the least one
                rounds = min(rounds, (self.loads[order[len(within)]] - least) // size)
            if rounds:
                taken = rounds * len(within)
                for k in within:
                    self.loads[k] += rounds * size
            else:
                # one more, or the rest of a round
                within = within[:number - first]
                taken = len(within)
                for k in within:
                    self.loads[k] += size
            yield first, taken, within
            first += taken


def lpt(items: Iterable[tuple[str, int]], shards: int) -> dict[str, int]:
    """name -> shard of items by falling size, ties by name; the scheduler for a list that fits in memory."""
    loads, out = Loads(shards), {}
    by_size: dict[int, list[str]] = {}
    for name, size in items:
        by_size.setdefault(size, []).append(name)
    for size in sorted(by_size, reverse=True):
        names = sorted(by_size[size])
        for first, taken, turn in loads.deal(size, len(names)):
            for i in range(taken):
                out[names[first + i]] = turn[i % len(turn)]
    return out


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, size, crc, group) of each row, a written table."""
    text = text_or_empty(text_col)
    return materialize(df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), (F.octet_length(text) + 16).cast("bigint").alias("size"),
                                 F.crc32(text.cast("binary")).alias("crc"), F.sha2(text, 256).alias("group")), "shard-rows")


def ranked(rows: DataFrame) -> DataFrame:
    """(group, bytes, rank): every group with its rank by hash among those of its size, from 0.

    Pieces by the hash's first digits are ranked each on its own and their sizes summed, so no window holds all groups of a frequent size.
    """
    groups = rows.groupBy("group").agg(F.sum("size").alias("bytes")).withColumn("piece", F.substring("group", 1, RANK_DIGITS))
    groups = materialize(groups, "shard-groups")
    before = Window.partitionBy("bytes").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.groupBy("bytes", "piece").agg(F.count("*").alias("n")).select("bytes", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    local = F.row_number().over(Window.partitionBy("bytes", "piece").orderBy("group")) - 1
    return groups.withColumn("local", local).join(starts, ["bytes", "piece"]).select("group", "bytes", (F.col("start") + F.col("local")).alias("rank"))


def plan(groups: DataFrame, shards: int) -> DataFrame:
    """(bytes, first, taken, turn): the stretches of ``Loads.deal`` for each size, a written table.

    The driver walks the histogram by falling size, one partition at a time, and writes the stretches in pieces.
    """
    spark = groups.sparkSession
    histogram = groups.groupBy("bytes").agg(F.count("*").alias("n"))
    loads, held, out = Loads(shards), [], None
    schema = "bytes bigint, first bigint, taken bigint, turn array<int>"

    def write(rows):
        return materialize(spark.createDataFrame(rows, schema), "shard-plan", 1)

    for row in histogram.orderBy(F.desc("bytes")).toLocalIterator():
        held += [(row["bytes"], first, taken, turn) for first, taken, turn in loads.deal(row["bytes"], row["n"])]
        if len(held) >= HISTOGRAM_ROWS:
            out, held = write(held) if out is None else out.unionAll(write(held)), []
    last = write(held)
    return last if out is None else out.unionAll(last)


def assign(rows: DataFrame, shards: int) -> DataFrame:
    """``rows`` with shard, by scheduling their groups."""
    groups = materialize(ranked(rows), "shard-ranks")
    stretches = plan(groups, shards)
    within = (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("taken"))
    turn = F.get("turn", ((F.col("rank") - F.col("first")) % F.size("turn")).cast("int"))
    placed = materialize(groups.join(stretches, "bytes").filter(within).select("group", turn.alias("shard")), "shard-placed")
    return rows.join(placed, "group")


def number(rows: DataFrame) -> DataFrame:
    """``rows`` (rid, shard, ...) with slot, gapless from 0 in each shard.

    The rows of one shard in one input partition are numbered together, so no window spans a shard.
    """
    rows = materialize(rows.withColumn("part", F.shiftright("rid", 33)), "shard-assigned")
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    local = F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid")) - 1
    return rows.withColumn("local", local).join(counts, ["shard", "part"]).withColumn("slot", (F.col("first") + F.col("local")).cast("bigint")).drop("part", "first", "local")


def shard(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, crc, shard, slot) of each row."""
    return number(assign(measure(df, id_col, text_col), shards)).drop("rid", "group")


@register("op9_lpt_shards")
def op9_lpt_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shard(table(spark, sf_dir, "documents"), 40)
    return found.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
