"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Every source has a target number of words.  Among all document rates r (copies
per document, 0 to 2) whose expected words meet the targets, the one closest to
"each document once" in relative entropy is r = min(2, exp(lambda_s * size)): the convex
dual has one multiplier per source, found by Newton steps that are each one join and one
partial aggregation over the (source, size) histogram.  A bracket guards the
steps (bisection where Newton would leave it).

Rates become copies by order sampling: floor(r) copies for sure, and the fraction
f as a further copy for the documents of smallest u / f (u: a hash of the row), up to
the source's target.  The cut-off key of each source is found by narrowing histograms
of the keys (two rounds of 32,768 cells), so no source is sorted or gathered in one place.  The
document at the cut leaves a gap of at most its own size; a second cut, among the later
documents that are no larger than the gap, narrows it, and a third one, among the documents
no larger than what is left that may have one more copy, closes it to about a short document.

Sums are exact (decimal), so reruns and other partitionings give the same copies.

Defined results: null text has size 0; a null source is a source of its own, last in
order; rows of size 0 and rows of sources without words are taken once (0 words either way);
repeated rows share their hash and are decided alike; an empty table gives an empty one;
other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattle.llm.common import materialize, shielded, text_or_empty
from wattle.llm.registry import register, table

CAP = 2
#: Rates are counted in units of 1 / UNIT, so that their sums are exact.
UNIT = 10**9
KEY_BITS, STEP_BITS = 30, 15


def size_of(text: str = "text") -> Column:
    """Number of runs of other characters than ASCII white space."""
    # one mark per word start: what follows white space or the text's start
    return F.regexp_count(text_or_empty(text), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def _draw(id_col: str, source_col: str, size: str) -> Column:
    """Uniform integer in [0, 2^52) from the row's content."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(17), F.col(id_col), F.col(source_col), F.col(size)), 12)


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` times all
    words; a target stops at CAP times its source's size and the excess goes to the others by
    weight.  That fills a common level: with L = level, target = min(CAP * size, L * weight).
    Sources sorted by the level at which they are full tell L from running sums.
    One row per source, so the windows without a partition key see only these.
    """
    total = Window.partitionBy()
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")))
    rows = sources.withColumn("w", F.element_at(cycle, ((rank - 1) % len(weights) + 1).cast("int")).cast("double"))
    rows = rows.withColumn("full", F.lit(float(CAP)) * F.col("source_size") / F.col("w"))
    order = Window.orderBy("full", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    want = F.lit(float(share)) * F.sum("source_size").over(total)
    # level if this source and all later ones are below their caps
    level = (want - F.lit(float(CAP)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    # levels fall from the first such source on
    rows = rows.withColumn("level", F.max(F.when(level <= F.col("full"), level)).over(total))
    target = F.least(F.lit(float(CAP)) * F.col("source_size"), F.coalesce(F.col("level"), F.lit(float("inf"))) * F.col("w"))
    return rows.select("source", "source_size", target.alias("target"))


def _joined(left: DataFrame, sources: DataFrame, source_col: str = "source") -> DataFrame:
    """Inner join on the source, null included.  No hint: a few sources are broadcast by
    their measured size, many are joined by sorting, and Spark splits a hot one."""
    both = sources.withColumnRenamed("source", "_s")
    return left.join(both, _same(source_col, "_s")).drop("_s")


def _rate(size: Column, scale: Column, multiplier: Column) -> Column:
    """Units of min(CAP, exp(multiplier * size / scale))."""
    return F.round(F.least(F.lit(float(CAP)), F.exp(F.least(multiplier * size / scale, F.lit(1.0)))) * UNIT).cast("bigint")


def solve(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5, rounds: int = 40, close: float = 1e-6) -> DataFrame:
    """(source, source_size, target, scale, multiplier) of the entropy-balancing dual.

    ``sized`` has source and size.  The loop collects one number per round, the largest relative miss.
    """
    histogram = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("rows"),
                                              F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"))
    goal = targets(sources.select("source", "source_size"), weights, share)
    state = _joined(sources.drop("source_size"), goal).filter("source_size > 0")
    state = state.withColumn("scale", F.col("source_size") / F.col("rows")).withColumn("x", F.col("least") / F.col("scale"))
    # all rates reach the cap at ln(CAP) / x; below ln(target / size) / x they miss the target for sure
    high = F.lit(math.log(CAP)) / F.col("x")
    state = state.select("source", "source_size", "target", "scale",
                         F.least(F.lit(0.0), F.log(F.col("target") / F.col("source_size")) / F.col("x")).alias("low"), high.alias("high"),
                         F.when(F.col("target") >= CAP * F.col("source_size"), high).otherwise(0.0).alias("multiplier"), F.lit(None).cast("double").alias("miss"))
    state = materialize(state, "mix-dual")
    positive = histogram.filter("size > 0")
    units = lambda c: c.cast("decimal(38,0)")
    for _ in range(rounds):
        rate = _rate(F.col("size"), F.col("scale"), F.col("multiplier"))
        rows = _joined(positive, state).withColumn("rate", rate).withColumn("words", units(F.col("size") * F.col("n")))
        moving = F.when(F.col("rate") < CAP * UNIT, units(F.col("rate")) * F.col("words") * F.col("size")).otherwise(units(F.lit(0)))
        step = rows.groupBy("source").agg(
            *[F.max(c).alias(c) for c in ("source_size", "target", "scale", "low", "high", "multiplier")],
            (F.sum((units(F.col("rate")) * F.col("words")).cast("decimal(38,0)")).cast("double") / UNIT).alias("words"),
            (F.sum(moving.cast("decimal(38,0)")).cast("double") / UNIT).alias("slope"),
        )
        miss = F.col("words") / F.col("target") - 1
        step = step.withColumn("miss", miss)
        step = step.withColumn("low", F.when(miss <= 0, F.col("multiplier")).otherwise(F.col("low"))).withColumn("high", F.when(miss > 0, F.col("multiplier")).otherwise(F.col("high")))
        # Newton on the logarithm of the words taken, which is nearly straight in the multiplier
        newton = F.col("multiplier") - F.log(F.col("words") / F.col("target")) * F.col("words") / (F.col("slope") / F.col("scale"))
        inside = F.coalesce((newton > F.col("low")) & (newton < F.col("high")), F.lit(False))
        settled = F.abs(F.col("miss")) <= close
        step = step.withColumn("multiplier", F.when(settled, F.col("multiplier")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2))
        state = materialize(step.select("source", "source_size", "target", "scale", "low", "high", "multiplier", "miss"), "mix-dual")
        left = state.agg(F.max(F.when(F.col("high") - F.col("low") > 1e-12, F.abs("miss")))).first()[0]
        if left is None or left <= close:
            break
    return state.select("source", "source_size", "target", "scale", "multiplier")


def _sampled(sized: DataFrame, dual: DataFrame) -> DataFrame:
    """``sized`` with its source's dual, sure copies and the key of a further one (null: none)."""
    rows = _joined(sized, dual).withColumn("_rate", _rate(F.col("size"), F.col("scale"), F.col("multiplier")))
    sure = F.floor(F.col("_rate") / UNIT)
    rows = rows.withColumn("_sure", sure).withColumn("_part", F.col("_rate") - sure * UNIT)
    ratio = (F.col("_u") / float(2**52)) / (F.col("_part") / float(UNIT))
    key = F.least(F.floor(ratio / (ratio + 1) * float(2**KEY_BITS)), F.lit(2**KEY_BITS - 1))
    return rows.withColumn("_key", F.when((F.col("_part") > 0) & (F.col("size") > 0), key).cast("bigint"))


def fit(sized: DataFrame, weights=(3, 1, 2), share: float = 1.5) -> DataFrame:
    """One row per source, the dual and the cuts: all that decides a row's copies.

    ``sized`` (source, size, _u) is read several times: pass a written table.
    """
    dual = solve(sized.select("source", "size"), weights, share)
    rows = materialize(_sampled(sized.select("source", "size", "_u"), dual).select("source", "size", "_sure", "_key", "_u"), "mix-keys")
    need = rows.groupBy("source").agg(F.sum(F.col("_sure") * F.col("size")).alias("sure"))
    state = _joined(dual, need).select(*DUAL, (F.col("target") - F.col("sure")).alias("need"))
    keyed = rows.filter("_key is not null").select("source", "size", "_key")
    first = _cut(keyed, state, last=False).select(*DUAL, "need", F.col("low").alias("cut"))
    first = materialize(first, "mix-model")
    later = _joined(keyed, first.select("source", "cut", "need")).filter("_key >= cut and size <= need").select("source", "size", "_key")
    second = _cut(later, first.withColumn("limit", F.col("need")), last=False).withColumnRenamed("low", "cut2")
    second = materialize(second, "mix-model").withColumn("limit3", F.col("need"))
    spare = _joined(rows, second.select("source", "cut", "limit", "cut2", "limit3"))
    spare = spare.filter((F.col("size") > 0) & (F.col("size") <= F.col("limit3")) & (F.col("_sure") + _chosen() < CAP)).select("source", "size", _third().alias("_key"))
    third = _cut(spare, second, last=True).withColumnRenamed("low", "cut3")
    return materialize(third.select(*DUAL, *CUTS), "mix-model")


DUAL = ("source", "source_size", "target", "scale", "multiplier")
CUTS = ("cut", "limit", "cut2", "limit3", "cut3")


def _chosen() -> Column:
    """1 for rows that the first two cuts give one more copy, else 0."""
    return F.when((F.col("_key") < F.col("cut")) | ((F.col("size") <= F.col("limit")) & (F.col("_key") < F.col("cut2"))), 1).otherwise(0)


def _third() -> Column:
    """Key of the third cut: other bits of the row's hash."""
    return F.col("_u").bitwiseAND(2**KEY_BITS - 1)


def _cut(keyed: DataFrame, state: DataFrame, last: bool) -> DataFrame:
    """``state`` with ``low``, the key below which the rows of ``keyed`` are taken, and the words then needed.

    The words taken stay below those needed, but with ``last`` the key at the cut is taken if that is nearer.
    """
    columns = state.columns
    state = state.withColumn("low", F.lit(0).cast("bigint"))
    for width in range(KEY_BITS - STEP_BITS, -1, -STEP_BITS):
        # keys below ``low`` are taken, ``need`` words are wanted from the cells that follow
        state = materialize(state, "mix-cut")
        cell = F.shiftright(F.col("_key") - F.col("low"), width)
        cells = (_joined(keyed, state.select("source", "low")).filter((F.col("_key") >= F.col("low")) & (cell < 2**STEP_BITS))
                 .groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words")))
        # at most 2^STEP_BITS cells of each source
        running = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
        at = _joined(cells, state.select("source", "need"))
        # the cell in which the wanted words run out, else past the last one
        hit = F.min(F.when(F.col("before") + F.col("words") > F.col("need"), F.struct("cell", "before", "words"))).alias("hit")
        found = at.groupBy("source").agg(hit, F.max("cell").alias("top"), F.sum("words").alias("all")).withColumnRenamed("source", "_s")
        state = state.join(found, _same("source", "_s"), "left").drop("_s")
        cell = F.coalesce(F.col("hit.cell"), F.col("top") + 1, F.lit(0))
        spent = F.coalesce(F.col("hit.before"), F.col("all"), F.lit(0))
        if last and width == 0:
            cell = cell + F.when(F.col("hit.words") / 2 <= F.col("need") - F.col("hit.before"), 1).otherwise(0)
        left = (F.col("need") - spent).alias("need")
        state = state.select(*[left if c == "need" else F.col(c) for c in columns], (F.col("low") + F.shiftleft(cell.cast("bigint"), width)).alias("low"))
    return state


def _same(left: str, right: str) -> Column:
    return (F.coalesce(F.col(left), F.lit("")) == F.coalesce(F.col(right), F.lit(""))) & (F.col(left).isNull() == F.col(right).isNull())


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: bool = False) -> DataFrame:
    """(id, source, size, _u) of each row, or with ``keep`` the row itself with size and _u."""
    sized = df.withColumn("size", size_of(text_col)) if keep else df.select(F.col(id_col), F.col(source_col).alias("source"), size_of(text_col).alias("size"))
    return sized.withColumn("_u", _draw(id_col, source_col if keep else "source", "size"))


def copies(sized: DataFrame, model: DataFrame) -> DataFrame:
    """``sized`` with source_size, target and copies (0 to CAP)."""
    rows = _sampled(sized, model)
    given = F.col("_sure") + _chosen()
    more = F.when((given < CAP) & (F.col("size") <= F.col("limit3")) & (_third() < F.col("cut3")), 1).otherwise(0)
    rows = rows.withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(given + more).cast("int"))
    return rows.drop("scale", "multiplier", *CUTS, "_rate", "_sure", "_part", "_key", "_u")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=(3, 1, 2), share: float = 1.5) -> DataFrame:
    """The mix itself: each row of ``df`` as many times as it has copies, columns unchanged.

    Copies depend on a row's id, source and size and on one small row per source only, so
    the second pass over the texts needs no join by id and moves no text.
    """
    own = df.columns
    df, (id_col, text_col, source_col) = shielded(df, id_col, text_col, source_col)
    sized = materialize(measure(df, id_col, text_col, source_col), "mix-sizes")
    model = fit(sized, weights, share)
    rows = measure(df, id_col, text_col, source_col, keep=True)
    # sources without words have no model row: size 0, taken once
    empty = F.col("size") == 0
    taken = copies(rows.filter(~empty).withColumnRenamed(source_col, "source"), model).withColumnRenamed("source", source_col)
    taken = taken.filter("copies > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*df.columns)
    return taken.unionByName(rows.filter(empty).select(*df.columns)).toDF(*own)


@register("op4_entropy_mix")
def op4_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = materialize(measure(table(spark, sf_dir, "documents")), "mix-sizes")
    model = fit(sized)
    decided = copies(sized, model).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
    # sources without any word have no dual
    rest = _without(sized, model).select("doc_id", "size", F.lit(0).cast("bigint").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("bigint").alias("taken"))
    return decided.unionByName(rest)


def _without(sized: DataFrame, model: DataFrame) -> DataFrame:
    named = model.select(F.col("source").alias("_s"))
    return sized.join(named, _same("source", "_s"), "left_anti")
