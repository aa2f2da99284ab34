"""Columns named like the helpers of the operators that return whole rows, and extreme ids."""

from pyspark.sql import functions as F

from wattle.llm import chosen_path, entropy_mix, quotient_dedup

HELPERS = ["limit", "scale", "cut", "cut2", "cut3", "limit3", "multiplier", "size", "copies", "target", "source_size", "_u", "_i", "_rate", "_sure", "_part", "_key", "_maybe", "_bytes", "_row",
           "_id", "_k", "id", "rid", "fp", "sha", "n_chars", "col0", "col1", "component", "low"]
WORDS = "one two three four five six seven eight nine ten eleven twelve"


def rows(spark):
    texts = [WORDS, WORDS, WORDS + " thirteen", "a b", "ab", None, "", "other words that stand alone in this table"]
    data = [(i, t, "s" if i % 2 else "r", *(f"{h}{i}" for h in HELPERS)) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "doc_id long, text string, source string, " + ", ".join(f"`{h}` string" for h in HELPERS))


def test_exact_and_near(spark):
    df = rows(spark)
    for operator, want in ((quotient_dedup.deduplicate, [0, 2, 3, 5, 7]), (chosen_path.deduplicate, [0, 3, 4, 5, 6, 7])):
        out = operator(df)
        assert out.columns == df.columns and sorted(r.doc_id for r in out.collect()) == want
        assert all(r["_id"] == f"_id{r.doc_id}" and r["limit"] == f"limit{r.doc_id}" for r in out.collect())


def test_mix(spark):
    df = rows(spark)
    out = entropy_mix.mix(df)
    plain = entropy_mix.mix(df.select("doc_id", "text", "source"))
    assert out.columns == df.columns
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in plain.collect())
    assert all(r["cut"] == f"cut{r.doc_id}" for r in out.collect())


def test_extreme_and_text_ids(spark):
    df = spark.createDataFrame([(-(1 << 63), "a b"), ((1 << 63) - 1, "ab"), (None, "a b"), (5, "x")], "doc_id long, text string")
    kept = {r.id: r.keep_id for r in quotient_dedup.classes(df).collect()}
    assert kept == {-(1 << 63): -(1 << 63), (1 << 63) - 1: -(1 << 63), None: -(1 << 63), 5: 5}
    assert sorted(r.doc_id for r in quotient_dedup.deduplicate(df).collect()) == [-(1 << 63), 5]
    named = df.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert sorted(r.doc_id for r in quotient_dedup.deduplicate(named).collect()) == ["d-9223372036854775808", "d5"]
