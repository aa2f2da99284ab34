"""Saved search indexes over the names of a table (T1-T4, F3, O6): postings of stems, of trigrams, and names in order.

``build`` writes three tables, each once:

* ``names``: (id, name, upper), sorted by ``upper`` over range partitions, so a prefix reads the row groups whose
  statistics can hold it;
* ``postings``: (stem, id, position), sorted by stem.  Each distinct token is stemmed once;
* ``grams``: (gram, id), the distinct three-letter pieces of every name, sorted by gram, and ``gram_counts``.

``NameIndex`` answers from them: all tokens of a query (an equality join with a count), a substring (the rarest piece's rows, then the
text itself), a prefix (a range).  No query reads all names, but for substrings shorter than a piece.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from wattle.functions.stemming import STOP_WORDS, stem
from wattle.functions.text import escape_like

#: Words are what stands between other characters than these.
_NOT_WORD = r"[^\p{L}\p{N}]+"
GRAM = 3


@F.pandas_udf(StringType())
def stemmed(words: pd.Series) -> pd.Series:
    return words.map(stem)


def tokens(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, position, token): the lower-case words of each text but for stop words; positions count all words, from 1."""
    words = F.filter(F.split(F.lower(F.col(text_col)), _NOT_WORD), lambda t: t != "")
    spread = df.select(F.col(id_col).alias("id"), F.posexplode(words).alias("position", "token"))
    return spread.filter(~F.col("token").isin(*sorted(STOP_WORDS))).withColumn("position", F.col("position") + 1)


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(stem, id, position)."""
    found = tokens(df, id_col, text_col)
    stems = found.select("token").distinct().select("token", stemmed("token").alias("stem"))
    return found.join(stems, "token").select("stem", "id", "position")


def query_stems(query: str) -> list[str]:
    import re
    words = [w for w in re.split(r"[^\w]+|_", query.lower()) if w]
    return sorted({stem(w) for w in words if w not in STOP_WORDS})


def grams(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (gram, id) of the upper-case texts."""
    up = F.upper(F.col(text_col))
    pieces = F.transform(F.sequence(F.lit(1), F.length(up) - (GRAM - 1)), lambda i: F.substr(up, i, F.lit(GRAM)))
    return df.filter(F.length(text_col) >= GRAM).select(F.explode(F.array_distinct(pieces)).alias("gram"), F.col(id_col).alias("id"))


def build(df: DataFrame, id_col: str, text_col: str, folder: str) -> None:
    """Write the index of ``df``'s names; rows without a name are left out."""
    named = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("name"))
    named.withColumn("upper", F.upper("name")).repartitionByRange("upper").sortWithinPartitions("upper").write.parquet(f"{folder}/names")
    postings(named, "id", "name").repartitionByRange("stem", "id").sortWithinPartitions("stem", "id").write.parquet(f"{folder}/postings")
    pieces = grams(named, "id", "name")
    pieces.repartitionByRange("gram", "id").sortWithinPartitions("gram", "id").write.parquet(f"{folder}/grams")
    df.sparkSession.read.parquet(f"{folder}/grams").groupBy("gram").count().write.parquet(f"{folder}/gram_counts")


class NameIndex:
    """Reads a folder that ``build`` wrote."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def matching(self, query: str) -> DataFrame:
        """(id) of the names that hold all words of the query, by stem, stop words aside; none if no word is left."""
        wanted = query_stems(query)
        rows = self.table("postings").filter(F.col("stem").isin(wanted) if wanted else F.lit(False))
        return rows.groupBy("id").agg(F.count_distinct("stem").alias("n")).filter(F.col("n") == len(wanted)).select("id")

    def containing(self, part: str) -> DataFrame:
        """(id, name) of the names with ``part`` in them, whatever the case."""
        up = part.upper()
        pieces = sorted({up[i:i + GRAM] for i in range(len(up) - GRAM + 1)})
        verified = F.col("upper").like(f"%{escape_like(up)}%")
        if not pieces:
            return self.table("names").filter(verified).select("id", "name")
        # at most one row for each piece of the query
        known = {r["gram"]: r["count"] for r in self.table("gram_counts").filter(F.col("gram").isin(pieces)).collect()}
        if len(known) < len(pieces):
            return self.table("names").filter(F.lit(False)).select("id", "name")
        rarest = min(pieces, key=lambda g: (known[g], g))
        ids = self.table("grams").filter(F.col("gram") == rarest).select("id")
        return self.table("names").join(ids, "id", "left_semi").filter(verified).select("id", "name")

    def starting(self, prefix: str) -> DataFrame:
        """(id, name) of the names that start with ``prefix``, whatever the case."""
        return self.table("names").filter(F.col("upper").startswith(prefix.upper())).select("id", "name")
