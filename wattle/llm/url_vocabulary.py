"""URL filter: a weighted vocabulary counted with an Aho-Corasick automaton.

Host rules decide first: a rule fits its host and all subdomains when the path
starts with the rule's path, and the longest fitting rule wins.  Every other
URL goes to the vocabulary: terms are searched in the lower-cased URL in one pass
and count only between boundaries (no ASCII letter or digit next to them); one
strict term, or ``soft_limit`` distinct soft terms, blocks the page.

Defined results: a null URL or one without ``://`` has an empty host and path, no
rule, and is judged by the vocabulary alone (null: allow); ties between equally
long rules go to the first given; repeated rows give equal rows; an empty table
gives an empty one; of other columns only the id is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattle.llm.registry import register, table

#: (host, path, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
STRICT = ("porn", "porno", "pornhub", "xxx", "xvideos", "hentai", "camgirls", "milf", "hardcore-sex", "sex-cams", "escorts", "warez", "keygen", "torrentz", "adult-x")
SOFT = ("adult", "sex", "sexy", "nude", "naked", "casino", "casinos", "bet", "bets", "betting", "poker", "slots", "jackpot", "gamble", "gambling", "viagra",
        "cialis", "pills", "pharmacy", "replica", "escort", "dating", "hookup", "win", "free", "bonus", "cheap", "loan", "loans", "payday", "crack", "cracked", "torrent", "spam", "farm", "ads", "track", "tracker")


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL; both empty without ``://``."""
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(host, upper, lower), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as ``struct(rule, verdict)``; null if none fits."""
    ranked = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule_host, rule_path, verdict in reversed(ranked):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def count_terms(df: DataFrame, url_col: str = "url", strict=STRICT, soft=SOFT) -> DataFrame:
    """``df`` with n_strict, n_soft (distinct terms between boundaries) and the terms found."""
    strict, soft = tuple(t.lower() for t in strict), tuple(t.lower() for t in soft)
    word = re.compile("[a-z0-9]")

    @F.pandas_udf("n_strict int, n_soft int, terms string")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for weight, terms in ((1, soft), (2, strict)):
            for term in terms:
                machine.add_word(term, (weight, term))
        machine.make_automaton()
        for urls in batches:
            rows = []
            for url in urls:
                # A-Z only, so that positions and boundaries are those of the URL itself
                text = "" if url is None else url.translate(_LOWER)
                found = set()
                for end, (weight, term) in machine.iter(text):
                    start = end - len(term) + 1
                    if not (start and word.match(text[start - 1])) and not word.match(text[end + 1:end + 2]):
                        found.add((weight, term))
                rows.append((sum(w == 2 for w, _ in found), sum(w == 1 for w, _ in found), ",".join(sorted(t for _, t in found))))
            yield pd.DataFrame(rows, columns=["n_strict", "n_soft", "terms"])

    return df.withColumn("_c", count(F.col(url_col))).select("*", "_c.*").drop("_c")


_LOWER = {c: c + 32 for c in range(65, 91)}


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = 2) -> DataFrame:
    """(id, host, path, rule, verdict, n_strict, n_soft, terms) for each row."""
    host, path = host_path(F.col("url"))
    rows = df.select(F.col(id_col).alias(id_col), F.col(url_col).alias("url"))
    rows = rows.select(id_col, "url", host.alias("host"), path.alias("path"))
    rows = count_terms(rows.withColumn("_r", fitting_rule(F.col("host"), F.col("path"), rules)), "url", strict, soft)
    rejected = (F.col("n_strict") >= 1) | (F.col("n_soft") >= soft_limit)
    return rows.select(id_col, "host", "path", F.col("_r.rule").alias("rule"),
                       F.coalesce(F.col("_r.verdict"), F.when(rejected, "block").otherwise("allow")).alias("verdict"), "n_strict", "n_soft", "terms")


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    hit = lambda t: f"regexp_matches(u, '(^|[^a-z0-9]){re.escape(t)}([^a-z0-9]|$)')"
    terms = lambda ts: " + ".join(f"{hit(t)}::INT" for t in ts)
    ranked = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    case = lambda pick, other: "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{pick(h, p, v)}'" for h, p, v in ranked) + f" ELSE {other} END"
    found = "concat_ws(',', " + ", ".join(f"CASE WHEN {hit(t)} THEN '{t}' END" for t in sorted({*STRICT, *SOFT})) + ")"
    return f"""
WITH a AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
r AS (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest, translate(url, '{upper}', '{lower}') AS u FROM a),
h AS (SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
n AS (SELECT *, ({terms(STRICT)})::INT AS n_strict, ({terms(SOFT)})::INT AS n_soft, {found} AS terms FROM h)
SELECT page_id, host, path, {case(lambda h, p, v: h + p, 'NULL')} AS rule,
       {case(lambda h, p, v: v, "CASE WHEN n_strict >= 1 OR n_soft >= 2 THEN 'block' ELSE 'allow' END")} AS verdict, n_strict, n_soft, terms
FROM n"""


@register("op3_url_vocabulary", _sql())
def op3_url_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
