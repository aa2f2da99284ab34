"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans, per kind leftmost and non-overlapping: ``assign`` (a keyword, ``:`` or
``=``, a value of 8+ characters), ``access`` (AKIA identifiers of 16+), ``hex``
(32+ lower-case hex digits).  They are always reported.

Weak candidates are parts of a credential that mean little alone: ``ident`` (an
account or key id assigned by name), ``short`` (an assignment whose value is too
short for a base span), ``key40`` (a lone run of 40 base64 characters of mixed
case with a digit) and ``endpoint`` (a URL or connection string).  A weak
candidate that overlaps a base span is dropped; the others are reported only
if a complementary part (base or weak) lies within ``scope`` code points: a secret
for an identifier or an endpoint, an identifier or an endpoint for a secret.  That is an
interval join on (row, role, scope cell) against one summary per cell (smallest
start, largest end), so it never lists the pairs of a scope.

Positions: a text equals its gaps (``split``) interleaved with its matches
(``regexp_extract_all``), so ends are running sums of their lengths in code points, taken
by a window over a text's gaps and matches.  All work is linear in a text and its matches, but for sorting.

Defined results: null text counts as empty (no span); a null id passes through;
repeated rows are scanned each on its own; ties are ordered by start, then kind in the
order above; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wattle.llm.common import materialize, text_or_empty
from wattle.llm.registry import register, table

KINDS = ("assign", "access", "hex", "ident", "short", "key40", "endpoint")
ROLE = {"assign": "secret", "hex": "secret", "access": "id", "ident": "id", "short": "secret", "key40": "secret", "endpoint": "endpoint"}

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
IDENT = r"""(?i:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
KEY40 = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/=])"
ENDPOINT = r"""[a-z][a-z0-9+]*://[^\x20\x09-\x0D"'<>]+"""
#: A run long enough for hex or key40.
LONG_RUN = r"(?<![A-Za-z0-9+/])[A-Za-z0-9+/]{32}"

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"
PIECE = "array<struct<pattern:int,gap:int,hit:int,kind:int>>"


def _pieces(text: Column, pattern: int, regex: str, kind) -> Column:
    """The text as gaps, each with the match after it: lengths in code points, and the match's ``kind`` (-1: none)."""
    zipped = F.arrays_zip(F.split(text, regex, -1).alias("gap"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("hit"))
    return F.transform(zipped, lambda x: F.struct(
        F.lit(pattern).alias("pattern"), F.coalesce(F.length(x["gap"]), F.lit(0)).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"),
        F.when(x["hit"].isNull(), -1).otherwise(kind(x["hit"])).alias("kind"))).cast(PIECE)


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(rid, id, pieces): each row's gaps and matches of every pattern.

    Cheap tests that every match passes (a ``:`` or ``=``, ``AKIA``, ``://``, a long run)
    keep the regexes off texts that cannot match.
    """
    t = F.col("_t")
    named = t.contains(":") | t.contains("=")
    run = t.rlike(LONG_RUN)
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text_or_empty(text_col).alias("_t"))
    rows = rows.select("rid", "id", "_t", named.alias("_named"), run.alias("_run"))
    is_kind = lambda name: F.lit(KINDS.index(name))
    value = lambda hit: F.when(F.length(F.regexp_extract(hit, ASSIGN, 2)) >= 8, is_kind("assign")).otherwise(is_kind("short"))
    mixed = lambda hit: F.when(hit.rlike("[0-9]") & hit.rlike("[A-Z]") & hit.rlike("[a-z]"), is_kind("key40")).otherwise(-1)
    patterns = ((F.col("_named"), ASSIGN, value), (t.contains("AKIA"), ACCESS, lambda _: is_kind("access")), (F.col("_run"), HEX, lambda _: is_kind("hex")),
                (F.col("_named"), IDENT, lambda _: is_kind("ident")), (F.col("_run"), KEY40, mixed), (t.contains("://"), ENDPOINT, lambda _: is_kind("endpoint")))
    found = [F.coalesce(F.when(may, _pieces(t, i, regex, kind)), F.array().cast(PIECE)) for i, (may, regex, kind) in enumerate(patterns)]
    return rows.select("rid", "id", F.concat(*found).alias("pieces"))


def located(scanned: DataFrame) -> DataFrame:
    """(rid, start, end, kind) of every match of ``scan``; code points, end exclusive."""
    spread = scanned.filter(F.exists("pieces", lambda x: x["kind"] >= 0)).select("rid", F.posexplode("pieces").alias("_at", "_p"))
    along = Window.partitionBy("rid", "_p.pattern").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum((F.col("_p.gap") + F.col("_p.hit")).cast("bigint")).over(along)
    spread = spread.select("rid", F.col("_p.hit").alias("_hit"), F.col("_p.kind").alias("kind"), end.alias("end")).filter("kind >= 0")
    return spread.select("rid", (F.col("end") - F.col("_hit")).alias("start"), "end", "kind")


#: Kinds from this one on are weak.
_WEAK = KINDS.index("ident")


def link(found: DataFrame, scope: int = 400) -> DataFrame:
    """(rid, start, end, kind): the weak candidates of ``located`` that have a complementary part within ``scope``."""
    role = F.element_at(F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (i, ROLE[k])]), F.col("kind"))
    weak = (F.col("kind") >= _WEAK).cast("int")
    some = found.join(found.filter(F.col("kind") >= _WEAK).select("rid").distinct(), "rid", "left_semi")
    parts = some.select("rid", "start", weak.alias("weak"), "kind", "end", role.alias("role"))
    # a weak candidate under a base span goes: the base spans around it tell, from both sides (frames that
    # look back grow row by row; one that looks ahead would start anew at every row)
    before = Window.partitionBy("rid").orderBy("start", "weak", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy("rid").orderBy(*(F.desc(c) for c in ("start", "weak", "kind", "end"))).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("*", F.max(F.when(F.col("weak") == 0, F.col("end"))).over(before).alias("_before"),
                         F.min(F.when(F.col("weak") == 0, F.col("start"))).over(after).alias("_after"))
    covered = (F.col("weak") == 1) & (F.coalesce(F.col("_before") > F.col("start"), F.lit(False)) | F.coalesce(F.col("_after") < F.col("end"), F.lit(False)))
    parts = materialize(parts.filter(~covered).drop("_before", "_after"), "credential-parts")
    cell = lambda c: F.floor(c / scope)
    # one summary per (row, role, cell); a part counts in every cell from its start to its end
    cells = (parts.select("rid", "role", "start", "end", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))).alias("cell"))
             .groupBy("rid", "role", "cell").agg(F.min("start").alias("first"), F.max("end").alias("last")))
    wanted = F.when(F.col("role") == "secret", F.array(F.lit("id"), F.lit("endpoint"))).otherwise(F.array(F.lit("secret")))
    probes = (parts.filter("weak = 1")
              .select("rid", "start", "kind", "end", F.explode(wanted).alias("role"))
              .select("*", F.explode(F.sequence(cell(F.greatest(F.col("start") - scope, F.lit(0))), cell(F.col("end") + scope))).alias("cell")))
    near = (F.col("first") <= F.col("end") + scope) & (F.col("last") >= F.col("start") - scope)
    return probes.join(cells, ["rid", "role", "cell"]).filter(near).select("rid", "start", "end", "kind").distinct()


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = 400) -> DataFrame:
    """(id, base, spans) for each row, spans as arrays of (start, kind index, end) in order."""
    scanned = materialize(scan(df, id_col, text_col), "secret-scan")
    found = materialize(located(scanned), "secret-spans")
    every = found.filter(F.col("kind") < _WEAK).unionByName(link(found, scope))
    span = F.struct("start", "kind", "end")
    per = every.groupBy("rid").agg(F.sort_array(F.collect_list(F.when(F.col("kind") < _WEAK, span))).cast(SPAN).alias("base"), F.sort_array(F.collect_list(span)).cast(SPAN).alias("spans"))
    none = F.array().cast(SPAN)
    return scanned.select("rid", "id").join(per, "rid", "left").select("id", F.coalesce("base", none).alias("base"), F.coalesce("spans", none).alias("spans"))


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _sql(scope: int = 400) -> str:
    """The same in SQL: matches and gaps unfolded, weak candidates linked by comparing the spans of each document."""
    quoted = lambda regex: "'" + regex.replace("'", "''") + "'"
    # a run of exactly 40 is a whole run of its characters
    regexes = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "key40": "[A-Za-z0-9+/]+", "endpoint": ENDPOINT}
    found = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, regexp_extract_all(t, {quoted(r)}) AS hits, string_split_regex(t, {quoted(r)}) AS gaps FROM d WHERE regexp_matches(t, {quoted(r if k != 'key40' else '[A-Za-z0-9+/]{40}')})" for k, r in regexes.items())
    kinds = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    text = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no, e)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({found}),
x AS (SELECT doc_id, kind, hits[i] AS hit, gaps[i + 1] AS following,
       list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0) AS s
      FROM (SELECT *, unnest(generate_series(1, len(hits))) AS i FROM f)),
v AS (SELECT doc_id, CASE WHEN kind = 'assign' AND length(regexp_extract(hit, {quoted(ASSIGN)}, 2)) < 8 THEN 'short' ELSE kind END AS kind, s::BIGINT AS s, (s + length(hit))::BIGINT AS e
      FROM x WHERE kind <> 'key40' OR (length(hit) = 40 AND NOT starts_with(following, '=') AND regexp_matches(hit, '[0-9]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[a-z]'))),
k AS (SELECT *, list_position({kinds}, kind) AS no, CASE WHEN kind IN ('access', 'ident') THEN 'id' WHEN kind = 'endpoint' THEN 'endpoint' ELSE 'secret' END AS role FROM v),
base AS (SELECT * FROM k WHERE no <= 3),
weak AS (SELECT * FROM k w WHERE no > 3 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = w.doc_id AND b.s < w.e AND w.s < b.e)),
parts AS (SELECT * FROM base UNION ALL SELECT * FROM weak),
linked AS (SELECT * FROM weak w WHERE EXISTS (SELECT 1 FROM parts p WHERE p.doc_id = w.doc_id AND (w.role = 'secret') <> (p.role = 'secret') AND p.s <= w.e + {scope} AND p.e >= w.s - {scope})),
b AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, {text} AS spans FROM base GROUP BY doc_id),
a AS (SELECT doc_id, {text} AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b.spans, '')) AS base_sha256, coalesce(a.spans, '') AS spans
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN a USING (doc_id)"""


@register("op2_secret_linking", _sql())
def op2_secret_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("bigint")
    return found.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
                        F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
