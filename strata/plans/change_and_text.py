"""Change, closure, resolution, text, fact, patch and job queries."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import text as t
from strata.operators import closure, delta, facts, nav, patch, resolve
from strata.plans import bindings as b
from strata.plans.bindings import with_sql
from strata.plans.registry import joined, query
from strata.streaming import jobs

#: Parts that one query of ``st13`` counts in every text.
MOST_PARTS = 20_000

# --- change between snapshots -------------------------------------------------------------------------------------------


def _snap(f: DataFrame, unhashed: int) -> DataFrame:
    return f.select(F.col("path").alias("file"), F.when(F.col("doc_id") % unhashed != 0, F.col("hash")).alias("hash"), F.length("content").cast("string").alias("print"))


_SNAP = """, s0 AS (SELECT path AS file, CASE WHEN doc_id % 5 <> 0 THEN hash END AS hash, CAST(length(content) AS VARCHAR) AS print FROM file),
s1 AS (SELECT path AS file, CASE WHEN doc_id % 9 <> 0 THEN hash END AS hash, CAST(length(content) AS VARCHAR) AS print FROM file2), delta AS (
SELECT * FROM (SELECT coalesce(s0.file, s1.file) AS file, CASE WHEN s0.file IS NULL THEN 'added' WHEN s1.file IS NULL THEN 'deleted'
  WHEN s0.hash IS NOT NULL AND s1.hash IS NOT NULL THEN CASE WHEN s0.hash <> s1.hash THEN 'changed' END WHEN s0.print <> s1.print THEN 'changed' END AS status FROM s0 FULL JOIN s1 ON s0.file = s1.file) WHERE status IS NOT NULL)
"""


def _delta(spark: SparkSession, d: str) -> DataFrame:
    return delta.diff(_snap(b.files(spark, d), 5), _snap(b.after(spark, d), 9))


@query("gr11_j13_diff", with_sql("file file2", _SNAP + "SELECT * FROM delta"))
def gr11(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d)


@query("gr11_diff_structural", with_sql("file file2", "SELECT * FROM (SELECT coalesce(a.path, z.path) AS file, CASE WHEN a.path IS NULL THEN 'added' WHEN z.path IS NULL THEN 'deleted' WHEN length(a.content) <> length(z.content) THEN 'changed' END AS status FROM file a FULL JOIN file2 z ON a.path = z.path) WHERE status IS NOT NULL"))
def gr11s(spark: SparkSession, d: str) -> DataFrame:
    return delta.diff(_snap(b.files(spark, d), 5), _snap(b.after(spark, d), 9), hashed=False)


@query("ag19_fingerprints", with_sql("fnode", "SELECT file, coalesce(string_agg(qualname || '@' || line_start || '-' || line_end || ':' || signature, '|' ORDER BY qualname || '@' || line_start || '-' || line_end || ':' || signature) FILTER (NOT synthetic), '') AS print FROM (SELECT file, qualname, line_start, line_end, signature, synthetic FROM fnode UNION ALL SELECT 'empty.x', NULL, NULL, NULL, NULL, true) GROUP BY 1"))
def ag19(spark: SparkSession, d: str) -> DataFrame:
    n = b.nodes(spark, d)
    return delta.fingerprints(n.select("file").union(spark.range(1).select(F.lit("empty.x"))), n)


@query("set2_no_facts", "SELECT doc_id AS file FROM documents EXCEPT SELECT doc_id FROM labels")
def set2(spark: SparkSession, d: str) -> DataFrame:
    return delta.no_fact_difference(b.table(spark, d, "documents").select(F.col("doc_id").alias("file")), b.table(spark, d, "labels").select(F.col("doc_id").alias("file")))


@query("set3_refresh_set", with_sql("file file2", _SNAP + "SELECT file FROM delta UNION SELECT path FROM file WHERE doc_id % 10 = 0 UNION SELECT path FROM file WHERE doc_id % 17 = 0"))
def set3(spark: SparkSession, d: str) -> DataFrame:
    f = b.files(spark, d).select(F.col("path").alias("file"), "doc_id")
    return delta.refresh_set(_delta(spark, d), f.where("doc_id % 10 = 0"), f.where("doc_id % 17 = 0"))


@query("set4_j15_known_and_unknown", with_sql("file", "SELECT path AS file, CAST(NULL AS VARCHAR) AS problem FROM file WHERE doc_id % 10 = 0 UNION ALL SELECT 'x' || path, 'not in the scanned tree' FROM file WHERE doc_id % 10 = 1"))
def set4(spark: SparkSession, d: str) -> DataFrame:
    f = b.files(spark, d).select(F.col("path").alias("file"), "doc_id")
    named = f.where("doc_id % 10 = 0").select("file").union(f.where("doc_id % 10 = 1").select(F.concat(F.lit("x"), "file")))
    return delta.known_and_unknown(named, f)


@query("j14_declared_files", with_sql("fnode", ", dec AS (SELECT CASE line_start % 3 WHEN 0 THEN qualname WHEN 1 THEN name ELSE id END AS name FROM fnode WHERE line_start % 5 = 0) SELECT DISTINCT d.name, f.file FROM dec d JOIN fnode f ON d.name IN (f.qualname, f.name, f.id)"))
def j14(spark: SparkSession, d: str) -> DataFrame:
    n, k = b.nodes(spark, d), F.col("line_start") % 3
    return delta.declared_files(n.where("line_start % 5 = 0").select(F.when(k == 0, F.col("qualname")).when(k == 1, F.col("name")).otherwise(F.col("id")).alias("name")), n)


@query("gr14_touched_stages", with_sql("file file2", _SNAP + "SELECT DISTINCT lang AS stage FROM file JOIN delta ON path = file.path AND delta.file = file.path WHERE lang <> 'fr'"))
def gr14(spark: SparkSession, d: str) -> DataFrame:
    a = b.files(spark, d).select(F.col("path").alias("file"), F.when(F.col("lang") == "fr", "unassigned").otherwise(F.col("lang")).alias("stage"))
    return delta.touched_stages(_delta(spark, d), a)


@query(
    "gr16_mark_stale",
    with_sql("file", f"SELECT path AS file, CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN CASE WHEN doc_id % 7 = 0 THEN 'does it{delta.STALE}' ELSE 'does it' END ELSE 'has it{delta.STALE}' END AS purpose FROM file"),
)
def gr16(spark: SparkSession, d: str) -> DataFrame:
    f, k = b.files(spark, d), F.col("doc_id") % 3
    cards = f.select(F.col("path").alias("file"), F.when(k == 0, "").when(k == 1, "does it").otherwise("has it" + delta.STALE).alias("purpose"))
    return delta.mark_stale(cards, f.where("doc_id % 7 = 0").select(F.col("path").alias("file"))).select("file", "purpose")


@query("gr17_roll_forward", with_sql("file file2", "SELECT z.path AS id, coalesce(a.lang, 'unassigned') AS stage FROM file2 z LEFT JOIN file a ON a.path = z.path"))
def gr17(spark: SparkSession, d: str) -> DataFrame:
    return delta.roll_forward(b.after(spark, d).select(F.col("path").alias("id")), b.files(spark, d).select(F.col("path").alias("id"), F.col("lang").alias("stage")))


@query(
    "j17_sk11_live_check",
    with_sql("file file2", "SELECT CASE WHEN a.doc_id % 19 = 0 THEN '../' || a.path ELSE a.path END AS file, CASE WHEN a.doc_id % 19 = 0 THEN 'unsafe' WHEN z.path IS NULL THEN 'deleted' WHEN z.hash <> a.hash THEN 'stale' ELSE 'fresh' END AS state FROM file a LEFT JOIN file2 z ON z.path = a.path"),
)
def j17(spark: SparkSession, d: str) -> DataFrame:
    rec = b.files(spark, d).select(F.when(F.col("doc_id") % 19 == 0, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("file"), "hash")
    return delta.live_check(rec, b.after(spark, d).select(F.col("path").alias("file"), "hash"))


@query("j18_link_problems", "SELECT 'p' || doc_id AS page, 'missing page' AS problem FROM (SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels)) UNION ALL SELECT 'p' || doc_id, 'not linked' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 2 = 0)")
def j18(spark: SparkSession, d: str) -> DataFrame:
    page = F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("page")
    return delta.link_problems(b.table(spark, d, "documents").where("doc_id % 2 = 0").select(page), b.table(spark, d, "labels").select(page))


@query("j21_j24_left_to_do", "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
def j21(spark: SparkSession, d: str) -> DataFrame:
    return delta.without(b.table(spark, d, "documents").select("doc_id", "lang"), b.table(spark, d, "labels"), "doc_id")


@query("j23_chosen_only", "SELECT doc_id, lang FROM documents SEMI JOIN labels USING (doc_id)")
def j23(spark: SparkSession, d: str) -> DataFrame:
    return delta.only(b.table(spark, d, "documents").select("doc_id", "lang"), b.table(spark, d, "labels"), "doc_id")


@query(
    "j22_cache_lookup",
    """WITH q AS (SELECT conv_id, turn, 'm' || (conv_id % 2) AS model, text AS prompt, role AS options FROM conversations),
c AS (SELECT sha256(model || chr(10) || prompt || chr(10) || options) AS key, max(CASE WHEN conv_id % 3 = 0 THEN '  ' ELSE 'got ' || substr(prompt, 1, 20) END) FILTER (conv_id % 3 <> 0) AS reply FROM q WHERE conv_id % 4 <> 1 GROUP BY 1)
SELECT q.conv_id, q.turn, sha256(model || chr(10) || prompt || chr(10) || options) AS key, c.reply FROM q LEFT JOIN c ON c.key = sha256(model || chr(10) || prompt || chr(10) || options) AND trim(c.reply) <> ''""",
)
def j22(spark: SparkSession, d: str) -> DataFrame:
    q = b.table(spark, d, "conversations").select("conv_id", "turn", F.concat(F.lit("m"), (F.col("conv_id") % 2).cast("string")).alias("model"), F.col("text").alias("prompt"), F.col("role").alias("options"))
    cache = q.where("conv_id % 4 <> 1").select(F.sha2(F.concat_ws("\n", "model", "prompt", "options"), 256).alias("key"), F.when(F.col("conv_id") % 3 == 0, "  ").otherwise(F.concat(F.lit("got "), F.substring("prompt", 1, 20))).alias("reply"))
    return delta.cached(q, cache).select("conv_id", "turn", "key", "reply")


@query(
    "gr12_files_from_diff",
    with_sql(
        "file",
        """, u AS (SELECT doc_id, list_value('--- a/' || path, '+++ b/' || path, '@@ -1 +1 @@', '+x', '+++ b//etc/passwd', '--- /dev/null', '+++ b/../up.txt', '+++ b/new' || doc_id || '.txt') AS ls FROM file)
SELECT doc_id, path FROM (SELECT DISTINCT doc_id, unnest(list_filter([regexp_extract(l, '^[+-]{3} [ab]/(.+)$', 1) for l in ls], lambda x: x <> '')) AS path FROM u) WHERE NOT starts_with(path, '/') AND NOT contains(path, '..')""",
    ),
)
def gr12(spark: SparkSession, d: str) -> DataFrame:
    return _from_diff(b.files(spark, d))


def _from_diff(files: DataFrame) -> DataFrame:
    p = F.col("path")
    text = F.concat(F.lit("--- a/"), p, F.lit("\n+++ b/"), p, F.lit("\n@@ -1 +1 @@\n+x\n+++ b//etc/passwd\n--- /dev/null\n+++ b/../up.txt\n+++ b/new"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return files.select("doc_id", F.explode(delta.files_from_diff(text)).alias("path"))


@query("gr15_settle_groups", with_sql("file file2", "SELECT f.lang AS stage, 'g' || (f.doc_id % 4) AS title, count(*) AS n_files, CAST(min(f.doc_id % 4) AS INT) AS group_ord FROM file f JOIN file2 z ON z.path = f.path GROUP BY 1, 2"))
def gr15(spark: SparkSession, d: str) -> DataFrame:
    k = (F.col("doc_id") % 4).cast("int")
    org = b.files(spark, d).select(F.col("lang").alias("stage"), F.concat(F.lit("g"), k.cast("string")).alias("title"), k.alias("group_ord"), F.col("path").alias("file"))
    return delta.settle_groups(org, b.after(spark, d).select(F.col("path").alias("file")))


# --- closures ------------------------------------------------------------------------------------------------------------

_DAG = """, g AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'n' || s_nationkey AS dst FROM customer JOIN supplier ON c_custkey % 40 = s_suppkey % 40 AND c_nationkey % 4 = s_nationkey % 4 WHERE c_nationkey <> s_nationkey)
, n AS (SELECT src AS x FROM g UNION SELECT dst FROM g), r AS (SELECT x AS src, x AS dst FROM n UNION SELECT r.src, g.dst FROM r JOIN g ON g.src = r.dst)
"""


def _graph(spark: SparkSession, d: str) -> DataFrame:
    c, s = b.table(spark, d, "customer"), b.table(spark, d, "supplier")
    pairs = c.join(s, (F.col("c_custkey") % 40 == F.col("s_suppkey") % 40) & (F.col("c_nationkey") % 4 == F.col("s_nationkey") % 4)).where("c_nationkey <> s_nationkey")
    return pairs.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("src"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("dst")).distinct()


@query("gr3_reach", "WITH RECURSIVE " + _DAG.strip().removeprefix(",") + "SELECT src, dst FROM r")
def gr3(spark: SparkSession, d: str) -> DataFrame:
    return closure.reach(_graph(spark, d)).select("src", "dst")


@query("gr3_opaque_headers", "WITH RECURSIVE " + _DAG.strip().removeprefix(",") + "SELECT src, bool_or(dst IN ('n3', 'n7', 'n12')) AS flag FROM r GROUP BY 1")
def gr3_flags(spark: SparkSession, d: str) -> DataFrame:
    flags = spark.range(1).select(F.explode(F.array(*map(F.lit, ("n3", "n7", "n12")))).alias("node"), F.lit(True).alias("flag"))
    return closure.any_over_closure(closure.reach(_graph(spark, d)), flags)


@query(
    "gr4_nearest_ancestor",
    "WITH RECURSIVE "
    + _DAG.strip().removeprefix(",").split(", r AS")[0]
    + """, w AS (SELECT x AS src, x AS dst, 0 AS level FROM n UNION SELECT w.src, g.dst, level + 1 FROM w JOIN g ON g.src = w.dst WHERE level < 6), l AS (SELECT src, dst, min(level) AS level FROM w GROUP BY 1, 2),
h AS (SELECT 'n' || c_nationkey AS node, c_mktsegment AS key, min(c_custkey) AS ord FROM customer WHERE c_custkey % 29 = 0 GROUP BY 1, 2)
SELECT src, key, arg_min(dst, struct_pack(a := level, b := ord, c := dst)) AS dst, min(level) AS level FROM l JOIN h ON node = dst GROUP BY 1, 2""",
)
def gr4(spark: SparkSession, d: str) -> DataFrame:
    having = b.table(spark, d, "customer").where("c_custkey % 29 = 0").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("node"), F.col("c_mktsegment").alias("key")).agg(F.min("c_custkey").alias("ord"))
    return closure.nearest(closure.reach(_graph(spark, d)), having)


@query("gr6_components", "WITH RECURSIVE " + _DAG.strip().removeprefix(",").split(", n AS")[0] + ", u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g), r AS (SELECT src, src AS dst FROM u UNION SELECT r.src, u.dst FROM r JOIN u ON u.src = r.dst) SELECT src AS node, min(dst) AS component FROM r GROUP BY 1")
def gr6(spark: SparkSession, d: str) -> DataFrame:
    return closure.components(_graph(spark, d))


@query("gr7_suggest_order")
def gr7(spark: SparkSession, d: str) -> DataFrame:
    g = _graph(spark, d)
    files = b.stages(spark, d).where("parent like 'r%'").select(F.col("parent").alias("stage"), F.col("id").alias("file"))
    return closure.order_in_groups(files, g)


# --- resolution ----------------------------------------------------------------------------------------------------------

_TYPES = """, ty AS (SELECT 'r' || n_regionkey AS module, c_mktsegment || (c_custkey % 30) AS type, 'n' || c_nationkey AS scope FROM customer JOIN nation ON n_nationkey = c_nationkey)
"""


def _types(spark: SparkSession, d: str) -> DataFrame:
    c = b.table(spark, d, "customer").join(F.broadcast(b.table(spark, d, "nation")), F.col("n_nationkey") == F.col("c_nationkey"))
    return c.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("module"), F.concat("c_mktsegment", (F.col("c_custkey") % 30).cast("string")).alias("type"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("scope"), "c_custkey")


_OWNED = "SELECT {k}, CASE WHEN count(DISTINCT module) = 1 THEN min(module) END AS module, count(DISTINCT module) > 1 AS ambiguous FROM {t} GROUP BY {k}"


@query("rx2_type_to_module", "WITH " + _TYPES.strip().removeprefix(",") + _OWNED.format(k="type", t="ty"))
def rx2(spark: SparkSession, d: str) -> DataFrame:
    return resolve.unique_owner(_types(spark, d), ["type"])


@query("rx3_scoped_type_to_module", "WITH " + _TYPES.strip().removeprefix(",") + _OWNED.format(k="scope, type", t="ty"))
def rx3(spark: SparkSession, d: str) -> DataFrame:
    return resolve.unique_owner(_types(spark, d), ["scope", "type"])


@query("rx4_type_methods", "WITH " + _TYPES.strip().removeprefix(",") + ", m AS (SELECT 'r' || n_regionkey AS module, c_mktsegment || (c_custkey % 30) AS type, 'm' || (c_custkey % 4) AS method FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 7 = 0) SELECT module, type, coalesce(string_agg(method, '|' ORDER BY method), '') AS methods FROM (SELECT DISTINCT module, type FROM ty) LEFT JOIN (SELECT DISTINCT * FROM m) USING (module, type) GROUP BY 1, 2")
def rx4(spark: SparkSession, d: str) -> DataFrame:
    ty = _types(spark, d)
    return resolve.methods(ty, ty.where("c_custkey % 7 = 0").withColumn("method", F.concat(F.lit("m"), (F.col("c_custkey") % 4).cast("string")))).select("module", "type", *joined("methods"))


_FUNCS = """, fn AS (SELECT p_brand || '/' || (p_size % 5) AS module, p_brand AS dir, 'f' || (p_partkey % 60) AS name FROM part)
"""


def _functions(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select(F.concat_ws("/", "p_brand", (F.col("p_size") % 5).cast("string")).alias("module"), F.col("p_brand").alias("dir"), F.concat(F.lit("f"), (F.col("p_partkey") % 60).cast("string")).alias("name"))


@query("rx5_set6_module_functions", "WITH " + _FUNCS.strip().removeprefix(",") + "SELECT DISTINCT module, name FROM fn")
def rx5(spark: SparkSession, d: str) -> DataFrame:
    return _functions(spark, d).select("module", "name").distinct()


@query("rx6_directory_functions", "WITH " + _FUNCS.strip().removeprefix(",") + _OWNED.format(k="dir, name", t="fn"))
def rx6(spark: SparkSession, d: str) -> DataFrame:
    return resolve.unique_owner(_functions(spark, d), ["dir", "name"])


@query(
    "rx7_lookup_scoped",
    "WITH " + _TYPES.strip().removeprefix(",") + ", st AS (" + _OWNED.format(k="scope, type", t="ty") + """), ask AS (SELECT c_custkey AS ask, c_mktsegment || (c_custkey % 31) AS name, 'n' || (c_custkey % 25) AS s1, 'n' || (c_custkey % 23) AS s2, 'n' || (c_custkey % 19) AS s3 FROM customer WHERE c_custkey % 3 = 0),
e AS (SELECT ask, name, 0 AS pos, s1 AS scope FROM ask UNION ALL SELECT ask, name, 1, s2 FROM ask UNION ALL SELECT ask, name, 2, s3 FROM ask), h AS (SELECT ask, min(struct_pack(pos := pos, a := ambiguous, m := module)) AS m FROM e JOIN st ON st.scope = e.scope AND st.type = e.name GROUP BY 1)
SELECT ask.ask, CASE WHEN NOT m.a THEN m.m END AS module FROM ask LEFT JOIN h USING (ask)""",
)
def rx7(spark: SparkSession, d: str) -> DataFrame:
    scope = lambda n: F.concat(F.lit("n"), (F.col("c_custkey") % n).cast("string"))
    asked = b.table(spark, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("ask"), F.concat("c_mktsegment", (F.col("c_custkey") % 31).cast("string")).alias("name"), F.array(scope(25), scope(23), scope(19)).alias("scopes"))
    return resolve.lookup_scoped(asked, resolve.unique_owner(_types(spark, d), ["scope", "type"]).withColumnRenamed("type", "name"))


@query(
    "rx8_rx10_resolve_bare",
    "WITH " + _FUNCS.strip().removeprefix(",") + """, calls AS (SELECT p_partkey AS call, p_brand || '/' || (p_size % 5) AS module, p_brand AS dir, CASE p_partkey % 4 WHEN 0 THEN 'f' || (p_partkey * 7 % 66) WHEN 1 THEN 'T' || (p_partkey % 9) ELSE 'f' || (p_partkey * 13 % 90) END AS name FROM part),
imp AS (SELECT module, name, CASE min(call) % 3 WHEN 0 THEN 'outside' ELSE 'Brand#1' || (1 + min(call) % 5) || '/' || (min(call) % 5) END AS target FROM calls WHERE call % 5 <> 0 GROUP BY 1, 2),
sib AS (""" + _OWNED.format(k="dir, name", t="fn") + """), td AS (SELECT 'T' || (p_partkey % 7) AS type, 'Brand#1' || (1 + p_partkey % 2) || '/1' AS module FROM part WHERE p_partkey < 40), ts AS (""" + _OWNED.format(k="type", t="td") + """),
j AS (SELECT c.*, i.target, s.module AS sibling, t.module AS tm, t.ambiguous AS ta, EXISTS (SELECT 1 FROM fn WHERE fn.module = c.module AND fn.name = c.name) AS own, EXISTS (SELECT 1 FROM fn WHERE fn.module = i.target AND fn.name = c.name) AS free, EXISTS (SELECT 1 FROM fn WHERE fn.module = i.target) AS scanned
  FROM calls c LEFT JOIN imp i ON i.module = c.module AND i.name = c.name LEFT JOIN sib s ON s.dir = c.dir AND s.name = c.name LEFT JOIN ts t ON t.type = c.name)
SELECT call, CASE WHEN own THEN module || '.' || name WHEN sibling IS NOT NULL THEN sibling || '.' || name WHEN target IS NULL THEN 'unresolved:' || name WHEN free THEN target || '.' || name WHEN ta THEN 'unresolved:' || name
    WHEN tm = target THEN target || '.' || name || '.__init__' WHEN NOT scanned THEN 'boundary:' || target || '.' || name ELSE 'unresolved:' || name END AS callee,
  CASE WHEN own OR sibling IS NOT NULL THEN 'internal_func' WHEN target IS NULL THEN 'unresolved' WHEN free THEN 'internal_func' WHEN ta THEN 'unresolved' WHEN tm = target THEN 'constructor'
    WHEN NOT scanned THEN CASE WHEN regexp_matches(name, '^[A-Z]') THEN 'boundary_constructor' ELSE 'boundary' END ELSE 'unresolved' END AS call_type FROM j""",
)
def rx10(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    text = lambda c: c.cast("string")
    name = F.when(k % 4 == 0, F.concat(F.lit("f"), text(k * 7 % 66))).when(k % 4 == 1, F.concat(F.lit("T"), text(k % 9))).otherwise(F.concat(F.lit("f"), text(k * 13 % 90)))
    p = b.table(spark, d, "part")
    calls = p.select(k.alias("call"), F.concat_ws("/", "p_brand", text(F.col("p_size") % 5)).alias("module"), F.col("p_brand").alias("dir"), name.alias("name"))
    m = F.col("m")
    imports = calls.where("call % 5 <> 0").groupBy("module", "name").agg(F.min("call").alias("m")).select("module", "name", F.when(m % 3 == 0, "outside").otherwise(F.concat(F.lit("Brand#1"), text(1 + m % 5), F.lit("/"), text(m % 5))).alias("target"))
    types = p.where("p_partkey < 40").select(F.concat(F.lit("T"), text(k % 7)).alias("type"), F.concat(F.lit("Brand#1"), text(1 + k % 2), F.lit("/1")).alias("module"))
    return resolve.resolve_bare(calls, _functions(spark, d), imports, resolve.unique_owner(types, ["type"]))


@query(
    "rx11_rx12_resolve_members",
    """WITH calls AS (SELECT event_id AS call, event_type AS module, 'C' || (user_id % 5) AS type, CASE WHEN event_id % 3 = 0 THEN 'g' || (event_id % 4) END AS field, 'm' || (event_id % 6) AS method FROM events),
mem AS (SELECT DISTINCT module, type, method FROM calls WHERE call % 11 = 0), fld AS (SELECT DISTINCT module, type, 'g' || (call % 3) AS field, 'D' || (length(module || type) % 4) AS field_type FROM calls WHERE call % 7 = 0 AND call % 3 < 2),
ts AS (SELECT * FROM (VALUES ('D0', 'view', false), ('D1', NULL, true), ('D2', 'click', false)) v(ft, tm, am))
SELECT call, CASE WHEN field IS NULL THEN CASE WHEN own THEN module || '.' || type || '.' || method ELSE 'unresolved:self.' || method END WHEN field_type IS NULL THEN 'unresolved:self.' || field || '.' || method
  WHEN tm IS NOT NULL THEN tm || '.' || field_type || '.' || method ELSE 'boundary:' || field_type || '.' || method END AS callee,
 CASE WHEN field IS NULL THEN CASE WHEN own THEN 'self_method' ELSE 'unresolved' END WHEN field_type IS NULL THEN 'unresolved' WHEN tm IS NOT NULL THEN 'field_method' ELSE 'boundary' END AS call_type
FROM (SELECT c.*, f.field_type, t.tm, EXISTS (SELECT 1 FROM mem m WHERE m.module = c.module AND m.type = c.type AND m.method = c.method) AS own FROM calls c LEFT JOIN fld f ON f.module = c.module AND f.type = c.type AND f.field = c.field LEFT JOIN ts t ON t.ft = f.field_type)""",
)
def rx12(spark: SparkSession, d: str) -> DataFrame:
    text = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    k = F.col("event_id")
    calls = b.table(spark, d, "events").select(k.alias("call"), F.col("event_type").alias("module"), text("C", F.col("user_id") % 5).alias("type"), F.when(k % 3 == 0, text("g", k % 4)).alias("field"), text("m", k % 6).alias("method"))
    members = calls.where("call % 11 = 0").select("module", "type", "method").distinct()
    fields = calls.where("call % 7 = 0 and call % 3 < 2").select("module", "type", text("g", F.col("call") % 3).alias("field"), text("D", F.length(F.concat("module", "type")) % 4).alias("field_type")).distinct()
    types = spark.sql("SELECT * FROM VALUES ('D0', 'view', false), ('D1', CAST(NULL AS STRING), true), ('D2', 'click', false) AS v(type, module, ambiguous)")
    return resolve.resolve_members(calls, members, fields, types)


# --- text ----------------------------------------------------------------------------------------------------------------


@query("st1_truncate", "SELECT doc_id, CASE WHEN length(text) > 60 THEN substr(text, 1, 59) || '…' ELSE text END AS short FROM documents")
def st1(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", t.truncate(F.col("text"), 60).alias("short"))


@query("st2_first_sentence", "WITH x AS (SELECT doc_id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) SELECT doc_id, CASE WHEN strpos(t, '. ') > 0 THEN substr(t, 1, strpos(t, '. ')) ELSE t END AS sentence FROM x")
def st2(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", t.first_sentence(F.col("text")).alias("sentence"))


@query("st3_slugify", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[^a-z0-9一-鿿]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM documents")
def st3(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", t.slugify(F.col("text")).alias("slug"))


@query("st4_cap_list", "SELECT doc_id, CASE WHEN len(w) > 5 THEN array_to_string(w[1:5], ', ') || ' (+' || (len(w) - 5) || ' more)' ELSE array_to_string(w, ', ') END AS shown FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)")
def st4(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", t.cap_list(F.split("text", " ", -1), 5).alias("shown"))


@query("st5_leaf_name", "SELECT p_partkey, split_part(split_part(n, '::', -1), '.', -1) AS leaf FROM (SELECT p_partkey, p_brand || CASE WHEN p_partkey % 2 = 0 THEN '::' ELSE '.' END || replace(p_type, ' ', '.') AS n FROM part)")
def st5(spark: SparkSession, d: str) -> DataFrame:
    name = F.concat("p_brand", F.when(F.col("p_partkey") % 2 == 0, "::").otherwise("."), F.regexp_replace("p_type", " ", "."))
    return b.table(spark, d, "part").select("p_partkey", t.leaf_name(name).alias("leaf"))


@query("st6_dir_and_stem", with_sql("file", "SELECT path, dir, CAST(doc_id AS VARCHAR) AS stem, '.' AS root FROM file"))
def st6(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).select("path", nav.dir_of(F.col("path")).alias("dir"), t.stem(F.col("path")).alias("stem"), nav.dir_of(F.col("lang")).alias("root"))


@query("st7_module_id", with_sql("file", "SELECT path, source || '.' || lang || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.m' || doc_id END AS module FROM file"))
def st7(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat_ws("/", "dir", F.when(F.col("doc_id") % 2 == 0, "__init__.py").otherwise(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py"))))
    return b.files(spark, d).select("path", t.module_id(p).alias("module"))


@query("st8_normalize_path", with_sql("file", "SELECT path, lang || '/' || doc_id AS plain FROM file"))
def st8(spark: SparkSession, d: str) -> DataFrame:
    return b.files(spark, d).select("path", t.normalize_path(F.concat_ws("/", F.lit("./.."), "source", F.lit("x/../..//."), "lang", "doc_id")).alias("plain"))


@query("st9_hashes", "SELECT doc_id, sha256(text) AS sha256, sha1(text) AS sha1, substr(sha1(text), 1, 12) AS short FROM documents")
def st9(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.sha1("text").alias("sha1"), t.short_hash(F.col("text")).alias("short"))


@query(
    "st10_st11_prose_and_code",
    r"""WITH x AS (SELECT conv_id, turn, 'Use `foo` at https://a.b/c?d or src/main.ts via obj.field_name and camelCase; ' || text || ' (x<y);' AS t FROM conversations),
p AS (SELECT conv_id, turn, t, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?s)```.*?```', ' ', 'g'), '`[^`]*`', ' ', 'g'), 'https?://\S+', ' ', 'g'), '[\w.-]+/[\w./-]+', ' ', 'g'), '\b[A-Za-z_]+(?:[._][A-Za-z_]+)+\b', ' ', 'g'), '\b[a-z]+[A-Z][A-Za-z]*\b', ' ', 'g'), '\s+', ' ', 'g')) AS prose FROM x)
SELECT conv_id, turn, prose, round(length(regexp_replace(t, '[^(){}\[\]<>;=|&/\\]', '', 'g')) / length(t), 6) AS code FROM p""",
)
def st10(spark: SparkSession, d: str) -> DataFrame:
    x = F.concat(F.lit("Use `foo` at https://a.b/c?d or src/main.ts via obj.field_name and camelCase; "), "text", F.lit(" (x<y);"))
    return b.table(spark, d, "conversations").select("conv_id", "turn", t.prose_only(x).alias("prose"), F.round(t.code_ratio(x), 6).alias("code"))


def _weights() -> str:
    return ", ".join(f"('{lang}', '{w}', {0.35 if w in t.AMBIGUOUS else 1.0})" for lang, own in t.FUNCTION_WORDS.items() for w in own)


#: Texts of fewer than 25 Latin words, also of none, are undecided; so are null ones.
@query(
    "st12_ag22_language_check",
    f"""WITH t AS (SELECT row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
cut AS (SELECT rid, regexp_extract_all(lower(text), '[a-zà-öø-ÿ]+') AS ws FROM t), wt(lang, w, weight) AS (VALUES {_weights()}),
hit AS (SELECT rid, lang, sum(weight) AS s FROM (SELECT rid, unnest(ws) AS w FROM cut) JOIN wt USING (w) GROUP BY ALL),
s AS (SELECT rid, l.lang, coalesce(h.s, 0) / greatest(len(ws), 1) AS score, len(ws) AS n FROM cut CROSS JOIN (SELECT DISTINCT lang FROM wt) l LEFT JOIN hit h USING (rid, lang)),
b AS (SELECT rid, arg_max(lang, struct_pack(s := score, k := -list_position(['en', 'es', 'pt', 'de'], lang))) AS best, max(score) AS top, max(score) FILTER (lang = 'en') AS mine, any_value(n) AS n FROM s GROUP BY 1)
SELECT CASE WHEN n < 25 OR top < 0.02 OR (best <> 'en' AND top - mine < 0.02) THEN 'undecided' ELSE best END AS got, count(*) AS n FROM b GROUP BY 1""",
)
def st12(spark: SparkSession, d: str) -> DataFrame:
    return _judged(b.table(spark, d, "documents"), F.coalesce("text", F.lit("")))


def _judged(docs: DataFrame, text: Column) -> DataFrame:
    v = t.check_latin(text, "en")
    got = F.when(~F.col("v.decided"), "undecided").when(F.col("v.ok"), "en").otherwise(F.coalesce("v.looks_like", F.lit("unknown")))
    return docs.select(v.alias("v")).groupBy(got.alias("got")).agg(F.count("*").alias("n"))


@query(
    "st13_occurrences",
    """WITH c AS (SELECT doc_id, string_split(text, '') AS cs FROM documents WHERE text IS NOT NULL),
p AS (SELECT doc_id, cs, unnest(range(1, len(cs) - 1)) AS k FROM c),
n AS (SELECT doc_id, cs[k] || cs[k + 1] || cs[k + 2] AS part, count(*) AS n FROM p GROUP BY ALL),
items AS (SELECT item_id, substr(text, 1, 3) AS part FROM benchmark)
SELECT d.doc_id, i.item_id, coalesce(n.n, 0) AS n FROM documents d CROSS JOIN items i LEFT JOIN n ON n.doc_id = d.doc_id AND n.part = i.part""",
)
def st13(spark: SparkSession, d: str) -> DataFrame:
    """Every item's first three characters in every whole text; the items are few and ship to every task as one list."""
    items = [(r["item_id"], r["p"]) for r in b.table(spark, d, "benchmark").select("item_id", F.substring("text", 1, 3).alias("p")).limit(MOST_PARTS + 1).collect()]
    if len(items) > MOST_PARTS:
        raise ValueError(f"st13 counts at most {MOST_PARTS} parts at once")
    part = F.explode(F.from_json(F.lit(json.dumps([{"item_id": i, "p": p} for i, p in items])), "array<struct<item_id:bigint,p:string>>"))
    x = b.table(spark, d, "documents").select("doc_id", "text", part.alias("i"))
    return x.select("doc_id", "i.item_id", t.occurrences(F.col("text"), F.col("i.p")).cast("long").alias("n"))


@query("st14_st15_lines", "SELECT doc_id, length(substr(text, 1, 99)) - length(replace(substr(text, 1, 99), chr(10), '')) + 1 AS line, CASE WHEN doc_id % 2 = 0 AND contains(text, chr(10)) THEN 'crlf' ELSE 'lf' END AS eol FROM documents")
def st14(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit("\r\n"))).otherwise(F.col("text"))
    return b.table(spark, d, "documents").select("doc_id", t.line_of(F.col("text"), F.lit(100)).cast("long").alias("line"), t.dominant_eol(x).alias("eol"))


@query("st16_edit_distance", "SELECT p_partkey, levenshtein(p_name, p_type) AS distance FROM part")
def st16(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").cast("long").alias("distance"))


@query("st17_screaming_snake", "SELECT c_custkey, upper(regexp_replace('my' || c_mktsegment || 'Key', '([A-Z])', '_\\1', 'g')) AS name FROM customer")
def st17(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "customer").select("c_custkey", t.screaming_snake(F.concat(F.lit("my"), "c_mktsegment", F.lit("Key"))).alias("name"))


@query("st19_durations", "WITH x AS (SELECT event_id, CAST(floor(value * 37 + 0.5) AS BIGINT) AS s FROM events) SELECT event_id, CASE WHEN s < 60 THEN s || 's' WHEN s // 60 < 60 THEN (s // 60) || 'm' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' ELSE (s // 3600) || 'h' || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || 'm' END AS shown FROM x")
def st19(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "events").select("event_id", t.duration(F.col("value") * 37).alias("shown"))


@query("st20_tk7_grep", with_sql("file", ", l AS (SELECT path AS file, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS line FROM file) SELECT file, CAST(line AS INT) AS line, substr(trim(x), 1, 200) AS text FROM l WHERE regexp_matches(x, '[0-9]{3}') ORDER BY file, line LIMIT 100"))
def st20(spark: SparkSession, d: str) -> DataFrame:
    return facts.grep(b.files(spark, d).select(F.col("path").alias("file"), "content"), "[0-9]{3}")


@query("pf7_coerce_role", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'config' WHEN event_type = 'view' THEN 'util' ELSE 'other' END AS role FROM events")
def pf7(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_type")
    return b.table(spark, d, "events").select("event_id", t.coerce_role(F.when(e == "click", "config").when(e == "view", "util").otherwise(e)).alias("role"))


_PREFIX = ("", "~", "/", "C:", "a\\", "a b", "`")


@query("pf11_pf12_path_problem", with_sql("file", "SELECT path, CASE doc_id % 7 WHEN 1 THEN 'home' WHEN 2 THEN 'absolute' WHEN 3 THEN 'drive' WHEN 4 THEN 'backslash' WHEN 5 THEN 'space' WHEN 6 THEN 'backtick' END AS problem, doc_id % 7 IN (2, 3) AS is_unsafe FROM file"))
def pf11(spark: SparkSession, d: str) -> DataFrame:
    p = F.concat(F.element_at(F.array(*map(F.lit, _PREFIX)), (F.col("doc_id") % 7 + 1).cast("int")), "path")
    return b.files(spark, d).select("path", t.path_problem(p).alias("problem"), delta.unsafe(p).alias("is_unsafe"))


@query("pf14_gateway_page", "SELECT page_id, regexp_matches(lower(substr(ltrim(html, ' '), 1, 200)), '^(<!doctype|<html|<\\?xml)') AS is_page FROM pages")
def pf14(spark: SparkSession, d: str) -> DataFrame:
    return b.table(spark, d, "pages").select("page_id", t.is_gateway_page(F.col("html")).alias("is_page"))


@query("pf16_credentials", "SELECT page_id, page_id % 3 = 0 AS has FROM pages WHERE url IS NOT NULL")
def pf16(spark: SparkSession, d: str) -> DataFrame:
    u = F.when(F.col("page_id") % 3 == 0, F.regexp_replace("url", "://", "://me:pw@")).otherwise(F.col("url"))
    return b.table(spark, d, "pages").where("url is not null").select("page_id", t.has_credentials(u).alias("has"))


@query("pf15_type_index_coverage", "SELECT CASE WHEN lang = 'en' THEN 'nobody looked' WHEN lang = 'de' THEN 'none' ELSE 'some' END AS coverage, count(*) AS n FROM documents GROUP BY 1")
def pf15(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("lang") == "en", F.lit(None)).when(F.col("lang") == "de", F.array().cast("array<string>")).otherwise(F.array("lang"))
    cover = F.when(F.col("k").isNull(), "nobody looked").when(F.size("k") == 0, "none").otherwise("some")
    return b.table(spark, d, "documents").select(kinds.cast("array<string>").alias("k")).groupBy(cover.alias("coverage")).agg(F.count("*").alias("n"))


@query("st27_register_id", "WITH x AS (SELECT p_partkey, regexp_replace(lower(trim(CASE WHEN p_partkey % 5 = 0 THEN 'REG-' || p_type WHEN p_partkey % 7 = 0 THEN '!' || p_name ELSE p_type END)), '[_\\s]+', '-', 'g') AS v FROM part), y AS (SELECT p_partkey, CASE WHEN starts_with(v, 'reg-') THEN v ELSE 'reg-' || v END AS id FROM x) SELECT p_partkey, CASE WHEN regexp_matches(id, '^reg-[a-z0-9][a-z0-9-]*$') THEN id END AS id FROM y")
def st27(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    x = F.when(k % 5 == 0, F.concat(F.lit("REG-"), "p_type")).when(k % 7 == 0, F.concat(F.lit("!"), "p_name")).otherwise(F.col("p_type"))
    return b.table(spark, d, "part").select("p_partkey", t.register_id(x).alias("id"))


@query("st30_escapes", """SELECT page_id, CASE WHEN regexp_matches(substr(html, 1, 120), '[",\n]') THEN '"' || replace(substr(html, 1, 120), '"', '""') || '"' ELSE substr(html, 1, 120) END AS csv, replace(replace(replace(replace(substr(html, 1, 120), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS esc FROM pages""")
def st30(spark: SparkSession, d: str) -> DataFrame:
    x = F.substring("html", 1, 120)
    return b.table(spark, d, "pages").select("page_id", t.csv_field(x).alias("csv"), t.escape_html(x).alias("esc"))


@query("st31_markdown_links", with_sql("file", "SELECT doc_id, unnest(list_value('a' || doc_id || '.md', lang || '/b.md')) AS link FROM file"))
def st31(spark: SparkSession, d: str) -> DataFrame:
    return _links(b.files(spark, d))


def _links(files: DataFrame) -> DataFrame:
    x = F.concat(F.lit("see [x](a"), F.col("doc_id").cast("string"), F.lit(".md) and [y]("), "lang", F.lit("/b.md) or [z](c.md#top) [w](d.txt)"))
    return files.select("doc_id", F.explode(t.markdown_links(x)).alias("link"))


# --- facts, search -------------------------------------------------------------------------------------------------------


@query(
    "r30_ag27_symbols",
    with_sql(
        "fnode edge",
        """, d AS (SELECT callee AS id, count(*) AS n FROM edge WHERE call_type <> 'unresolved' GROUP BY 1), bc AS (SELECT name AS leaf, 2 AS n FROM fnode WHERE line_start % 50 = 0), ty AS (SELECT DISTINCT class_name AS name, file, 'class' AS kind, 1 AS a, 9 AS z FROM fnode WHERE class_name IS NOT NULL AND line_start % 4 = 0)
SELECT f.name, f.file || ':' || line_start || '-' || line_end AS path, 'function' AS kind, CASE WHEN f.file LIKE 'ASIA%' THEN 'asia' ELSE 'unassigned' END AS stage, coalesce(d.n, 0) + coalesce(bc.n, 0) AS n_called_by, signature FROM fnode f LEFT JOIN d USING (id) LEFT JOIN bc ON bc.leaf = f.name
UNION ALL SELECT name, file || ':1-9', 'type:class', CASE WHEN file LIKE 'ASIA%' THEN 'asia' ELSE 'unassigned' END, NULL, 'class ' || name FROM ty
UNION ALL SELECT class_name, file || ':' || min(line_start) || '-' || max(line_end), 'class-derived', CASE WHEN file LIKE 'ASIA%' THEN 'asia' ELSE 'unassigned' END, NULL, count(*) || ' method(s)' FROM fnode f WHERE class_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ty WHERE ty.name = f.class_name AND ty.file = f.file) GROUP BY class_name, file""",
    ),
)
def r30(spark: SparkSession, d: str) -> DataFrame:
    from strata.operators import graph

    n = b.nodes(spark, d)
    fn = n.join(graph.degrees(n, b.edges(spark, d)), "id")
    ty = n.where("class_name is not null and line_start % 4 = 0").select(F.col("class_name").alias("name"), "file").distinct().select("*", F.lit("class").alias("kind"), F.lit(1).alias("line_start"), F.lit(9).alias("line_end"), F.concat(F.lit("class\t"), "name").alias("signature"))
    calls = n.where("line_start % 50 = 0").select(F.col("name").alias("leaf"), F.lit(2).alias("n"))
    stage = n.select("file").distinct().where("file not like 'EUROPE%'").select("file", F.when(F.col("file").startswith("ASIA"), "asia").otherwise("").alias("stage"))
    return facts.symbols(fn, ty, calls, stage)


@query(
    "r31_files",
    with_sql("file", "SELECT path, lang AS stage, CASE WHEN doc_id % 2 = 0 THEN 'util' ELSE 'other' END AS role, CASE WHEN doc_id % 3 = 0 THEN doc_id ELSE 0 END AS n_symbols, CASE WHEN doc_id % 5 = 0 THEN '?' ELSE lang END AS language, CASE WHEN doc_id % 2 = 0 THEN 'about it' ELSE '' END AS purpose FROM file"),
)
def r31(spark: SparkSession, d: str) -> DataFrame:
    f = b.files(spark, d).withColumn("file", F.col("path"))
    cards = f.where("doc_id % 2 = 0").select("file", F.lit("util").alias("role"), F.lit(" about\tit\n").alias("purpose"))
    return facts.file_facts(f.select("file", F.col("lang").alias("stage")), cards, f.where("doc_id % 3 = 0").select("file", F.col("doc_id").alias("n_symbols")), f.where("doc_id % 5 <> 0").select("file", F.col("lang").alias("language")))


@query(
    "r32_calls",
    with_sql(
        "fnode edge",
        """SELECT DISTINCT a.qualname AS caller, a.file || ':' || a.line_start AS caller_at, CASE WHEN starts_with(callee, 'boundary:') THEN regexp_extract(callee, '([^.:]*)$', 1) ELSE z.qualname END AS callee,
  CASE WHEN starts_with(callee, 'boundary:') THEN 'boundary:' || split_part(regexp_replace(callee, '^boundary:', ''), '.', 1) ELSE z.file || ':' || z.line_start END AS callee_at
FROM edge JOIN fnode a ON a.id = caller LEFT JOIN fnode z ON z.id = callee WHERE call_type <> 'unresolved'""",
    ),
)
def r32(spark: SparkSession, d: str) -> DataFrame:
    return facts.call_facts(b.edges(spark, d), b.nodes(spark, d))


_FORM = ("{s}", "{s}_test", "test_{s}", "{s}.spec", "{s}_tests")


@query(
    "j12_twins",
    """WITH f AS (SELECT DISTINCT p_brand || CASE WHEN p_size % 3 = 0 THEN '/__tests__' ELSE '' END || '/' || CASE p_partkey % 5 WHEN 0 THEN s WHEN 1 THEN s || '_test' WHEN 2 THEN 'test_' || s WHEN 3 THEN s || '.spec' ELSE s || '_tests' END || '.py' AS file FROM (SELECT *, 'm' || (p_size % 6) AS s FROM part)),
g AS (SELECT file, regexp_replace(file, '/[^/]*$', '') AS dir, regexp_replace(split_part(file, '/', -1), '\\.py$', '') AS stem FROM f)
SELECT DISTINCT a.file, z.file AS twin FROM g a JOIN g z ON a.file <> z.file AND (z.dir = a.dir OR z.dir = a.dir || '/__tests__') AND z.stem IN (a.stem || '_test', a.stem || '_tests', a.stem || '_spec', 'test_' || a.stem, a.stem || '.test', a.stem || '.tests', a.stem || '.spec')""",
)
def j12(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.concat(F.lit("m"), (F.col("p_size") % 6).cast("string")), F.col("p_partkey") % 5
    base = F.when(k == 0, s).when(k == 1, F.concat(s, F.lit("_test"))).when(k == 2, F.concat(F.lit("test_"), s)).when(k == 3, F.concat(s, F.lit(".spec"))).otherwise(F.concat(s, F.lit("_tests")))
    return facts.twins(b.table(spark, d, "part").select(F.concat("p_brand", F.when(F.col("p_size") % 3 == 0, "/__tests__").otherwise(""), F.lit("/"), base, F.lit(".py")).alias("file")).distinct())


_INDEX = """, idx AS (SELECT 0 AS kind, r_name AS label, '' AS sub, r_regionkey AS ord FROM region UNION ALL SELECT 1, n_name, 'nation ' || n_regionkey, 100 + n_nationkey FROM nation
 UNION ALL SELECT 2, c_name, c_mktsegment, 1000 + c_custkey FROM customer UNION ALL SELECT 3, p_name, p_type, 1000000 + p_partkey FROM part)
"""


def _index(spark: SparkSession, d: str) -> DataFrame:
    e = lambda n, kind, label, sub, base, key: b.table(spark, d, n).select(F.lit(kind).alias("kind"), F.col(label).alias("label"), sub.alias("sub"), (F.col(key) + base).cast("long").alias("ord"))
    return e("region", 0, "r_name", F.lit(""), 0, "r_regionkey").union(e("nation", 1, "n_name", F.concat(F.lit("nation "), F.col("n_regionkey").cast("string")), 100, "n_nationkey")).union(e("customer", 2, "c_name", F.col("c_mktsegment"), 1000, "c_custkey")).union(e("part", 3, "p_name", F.col("p_type"), 1_000_000, "p_partkey"))


@query("r34_search_index", "WITH " + _INDEX.strip().removeprefix(",") + "SELECT kind, count(*) AS n, min(label) AS first FROM idx GROUP BY 1")
def r34(spark: SparkSession, d: str) -> DataFrame:
    return _index(spark, d).groupBy("kind").agg(F.count("*").alias("n"), F.min("label").alias("first"))


@query(
    "tk4_search",
    "WITH " + _INDEX.strip().removeprefix(",") + """, h AS (SELECT *, strpos(lower(label), 'an') AS p1, strpos(lower(sub), 'an') AS p2 FROM idx), s AS (SELECT *, CASE WHEN p1 > 0 THEN p1 ELSE p2 END - 1 AS pos, CASE WHEN p1 > 0 THEN label ELSE sub END AS x FROM h WHERE p1 > 0 OR p2 > 0)
SELECT kind, label, sub, score FROM (SELECT *, CAST(CASE WHEN p1 > 0 THEN 400 ELSE 800 END + CASE WHEN pos = 0 OR x[pos] IN ('.', '/', '_', '-', ' ', ':') THEN 0 ELSE 200 END + least(pos, 120) + kind AS INT) AS score FROM s) ORDER BY score, ord, label LIMIT 50""",
)
def tk4(spark: SparkSession, d: str) -> DataFrame:
    return facts.search(_index(spark, d), "an")


@query("tk8_nearest_key", "WITH k AS (SELECT DISTINCT event_type AS key FROM events), a AS (SELECT DISTINCT CASE WHEN event_id % 3 = 0 THEN event_type || 'x' WHEN event_id % 3 = 1 THEN substr(event_type, 2) ELSE 'qqq' || event_id % 5 END AS asked FROM events), p AS (SELECT asked, key, levenshtein(asked, key) AS d FROM a JOIN k ON levenshtein(asked, key) <= least(3, greatest(1, length(asked) // 4))) SELECT a.asked, (SELECT arg_min(key, struct_pack(d := d, k := key)) FROM p WHERE p.asked = a.asked) AS key FROM a")
def tk8(spark: SparkSession, d: str) -> DataFrame:
    e, k = b.table(spark, d, "events"), F.col("event_id")
    keys = e.select(F.col("event_type").alias("key")).distinct().select("key", F.col("key").alias("ord"))
    asked = e.select(F.when(k % 3 == 0, F.concat("event_type", F.lit("x"))).when(k % 3 == 1, F.substring("event_type", 2, 100)).otherwise(F.concat(F.lit("qqq"), (k % 5).cast("string"))).alias("asked")).distinct()
    return facts.nearest_key(asked, keys)


# --- patches -------------------------------------------------------------------------------------------------------------


@query(
    "w8_index_problems",
    "WITH e AS (SELECT user_id AS plan, event_id AS pos, event_id * 7 % 40 AS idx FROM events), p AS (SELECT plan, pos, CASE WHEN count(*) OVER (PARTITION BY plan, idx) > 1 THEN 'duplicate' WHEN idx <= lag(idx) OVER (PARTITION BY plan ORDER BY pos) THEN 'not rising' END AS problem FROM e) SELECT * FROM p WHERE problem IS NOT NULL",
)
def w8(spark: SparkSession, d: str) -> DataFrame:
    return _problems(b.table(spark, d, "events"))


def _problems(e: DataFrame) -> DataFrame:
    return patch.index_problems(e.select(F.col("user_id").alias("plan"), F.col("event_id").alias("pos"), (F.col("event_id") * 7 % 40).alias("idx")))


#: Which file and text an edit names, so that every status occurs; one document in ten stands for an empty file.
_EDITS = """, f AS (
  SELECT doc_id, path, CASE WHEN doc_id % 10 = 7 THEN '' ELSE content END AS content, doc_id % 23 = 4 AS is_dir, doc_id % 29 = 3 AS bad_bytes FROM file
), ed AS (
  SELECT doc_id AS edit,
         CASE WHEN doc_id % 9 = 0 THEN '/' || path WHEN doc_id % 31 = 1 THEN 'a/../../' || path WHEN doc_id % 8 = 0 THEN 'none/' || doc_id ELSE path END AS f,
         CASE WHEN doc_id % 5 = 0 THEN 'no such text' WHEN doc_id % 6 = 0 OR doc_id % 10 = 7 THEN '' ELSE coalesce(substr(content, 5, 30), '') END AS old
  FROM f
), v AS (
  SELECT edit, f AS file, old, path IS NOT NULL AS there, coalesce(content, '') AS c, coalesce(is_dir, false) AS is_dir, coalesce(bad_bytes, false) AS bad_bytes FROM ed LEFT JOIN f ON path = f
), h AS (
  SELECT *, CASE WHEN old = '' OR NOT contains(c, old) THEN 0 WHEN contains(substr(c, strpos(c, old) + 1), old) THEN 2 ELSE 1 END AS hits FROM v
), st AS (
  SELECT edit, file, c, old,
         CASE WHEN starts_with(file, '/') OR starts_with(file, 'a/../../') THEN 'unsafe-path' WHEN is_dir THEN 'not-a-file' WHEN bad_bytes THEN 'undecodable'
           WHEN NOT there AND old = '' THEN 'created' WHEN NOT there THEN 'file-missing' WHEN old = '' AND c = '' THEN 'applied'
           WHEN old = '' OR hits = 0 THEN 'no-match' WHEN hits > 1 THEN 'ambiguous' ELSE 'applied' END AS status FROM h)
"""


def _verified(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    f = b.files(spark, d).select("doc_id", "path", F.when(k % 10 == 7, "").otherwise(F.col("content")).alias("content"), (k % 23 == 4).alias("is_dir"), (k % 29 == 3).alias("bad_bytes"))
    name = F.when(k % 9 == 0, F.concat(F.lit("/"), "path")).when(k % 31 == 1, F.concat(F.lit("a/../../"), "path")).when(k % 8 == 0, F.concat(F.lit("none/"), k.cast("string"))).otherwise(F.col("path"))
    old = F.when(k % 5 == 0, "no such text").when((k % 6 == 0) | (k % 10 == 7), "").otherwise(F.coalesce(F.substring("content", 5, 30), F.lit("")))
    edits = f.select(k.alias("edit"), name.alias("file"), old.alias("old"), F.lit("new").alias("new"))
    return patch.verify(edits, f.select(F.col("path").alias("file"), "content", "is_dir", "bad_bytes"))


_LINE = "CASE WHEN status = 'created' OR status = 'applied' AND old = '' THEN 1 WHEN status = 'applied' THEN CAST(length(substr(c, 1, strpos(c, old) - 1)) - length(replace(substr(c, 1, strpos(c, old) - 1), chr(10), '')) + 1 AS INT) END"


@query("pt2_verify", with_sql("file", _EDITS + f"SELECT edit, file, status, {_LINE} AS line FROM st"))
def pt2(spark: SparkSession, d: str) -> DataFrame:
    return _verified(spark, d)


@query("pt3_all_or_nothing", with_sql("file", _EDITS + "SELECT edit % 400 AS plan, edit, CASE WHEN status IN ('applied', 'created') AND bool_or(status NOT IN ('applied', 'created')) OVER (PARTITION BY edit % 400) THEN 'skipped' ELSE status END AS status FROM st"))
def pt3(spark: SparkSession, d: str) -> DataFrame:
    return patch.all_or_nothing(_verified(spark, d).select((F.col("edit") % 400).alias("plan"), "edit", "status"))


@query("pt4_net_changes", with_sql("file file2", "SELECT a.path AS file FROM file a JOIN file2 z ON z.path = a.path WHERE a.content <> z.content"))
def pt4(spark: SparkSession, d: str) -> DataFrame:
    both = b.files(spark, d).select(F.col("path").alias("file"), F.col("content").alias("original")).join(b.after(spark, d).select(F.col("path").alias("file"), F.col("content").alias("next")), "file")
    return patch.net_changes(both).select("file")


@query(
    "pt5_rollback_plan",
    with_sql(
        "file file2",
        """, m AS (SELECT path AS file, hash AS bh, sha256(content || ' edited') AS ah, CASE WHEN doc_id % 4 = 0 THEN 'zz' ELSE hash END AS kh FROM file)
SELECT m.file, CASE WHEN z.hash = bh THEN 'already back' WHEN kh <> bh THEN 'corrupt backup' WHEN z.hash = ah THEN 'restore' WHEN z.hash IS NULL THEN 'absent' ELSE 'changed since' END AS action FROM m LEFT JOIN file2 z ON z.path = m.file""",
    ),
)
def pt5(spark: SparkSession, d: str) -> DataFrame:
    m = b.files(spark, d).select(F.col("path").alias("file"), F.col("hash").alias("before_hash"), F.sha2(F.concat("content", F.lit(" edited")), 256).alias("after_hash"), F.when(F.col("doc_id") % 4 == 0, "zz").otherwise(F.col("hash")).alias("backup_hash"))
    return patch.rollback_plan(m, b.after(spark, d).select(F.col("path").alias("file"), "hash"))


@query("pt2_apply_in_order", with_sql("file", "SELECT path AS file, sha256(CASE WHEN contains(substr(content, 2), substr(content, 1, 12)) THEN content ELSE 'A' || substr(content, 13) END) AS sha FROM file"))
def pt2_order(spark: SparkSession, d: str) -> DataFrame:
    return _edited(b.files(spark, d))


def _edited(files: DataFrame) -> DataFrame:
    f = files.select(F.col("path").alias("file"), "content", "doc_id")
    edits = f.select("file", F.lit(1).alias("ord"), F.substring("content", 1, 12).alias("old"), F.lit("A").alias("new"))
    return patch.apply_in_order(edits, f.select("file", "content")).select("file", F.sha2("content", 256).alias("sha"))


# --- job logs ------------------------------------------------------------------------------------------------------------


@query(
    "w5_progress",
    with_sql(
        "job",
        """, p AS (SELECT job, seq, 1 + seq % 3 AS weight, ts FROM job), r AS (SELECT job, seq, sum(weight) OVER (PARTITION BY job ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS done, sum(weight) OVER (PARTITION BY job) AS total, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY job) AS spent FROM p)
SELECT job, seq, CAST(done AS BIGINT) AS done, CAST(floor(100 * done / total + 0.5) AS INT) AS pct, round(spent / 1e6 / done * (total - done), 6) AS eta FROM r""",
    ),
)
def w5(spark: SparkSession, d: str) -> DataFrame:
    return jobs.progress(b.jobs(spark, d).withColumn("weight", 1 + F.col("seq") % 3))


@query("w6_scope_progress", with_sql("job", ", s AS (SELECT job, type, arg_max(seq % 7, seq) AS done, arg_max(CASE WHEN seq % 2 = 0 THEN 5 ELSE 6 END, seq) AS total FROM job GROUP BY 1, 2) SELECT job, CAST(floor(100 * sum(least(done, total)) / sum(total) + 0.5) AS INT) AS pct FROM s GROUP BY 1"))
def w6(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("seq")
    return jobs.scope_progress(b.jobs(spark, d).select("job", F.col("type").alias("scope"), "seq", (k % 7).alias("done"), F.when(k % 2 == 0, 5).otherwise(6).cast("long").alias("total")))


@query("str2_newest", with_sql("job", "SELECT job, arg_max(seq, struct_pack(a := ts, b := seq)) AS seq, arg_max(type, struct_pack(a := ts, b := seq)) AS type FROM job GROUP BY 1"))
def str2(spark: SparkSession, d: str) -> DataFrame:
    return jobs.newest(b.jobs(spark, d))


@query("str3_w11_bounded_log", with_sql("job", ", r AS (SELECT job, seq, row_number() OVER (PARTITION BY job ORDER BY ts DESC, seq DESC) AS nth, count(*) OVER (PARTITION BY job) AS n FROM job) SELECT job, seq, greatest(n - 20, 0) AS dropped FROM r WHERE nth <= 20"))
def str3(spark: SparkSession, d: str) -> DataFrame:
    return jobs.bounded_log(b.jobs(spark, d), 20)


@query("str5_status", with_sql("job", ", e AS (SELECT job, min(struct_pack(a := ts, b := seq, s := CASE type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'cancelled' WHEN 'purchase' THEN 'succeeded' END)) FILTER (type IN ('error', 'signup', 'purchase')) AS e FROM job GROUP BY 1) SELECT job, coalesce(e.s, 'running') AS status FROM e"))
def str5(spark: SparkSession, d: str) -> DataFrame:
    return jobs.status(b.jobs(spark, d))


@query("w10_batches", "SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 8 AS batch FROM events")
def w10(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    nth = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    return b.table(spark, d, "events").select("user_id", "event_id", F.floor((nth - 1) / 8).alias("batch"))
