"""Call graph, navigation, inventory and stage queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import graph, inventory, nav, stages
from strata.plans import bindings as b
from strata.plans.bindings import with_sql
from strata.plans.registry import joined, query

_DEGREE = """, ends AS (
  SELECT caller AS id, 1 AS o, 0 AS i FROM edge WHERE call_type <> 'unresolved' UNION ALL SELECT callee, 0, 1 FROM edge WHERE call_type <> 'unresolved'
), degree AS (
  SELECT f.id, CAST(coalesce(sum(o), 0) AS BIGINT) AS n_callees, CAST(coalesce(sum(i), 0) AS BIGINT) AS n_callers FROM fnode f LEFT JOIN ends e ON e.id = f.id GROUP BY f.id)
"""
_ADJ = """, adj AS (
  SELECT a.file AS from_file, z.file AS to_file, count(*) AS weight FROM edge JOIN fnode a ON a.id = caller JOIN fnode z ON z.id = callee WHERE call_type <> 'unresolved' AND a.file <> z.file GROUP BY ALL)
"""


@query("ag1_node_degrees", with_sql("fnode edge", _DEGREE + "SELECT * FROM degree"))
def ag1(spark: SparkSession, d: str) -> DataFrame:
    return graph.degrees(b.nodes(spark, d), b.edges(spark, d))


@query("pf1_kept_edges", with_sql("edge", "SELECT call_type, count(*) AS n FROM edge WHERE call_type <> 'unresolved' GROUP BY 1"))
def pf1(spark: SparkSession, d: str) -> DataFrame:
    return graph.kept(b.edges(spark, d)).groupBy("call_type").agg(F.count("*").alias("n"))


@query(
    "pf4_ag4_dropped_calls",
    with_sql(
        "edge",
        f""", h AS (SELECT regexp_replace(callee, '^unresolved:', '') AS hint FROM edge WHERE call_type = 'unresolved')
SELECT CASE WHEN regexp_matches(hint, '^self\\._?logger\\.') THEN 'inherited_method' WHEN regexp_matches(hint, '^(self|this)\\.') THEN 'self_attr_unknown'
  WHEN regexp_matches(hint, '^["'']') THEN 'string_literal_method' WHEN regexp_extract(hint, '^([^.(]*)', 1) IN ({", ".join(f"'{x}'" for x in graph.BUILTINS)}) THEN 'builtin'
  WHEN contains(hint, '.') THEN 'local_var_method' ELSE 'bare_name' END AS category, count(*) AS n FROM h GROUP BY 1""",
    ),
)
def pf4(spark: SparkSession, d: str) -> DataFrame:
    return graph.dropped_calls(b.edges(spark, d))


_BOUNDARY_SQL = """, ids AS (SELECT DISTINCT callee AS id FROM edge WHERE callee LIKE 'boundary:%'), p AS (
  SELECT id, list_filter(string_split_regex(regexp_replace(id, '^boundary:', ''), '[.:]+'), lambda x: x <> '') AS s FROM ids), c AS (
  SELECT id, s, list_position([regexp_matches(x, '^[A-Z]') for x in s[1:len(s) - 1]], true) AS ci FROM p)
"""
_PARTS = "s[len(s)] AS name, CASE WHEN ci > 0 THEN s[ci] END AS class_name, array_to_string(CASE WHEN ci > 0 THEN s[1:ci - 1] ELSE s[1:len(s) - 1] END, '.') AS module"


@query("pf5_boundary_parts", with_sql("edge", _BOUNDARY_SQL + f"SELECT id, {_PARTS} FROM c"))
def pf5(spark: SparkSession, d: str) -> DataFrame:
    ids = b.edges(spark, d).where("callee like 'boundary:%'").select(F.col("callee").alias("id")).distinct()
    name, cls, module = graph.boundary_parts(F.col("id"))
    return ids.select("id", name.alias("name"), cls.alias("class_name"), module.alias("module"))


@query(
    "pf6_constructor_parts",
    """WITH ids AS (SELECT CASE WHEN p_partkey % 2 = 0 THEN 'pkg.' || replace(p_name, ' ', '_') || '.Make.__init__' WHEN p_partkey % 3 = 0 THEN 'solo' ELSE 'crate::' || replace(p_name, ' ', '_') || '::new' END AS id FROM part),
p AS (SELECT id, CASE WHEN contains(id, '::') THEN string_split(id, '::') ELSE string_split(id, '.') END AS s FROM ids)
SELECT id, s[len(s)] AS name, CASE WHEN len(s) > 1 THEN s[len(s) - 1] END AS class_name, array_to_string(s[1:greatest(len(s) - 2, 1)], '.') AS module FROM p""",
)
def pf6(spark: SparkSession, d: str) -> DataFrame:
    p, n = b.table(spark, d, "part"), F.regexp_replace("p_name", " ", "_")
    ids = p.select(F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("pkg."), n, F.lit(".Make.__init__"))).when(F.col("p_partkey") % 3 == 0, "solo").otherwise(F.concat(F.lit("crate::"), n, F.lit("::new"))).alias("id"))
    name, cls, module = graph.constructor_parts(F.col("id"))
    return ids.select("id", name.alias("name"), cls.alias("class_name"), module.alias("module"))


@query("j1_node_table", with_sql("fnode edge", _BOUNDARY_SQL + f"SELECT id, kind, name, class_name, NULL AS module FROM fnode UNION ALL SELECT id, 'boundary', {_PARTS} FROM c"))
def j1(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_table(b.nodes(spark, d), b.edges(spark, d))


@query(
    "ag2_graph_counts",
    with_sql(
        "fnode edge",
        "SELECT (SELECT count(*) FROM fnode) AS n_internal, (SELECT count(DISTINCT callee) FROM edge WHERE callee LIKE 'boundary:%') AS n_boundary, (SELECT count(*) FROM edge WHERE call_type <> 'unresolved') AS n_kept, (SELECT count(*) FROM edge WHERE call_type = 'unresolved') AS n_dropped",
    ),
)
def ag2(spark: SparkSession, d: str) -> DataFrame:
    return graph.graph_counts(b.nodes(spark, d), b.edges(spark, d))


@query("j3_file_adjacency", with_sql("fnode edge", _ADJ + "SELECT * FROM adj"))
def j3(spark: SparkSession, d: str) -> DataFrame:
    return graph.file_adjacency(b.nodes(spark, d), b.edges(spark, d))


_TOP = """, ends AS (SELECT from_file AS file, weight FROM adj UNION ALL SELECT to_file, weight FROM adj), ranked AS (SELECT file, sum(weight) AS degree FROM ends GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
"""


@query("ag18_tk5_impact_nodes", with_sql("fnode edge", _ADJ + _TOP + "SELECT file, CAST(degree AS BIGINT) AS degree FROM ranked"))
def ag18_nodes(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(graph.file_adjacency(b.nodes(spark, d), b.edges(spark, d)), 10)[0]


@query("ag18_impact_links", with_sql("fnode edge", _ADJ + _TOP + "SELECT * FROM adj WHERE from_file IN (SELECT file FROM ranked) AND to_file IN (SELECT file FROM ranked)"))
def ag18_links(spark: SparkSession, d: str) -> DataFrame:
    return graph.impact(graph.file_adjacency(b.nodes(spark, d), b.edges(spark, d)), 10)[1]


#: The focus is the first file of the adjacency, so that it exists in every set of tables.
_NEAR = _ADJ + ", focus AS (SELECT min(least(from_file, to_file)) AS file FROM adj), near AS (SELECT adj.* FROM adj, focus WHERE from_file = file OR to_file = file)" + _TOP.replace("FROM adj", "FROM near")


def _focused(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    adjacency = graph.file_adjacency(b.nodes(spark, d), b.edges(spark, d))
    return graph.impact(adjacency, 10, adjacency.agg(F.min(F.least("from_file", "to_file")).alias("file")))


@query("gr8_impact_focus", with_sql("fnode edge", _NEAR + "SELECT file, CAST(degree AS BIGINT) AS degree FROM ranked"))
def gr8(spark: SparkSession, d: str) -> DataFrame:
    return _focused(spark, d)[0]


@query("gr8_impact_focus_links", with_sql("fnode edge", _NEAR + "SELECT from_file, to_file, weight FROM near WHERE from_file IN (SELECT file FROM ranked) AND to_file IN (SELECT file FROM ranked)"))
def gr8_links(spark: SparkSession, d: str) -> DataFrame:
    return _focused(spark, d)[1]


@query(
    "ag3_self_attributes",
    """WITH r AS (SELECT event_type AS class_name, 'a' || (event_id % 7) AS attr, 'u' || user_id AS fn, CASE WHEN event_id % 3 = 0 THEN 'write' ELSE 'read' END AS mode, event_id AS ord FROM events),
f AS (SELECT class_name, attr, mode, fn, min(ord) AS ord FROM r GROUP BY ALL)
SELECT class_name, attr, coalesce(string_agg(fn, '|' ORDER BY ord) FILTER (mode = 'read'), '') AS read_in, coalesce(string_agg(fn, '|' ORDER BY ord) FILTER (mode = 'write'), '') AS written_in FROM f GROUP BY 1, 2""",
)
def ag3(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    rows = e.select(F.col("event_type").alias("class_name"), F.concat(F.lit("a"), (F.col("event_id") % 7).cast("string")).alias("attr"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("fn"), F.when(F.col("event_id") % 3 == 0, "write").otherwise("read").alias("mode"), F.col("event_id").alias("ord"))
    return graph.self_attributes(rows).select("class_name", "attr", *joined("read_in", "written_in"))


@query(
    "ag5_scan_coverage",
    """WITH u AS (SELECT source || '/' || doc_id AS file, CASE WHEN n_chars > 5000 THEN 'unreadable' WHEN lang = 'fr' THEN 'unparsable' ELSE 'partial' END AS reason FROM documents)
SELECT reason, file, count(*) OVER (PARTITION BY reason) AS n FROM u""",
)
def ag5(spark: SparkSession, d: str) -> DataFrame:
    reason = F.when(F.col("n_chars") > 5000, "unreadable").when(F.col("lang") == "fr", "unparsable").otherwise("partial")
    return graph.scan_coverage(b.table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("file"), reason.alias("reason")))


@query("ag6_dir_map", with_sql("fnode", "SELECT regexp_replace(file, '/[^/]*$', '') AS dir, count(DISTINCT file) AS n_files, count(*) AS n_functions FROM fnode WHERE NOT synthetic GROUP BY 1"))
def ag6(spark: SparkSession, d: str) -> DataFrame:
    return nav.directories(b.nodes(spark, d)).withColumn("n_functions", F.col("n_functions").cast("long"))


_DESC = """, r AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY line_start, id) AS nth FROM fnode WHERE NOT synthetic), descr AS (
  SELECT file, count(*) AS n_functions, coalesce(array_to_string(list_sort(list_distinct(list(class_name) FILTER (class_name IS NOT NULL))), '|'), '') AS classes,
         string_agg(CASE WHEN length(signature) > 120 THEN signature[:119] || '…' ELSE signature END, '|' ORDER BY nth) FILTER (nth <= 8) AS functions FROM r GROUP BY file)
"""


@query("ag7_w1_file_descriptors", with_sql("fnode", _DESC + "SELECT * FROM descr"))
def ag7(spark: SparkSession, d: str) -> DataFrame:
    return nav.file_descriptors(b.nodes(spark, d)).select("file", "n_functions", *joined("classes", "functions"))


@query("j4_all_descriptors", with_sql("fnode", _DESC + "SELECT * FROM descr UNION ALL SELECT DISTINCT r_name || '/none.x', 0, '', '' FROM region"))
def j4(spark: SparkSession, d: str) -> DataFrame:
    nodes = b.nodes(spark, d)
    scanned = nodes.select("file").union(b.table(spark, d, "region").select(F.concat("r_name", F.lit("/none.x"))))
    return nav.all_descriptors(scanned, nav.file_descriptors(nodes)).select("file", "n_functions", *joined("classes", "functions"))


@query("ag8_tk3_fan_out", with_sql("fnode edge", _DEGREE + "SELECT file, CAST(sum(n_callees) AS BIGINT) AS fan_out FROM degree JOIN fnode USING (id) WHERE NOT synthetic GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"))
def ag8(spark: SparkSession, d: str) -> DataFrame:
    n = b.nodes(spark, d)
    return nav.fan_out(n, graph.degrees(n, b.edges(spark, d)), 10)


@query(
    "ag9_externals",
    with_sql(
        "edge",
        """, x AS (SELECT regexp_replace(callee, '^boundary:', '') AS name, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM edge WHERE callee LIKE 'boundary:%'),
p AS (SELECT CASE WHEN contains(name, '::') THEN split_part(name, '::', 1) ELSE split_part(name, '.', 1) END AS module, name, count(*) AS n, min(struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey)) AS ord FROM x GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY module ORDER BY ord, name) AS nth FROM p)
SELECT module, CAST(sum(n) AS BIGINT) AS n_calls, string_agg(name, '|' ORDER BY nth) FILTER (nth <= 5) AS sample FROM r GROUP BY 1""",
    ),
)
def ag9(spark: SparkSession, d: str) -> DataFrame:
    return nav.externals(b.edges(spark, d)).select("module", "n_calls", *joined("sample"))


@query(
    "ag10_totals",
    with_sql("fnode edge", "SELECT (SELECT count(*) FROM fnode WHERE NOT synthetic) AS n_functions, (SELECT count(DISTINCT file) FROM fnode WHERE NOT synthetic) AS n_files, (SELECT count(DISTINCT class_name) FROM fnode WHERE NOT synthetic) AS n_classes, (SELECT count(*) FROM edge WHERE call_type = 'boundary') AS n_boundary_edges, (SELECT count(*) FROM edge WHERE call_type = 'internal_func') AS n_internal_edges"),
)
def ag10(spark: SparkSession, d: str) -> DataFrame:
    return nav.totals(b.nodes(spark, d), b.edges(spark, d))


@query("ag11_function_counts", with_sql("fnode", "SELECT file, count(*) AS n_functions FROM fnode WHERE NOT synthetic GROUP BY 1"))
def ag11(spark: SparkSession, d: str) -> DataFrame:
    return nav.function_counts(b.nodes(spark, d))


@query("pf10_tk2_entry_points", with_sql("fnode edge", _DEGREE + f"SELECT id, qualname, file, n_callees, n_callers FROM fnode JOIN degree USING (id) WHERE NOT synthetic AND line_start > 0 AND (n_callers = 0 OR regexp_matches(name, '^({'|'.join(nav.ENTRY_HINTS)})($|_)'))"))
def pf10(spark: SparkSession, d: str) -> DataFrame:
    n = b.nodes(spark, d)
    return nav.entry_points(n, graph.degrees(n, b.edges(spark, d)))


_REL = """, k AS (SELECT *, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey) AS ord FROM edge WHERE call_type <> 'unresolved' AND caller <> callee AND caller IN (SELECT id FROM fnode)),
ins AS (SELECT * FROM k WHERE callee IN (SELECT id FROM fnode)), ext AS (SELECT caller, regexp_replace(callee, '^boundary:', '') AS name, ord FROM k WHERE callee NOT IN (SELECT id FROM fnode))
"""


@query("j2_call_relations", with_sql("fnode edge", _REL + "SELECT 'internal' AS side, caller, callee, count(*) AS n FROM ins GROUP BY ALL UNION ALL SELECT 'external', caller, name, count(*) FROM ext GROUP BY ALL"))
def j2(spark: SparkSession, d: str) -> DataFrame:
    inside, outside = inventory.call_relations(b.nodes(spark, d), b.edges(spark, d))
    rows = inside.select(F.lit("internal").alias("side"), "caller", "callee").union(outside.select(F.lit("external"), "caller", "name"))
    return rows.groupBy("side", "caller", "callee").agg(F.count("*").alias("n"))


def _seen(src: str, key: str, item: str, n: int = 25) -> str:
    return f"(SELECT k, string_agg(x, '|' ORDER BY nth) AS l, CAST(count(*) AS INT) AS n FROM (SELECT {key} AS k, {item} AS x, row_number() OVER (PARTITION BY {key} ORDER BY min(ord), {item}) AS nth FROM {src} GROUP BY {key}, {item}) WHERE nth <= {n} GROUP BY k)"


@query(
    "ag12_inventory",
    with_sql(
        "fnode edge",
        _REL
        + f"""SELECT f.id, coalesce(a.l, '') AS calls, coalesce(b.l, '') AS called_by, coalesce(c.l, '') AS ext_calls, coalesce(a.n, 0) AS n_calls_capped, coalesce(b.n, 0) AS n_called_by_capped, coalesce(c.n, 0) AS n_ext_calls_capped
FROM fnode f LEFT JOIN {_seen("ins", "caller", "callee")} a ON a.k = f.id LEFT JOIN {_seen("ins", "callee", "caller")} b ON b.k = f.id LEFT JOIN {_seen("ext", "caller", "name")} c ON c.k = f.id WHERE NOT synthetic AND line_start > 0""",
    ),
)
def ag12(spark: SparkSession, d: str) -> DataFrame:
    lists = ("calls", "called_by", "ext_calls")
    return inventory.inventory(b.nodes(spark, d), b.edges(spark, d)).select("id", *joined(*lists), *(f"n_{x}_capped" for x in lists))


@query(
    "ag25_member_relations",
    with_sql(
        "fnode edge",
        """, k AS (SELECT *, struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey) AS ord FROM edge WHERE call_type <> 'unresolved'),
a AS (SELECT caller, qualname, row_number() OVER (PARTITION BY caller ORDER BY ord, callee) AS nth FROM k JOIN fnode ON callee = id),
z AS (SELECT callee, caller, row_number() OVER (PARTITION BY callee ORDER BY ord, caller) AS nth FROM k)
SELECT f.id, coalesce((SELECT string_agg(qualname, '|' ORDER BY nth) FROM a WHERE a.caller = f.id AND nth <= 6), '') AS calls, coalesce((SELECT string_agg(caller, '|' ORDER BY nth) FROM z WHERE z.callee = f.id AND nth <= 6), '') AS called_by
FROM fnode f WHERE NOT synthetic AND line_start > 0""",
    ),
)
def ag25(spark: SparkSession, d: str) -> DataFrame:
    return inventory.members(b.nodes(spark, d), b.edges(spark, d)).select("id", *(F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("calls", "called_by")))


@query("ag12b_type_inventory", with_sql("fnode", "SELECT file, string_agg(line_start || ':' || name || ':' || (CASE WHEN length(signature) > 200 THEN signature[:199] || '…' ELSE signature END), '|' ORDER BY line_start, name) AS types FROM fnode WHERE class_name IS NULL GROUP BY 1"))
def ag12b(spark: SparkSession, d: str) -> DataFrame:
    out = inventory.type_inventory(b.nodes(spark, d).where("class_name is null"))
    return out.select("file", F.array_join(F.transform("types", lambda t: F.concat_ws(":", t["line_start"].cast("string"), t["name"], t["signature"])), "|").alias("types"))


@query("ag26_keep_last", "SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY 1")
def ag26_last(spark: SparkSession, d: str) -> DataFrame:
    return inventory.keep_last(b.table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", "event_type")


@query("ag26_keep_first", with_sql("file", "SELECT hash, min(doc_id) AS doc_id FROM file GROUP BY 1"))
def ag26_first(spark: SparkSession, d: str) -> DataFrame:
    return inventory.keep_first(b.files(spark, d), "hash", "doc_id").select("hash", "doc_id")


@query(
    "j5_merge_notes",
    with_sql(
        "fnode",
        """, notes AS (SELECT file, CASE WHEN line_start % 3 = 0 THEN qualname WHEN line_start % 3 = 1 THEN 'Other.' || name ELSE 'nothing' || line_start END AS note, 'does ' || line_start AS purpose, line_start AS ord FROM fnode),
e AS (SELECT file, note, arg_min(purpose, ord) AS purpose FROM notes GROUP BY 1, 2), l AS (SELECT file, split_part(note, '.', -1) AS leaf, arg_min(purpose, ord) AS purpose FROM notes GROUP BY 1, 2)
SELECT f.id, coalesce(e.purpose, l.purpose) AS purpose FROM fnode f LEFT JOIN e ON e.file = f.file AND e.note = f.qualname LEFT JOIN l ON l.file = f.file AND l.leaf = split_part(f.qualname, '.', -1)""",
    ),
)
def j5(spark: SparkSession, d: str) -> DataFrame:
    n, k = b.nodes(spark, d), F.col("line_start") % 3
    notes = n.select("file", F.when(k == 0, F.col("qualname")).when(k == 1, F.concat(F.lit("Other."), "name")).otherwise(F.concat(F.lit("nothing"), F.col("line_start").cast("string"))).alias("name"), F.concat(F.lit("does "), F.col("line_start").cast("string")).alias("purpose"), F.col("line_start").alias("ord"))
    return inventory.merge_notes(n.select("id", "file", "qualname"), notes).select("id", "purpose")


@query(
    "j6_j25_match_loosely",
    with_sql(
        "file",
        """, named AS (SELECT DISTINCT CASE WHEN doc_id % 3 = 0 THEN path WHEN doc_id % 3 = 1 THEN lang || '/' || doc_id || '.txt' ELSE 'absent' || doc_id END AS named FROM file WHERE doc_id % 4 = 1)
SELECT named, path FROM named JOIN file ON named = path UNION ALL
SELECT named, min(path) FROM named JOIN file ON ends_with(path, '/' || named) WHERE named NOT IN (SELECT path FROM file) GROUP BY named HAVING count(*) = 1""",
    ),
)
def j6(spark: SparkSession, d: str) -> DataFrame:
    f, k = b.files(spark, d), F.col("doc_id") % 3
    name = F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))
    named = f.where("doc_id % 4 = 1").select(F.when(k == 0, F.col("path")).when(k == 1, F.concat_ws("/", "lang", name)).otherwise(F.concat(F.lit("absent"), F.col("doc_id").cast("string"))).alias("named")).distinct()
    return inventory.match_loosely(named, f.select("path"))


_STAGE_ORDER = "(SELECT event_type AS stage, row_number() OVER (ORDER BY event_type) AS ord FROM (SELECT DISTINCT event_type FROM events))"


def _order(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window as W

    return b.votes(spark, d).select("stage").distinct().select("stage", F.row_number().over(W.orderBy("stage")).alias("ord"))


@query(
    "ag13_j20_majority",
    with_sql(
        "vote",
        f""", c AS (SELECT file, stage, count(*) AS n FROM vote WHERE member % 5 <> 0 GROUP BY 1, 2), r AS (SELECT c.*, row_number() OVER (PARTITION BY file ORDER BY n DESC, ord) AS nth FROM c JOIN {_STAGE_ORDER} o USING (stage))
SELECT v.file, coalesce(max(stage) FILTER (nth = 1), 'unassigned') AS stage, coalesce(string_agg(stage, '|' ORDER BY nth) FILTER (nth IN (2, 3)), '') AS also FROM (SELECT DISTINCT file FROM vote) v LEFT JOIN r ON r.file = v.file GROUP BY 1""",
    ),
)
def ag13(spark: SparkSession, d: str) -> DataFrame:
    v = b.votes(spark, d).withColumn("stage", F.when(F.col("member") % 5 != 0, F.col("stage")))
    return stages.majority(v, _order(spark, d)).select("file", "stage", *joined("also"))


@query(
    "ag14_rebuild_assignment",
    with_sql(
        "vote",
        """, a AS (SELECT DISTINCT file, CASE WHEN member % 3 = 0 THEN 'ghost' ELSE stage END AS stage, list_value('view', 'ghost', 'click', stage) AS also FROM vote WHERE member < 500)
SELECT file, CASE WHEN stage = 'ghost' THEN 'unassigned' ELSE stage END AS stage2, array_to_string(list_filter(also, lambda x: x <> 'ghost' AND x <> (CASE WHEN stage = 'ghost' THEN 'unassigned' ELSE stage END)), '|') AS also FROM a""".replace("stage2", "stage"),
    )
    .replace("WHERE member < 500)", "WHERE member IN (SELECT min(member) FROM vote GROUP BY file))"),
)
def ag14(spark: SparkSession, d: str) -> DataFrame:
    v = b.votes(spark, d)
    one = v.groupBy("file").agg(F.min(F.struct("member", "stage")).alias("m")).select("file", "m.*")
    a = one.select("file", F.when(F.col("member") % 3 == 0, "ghost").otherwise(F.col("stage")).alias("stage"), F.array(F.lit("view"), F.lit("ghost"), F.lit("click"), "stage").alias("also"))
    return stages.rebuild_assignment(a, v.select(F.col("stage").alias("id")).distinct()).select("file", "stage", *joined("also"))


@query("ag24_bucket_sizes", with_sql("vote", f", c AS (SELECT file, stage, count(*) AS n FROM vote GROUP BY 1, 2), r AS (SELECT c.*, row_number() OVER (PARTITION BY file ORDER BY n DESC, ord) AS nth FROM c JOIN {_STAGE_ORDER} o USING (stage)) SELECT stage, count(*) AS n_files FROM r WHERE nth = 1 GROUP BY 1"))
def ag24(spark: SparkSession, d: str) -> DataFrame:
    return stages.buckets(stages.majority(b.votes(spark, d), _order(spark, d)))


@query("ag15_stage_stats", "WITH s AS (SELECT c_mktsegment AS stage, count(*) AS n_files FROM customer GROUP BY 1), m AS (SELECT avg(n_files) AS mean FROM s) SELECT stage, n_files, round(mean, 6) AS mean, round(greatest(20.0, 2.5 * mean), 6) AS floor, n_files > greatest(20.0, 2.5 * mean) AS overloaded FROM s, m")
def ag15(spark: SparkSession, d: str) -> DataFrame:
    out = stages.stage_stats(b.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("stage")).agg(F.count("*").alias("n_files")))
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "floor")})


_CARDS = """, card AS (SELECT dir, path AS file, 'role' || (doc_id % 3) AS role, CASE doc_id % 4 WHEN 0 THEN 'none' WHEN 1 THEN '' ELSE 'life' || (doc_id % 5) END AS lifecycle, CASE WHEN doc_id % 6 = 0 THEN '' ELSE repeat('p', CAST(doc_id % 50 AS INT) + 1) END AS purpose FROM file)
"""


def _rank_sql(item: str, n: int, where: str = "true", show: str = "") -> str:
    return f"(SELECT dir, string_agg({show or item}, '|' ORDER BY nth) AS l FROM (SELECT dir, {item}, count(*) AS n, row_number() OVER (PARTITION BY dir ORDER BY count(*) DESC, {item}) AS nth FROM card WHERE {where} GROUP BY 1, 2) WHERE nth <= {n} GROUP BY 1)"


@query(
    "ag16_dir_rollups",
    with_sql(
        "file",
        _CARDS
        + f"""SELECT c.dir, count(*) AS n_files, any_value(r.l) AS roles, coalesce(any_value(l.l), '') AS lifecycles, coalesce(any_value(p.l), '') AS purposes FROM card c LEFT JOIN {_rank_sql("role", 1000, show="role || ':' || n")} r USING (dir)
LEFT JOIN {_rank_sql("lifecycle", 3, "lifecycle <> '' AND lifecycle <> 'none'")} l USING (dir)
LEFT JOIN (SELECT dir, string_agg(purpose, '|' ORDER BY nth) AS l FROM (SELECT *, row_number() OVER (PARTITION BY dir ORDER BY length(purpose) DESC, file) AS nth FROM card WHERE purpose <> '') WHERE nth <= 4 GROUP BY 1) p USING (dir) GROUP BY c.dir""",
    ),
)
def ag16(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    cards = b.files(spark, d).select(
        "dir", F.col("path").alias("file"), F.concat(F.lit("role"), (k % 3).cast("string")).alias("role"),
        F.when(k % 4 == 0, "none").when(k % 4 == 1, "").otherwise(F.concat(F.lit("life"), (k % 5).cast("string"))).alias("lifecycle"), F.when(k % 6 == 0, "").otherwise(F.repeat(F.lit("p"), (k % 50 + 1).cast("int"))).alias("purpose"),
    )
    return stages.dir_rollups(cards).select("dir", "n_files", *(F.coalesce(F.array_join(c, "|"), F.lit("")).alias(c) for c in ("roles", "lifecycles", "purposes")))


@query("ag17_path_prefixes", with_sql("file", "SELECT lang AS stage, string_agg(dir, '|' ORDER BY nth) AS prefixes FROM (SELECT lang, dir, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, dir) AS nth FROM file GROUP BY 1, 2) WHERE nth <= 2 GROUP BY 1"))
def ag17(spark: SparkSession, d: str) -> DataFrame:
    return stages.path_prefixes(b.files(spark, d).withColumnRenamed("lang", "stage")).select("stage", *joined("prefixes"))


@query(
    "j8_w2_direct_files",
    with_sql("file", "SELECT lang AS stage, path AS file, CAST(row_number() OVER (PARTITION BY lang ORDER BY CASE WHEN doc_id % 2 = 0 THEN -doc_id END NULLS LAST, doc_id) AS INT) AS place FROM file"),
)
def j8(spark: SparkSession, d: str) -> DataFrame:
    f = b.files(spark, d)
    return stages.direct_files(f.select(F.col("lang").alias("stage"), F.col("path").alias("file"), F.col("doc_id").alias("bucket_ord")), f.where("doc_id % 2 = 0").select(F.col("lang").alias("stage"), F.col("path").alias("file"), (-F.col("doc_id")).alias("rank")))


@query(
    "j9_groups",
    with_sql(
        "file",
        """, org AS (SELECT lang AS stage, g AS group_ord, 'g' || g AS title, path AS file FROM file, (VALUES (2), (3), (5)) t(g) WHERE doc_id % g = 0 UNION ALL SELECT 'en', 1, 'g1', 'absent.txt')
SELECT f.lang AS stage, arg_min(o.title, o.group_ord) AS title, f.path AS file FROM file f LEFT JOIN org o ON o.stage = f.lang AND o.file = f.path GROUP BY f.lang, f.path""",
    ),
)
def j9(spark: SparkSession, d: str) -> DataFrame:
    f = b.files(spark, d)
    own = f.withColumn("g", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5)))).where("doc_id % g = 0").select(F.col("lang").alias("stage"), F.col("g").alias("group_ord"), F.concat(F.lit("g"), F.col("g").cast("string")).alias("title"), F.col("path").alias("file"))
    org = own.union(spark.range(1).select(F.lit("en"), F.lit(1), F.lit("g1"), F.lit("absent.txt")))
    return stages.groups(org, f.select(F.col("lang").alias("stage"), F.col("path").alias("file")))


@query("j10_file_stage_index", with_sql("file", "SELECT path AS file, lang AS stage FROM file"))
def j10(spark: SparkSession, d: str) -> DataFrame:
    nested = b.files(spark, d).groupBy(F.col("lang").alias("stage")).agg(F.collect_list("path").alias("files"))
    return nested.select(F.explode("files").alias("file"), "stage")


@query("j11_direct_registers", "SELECT doc_id AS id FROM documents WHERE list_contains([lang, source], 'de')")
def j11(spark: SparkSession, d: str) -> DataFrame:
    return stages.direct_registers(b.table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.array("lang", "source").alias("stages")), "de").select("id")


@query("gr1_stage_children", with_sql("stage", "SELECT s.id, coalesce(string_agg(c.id, '|' ORDER BY c.ord), '') AS children FROM stage s LEFT JOIN stage c ON c.parent = s.id GROUP BY s.id"))
def gr1(spark: SparkSession, d: str) -> DataFrame:
    return stages.children(b.stages(spark, d)).select("id", *joined("children"))


@query("gr1_stage_roots", with_sql("stage", "SELECT id, parent FROM stage WHERE id <> 'r1' AND (parent IS NULL OR parent = 'r1')"))
def gr1_roots(spark: SparkSession, d: str) -> DataFrame:
    return stages.roots(b.stages(spark, d).where("id <> 'r1'")).select("id", "parent")


_BELOW = ", below AS (SELECT id AS ancestor, id, 0 AS depth FROM stage UNION ALL SELECT b.ancestor, s.id, b.depth + 1 FROM below b JOIN stage s ON s.parent = b.id)\n"


@query("gr2_subtree", with_sql("stage", _BELOW + "SELECT ancestor, id, depth FROM below", recursive=True))
def gr2(spark: SparkSession, d: str) -> DataFrame:
    return stages.subtree(b.stages(spark, d))


@query("ag21_subtree_files", with_sql("stage", _BELOW + "SELECT ancestor AS stage, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_files FROM below LEFT JOIN (SELECT 'n' || c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1) c USING (id) GROUP BY 1", recursive=True))
def ag21(spark: SparkSession, d: str) -> DataFrame:
    sizes = b.table(spark, d, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("stage")).agg(F.count("*").alias("n_files"))
    return stages.subtree_files(b.stages(spark, d), sizes)


@query(
    "w3_numbering",
    with_sql(
        "stage",
        ", placed AS (SELECT id, parent, row_number() OVER (PARTITION BY parent ORDER BY ord) AS nth FROM stage WHERE NOT crosscut), n AS (SELECT id, CAST(nth AS VARCHAR) AS number FROM placed p WHERE NOT EXISTS (SELECT 1 FROM placed q WHERE q.id = p.parent) UNION ALL SELECT p.id, n.number || '.' || p.nth FROM n JOIN placed p ON p.parent = n.id) SELECT id, number FROM n",
        recursive=True,
    ),
)
def w3(spark: SparkSession, d: str) -> DataFrame:
    return stages.numbering(b.stages(spark, d))


@query("w4_pager", with_sql("stage", "SELECT id, lag(id) OVER (ORDER BY ord) AS prev, lead(id) OVER (ORDER BY ord) AS next FROM stage WHERE NOT crosscut"))
def w4(spark: SparkSession, d: str) -> DataFrame:
    return stages.pager(b.stages(spark, d))


@query("ag28_overview", with_sql("stage", "SELECT s.id, s.title, coalesce(c.n, 0) AS n_files, CASE WHEN s.ord % 2 = 0 THEN 'about ' || s.title END AS text FROM stage s LEFT JOIN (SELECT 'n' || c_nationkey AS id, count(*) AS n FROM customer GROUP BY 1) c USING (id)"))
def ag28(spark: SparkSession, d: str) -> DataFrame:
    s = b.stages(spark, d)
    sizes = b.table(spark, d, "customer").groupBy(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("stage")).agg(F.count("*").alias("n_files"))
    return stages.overview(s, sizes, s.where("ord % 2 = 0").select(F.col("id").alias("stage"), F.concat(F.lit("about "), "title").alias("text")))


@query("ag20_card_coverage", "SELECT count(*) AS n_files, count(l.doc_id) AS n_described FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id")
def ag20(spark: SparkSession, d: str) -> DataFrame:
    return stages.card_coverage(b.table(spark, d, "documents").select(F.col("doc_id").alias("file")), b.table(spark, d, "labels").select(F.col("doc_id").alias("file")))
