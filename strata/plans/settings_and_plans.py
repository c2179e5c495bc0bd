"""Plan parsing, settings, usage, cards, sinks as rows, and lists in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import graph, planning, settings
from strata.plans import bindings as b
from strata.plans.bindings import with_sql
from strata.plans.registry import query


@query("pt1_parse_plans")
def pt1(spark: SparkSession, d: str) -> DataFrame:
    """Every document as a plan of two edits, the second of which quotes the first's text in a longer fence."""
    line = F.regexp_replace(F.coalesce("text", F.lit("")), "[`~\n\r]", " ")
    text = F.concat(F.lit("### EDIT 1\n- file: `src/"), F.col("doc_id").cast("string"), F.lit(".py`\n- where: top\n```old\n"), line, F.lit("\n```\n```new\nx\n```\n### EDIT "), (F.col("doc_id") % 3).cast("string"), F.lit("\n- file: a/b.md\n````old\n```\n### EDIT 9\n```\n````\n````new\n"), line, F.lit("\n````\nDone.\n"))
    return planning.parse_plans(b.table(spark, d, "documents").select(F.col("doc_id").alias("plan"), text.alias("text")))


_KINDS = """, s AS (SELECT event_id AS setting, CASE event_id % 3 WHEN 0 THEN 'bool' WHEN 1 THEN 'int' ELSE 'enum' END AS kind FROM events),
g AS (
  SELECT event_id AS setting, 1 AS rank, 'flag' AS source, CASE WHEN event_id % 4 = 0 THEN event_type END AS raw FROM events
  UNION ALL SELECT event_id, 2, 'env', CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN ' Yes ' WHEN 2 THEN '-0' WHEN 3 THEN CAST(event_id % 90 AS VARCHAR) || '.5' END FROM events
  UNION ALL SELECT event_id, 4, 'default', CASE WHEN event_id % 7 <> 0 THEN 'off' END FROM events),
f AS (SELECT setting, source, raw FROM g WHERE raw IS NOT NULL AND NOT (source = 'env' AND raw = '') QUALIFY row_number() OVER (PARTITION BY setting ORDER BY rank) = 1),
r AS (SELECT s.setting, kind, source, raw, lower(trim(raw)) AS w, TRY_CAST(trim(raw) AS DOUBLE) AS n FROM s LEFT JOIN f USING (setting))
"""


@query(
    "j19_pf13_resolve_settings",
    "WITH " + _KINDS.strip().removeprefix(",") + """SELECT setting, source,
  CASE WHEN kind = 'bool' THEN CASE WHEN w IN ('1', 'true', 'yes', 'on') THEN 'true' WHEN w IN ('0', 'false', 'no', 'off') THEN 'false' END
    WHEN kind = 'int' THEN CASE WHEN n >= 1 AND n <= 60 AND raw <> '-0' THEN CAST(CAST(trunc(n) AS BIGINT) AS VARCHAR) END
    ELSE CASE WHEN raw IN ('click', 'view', 'off') THEN raw END END AS value,
  CASE WHEN raw IS NULL THEN NULL WHEN kind = 'bool' THEN CASE WHEN w NOT IN ('1', 'true', 'yes', 'on', '0', 'false', 'no', 'off') THEN 'no truth value' END
    WHEN kind = 'int' THEN CASE WHEN n IS NULL OR n < 1 OR raw = '-0' THEN 'not an integer from the least on' WHEN n > 60 THEN 'above the most' END
    ELSE CASE WHEN raw NOT IN ('click', 'view', 'off') THEN 'no choice' END END AS problem FROM r""",
)
def j19(spark: SparkSession, d: str) -> DataFrame:
    e, k = b.table(spark, d, "events"), F.col("event_id")
    known = e.select(k.alias("setting"), F.when(k % 3 == 0, "bool").when(k % 3 == 1, "int").otherwise("enum").alias("kind"), F.lit(1.0).alias("least"), F.lit(60.0).alias("most"), F.array(*map(F.lit, ("click", "view", "off"))).alias("choices"))
    env = F.when(k % 5 == 0, "").when(k % 5 == 1, " Yes ").when(k % 5 == 2, "-0").when(k % 5 == 3, F.concat((k % 90).cast("string"), F.lit(".5")))
    ways = {"flag": F.when(k % 4 == 0, F.col("event_type")), "env": env, "default": F.when(k % 7 != 0, "off")}
    given = F.explode(F.array(*(F.struct(F.lit(s).alias("source"), raw.cast("string").alias("raw")) for s, raw in ways.items())))
    return settings.resolved(known, e.select(k.alias("setting"), given.alias("g")).select("setting", "g.*"))


@query(
    "v2_unknown_keys",
    "WITH k AS (SELECT DISTINCT event_type AS key FROM events), a AS (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN event_type ELSE event_type || 'x' END AS asked FROM events), u AS (SELECT asked FROM a WHERE asked NOT IN (SELECT key FROM k)), p AS (SELECT asked, key, levenshtein(asked, key) AS d FROM u JOIN k ON levenshtein(asked, key) <= least(3, greatest(1, length(asked) // 4))) SELECT u.asked, (SELECT arg_min(key, struct_pack(d := d, k := key)) FROM p WHERE p.asked = u.asked) AS key FROM u",
)
def v2(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    known = e.select(F.col("event_type").alias("key")).distinct().select("key", F.col("key").alias("ord"))
    return settings.unknown_keys(e.select(F.when(F.col("event_id") % 2 == 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit("x"))).alias("asked")), known)


@query("ag23_usage", "SELECT user_id AS who, count(*) AS calls, count(*) FILTER (event_type = 'error') AS failures, sum(CASE WHEN event_id % 6 = 0 THEN 0.0 ELSE coalesce(value, 0.0) END) AS elapsed FROM events GROUP BY 1")
def ag23(spark: SparkSession, d: str) -> DataFrame:
    e = b.table(spark, d, "events")
    spent = F.when(F.col("event_id") % 12 == 0, float("nan")).when(F.col("event_id") % 6 == 0, float("inf")).otherwise(F.col("value"))
    return settings.usage(e.select(F.col("user_id").alias("who"), (F.col("event_type") == "error").alias("failed"), spent.alias("elapsed")))


@query(
    "w7_dry_streaks",
    "WITH r AS (SELECT user_id AS who, event_id AS seq, event_type = 'purchase' AS progress, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events) SELECT who, seq, nth - coalesce(max(nth) FILTER (progress) OVER (PARTITION BY who ORDER BY seq ROWS UNBOUNDED PRECEDING), 0) AS dry FROM r",
)
def w7(spark: SparkSession, d: str) -> DataFrame:
    return settings.dry_streaks(b.table(spark, d, "events").select(F.col("user_id").alias("who"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("progress")))


@query(
    "w9_size_chunks",
    """WITH RECURSIVE i AS (SELECT user_id AS file, event_id AS ord, 1 + event_id * 7 % 30 AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS nth FROM events),
c AS (SELECT file, ord, nth, 0 AS chunk, size AS held FROM i WHERE nth = 1
  UNION ALL SELECT i.file, i.ord, i.nth, CASE WHEN c.held + i.size > 60 THEN c.chunk + 1 ELSE c.chunk END, CASE WHEN c.held + i.size > 60 THEN i.size ELSE c.held + i.size END FROM c JOIN i ON i.file = c.file AND i.nth = c.nth + 1)
SELECT file, ord, chunk FROM c""",
)
def w9(spark: SparkSession, d: str) -> DataFrame:
    items = b.table(spark, d, "events").select(F.col("user_id").alias("file"), F.col("event_id").alias("ord"), (1 + F.col("event_id") * 7 % 30).alias("size"))
    return settings.size_chunks(items, 60)


_CARDS = """WITH c AS (SELECT conv_id AS file, CASE WHEN conv_id % 5 = 0 THEN '' ELSE 'does it' END AS purpose, CASE WHEN conv_id % 3 = 0 THEN 'at length' ELSE '' END AS description,
  list(CASE WHEN turn % 2 = 1 AND conv_id % 2 = 0 THEN 'part' ELSE '' END) AS parts FROM conversations GROUP BY conv_id)
"""


def _cards(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("conv_id")
    return b.table(spark, d, "conversations").groupBy(k.alias("file")).agg(F.max(F.when(k % 5 == 0, "").otherwise("does it")).alias("purpose"), F.max(F.when(k % 3 == 0, "at length").otherwise("")).alias("description"), F.collect_list(F.when((F.col("turn") % 2 == 1) & (k % 2 == 0), "part").otherwise("")).alias("parts"))


@query("pf8_card_done", _CARDS + "SELECT file, purpose <> '' AS brief, purpose <> '' AND (description <> '' OR len(list_filter(parts, lambda x: x <> '')) > 0) AS deep FROM c")
def pf8(spark: SparkSession, d: str) -> DataFrame:
    from strata.operators.inventory import card_done

    return _cards(spark, d).select("file", card_done("brief").alias("brief"), card_done("deep").alias("deep"))


@query("pf9_card_detail", _CARDS + "SELECT CASE WHEN bool_or(description <> '' OR len(parts) > 0) THEN 'deep' ELSE 'brief' END AS detail FROM c")
def pf9(spark: SparkSession, d: str) -> DataFrame:
    from strata.operators.inventory import card_detail

    return card_detail(_cards(spark, d))


_ADJ = """, adj AS (SELECT a.file AS from_file, z.file AS to_file, count(*) AS weight FROM edge JOIN fnode a ON a.id = caller JOIN fnode z ON z.id = callee WHERE call_type <> 'unresolved' AND a.file <> z.file GROUP BY 1, 2),
ends AS (SELECT from_file AS file, weight FROM adj UNION ALL SELECT to_file, weight FROM adj), ranked AS (SELECT file, sum(weight) AS degree FROM ends GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10),
st AS (SELECT r_name || '/' || n_name || '.x' AS file, 'n' || n_nationkey AS stage FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 3 <> 0)
"""


@query("j16_impact_stages", with_sql("fnode edge", _ADJ + "SELECT r.file, coalesce(st.stage, 'unassigned') AS stage, CAST(degree AS BIGINT) AS degree, (SELECT count(*) FROM fnode f WHERE f.file = r.file) AS functions FROM ranked r LEFT JOIN st ON st.file = r.file"))
def j16(spark: SparkSession, d: str) -> DataFrame:
    nodes = b.nodes(spark, d)
    place = b.table(spark, d, "nation").join(b.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey % 3 <> 0")
    stages = place.select(F.concat_ws("/", "r_name", F.concat("n_name", F.lit(".x"))).alias("file"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("stage"))
    return graph.impact_stages(graph.impact(graph.file_adjacency(nodes, b.edges(spark, d)), 10)[0], stages, nodes)


@query("sk3_functions_csv", with_sql("fnode", """, e AS (SELECT id, CASE WHEN regexp_matches(signature, '[",\n]') THEN '"' || replace(signature, '"', '""') || '"' ELSE signature END AS sig, name, qualname, file, line_start, line_end, class_name, is_async FROM (SELECT * REPLACE (name || ', "' || name || '"' AS signature) FROM fnode))
SELECT id, concat_ws(',', id, name, qualname, file, line_start, line_end, coalesce(class_name, ''), CASE WHEN is_async THEN 'true' ELSE 'false' END, sig) AS line FROM e"""))
def sk3(spark: SparkSession, d: str) -> DataFrame:
    n = b.nodes(spark, d).withColumn("signature", F.concat("name", F.lit(', "'), "name", F.lit('"')))
    return graph.csv_lines(n, ["id", "name", "qualname", "file", "line_start", "line_end", "class_name", "is_async", "signature"])


@query("sk4_graph_dot_edges", with_sql("edge", """SELECT DISTINCT caller, callee, '  "' || replace(caller, '"', '\\"') || '" -> "' || replace(callee, '"', '\\"') || '"' || CASE WHEN is_await AND call_type = 'boundary' THEN ' [color="#1a73e8", style=dashed]' WHEN is_await THEN ' [color="#1a73e8"]' WHEN call_type = 'boundary' THEN ' [style=dashed]' ELSE '' END || ';' AS line FROM edge WHERE call_type <> 'unresolved'"""))
def sk4(spark: SparkSession, d: str) -> DataFrame:
    return graph.dot_edges(b.edges(spark, d)).distinct()


_EXT = (("py", ".py"), ("ts", ".ts"), ("ts", ".d.ts"), ("text", ".txt"), ("odd", "5.txt"))


@query("sc4_adapter_for_file", with_sql("file", f", a(lang, ext) AS (VALUES {', '.join(map(str, _EXT))}), h AS (SELECT path, arg_max(a.lang, length(ext)) AS lang FROM file JOIN a ON ends_with(path, ext) GROUP BY 1) SELECT f.path, h.lang FROM file f LEFT JOIN h USING (path)"))
def sc4(spark: SparkSession, d: str) -> DataFrame:
    from strata.sources import adapter_of

    return b.files(spark, d).select("path", adapter_of(F.col("path"), _EXT).alias("lang"))


_NOTES = """, j AS (SELECT doc_id, row_number() OVER (PARTITION BY 1 ORDER BY doc_id) AS line, CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '{"file": "' || path || '", "claim": "c"}' WHEN 2 THEN '{"file": ""}' ELSE 'no json' END AS raw, path FROM file)
"""


@query("sc10_corrections", with_sql("file", _NOTES + "SELECT doc_id AS line, CASE WHEN doc_id % 4 = 1 THEN path END AS file, CASE WHEN doc_id % 4 = 1 THEN 'c' END AS claim, CASE doc_id % 4 WHEN 2 THEN 'not a valid correction' WHEN 3 THEN 'not valid JSON' END AS problem FROM j WHERE raw <> ''"))
def sc10(spark: SparkSession, d: str) -> DataFrame:
    return _corrections(spark, d).select("line", "file", "claim", "problem")


def _corrections(spark: SparkSession, d: str) -> DataFrame:
    from strata.sources import corrections

    k = F.col("doc_id")
    raw = F.when(k % 4 == 0, " ").when(k % 4 == 1, F.concat(F.lit('{"file": "'), "path", F.lit('", "claim": "c"}'))).when(k % 4 == 2, '{"file": ""}').otherwise("no json")
    return corrections(b.files(spark, d).select(k.alias("line"), raw.alias("raw")))


@query("set5_corrected_files", with_sql("file", "SELECT DISTINCT path AS file FROM file WHERE doc_id % 4 = 1"))
def set5(spark: SparkSession, d: str) -> DataFrame:
    return _corrections(spark, d).where("problem is null").select("file").distinct()
