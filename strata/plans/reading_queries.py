"""Anchors and spans, stage maps, call facts, shapes of replies, patterns that may never end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.operators import readings
from strata.plans import bindings as b
from strata.plans.bindings import with_sql
from strata.plans.registry import query

#: Patterns of the binding, and what they are.
PATTERNS = {"(a+)+": True, r"(a\+)+": False, "([+*])+": False, "((a)+)*": True, "(a{2,})+": True, "(a{2,3})+": False, "((a*)b)*": False, "a+(b)*": False}


@query("v6_anchors", with_sql("fnode", "SELECT file, qualname, line_start, line_end FROM fnode WHERE kind = 'internal' AND NOT synthetic AND line_start > 0"))
def v6(spark: SparkSession, d: str) -> DataFrame:
    return readings.anchors(b.nodes(spark, d))


@query("ag29_line_spans", with_sql("fnode", "SELECT DISTINCT file, line_start, line_end FROM fnode WHERE line_start IS NOT NULL AND line_end IS NOT NULL"))
def ag29(spark: SparkSession, d: str) -> DataFrame:
    return readings.line_spans(b.nodes(spark, d))


@query(
    "pf17_patterns",
    "SELECT p_partkey AS part, CASE p_partkey % 8 "
    + " ".join(f"WHEN {k} THEN {str(bad).lower()}" for k, bad in enumerate(PATTERNS.values()))
    + " END AS bad FROM part",
)
def pf17(spark: SparkSession, d: str) -> DataFrame:
    """The name of every part in front of a pattern; names hold letters and spaces only."""
    own = F.element_at(F.array(*map(F.lit, PATTERNS)), (F.col("p_partkey") % 8 + 1).cast("int"))
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("part"), readings.may_never_end(F.concat("p_name", own)).alias("bad"))


@query(
    "ag30_odd_quotes",
    """SELECT doc_id, (length(text) - length(replace(text, '"', ''))) % 2 + (length(text) - length(replace(text, '"', '')) + 1) % 2 + 1 AS n FROM documents WHERE text IS NOT NULL""",
)
def ag30(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a string, once more with a quote before it, and a key of one quote."""
    text = F.col("text")
    json = F.to_json(F.struct(text.alias("k"), F.array(F.concat(F.lit('"'), text)).alias("l"), F.lit(1).alias('"')))
    return b.table(spark, d, "documents").where("text is not null").select("doc_id", readings.odd_quotes(json).cast("long").alias("n"))


@query(
    "st24_replies",
    """SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'keys: semantics, semantic' WHEN 1 THEN 'top-level array of 2' ELSE 'no JSON block in the reply' END AS shape,
  CASE WHEN turn % 3 = 0 THEN nullif(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '') END AS picked,
  regexp_replace(substr(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), 1, 200), '\\s+', ' ', 'g') AS excerpt FROM conversations WHERE text IS NOT NULL""",
)
def st24(spark: SparkSession, d: str) -> DataFrame:
    """A third of the turns as objects with a blank first name, a third as arrays, a third cut off; excerpts read back from JSON."""
    text, turn = F.col("text"), F.col("turn")
    whole = F.to_json(F.struct(F.lit(" ").alias("semantics"), text.alias("semantic")))
    json = F.when(turn % 3 == 0, whole).when(turn % 3 == 1, F.to_json(F.array(text, text))).otherwise(F.concat(F.lit("{"), whole))
    said = F.get_json_object(F.concat(F.lit('{"x":'), readings.excerpt(text), F.lit("}")), "$.x")
    picked = readings.pick_string(F.try_parse_json(json), "semantics", "semantic")
    return b.table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", readings.json_shape(json).alias("shape"), picked.alias("picked"), said.alias("excerpt"))


@query(
    "st33_call_facts",
    """SELECT o_orderkey AS fn, CASE WHEN n = 0 THEN '' ELSE '*Call graph*: calls ' || n || ' internal (' || array_to_string(names[1:10], ', ') || CASE WHEN n > 10 THEN ' (+' || (n - 10) || ' more)' ELSE '' END || '); called by 1.' END AS facts,
  '- `' || o_orderkey || '` — ' || o_orderpriority || ' [' || o_orderstatus || ']' AS line
FROM (SELECT o_orderkey, o_orderpriority, o_orderstatus, count(l_linenumber) AS n, list('s' || l_suppkey ORDER BY l_linenumber, l_suppkey) FILTER (l_linenumber IS NOT NULL) AS names
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL) x""",
)
def st33(spark: SparkSession, d: str) -> DataFrame:
    """An order as a function that calls the suppliers of its lines (a handful each)."""
    lines = b.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("ls"))
    rows = b.table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    names = F.coalesce(F.transform("ls.l_suppkey", lambda s: F.concat(F.lit("m.s"), s.cast("string"))), F.array().cast("array<string>"))
    one, none = F.when(F.size(names) > 0, 1).otherwise(0), F.array().cast("array<string>")
    facts = readings.call_facts(F.size(names), names, one, none, F.lit(0), none)
    line = readings.file_line(F.col("o_orderkey").cast("string"), F.concat(F.lit(" "), "o_orderpriority", F.lit("\n")), F.col("o_orderstatus"))
    return rows.select(F.col("o_orderkey").alias("fn"), facts.alias("facts"), line.alias("line"))


@query(
    "st32_stage_map",
    with_sql(
        "stage",
        """, n AS (SELECT id, parent, ord, title, crosscut, CASE WHEN left(id, 1) = 'n' THEN 'x_' || (CAST(substr(id, 2) AS INT) // 2) || CASE WHEN CAST(substr(id, 2) AS INT) % 2 = 1 THEN '_' ELSE '' END ELSE id END AS name FROM stage)
SELECT 2 AS part, ord AS a, 0 AS b, '  ' || name || '["' || title || ' #quot;q#quot;"]' || CASE WHEN crosscut THEN ':::crosscut' ELSE '' END AS line FROM n
UNION ALL SELECT 3, p.ord, c.ord, '  ' || p.name || ' --> ' || c.name FROM n c JOIN n p ON c.parent = p.id
UNION ALL VALUES (0, 0, 0, '```mermaid'), (1, 0, 0, 'flowchart TD'), (4, 0, 0, '  classDef crosscut stroke-dasharray: 5 5;'), (5, 0, 0, '```')""",
    ),
)
def st32(spark: SparkSession, d: str) -> DataFrame:
    """Two nations each have ids that are the same but for a dot: ``x.0`` and ``x_0``."""
    key = F.expr("cast(substr(id, 2) as int)")
    own = F.when(F.col("id").startswith("n"), F.concat(F.when(key % 2 == 0, "x.").otherwise("x_"), F.floor(key / 2).cast("string"))).otherwise(F.col("id"))
    return readings.stage_map(b.stages(spark, d).select(own.alias("id"), "parent", F.col("ord").alias("place"), F.concat("title", F.lit(' \n"q" ')).alias("title"), "crosscut"))


@query(
    "st23_entry_lists",
    """SELECT event_id, CASE WHEN event_id % 6 < 5 THEN CASE WHEN event_id % 6 = 1 THEN 2 ELSE 1 END ELSE 0 END AS n,
  CASE WHEN event_id % 6 < 5 THEN event_type || '|' || user_id ELSE '' END AS first FROM events""",
)
def st23(spark: SparkSession, d: str) -> DataFrame:
    """Events as replies of six forms: a bare object, a list, a named list, a generic one, one in a wrapper, and a list of words."""
    k = F.col("event_id") % 6
    row = F.struct(F.col("event_type").alias("kind"), F.col("user_id").alias("who"))
    one, words = F.array(row), F.array(F.col("event_type"))
    json = (
        F.when(k == 0, F.to_json(row))
        .when(k == 1, F.to_json(F.array(row, row)))
        .when(k == 2, F.to_json(F.struct(words.alias("data"), one.alias("events"))))
        .when(k == 3, F.to_json(F.struct(words.alias("events"), one.alias("list"))))
        .when(k == 4, F.to_json(F.struct(F.struct(one.alias("events")).alias("result"))))
        .otherwise(F.to_json(words))
    )
    found = readings.entry_list(json, "events", fields=("kind",))
    first = F.try_element_at(found, F.lit(1))
    said = F.concat_ws("|", F.get_json_object(first, "$.kind"), F.get_json_object(first, "$.who"))
    return b.table(spark, d, "events").select("event_id", F.size(found).alias("n"), said.alias("first"))
