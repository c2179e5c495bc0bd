"""The driver's tables read as a code graph, stages, files and job logs.

``spark`` gives each binding as a DataFrame, ``SQL`` the same as common table expressions for the oracle.
Hints and entry names below are fixed values of the binding, not of an operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an unresolved call looks like, by line number of the line item.
HINTS = {1: "self.logger.info", 2: "self.cache", 3: '"abc".join', 4: "len", 5: "obj.method", 6: "helper", 7: "print(x)"}


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """``id, name, qualname, file, class_name, line_start, line_end, signature, is_async, synthetic, kind`` of functions."""
    place = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("/", "r_name", F.concat("n_name", F.lit(".x"))).alias("file"))
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("c").alias("side"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("class_name"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.lit("s").alias("side"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.lit(None).cast("string").alias("class_name"))
    rows = c.unionByName(s).join(F.broadcast(place), F.col("nation") == F.col("n_nationkey"))  # the nations are a fixed list
    return rows.select(
        F.concat("side", F.col("key").cast("string")).alias("id"), "name", F.concat(F.coalesce(F.concat("class_name", F.lit(".")), F.lit("")), "name").alias("qualname"), "file", "class_name",
        (F.col("key") + 1).cast("int").alias("line_start"), (F.col("key") + 5 + F.col("key") % 7).cast("int").alias("line_end"), F.concat("name", F.lit("("), (F.col("key") % 4).cast("string"), F.lit(")")).alias("signature"),
        (F.col("key") % 2 == 0).alias("is_async"), (F.col("key") % 10 == 0).alias("synthetic"), F.lit("internal").alias("kind"),
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    """``caller, callee, call_type, is_await, ord``: a row for each call site; ``ord`` gives the order of the array."""
    l = table(spark, d, "lineitem")  # noqa: E741
    rows = l.join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    hint = F.coalesce(*(F.when(F.col("l_linenumber") == k, F.lit(h)) for k, h in HINTS.items()), F.lit("other"))
    flag = F.col("l_returnflag")
    callee = F.when(flag == "A", F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).when(flag == "R", F.concat(F.lit("boundary:"), F.concat_ws(".", F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.regexp_replace("p_type", " ", "_"), F.regexp_replace("p_name", " ", "_")))).otherwise(F.concat(F.lit("unresolved:"), hint))
    kind = F.when(flag == "A", "internal_func").when(flag == "R", "boundary").otherwise("unresolved")
    return rows.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("caller"), callee.alias("callee"), kind.alias("call_type"), (F.col("l_linestatus") == "O").alias("is_await"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("ord"))


def stages(spark: SparkSession, d: str) -> DataFrame:
    """``id, parent, ord, title``: a root, its regions, their nations; ``crosscut`` for one region."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id"), F.lit("root").alias("parent"), (F.col("r_regionkey") + 1).cast("int").alias("ord"), F.col("r_name").alias("title"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), (F.col("n_nationkey") + 100).cast("int").alias("ord"), F.col("n_name").alias("title"))
    root = spark.range(1).select(F.lit("root").alias("id"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("ord"), F.lit("all").alias("title"))
    return root.unionByName(r).unionByName(n).withColumn("crosscut", F.col("id") == "r2")


def votes(spark: SparkSession, d: str) -> DataFrame:
    """``file, stage, member, stage_ord``: every event is a member that votes for its type."""
    e = table(spark, d, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("file"), F.col("event_type").alias("stage"), F.col("event_id").alias("member"))


def files(spark: SparkSession, d: str) -> DataFrame:
    """``path, dir, content, hash, doc_id, lang``."""
    t = table(spark, d, "documents")
    return t.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.concat_ws("/", "source", "lang").alias("dir"), F.col("text").alias("content"), F.sha2("text", 256).alias("hash"), "doc_id", "lang", "source")


def after(spark: SparkSession, d: str) -> DataFrame:
    """The files after a change: one in seven edited, one in eleven gone, one in thirteen also as a new file."""
    old = files(spark, d).where("doc_id % 11 <> 0")
    edited = old.withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit(" edited"))).otherwise(F.col("content")))
    new = files(spark, d).where("doc_id % 13 = 0").withColumn("doc_id", F.col("doc_id") + 1_000_000).withColumn("path", F.concat_ws("/", "dir", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return edited.unionByName(new).withColumn("hash", F.sha2("content", 256))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """``job, ts, seq, type, value``: the events of a user are the log of a job."""
    return table(spark, d, "events").select(F.col("user_id").alias("job"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), F.col("event_type").alias("type"), "value")


_HINT_SQL = " ".join(f"WHEN {k} THEN '{h}'" for k, h in HINTS.items())

#: The bindings as SQL; each needs those before it that it names.
SQL = {
    "fnode": """fnode AS (
  SELECT side || key AS id, name, coalesce(class_name || '.', '') || name AS qualname, r_name || '/' || n_name || '.x' AS file, class_name, CAST(key + 1 AS INT) AS line_start,
         CAST(key + 5 + key % 7 AS INT) AS line_end, name || '(' || (key % 4) || ')' AS signature, key % 2 = 0 AS is_async, key % 10 = 0 AS synthetic, 'internal' AS kind
  FROM (SELECT 'c' AS side, c_custkey AS key, c_name AS name, c_nationkey AS nation, c_mktsegment AS class_name FROM customer
        UNION ALL SELECT 's', s_suppkey, s_name, s_nationkey, NULL FROM supplier) x JOIN nation ON nation = n_nationkey JOIN region ON n_regionkey = r_regionkey)""",
    "edge": f"""edge AS (
  SELECT 'c' || o_custkey AS caller,
         CASE l_returnflag WHEN 'A' THEN 's' || l_suppkey
           WHEN 'R' THEN 'boundary:' || regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g') || '.' || replace(p_type, ' ', '_') || '.' || replace(p_name, ' ', '_')
           ELSE 'unresolved:' || CASE l_linenumber {_HINT_SQL} ELSE 'other' END END AS callee,
         CASE l_returnflag WHEN 'A' THEN 'internal_func' WHEN 'R' THEN 'boundary' ELSE 'unresolved' END AS call_type, l_linestatus = 'O' AS is_await,
         l_orderkey, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)""",
    "stage": """stage AS (
  SELECT 'root' AS id, CAST(NULL AS VARCHAR) AS parent, 0 AS ord, 'all' AS title, false AS crosscut
  UNION ALL SELECT 'r' || r_regionkey, 'root', r_regionkey + 1, r_name, r_regionkey = 2 FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_nationkey + 100, n_name, false FROM nation)""",
    "vote": "vote AS (SELECT 'u' || user_id AS file, event_type AS stage, event_id AS member FROM events)",
    "file": """file AS (
  SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, source || '/' || lang AS dir, text AS content, sha256(text) AS hash, doc_id, lang, source FROM documents)""",
    "file2": """file2 AS (
  SELECT path, dir, content, sha256(content) AS hash, doc_id, lang FROM (
    SELECT path, dir, CASE WHEN doc_id % 7 = 0 THEN content || ' edited' ELSE content END AS content, doc_id, lang FROM file WHERE doc_id % 11 <> 0
    UNION ALL SELECT dir || '/' || (doc_id + 1000000) || '.txt', dir, content, doc_id + 1000000, lang FROM file WHERE doc_id % 13 = 0) y)""",
    "job": "job AS (SELECT user_id AS job, ts, event_id AS seq, event_type AS type, value FROM events)",
}


def with_sql(names: str, body: str, recursive: bool = False) -> str:
    """``body`` after the bindings named; it may go on with further expressions if it starts with a comma."""
    return f"WITH {'RECURSIVE ' * recursive}" + ",\n".join(SQL[n] for n in names.split()) + "\n" + body
