"""Operators on literal rows: the cases that the driver's tables don't hold."""

from pyspark.sql import functions as F

from strata.functions import text as t
from strata.operators import closure, delta, graph, inventory, nav, patch, resolve, stages


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_degrees_count_every_call_site(spark):
    nodes = spark.createDataFrame([(x, "internal", "a.py") for x in ("main", "spin", "helper")], "id string, kind string, file string")
    edges = spark.createDataFrame([("main", "spin", "internal_func"), ("main", "helper", "internal_func"), ("spin", "helper", "internal_func"), ("spin", "x", "unresolved")], "caller string, callee string, call_type string")
    assert rows(graph.degrees(nodes, edges), "id", "n_callees", "n_callers") == [("helper", 0, 2), ("main", 2, 0), ("spin", 1, 1)]


def test_dropped_categories(spark):
    hints = ["self.logger.info", "self._logger.x", "self.a", "this.b", "'a'.join", "len(x)", "a.b", "foo"]
    df = spark.createDataFrame([(f"unresolved:{h}",) for h in hints], "callee string").select("callee", graph.dropped_category(F.col("callee")).alias("c"))
    assert [r.c for r in df.collect()] == ["inherited_method", "inherited_method", "self_attr_unknown", "self_attr_unknown", "string_literal_method", "builtin", "local_var_method", "bare_name"]


def test_ambiguous_names_are_withdrawn_even_the_third_time(spark):
    df = spark.createDataFrame([("m1", "T"), ("m2", "T"), ("m3", "T"), ("m1", "U"), ("m1", "U")], "module string, type string")
    assert rows(resolve.unique_owner(df, ["type"]), "type", "module", "ambiguous") == [("T", None, True), ("U", "m1", False)]


def test_reach_ends_on_cycles(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), (None, "d")], "src string, dst string")
    got = rows(closure.reach(e), "src", "dst", "level")
    assert ("a", "d", 3) in got and ("a", "a", 0) in got and len(got) == 13


def test_components_and_empty_graph(spark):
    e = spark.createDataFrame([("b", "c"), ("x", "y"), ("c", "d"), ("y", "x")], "src string, dst string")
    assert rows(closure.components(e), "node", "component") == [("b", "b"), ("c", "b"), ("d", "b"), ("x", "x"), ("y", "x")]
    assert closure.components(e.limit(0)).collect() == []


def test_order_takes_cycles_last(spark):
    files = spark.createDataFrame([("s", f) for f in ("a", "b", "c", "x", "y")], "stage string, file string")
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "src string, dst string")
    assert [r.file for r in closure.order_in_groups(files, e).orderBy("place").collect()] == ["a", "b", "c", "x", "y"]


def test_subtree_survives_a_cycle(spark):
    s = spark.createDataFrame([("a", "b", 1), ("b", "a", 2), ("c", None, 3)], "id string, parent string, ord int")
    assert rows(stages.subtree(s), "ancestor", "id", "depth") == [("a", "a", 0), ("a", "b", 1), ("b", "a", 1), ("b", "b", 0), ("c", "c", 0)]


def test_majority_ties_go_to_the_earlier_stage(spark):
    v = spark.createDataFrame([("f", "b"), ("f", "a"), ("g", None)], "file string, stage string")
    order = spark.createDataFrame([("b", 1), ("a", 2)], "stage string, ord int")
    assert rows(stages.majority(v, order), "file", "stage", "also") == [("f", "b", ["a"]), ("g", "unassigned", [])]


def test_overlapping_occurrences(spark):
    df = spark.createDataFrame([("aaaa", "aa"), ("abc", ""), ("", "a"), ("abc", "abcd")], "t string, p string")
    assert [r.n for r in df.select(t.occurrences(F.col("t"), F.col("p")).alias("n")).collect()] == [3, 0, 0, 0]


def test_durations_and_sentences(spark):
    df = spark.createDataFrame([(5.4,), (65.0,), (3725.0,)], "s double").select(t.duration(F.col("s")).alias("x"))
    assert [r.x for r in df.collect()] == ["5s", "1m05s", "1h02m"]
    df = spark.createDataFrame([(" One. Two. ",), ("一。二",), ("none",)], "s string").select(t.first_sentence(F.col("s")).alias("x"))
    assert [r.x for r in df.collect()] == ["One.", "一。", "none"]


def test_script_checks(spark):
    df = spark.createDataFrame([("これは日本語の文章です、よろしく",), ("这是一个中文句子没有任何假名的",), ("short",)], "s string")
    got = [r.v for r in df.select(t.check_script(F.col("s"), "zh").alias("v")).collect()]
    assert [(g.ok, g.decided, g.looks_like) for g in got] == [(False, True, "ja"), (True, True, None), (True, False, None)]


def test_edits_of_one_file_follow_each_other(spark):
    files = spark.createDataFrame([("f", "one two two")], "file string, content string")
    edits = spark.createDataFrame([("f", 1, "one", "two"), ("f", 2, "two", "x"), ("f", 3, "two two", "y")], "file string, ord int, old string, new string")
    assert rows(patch.apply_in_order(edits, files), "file", "content", "failed") == [("f", "two two two", 2)]


def test_rollback_decisions(spark):
    m = spark.createDataFrame([("a", "1", "2", "1"), ("b", "1", "2", "9"), ("c", "1", "2", "1"), ("d", "1", "2", "1"), ("e", "1", "2", "1")], "file string, before_hash string, after_hash string, backup_hash string")
    live = spark.createDataFrame([("a", "2"), ("b", "2"), ("c", "1"), ("d", "7")], "file string, hash string")
    assert rows(patch.rollback_plan(m, live), "file", "action") == [("a", "restore"), ("b", "corrupt backup"), ("c", "already back"), ("d", "changed since"), ("e", "absent")]


def test_stale_mark_is_put_once(spark):
    c = spark.createDataFrame([("f", "x"), ("g", "x" + delta.STALE), ("h", "")], "file string, purpose string")
    assert rows(delta.mark_stale(delta.mark_stale(c, c), c), "file", "purpose") == [("f", "x" + delta.STALE), ("g", "x" + delta.STALE), ("h", "")]


def test_loose_match_needs_one_hit(spark):
    named = spark.createDataFrame([("b.py",), ("x/b.py",), ("q/x/b.py",)], "named string")
    valid = spark.createDataFrame([("q/x/b.py",), ("r/b.py",)], "path string")
    assert rows(inventory.match_loosely(named, valid), "named", "path") == [("q/x/b.py", "q/x/b.py"), ("x/b.py", "q/x/b.py")]


def test_same_rows_with_other_partitions(spark):
    from strata.plans import QUERIES
    from tests.oracle import SF, rows_of_spark

    one = rows_of_spark(QUERIES["ag12_inventory"](spark, SF))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert rows_of_spark(QUERIES["ag12_inventory"](spark, SF)) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_module_keys(spark):
    df = spark.createDataFrame([("boundary:a::b.c",), ("boundary:a.b",), ("boundary:a",)], "c string").select(nav.module_key(F.col("c")).alias("m"))
    assert [r.m for r in df.collect()] == ["a", "a", "a"]
