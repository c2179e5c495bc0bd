"""Patterns, shapes, excerpts, call facts and stage maps, by cases."""

from pyspark.sql import functions as F

from strata.operators import readings


def of(spark, column, values):
    return [r[0] for r in spark.createDataFrame(list(enumerate(values)), "k int, x string").orderBy("k").select(column).collect()]


def test_patterns_that_may_never_end(spark):
    bad = ["(a+)+", "(a{2,})+", "x(?:(b)+c){1,}", "((a)+)*", "(a+){ 1,}(b+)*"]
    good = ["", "a+", "(a+)", r"(a\+)+", "([+*])+", "(a+){2}", "(a)+(b)*", "(a{2,3})+", ")+", "(a", r"[\]+*](b", "(a+)?", "((a*)b)*", "\\"]
    assert of(spark, readings.may_never_end(F.col("x")), bad + good + [None]) == [True] * len(bad) + [False] * len(good) + [None]


def test_shape_of_json(spark):
    cases = [None, "broken", "null", "[]", "[1, 2]", "{}", '{"b": 1, "a": 2}', '{"a":1,"b":1,"c":1,"d":1,"e":1,"f":1,"g":1,"h":1,"i":1}', '"s"', "1.5", "true"]
    none = "no JSON block in the reply"
    assert of(spark, readings.json_shape(F.col("x")), cases) == [
        none, none, none, "top-level array of 0", "top-level array of 2", "keys: (none)", "keys: b, a", "keys: a, b, c, d, e, f, g, h, …",
        "top-level string", "top-level number", "top-level boolean",
    ]


def test_odd_quotes(spark):
    cases = [None, "{", "{}", r'{"a": "b\"c"}', r'{"a\"": ["\"", "\"\"", {"k": "\\\""}]}', r'["\\", "\u0022"]', "3"]
    assert of(spark, readings.odd_quotes(F.col("x")), cases) == [None, None, 0, 1, 3, 1, 0]


def test_long_texts(spark):
    long = F.to_json(F.array(F.concat(F.repeat("x", F.lit(100_000)), F.lit('"'))))
    assert of(spark, readings.odd_quotes(long), ["a\n", "\\", 'a"']) == [1, 1, 1]
    deep = ["(a+[" + "\\]b" * 50_000 + "])+", "[" + "(" * 50_000 + "](a)+"]
    assert of(spark, readings.may_never_end(F.col("x")), deep) == [True, False]


def test_excerpt_and_picked_string(spark):
    assert of(spark, readings.excerpt(F.col("x"), 5), ['  a\n\n "b c', "", None, "\t"]) == ['"a \\""', '""', None, '""']
    picked = readings.pick_string(F.try_parse_json("x"), "semantics", "semantic")
    assert of(spark, picked, ['{"semantics": " ", "semantic": " v "}', '{"semantics": 3}', "[]", None, '{"semantics": "u", "semantic": "v"}']) == ["v", None, None, None, "u"]


def test_call_facts(spark):
    names = [f"m.f{k}" for k in range(12)]
    df = spark.createDataFrame([(1, 12, names, 0, ["x"], 1, None), (2, 0, [], 0, None, 0, []), (3, 0, [], 2, ["a.b", "c"], 0, None)], "k int, n int, c array<string>, m int, b array<string>, e int, x array<string>")
    got = [r[0] for r in df.orderBy("k").select(readings.call_facts(*map(F.col, "ncmbex"))).collect()]
    first = ", ".join(f"f{k}" for k in range(10))
    assert got == [f"*Call graph*: calls 12 internal ({first} (+2 more)); 1 external calls.", "", "*Call graph*: called by 2 (b, c)."]


def chart(spark, rows):
    df = spark.createDataFrame(rows, "id string, parent string, place int, title string, crosscut boolean")
    return [r["line"] for r in readings.stage_map(df).orderBy("part", "a", "b").collect()]


def test_stage_map(spark):
    rows = [("a.b", None, 0, 'T "x"\n y', False), ("a_b", "a.b", 1, " ", True), ("a_b_", "a.b", 2, None, None), ("a.b.", "a_b", 3, "z", False)]
    assert chart(spark, rows) == [
        "```mermaid", "flowchart TD", '  a_b["T #quot;x#quot; y"]', '  a_b_["a_b"]:::crosscut', '  a_b__["a_b_"]', '  a_b___["z"]',
        "  a_b --> a_b_", "  a_b --> a_b__", "  a_b_ --> a_b___", "  classDef crosscut stroke-dasharray: 5 5;", "```",
    ]
    assert chart(spark, rows[:1]) == [] and chart(spark, []) == []
    assert "  classDef crosscut stroke-dasharray: 5 5;" not in chart(spark, [rows[0], ("c", "a.b", 1, "c", False)])


def test_anchors_and_spans(spark):
    rows = [("f", "q", 1, 2, False, "internal"), ("f", "r", 1, 2, None, "internal"), ("f", "s", 0, 2, False, "internal"), ("f", "t", 3, None, True, "internal"), (None, "u", 4, 5, False, "boundary")]
    df = spark.createDataFrame(rows, "file string, qualname string, line_start int, line_end int, synthetic boolean, kind string")
    assert sorted(r["qualname"] for r in readings.anchors(df).collect()) == ["q", "r"]
    assert {tuple(r) for r in readings.line_spans(df).collect()} == {("f", 1, 2), ("f", 0, 2), (None, 4, 5)}


def test_entry_list(spark):
    cases = [
        ('[{"f": 1}, 2, [{}], null, {"g": "x"}]', ['{"f":1}', '{"g":"x"}']),
        ("[1, 2]", []),
        ('{"items": [{"f": 1}], "files": [{"f": 2}]}', ['{"f":2}']),
        ('{"files": ["a"], "data": [{"f": 3}]}', ['{"f":3}']),
        ('{"z": {"files": [{"f": 4}]}, "a": {"files": [{"f": 5}]}}', ['{"f":4}']),
        ('{"z": {"items": [{"f": 4}]}}', []),
        ('{"z": {"y": {"files": [{"f": 4}]}}}', []),
        ('{"path": null, "n": 1}', ['{"n":1,"path":null}']),
        ('{"n": 1}', []),
        ('"text"', []),
        ("null", []),
        ("broken", []),
        ("", []),
        (None, []),
    ]
    got = of(spark, readings.entry_list(F.col("x"), "files", fields=("path",)), [c for c, _ in cases])
    assert got == [e for _, e in cases]
    assert of(spark, readings.entry_list(F.col("x")), ['{"files": [{"f": 1}]}', '{"list": [{"f": 1}]}', '{"path": 1}']) == [[], ['{"f":1}'], []]
