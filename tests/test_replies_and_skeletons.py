"""Replies, plans, environment files, drafts of stage trees and orders of ancestors, by cases."""

from pyspark.sql import functions as F

from strata.functions import text as t
from strata.operators import replies, skeleton


def of(spark, column, values, name="x"):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, {name} string").orderBy("k").select(column).collect()]


def test_assistant_text(spark):
    cases = ['{"choices": [{"message": {"content": "a"}}], "text": "z"}', '{"data": {"response": "b"}}', '{"text": 3, "response": "c"}', '{"text": 3}', "no json", None, "[1]"]
    assert of(spark, replies.assistant_text(F.col("x")), cases) == ["a", "b", "c", None, None, None, None]


def test_verdicts(spark):
    many = '{"status": "reject", "concerns": [' + ", ".join(['"c"'] * 52) + '], "rationale": "why"}'
    cases = [
        ('{"decision": " approve ", "rationale": "ok"}', None, ("APPROVE", [], "ok")),
        ('{"verdict": "REVISE", "concerns": ["x", 2]}', None, ("REVISE", ["x", "2"], "")),
        ('{"verdict": "REVISE", "rationale": "r"}', None, ("APPROVE", [], "[normalized vacuous REVISE] r")),
        ('{"verdict": "REVISE", "suggested_revision": " move it "}', None, ("REVISE", ["move it"], "")),
        ('{"decision": 4, "verdict": "maybe"}', "**Decision:** reject.", ("REJECT", [], "[decision read from a plain-text reply]")),
        (None, "revise", ("APPROVE", [], "[bare REVISE with no concerns]")),
        ("broken", "I approve of it", (None, None, None)),
        (many, None, ("REJECT", ["c"] * 50, "[dropped 2 concern(s) over the cap] why")),
    ]
    df = spark.createDataFrame([(k, j, x) for k, (j, x, _) in enumerate(cases)], "reply int, json string, text string")
    got = {r["reply"]: (r["decision"], r["concerns"], r["rationale"]) for r in replies.verdicts(df).collect()}
    assert [got[k] for k in range(len(cases))] == [c[2] for c in cases]


def test_declarations(spark):
    block = "```json\n{}\n```\n".format
    cases = [block('{"will_modify": ["a", 1]}'), block('{"will_add": "x"}') + block("no json"), block('{"other": 1}'), "", None, block('{"will_add": ["old"]}') + block('{"will_remove": ["new"]}')]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(cases)], "plan int, text string")
    rows = lambda d: {r[0]: tuple(r[1:]) for r in d.collect()}
    assert rows(replies.declarations(df)) == {0: (["a", "1"], [], []), 1: ([], [], []), 5: ([], [], ["new"])}
    assert rows(replies.declarations(df, last_only=True)) == {0: (["a", "1"], [], []), 5: ([], [], ["new"])}


def test_register_lines(spark):
    text = "intro\n- `reg_One`: holds state\n2) reg-one — later one\r\n* reg-two - **bold text**\nreg-three: abc\nreg-four:long enough"
    got = {(r["id"], r["semantics"]) for r in replies.register_lines(spark.createDataFrame([(1, text), (2, None)], "reply int, text string")).collect()}
    assert got == {("reg-one", "holds state"), ("reg-two", "bold text"), ("reg-four", "long enough")}


def test_env_values(spark):
    text = "# no\nA=1\nexport B = 'two # x' # note\rC= # empty\nD=\"q\"tail #c\nA=3\r\n1X=no\nE=\"say \"x\"\"\nF='\nG=a#b  # c"
    got = {r["key"]: r["value"] for r in replies.env_values(spark.createDataFrame([("f", text)], "file string, text string")).collect()}
    assert got == {"A": "3", "B": "two # x", "C": "", "D": '"q"tail', "E": 'say "x"', "F": "'", "G": "a#b"}


def test_text_rules(spark):
    assert of(spark, t.close_fence(F.col("x")), ["a\n```py\nx\n", "```\nx\n```", "~~~~\n~~~\n```", "", None]) == [("a\n```py\nx\n```\n", True), ("```\nx\n```", False), ("~~~~\n~~~\n```\n~~~~\n", True), ("", False), (None, None)]
    assert of(spark, t.numbered_lines(F.col("x"), F.lit(2), F.lit(9)), ["a\nb\nc", "a", ""]) == ["    2|b\n    3|c", "", ""]
    assert of(spark, t.numbered_lines(F.col("x"), F.lit(None), F.lit(None), 10), ["abcdef"]) == ["    1|abc…\n… (truncated — request a narrower line range)"]
    assert of(spark, t.expand_phases(F.col("x")), ["all", "3, 2,2a", "1,x", " , "]) == [(["1", "2a", "2b", "2c", "3"], None), (["3", "2a", "2b", "2c"], None), (None, "unknown phase x"), (None, "no phases")]
    assert of(spark, t.short_description(F.lit("T"), F.col("x")), ["One. Two.", "v1.2 x", "一。二", ""]) == ["T: One.", "T: v1.2 x", "T: 一", "T: "]
    assert of(spark, t.join_key(F.col("x"), F.lit("readWorkers")), ["", "generate"]) == ["readWorkers", "generateReadWorkers"]
    assert of(spark, t.scoped_env_name("APP", F.col("x"), F.lit("readWorkers")), ["", "generate"]) == ["APP_READ_WORKERS", "APP_GENERATE_READ_WORKERS"]


def test_drafts_are_settled(spark):
    rows = [("a b", "T", " d ", "top", False), ("A-B", None, None, "a b", False), ("../x", "", "", "x", True), ("index", None, None, "gone", False), (None, None, None, "index", True)]
    want = [("a-b", "T", "d", None, False), ("A-B-2", "A-B-2", "A-B-2", "a-b", False), ("x", "x", "x", None, True), ("index-4", "index-4", "index-4", None, False), ("crosscut-5", "crosscut-5", "crosscut-5", "index-4", True)]
    assert skeleton.settled(rows) == want
    # The circle a-b-c is met from d at a: a loses its parent, d keeps its own.
    ring = [("d", "", "", "a", False), ("a", "", "", "b", False), ("b", "", "", "c", False), ("c", "", "", "a", False)]
    assert [s[3] for s in skeleton.settled(ring)] == ["a", None, "c", "a"]
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)] + [(2, 0, "a b", None, None, "a b", None)], "draft int, ord int, id string, title string, description string, parent string, crosscut boolean")
    got = [tuple(r[2:]) for r in skeleton.normalized(df).orderBy("draft", "ord").collect()]
    assert got == [*want, ("a-b", "a-b", "a-b", None, False)]


def test_orders_of_ancestors(spark):
    rows = [("p", "C", "B", ["M1", "M2"], ["P1", "P2"]), ("p", "B", "A", ["M1"], None), ("p", "M2", None, ["M0"], []), ("p", "A", "C", [], []), ("q", "C", None, None, None)]
    got = {(r[0], r[1]): (r[2], r[3]) for r in skeleton.ancestors(spark.createDataFrame(rows, "project string, type string, superclass string, includes array<string>, prepends array<string>")).collect()}
    assert got["p", "C"] == (["P1", "P2", "C", "M2", "M0", "M1", "B", "A"], ["C", "B", "A"])
    assert got["q", "C"] == (["C"], ["C"]) and got["p", "M2"] == (["M2", "M0"], ["M2"])
