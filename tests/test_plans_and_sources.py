"""Plan parsing and edit statuses by cases; source files on a small tree."""

from pyspark.sql import functions as F

from strata import sources
from strata.operators import patch, planning

EDIT = "### EDIT {n}\n- file: `{file}`\n- where: there\n```old\n{old}\n```\n```new\n{new}\n```\n"


def problems(text):
    return [p for _, p in planning.parse(text)[1]]


def test_a_plan_is_read():
    edits, bad = planning.parse("Intro\n" + EDIT.format(n=1, file="a/b.py", old="x", new="y") + EDIT.format(n=2, file="c.py", old="", new="z\n\nw") + "Done.\n```json\n{}\n```\n")
    assert bad == [] and edits == [(1, "a/b.py", "there", "x", "y"), (2, "c.py", "there", "", "z\n\nw")]


def test_headings_and_fences_inside_blocks_are_content():
    text = "### EDIT 1\r\n- file: a.md\r\n````old\r\n```\r\n### EDIT 7\r\n```\r\n````\r\n~~~new\r\n```\r\n~~~\r\n"
    assert planning.parse(text) == ([(1, "a.md", "", "```\n### EDIT 7\n```", "```")], [])
    assert planning.parse("### EDIT 1\n- file: a\n  ```old\n  one\n    two\n      ```x\n  ```\n  ```new\n  ```\n")[0][0][3] == "one\n  two\n    ```x"


def test_problems_of_plans():
    ok = EDIT.format(n=1, file="a", old="x", new="y")
    assert problems("") == problems(None) == problems("words") == ["no edits"]
    assert problems("```\nno end") == ["unclosed before any edit", "no edits"]
    assert problems(ok + ok) == ["number repeats", "number doesn't rise"]
    assert problems("## Edit 2\n" + ok) == ["odd heading"]
    assert problems(ok[:-4]) == ["unclosed block"]
    assert problems(ok.replace("```new", "stray\n```new")) == ["text between the blocks"]
    assert problems(ok.replace("- file: `a`\n", "")) == ["no file"] and problems(ok.replace("- where: there", "- file: b")) == ["several files"]
    for path in ("/a", "~a", "C:/a", "a\\b", "a b", "``"):
        assert problems(EDIT.format(n=1, file=path, old="x", new="y")) == ["bad path"], path
    assert problems(ok + "```\nx\n```\n") == ["untagged block"]
    assert problems(ok + "```new\nx\n```\n") == ["not one old and one new"]
    assert problems(ok.replace("old", "o").replace("new", "old").replace("```o\n", "```new\n")) == ["new before old"]
    assert problems(ok.replace("```new", "```py\n```\n```new")) == ["other block between"]
    assert problems(ok.replace("y", "x")) == ["old and new are the same"]
    assert problems("x" * (planning.MOST_CHARS + 1)) == ["too large"]
    assert problems("".join(EDIT.format(n=k, file="a", old="x", new="y") for k in range(1, 503))) == ["too many edits"]


def test_every_status_of_an_edit(spark):
    files = [("a", "one two\ntwo three", False, False), ("crlf", "x\r\ny\r\nz", False, False), ("empty", "", False, False), ("dir", None, True, False), ("bad", None, False, True), ("big", "x" * (patch.MAX_FILE_BYTES + 1), False, False), ("aa", "aaa", False, False)]
    cases = [
        ("a", "one", "applied", 1), ("a", "three", "applied", 2), ("a", "two", "ambiguous", None), ("aa", "aa", "ambiguous", None), ("a", "four", "no-match", None), ("a", "", "no-match", None), ("crlf", "y\nz", "applied", 2),
        ("empty", "", "applied", 1), ("empty", "x", "no-match", None), ("new", "", "created", 1), ("new", "x", "file-missing", None), ("dir", "x", "not-a-file", None), ("bad", "x", "undecodable", None), ("big", "x", "undecodable", None),
        ("/a", "one", "unsafe-path", None), ("../a", "one", "unsafe-path", None), ("b/../../a", "one", "unsafe-path", None), (None, "one", "unsafe-path", None), ("a", None, "no-match", None),
    ]
    edits = spark.createDataFrame([(k, f, old, "n") for k, (f, old, _, _) in enumerate(cases)], "edit int, file string, old string, new string")
    got = {r.edit: (r.status, r.line) for r in patch.verify(edits, spark.createDataFrame(files, "file string, content string, is_dir boolean, bad_bytes boolean")).collect()}
    assert got == {k: (status, line) for k, (_, _, status, line) in enumerate(cases)}


def test_source_files(spark, tmp_path):
    for name, raw in {"a.py": b"x = 1\n", "lib/b.ts": "é".encode(), "lib/c.py": b"\xff\xfe", "node_modules/d.py": b"x", "e.md": b"x", "big.py": b"x" * 50}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.file: (r.content, r.problem) for r in sources.source_files(spark, str(tmp_path), [".py", ".ts"], most_bytes=20).collect()}
    assert got == {"a.py": ("x = 1\n", None), "lib/b.ts": ("é", None), "lib/c.py": (None, "undecodable"), "big.py": (None, "too large")}
    langs = [("py", ".py"), ("d", ".d.py")]
    df = spark.createDataFrame([("a.py",), ("b.d.py",), ("c",)], "path string")
    assert [r[0] for r in df.select(sources.adapter_of(F.col("path"), langs)).collect()] == ["py", "d", None]
