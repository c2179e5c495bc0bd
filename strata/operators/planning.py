"""Edit plans out of text: the blocks of a plan, one row each, and what is wrong with it."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

#: The grammar of a plan, and its largest sizes.
HEAD = re.compile(r" {0,3}###\s+EDIT\s+([0-9]+)\s*")
LIKE_HEAD = re.compile(r"\s*#{1,6}\s*EDIT\s+[0-9]", re.IGNORECASE)
FENCE = re.compile(r"([ \t]*)(`{3,}|~{3,})(.*)")
FIELD = re.compile(r" {0,3}-\s*(file|where):\s*(.+?)\s*")
MOST_CHARS, MOST_EDITS = 4 * 1024 * 1024, 500


@dataclass
class Block:
    """A fenced block: what opens it, and its lines."""

    indent: int
    mark: str
    kind: str
    lines: list[str] = field(default_factory=list)
    closed: bool = False

    def ends_at(self, line: str) -> bool:
        m = FENCE.fullmatch(line)
        return bool(m) and m[2][0] == self.mark[0] and len(m[2]) >= len(self.mark) and not m[3].strip() and len(m[1]) <= max(3, self.indent)

    def text(self) -> str:
        """The lines, each without what of the opening line's indentation it has."""
        return "\n".join(x[len(x[: self.indent]) - len(x[: self.indent].lstrip(" \t")) :] for x in self.lines)


@dataclass
class Section:
    """What stands under one heading: its fields, its blocks, and loose lines by the number of blocks before them."""

    index: int
    fields: list[tuple[str, str]] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    loose: list[int] = field(default_factory=list)


def sections(plan: str) -> tuple[list[Section], list[str]]:
    """One walk over the lines; a heading inside a block is content."""
    found: list[Section] = []
    problems: list[str] = []
    block: Block | None = None
    for line in plan.replace("\r\n", "\n").split("\n"):
        now = found[-1] if found else Section(0)
        if block:
            if block.ends_at(line):
                block.closed, block = True, None
            else:
                block.lines.append(line)
        elif m := FENCE.fullmatch(line):
            block = Block(len(m[1]), m[2], m[3].strip().lower())
            now.blocks.append(block)
        elif m := HEAD.fullmatch(line):
            found.append(Section(int(m[1])))
        else:
            if LIKE_HEAD.match(line):
                problems.append("odd heading")
            if not now.blocks and (m := FIELD.fullmatch(line)):
                now.fields.append((m[1], m[2]))
            elif now.blocks and line.strip():
                now.loose.append(len(now.blocks))
    if block and not found:
        problems.append("unclosed before any edit")
    return found, problems


def path_fault(path: str) -> bool:
    """The rules of :func:`strata.functions.text.path_problem`, and an empty path."""
    return not path or bool(re.match(r"[~/]|[a-zA-Z]:", path)) or bool(re.search(r"[\\`\s\x00-\x1f]", path))


def fault(s: Section) -> str | None:
    """The first rule that a section breaks, or null."""
    kinds = [b.kind for b in s.blocks]
    last = max((k + 1 for k, kind in enumerate(kinds) if kind in ("old", "new")), default=0)
    named = [v for k, v in s.fields if k == "file"]
    rules = (
        ("unclosed block", any(not b.closed for b in s.blocks)),
        ("text between the blocks", any(at < last for at in s.loose)),
        ("no file", not named),
        ("several files", len(named) > 1),
        ("bad path", len(named) == 1 and path_fault(bare(named[0]))),
        ("untagged block", "" in kinds),
        ("not one old and one new", kinds.count("old") != 1 or kinds.count("new") != 1),
        ("new before old", "new" in kinds and "old" in kinds and kinds.index("new") < kinds.index("old")),
        ("other block between", any(k not in ("old", "new") for k in kinds[:last])),
    )
    for name, broken in rules:
        if broken:
            return name
    old, new = (s.blocks[kinds.index(k)].text() for k in ("old", "new"))
    return "old and new are the same" if old == new else None


def bare(path: str) -> str:
    return path.strip().strip("`").strip()


def parse(plan: str | None) -> tuple[list[tuple[int, str, str, str, str]], list[tuple[int | None, str]]]:
    """Edits (number, file, where, old, new) and problems (number or null, problem) of a plan's text."""
    if plan and len(plan) > MOST_CHARS:
        return [], [(None, "too large")]
    found, odd = sections(plan or "")
    problems: list[tuple[int | None, str]] = [(None, p) for p in odd]
    if not found or len(found) > MOST_EDITS:
        return [], [*problems, (None, "too many edits" if found else "no edits")]
    edits, seen, before = [], set(), 0
    for s in found:
        problems += [(s.index, "number repeats")] * (s.index in seen) + [(s.index, "number doesn't rise")] * (s.index <= before)
        seen.add(s.index)
        before = s.index
        if broken := fault(s):
            problems.append((s.index, broken))
            continue
        text = {b.kind: b.text() for b in s.blocks if b.kind in ("old", "new")}
        where = next((v for k, v in s.fields if k == "where"), "")
        edits.append((s.index, bare(next(v for k, v in s.fields if k == "file")), where, text["old"], text["new"]))
    return edits, problems


def parse_plans(plans: DataFrame, id_col: str = "plan", text_col: str = "text") -> DataFrame:
    """``plan, pos, idx, file, where, old, new, problem`` from one text a plan: a row for each edit, and for each problem.

    A null or empty text has the problem that there are no edits. A plan is applicable if none of its rows has a problem.
    """
    kind = plans.schema[id_col].dataType.simpleString()
    names = ["plan", "pos", "idx", "file", "where", "old", "new", "problem"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for who, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                edits, problems = parse(text)
                rows += [(who, k, *e, None) for k, e in enumerate(edits)]
                rows += [(who, len(edits) + k, idx, None, None, None, None, p) for k, (idx, p) in enumerate(problems)]
            types = [batch.schema.field(0).type, pa.int32(), pa.int64(), *[pa.string()] * 5]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    return plans.select(id_col, text_col).mapInArrow(run, f"plan {kind}, pos int, idx bigint, file string, `where` string, old string, new string, problem string")
