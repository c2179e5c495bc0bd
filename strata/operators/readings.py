"""Anchors and spans of functions, stage maps, call facts, shapes of replies, patterns that may never end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import cap_list, leaf_name
from strata.operators.replies import text_at

#: Tokens of a pattern without escapes (class, open, close with a repeat that has no end, such a repeat),
#: names shown of each kind of relation, and keys shown of an object. No token repeats a group: Java's matcher would recurse.
PATTERN_TOKEN = r"\[[^\]]*\]?|\(|\)(?:[+*]|\{\d*,\s*\})?|[+*]|\{\d*,\s*\}"
NAMES_SHOWN, KEYS_SHOWN = 10, 8
#: Names under which any reply may put its list.
GENERIC_KEYS = ("items", "entries", "results", "data", "list")


def anchors(nodes: DataFrame) -> DataFrame:
    """``file, qualname, line_start, line_end`` of internal functions that stand in their file; made-up ones don't."""
    return nodes.where("kind = 'internal' and not coalesce(synthetic, false) and line_start > 0").select("file", "qualname", "line_start", "line_end")


def line_spans(nodes: DataFrame) -> DataFrame:
    """``file, line_start, line_end``: each span of lines once; ones without a start or an end go."""
    return nodes.select("file", "line_start", "line_end").dropna(subset=["line_start", "line_end"]).distinct()


def call_facts(n_calls: Column, calls: Column, n_called_by: Column, called_by: Column, n_external: Column, external: Column) -> Column:
    """One line of what a function calls and who calls it, with ten short names of each; empty if there are no calls."""

    def part(count: Column, words: Column, names: Column) -> Column:
        shown = F.transform(F.coalesce(names, F.array().cast("array<string>")), leaf_name)
        named = F.when(F.size(shown) > 0, F.concat(words, F.lit(" ("), cap_list(shown, NAMES_SHOWN), F.lit(")"))).otherwise(words)
        return F.when(count > 0, named)

    said = F.concat_ws(
        "; ",
        part(n_calls, F.concat(F.lit("calls "), n_calls.cast("string"), F.lit(" internal")), calls),
        part(n_called_by, F.concat(F.lit("called by "), n_called_by.cast("string")), called_by),
        part(n_external, F.concat(n_external.cast("string"), F.lit(" external calls")), external),
    )
    return F.when(said == "", "").otherwise(F.concat(F.lit("*Call graph*: "), said, F.lit(".")))


def file_line(path: Column, purpose: Column, role: Column) -> Column:
    """A file's line in a list of evidence."""
    return F.concat(F.lit("- `"), path, F.lit("` — "), F.regexp_replace(purpose, r"(?U)^\s+|\s+$", ""), F.lit(" ["), role, F.lit("]"))


def pick_string(value: Column, *keys: str) -> Column:
    """The first string of a variant's keys that isn't blank, without the space around it; null if there is none."""
    return F.coalesce(*(F.nullif(F.regexp_replace(text_at(value, f"$.{k}"), r"(?U)^\s+|\s+$", ""), F.lit("")) for k in keys))


def entry_list(json: Column, *keys: str, fields: tuple[str, ...] = ()) -> Column:
    """The objects of the list that JSON text holds, as JSON texts; an empty array if there is none, also for broken text.

    The list is the text itself, or stands under one of ``keys``, then under a generic name, then under one of ``keys`` in an
    object one level down. Lists without an object don't count, and other values in a list are left out. An object with one of
    ``fields`` (null counts) and no list is the only entry.
    """
    entries = "map<string,variant>"
    value = F.try_parse_json(json)
    texts = lambda v: F.transform(F.filter(F.try_variant_get(v, "$", "array<variant>"), lambda x: F.schema_of_variant(x).startswith("OBJECT")), lambda x: F.to_json(x))
    some = lambda v: F.filter(F.array(texts(v)), lambda found: F.size(found) > 0)
    top = F.try_variant_get(value, "$", entries)
    inner = F.transform(F.json_object_keys(json), lambda k: F.try_variant_get(F.try_element_at(top, k), "$", entries))  # in the text's order
    under = lambda m, names: F.flatten(F.array(*(some(F.try_element_at(m, F.lit(k))) for k in names)))
    nested = F.flatten(F.transform(F.filter(inner, lambda m: m.isNotNull()), lambda m: under(m, keys))) if keys else F.array().cast("array<array<string>>")
    single = F.coalesce(F.arrays_overlap(F.map_keys(top), F.array(*map(F.lit, fields))), F.lit(False)) if fields else F.lit(False)
    none = F.array().cast("array<string>")
    return F.coalesce(
        F.try_element_at(some(value), F.lit(1)),
        F.try_element_at(under(top, (*keys, *GENERIC_KEYS)), F.lit(1)),
        F.try_element_at(nested, F.lit(1)),
        F.when(single, F.array(F.to_json(value))),
        none,
    )


def json_shape(json: Column) -> Column:
    """What JSON text is at its top; null, broken text and a JSON null are no JSON."""
    kind = F.schema_of_variant(F.try_parse_json(json))
    keys = F.json_object_keys(json)
    shown = F.when(F.size(keys) == 0, "(none)").otherwise(F.array_join(F.slice(keys, 1, KEYS_SHOWN), ", "))
    return (
        F.when(kind.isNull() | (kind == "VOID"), "no JSON block in the reply")
        .when(kind.startswith("ARRAY"), F.concat(F.lit("top-level array of "), F.json_array_length(json).cast("string")))
        .when(kind.startswith("OBJECT"), F.concat(F.lit("keys: "), shown, F.when(F.size(keys) > KEYS_SHOWN, ", …").otherwise("")))
        .when(kind == "STRING", "top-level string")
        .when(kind == "BOOLEAN", "top-level boolean")
        .otherwise("top-level number")
    )


def excerpt(text: Column, most: int = 200) -> Column:
    """The start of a reply on one line, as a JSON string: ``most`` code points of it, then each run of space as one."""
    start = F.substring(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), 1, most)
    quoted = F.to_json(F.array(F.regexp_replace(start, r"(?U)\s+", " ")))
    return F.when(text.isNotNull(), F.substring(quoted, F.lit(2), F.length(quoted) - 2))


def odd_quotes(json: Column) -> Column:
    """How many strings and keys of JSON text hold an odd number of quotes; null for broken text."""
    clean = F.regexp_replace(F.to_json(F.try_parse_json(json)), r'\\[^"]', "e")
    parts = F.split(F.replace(clean, F.lit('\\"'), F.lit("\x01")), '"')  # every second part is the inside of a string
    odd = lambda s, k: (k % 2 == 1) & ((F.length(s) - F.length(F.replace(s, F.lit("\x01"), F.lit("")))) % 2 == 1)
    return F.size(F.filter(parts, odd))


def may_never_end(pattern: Column) -> Column:
    """Whether a pattern repeats a group without end that itself holds a repeat without end; null for null.

    Classes and escaped characters don't count. A repeat counts for the innermost group around it, and a repeated group for
    the group around that. The open groups are a stack of flags, folded over the pattern's tokens.
    """
    tokens = F.regexp_extract_all(F.regexp_replace(pattern, r"\\[\s\S]", "e"), F.lit(PATTERN_TOKEN), F.lit(0))
    start = F.struct(F.array().cast("array<boolean>").alias("open"), F.lit(False).alias("bad"))

    def marked(stack: Column) -> Column:
        return F.when(F.size(stack) > 0, F.concat(F.slice(stack, F.lit(1), F.size(stack) - 1), F.array(F.lit(True)))).otherwise(stack)

    def step(state: Column, token: Column) -> Column:
        stack, bad = state["open"], state["bad"]
        outer = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        again = F.length(token) > 1
        after = (
            F.when(token == "(", F.concat(stack, F.array(F.lit(False))))
            .when(token.startswith(")"), F.when(again, marked(outer)).otherwise(outer))
            .when(token.startswith("["), stack)
            .otherwise(marked(stack))
        )
        inner = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(False))
        return F.struct(after.alias("open"), (bad | (token.startswith(")") & again & inner)).alias("bad"))

    return F.when(pattern.isNotNull(), F.aggregate(tokens, start, step, lambda s: s["bad"]))


def stage_map(stages: DataFrame) -> DataFrame:
    """``part, a, b, line``: a stage tree (``id, parent, place, title, crosscut``) as lines of a flow chart, in order of part, a and b.

    Dots in ids become underscores; where that makes two ids the same, the later one by ``place`` gets more underscores. A blank
    title is the id. Fewer than two stages make no chart. Ids that differ only in dots and underscores at their end are
    named together in one row, so their number must be small; other rows are dealt by name.
    """
    flat = F.translate("id", ".", "_")
    stem = F.regexp_replace(flat, "_+$", "")
    tail = (F.length(flat) - F.length(stem)).cast("int")
    alike = stages.groupBy(stem.alias("stem")).agg(F.sort_array(F.collect_list(F.struct("place", "id", tail.alias("tail")))).alias("members"))
    free = lambda taken, least: F.array_min(F.array_except(F.sequence(least, least + F.size(taken)), taken))
    tails = F.aggregate("members", F.array().cast("array<int>"), lambda taken, m: F.concat(taken, F.array(free(taken, m["tail"]))))
    named = alike.select("stem", F.explode(F.arrays_zip("members", tails.alias("tails"))).alias("m"))
    names = named.select(F.col("m.members.id").alias("id"), F.concat("stem", F.repeat(F.lit("_"), F.col("m.tails"))).alias("name"))
    if len(stages.select("id").take(2)) < 2:
        stages = stages.limit(0)
    rows = stages.join(names, "id")
    title = F.trim(F.regexp_replace(F.coalesce("title", F.lit("")), r"(?U)\s+", " "))
    label = F.replace(F.when(title == "", F.col("id")).otherwise(title), F.lit('"'), F.lit("#quot;"))
    crosscut = F.coalesce("crosscut", F.lit(False))
    box = F.concat(F.lit("  "), "name", F.lit('["'), label, F.lit('"]'), F.when(crosscut, ":::crosscut").otherwise(""))
    none = F.lit(0)
    boxes = rows.select(F.lit(2).alias("part"), F.col("place").alias("a"), none.alias("b"), box.alias("line"))
    above = rows.select(F.col("id").alias("parent"), F.col("name").alias("from"), F.col("place").alias("a"))
    arrows = rows.select("parent", F.col("name").alias("to"), F.col("place").alias("b")).join(above, "parent")
    arrows = arrows.select(F.lit(3).alias("part"), "a", "b", F.concat(F.lit("  "), "from", F.lit(" --> "), "to").alias("line"))
    about = rows.agg(F.count("*").alias("n"), F.max(crosscut).alias("crosscut"))
    frame = F.array(
        F.struct(F.lit(0).alias("part"), F.lit("```mermaid").alias("line")),
        F.struct(F.lit(1).alias("part"), F.lit("flowchart TD").alias("line")),
        F.struct(F.lit(4).alias("part"), F.when(F.col("crosscut"), "  classDef crosscut stroke-dasharray: 5 5;").alias("line")),
        F.struct(F.lit(5).alias("part"), F.lit("```").alias("line")),
    )
    edge = about.where("n > 0").select(F.explode(frame).alias("f")).where("f.line is not null").select("f.part", none.alias("a"), none.alias("b"), "f.line")
    return boxes.unionByName(arrows).unionByName(edge)
