"""Call graph: which edges count, which nodes must be made up, degrees, dropped calls, adjacency and impact.

Edges have ``caller, callee, call_type, ord``; nodes have at least ``id, kind, file``. Every row of an edge list is one call
site, so repeated rows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.functions.text import csv_field

#: Names that count as built in when a dropped call goes to them.
BUILTINS = (
    "len isinstance print str int float bool list dict set tuple range enumerate zip map filter sorted min max sum abs open repr hasattr getattr setattr super type vars iter next format "
    "ValueError TypeError KeyError RuntimeError Exception StopIteration NotImplementedError FileNotFoundError OSError IndexError AttributeError"
).split()


def kept(edges: DataFrame) -> DataFrame:
    return edges.where("call_type <> 'unresolved'")


def dropped(edges: DataFrame) -> DataFrame:
    return edges.where("call_type = 'unresolved'")


def dropped_category(callee: Column) -> Column:
    """Why a call was dropped, by what its hint looks like; the first fitting reason counts."""
    hint = F.regexp_replace(callee, "^unresolved:", "")
    head = F.regexp_extract(hint, r"^([^.(]*)", 1)
    return (
        F.when(hint.rlike(r"^self\._?logger\."), "inherited_method").when(hint.rlike(r"^(self|this)\."), "self_attr_unknown").when(hint.rlike("^[\"']"), "string_literal_method")
        .when(head.isin(*BUILTINS), "builtin").when(F.contains(hint, F.lit(".")), "local_var_method").otherwise("bare_name")
    )


def dropped_calls(edges: DataFrame) -> DataFrame:
    return dropped(edges).groupBy(dropped_category(F.col("callee")).alias("category")).agg(F.count("*").alias("n"))


def boundary_parts(node_id: Column) -> tuple[Column, Column, Column]:
    """Name, class and module of an external id: the class is the first capitalised segment that isn't the last one."""
    parts = F.filter(F.split(F.regexp_replace(node_id, "^boundary:", ""), "[.:]+", -1), lambda p: p != "")
    n = F.size(parts)
    inner = F.slice(parts, 1, n - 1)
    at = F.array_position(F.transform(inner, lambda p: p.rlike("^[A-Z]")), True).cast("int")
    module = F.when(at > 0, F.slice(parts, F.lit(1), at - 1)).otherwise(inner)
    return F.element_at(parts, -1), F.when(at > 0, F.element_at(parts, F.greatest(at, F.lit(1)))), F.array_join(module, ".")


def constructor_parts(node_id: Column) -> tuple[Column, Column, Column]:
    """Name, class and module of a constructor that no scan declares."""
    sep = F.when(F.contains(node_id, F.lit("::")), "::").otherwise(".")
    parts = F.when(sep == "::", F.split(node_id, "::", -1)).otherwise(F.split(node_id, r"\.", -1))
    n = F.size(parts)
    return F.element_at(parts, -1), F.when(n > 1, F.element_at(parts, F.greatest(n - 1, F.lit(1)))), F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(1))), ".")


def node_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All nodes of the kept edges: declared ones, and those that only calls name, made up from their ids."""
    ends = kept(edges).select(F.explode(F.array("caller", "callee")).alias("id")).distinct()
    missing = ends.join(nodes.select("id"), "id", "left_anti")
    outside = F.col("id").startswith("boundary:")
    name, cls, module = boundary_parts(F.col("id"))
    c_name, c_cls, c_module = constructor_parts(F.col("id"))
    made = missing.select("id", F.when(outside, "boundary").otherwise("internal").alias("kind"), F.when(outside, name).otherwise(c_name).alias("name"), F.when(outside, cls).otherwise(c_cls).alias("class_name"), F.when(outside, module).otherwise(c_module).alias("module"))
    return nodes.select("id", "kind", "name", "class_name", F.lit(None).cast("string").alias("module")).unionByName(made)


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``id, n_callees, n_callers`` for every node, over kept call sites; self-calls count on both sides."""
    ends = kept(edges).select(F.explode(F.array(F.struct(F.col("caller").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("callee").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    counted = ends.groupBy("id").agg(F.sum("o").alias("n_callees"), F.sum("i").alias("n_callers"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("n_callees", F.lit(0)).cast("long").alias("n_callees"), F.coalesce("n_callers", F.lit(0)).cast("long").alias("n_callers"))


def graph_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: internal and boundary nodes, kept and dropped edges."""
    n = node_table(nodes, edges).agg(F.count_if(F.col("kind") == "internal").alias("n_internal"), F.count_if(F.col("kind") == "boundary").alias("n_boundary"))
    e = edges.agg(F.count_if(F.col("call_type") != "unresolved").alias("n_kept"), F.count_if(F.col("call_type") == "unresolved").alias("n_dropped"))
    return n.join(e, F.lit(True))  # one row each


def file_adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``from_file, to_file, weight``: call sites between different files of declared functions."""
    at = nodes.select("id", "file")
    pairs = kept(edges).join(at.withColumnsRenamed({"id": "caller", "file": "from_file"}), "caller").join(at.withColumnsRenamed({"id": "callee", "file": "to_file"}), "callee").where("from_file <> to_file")
    return pairs.groupBy("from_file", "to_file").agg(F.count("*").alias("weight"))


def impact(adjacency: DataFrame, top: int = 60, focus: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The files of largest weighted degree (4 to 200 of them, by default 60), and the links among them.

    ``focus`` (a column ``file``) restricts the graph to those files and their direct neighbours.
    """
    if focus is not None:
        near = adjacency.join(focus.select(F.col("file").alias("from_file")), "from_file", "left_semi").unionByName(adjacency.join(focus.select(F.col("file").alias("to_file")), "to_file", "left_semi").select(adjacency.columns))
        adjacency = near.distinct()
    ends = adjacency.select(F.explode(F.array("from_file", "to_file")).alias("file"), "weight")
    ranked = ends.groupBy("file").agg(F.sum("weight").alias("degree")).orderBy(F.desc("degree"), "file").limit(max(4, min(200, top)))
    inside = ranked.select("file")
    links = adjacency.join(inside.withColumnRenamed("file", "from_file"), "from_file", "left_semi").join(inside.withColumnRenamed("file", "to_file"), "to_file", "left_semi")
    return ranked, links.select("from_file", "to_file", "weight")


def self_attributes(rows: DataFrame) -> DataFrame:
    """``class_name, attr, read_in, written_in`` from ``class_name, attr, fn, mode, ord``: distinct functions, first seen first."""
    first = rows.where("class_name is not null").groupBy("class_name", "attr", "mode", "fn").agg(F.min("ord").alias("ord"))
    lists = {m: F.transform(F.array_sort(F.collect_list(F.when(F.col("mode") == m, F.struct("ord", "fn")))), lambda s: s["fn"]) for m in ("read", "write")}
    return first.groupBy("class_name", "attr").agg(lists["read"].alias("read_in"), lists["write"].alias("written_in"))


def scan_coverage(unparsed: DataFrame) -> DataFrame:
    """``reason, file, n``: every file that was not fully read, with the number of files of its reason.

    Counts come from a partial aggregate (a row for each reason), so no reason's files meet in one row or one task.
    """
    sizes = unparsed.groupBy("reason").agg(F.count("*").alias("n"))
    return unparsed.join(F.broadcast(sizes), "reason").select("reason", "file", "n")


def impact_stages(ranked: DataFrame, stages: DataFrame, nodes: DataFrame) -> DataFrame:
    """``file, stage, degree, functions`` of the files of an impact graph; a file of no stage is ``unassigned``.

    The ranked files are at most 200 (see :func:`impact`).
    """
    counts = nodes.join(F.broadcast(ranked.select("file")), "file", "left_semi").groupBy("file").agg(F.count("*").alias("functions"))
    rows = ranked.join(stages, "file", "left").join(counts, "file", "left")
    return rows.select("file", F.coalesce("stage", F.lit("unassigned")).alias("stage"), "degree", F.coalesce("functions", F.lit(0)).cast("long").alias("functions"))


def csv_lines(nodes: DataFrame, columns: list[str]) -> DataFrame:
    """``id, line``: internal functions as lines of a CSV file, fields quoted only where they must be."""
    fields = [csv_field(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in columns]
    return nodes.where("kind = 'internal'").select("id", F.concat_ws(",", *fields).alias("line"))


def dot_edges(edges: DataFrame) -> DataFrame:
    """``caller, callee, line``: kept calls as edges of a DOT file; awaited ones are blue, those to the outside dashed."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
    marks = F.concat_ws(", ", F.when(F.col("is_await"), 'color="#1a73e8"'), F.when(F.col("call_type").isin("boundary", "boundary_constructor"), "style=dashed"))
    line = F.concat(F.lit("  "), quoted("caller"), F.lit(" -> "), quoted("callee"), F.when(marks != "", F.concat(F.lit(" ["), marks, F.lit("]"))).otherwise(""), F.lit(";"))
    return kept(edges).select("caller", "callee", line.alias("line"))
