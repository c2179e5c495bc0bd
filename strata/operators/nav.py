"""Navigation rollups over a call graph: directories, file descriptors, fan-out, externals, entry points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Names that hint at an entry point.
ENTRY_HINTS = ("main", "run", "serve", "start", "execute", "exec", "dispatch", "handle", "handler", "cmd", "command", "app", "loop", "bootstrap")


def real(nodes: DataFrame) -> DataFrame:
    """Declared functions that aren't made up; unlike callers of other rollups, this keeps those without a line."""
    return nodes.where("kind = 'internal' and not synthetic")


def dir_of(path: Column, root: str = ".") -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(root)


def directories(nodes: DataFrame) -> DataFrame:
    """``dir, n_files, n_functions``; only files with a function count."""
    per_file = real(nodes).groupBy("file").agg(F.count("*").alias("n"))
    return per_file.groupBy(dir_of(F.col("file")).alias("dir")).agg(F.count("*").alias("n_files"), F.sum("n").alias("n_functions"))


def cut(text: Column, most: int) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def file_descriptors(nodes: DataFrame, first: int = 8) -> DataFrame:
    """``file, n_functions, classes, functions``: sorted distinct classes, and the first functions' signatures by line."""
    rows = real(nodes).withColumn("nth", F.row_number().over(W.partitionBy("file").orderBy("line_start", "id")))
    shown = F.array_sort(F.collect_list(F.when(F.col("nth") <= first, F.struct("nth", cut(F.col("signature"), 120).alias("s")))))
    return rows.groupBy("file").agg(F.count("*").alias("n_functions"), F.array_sort(F.collect_set("class_name")).alias("classes"), F.transform(shown, lambda x: x["s"]).alias("functions"))


def all_descriptors(scanned: DataFrame, described: DataFrame) -> DataFrame:
    """The descriptors and, with no functions, every scanned file that has none."""
    rest = scanned.select("file").distinct().join(described, "file", "left_anti")
    blank = {f.name: (F.col("file") if f.name == "file" else F.array().cast(f.dataType) if f.dataType.typeName() == "array" else F.lit(0).cast(f.dataType)) for f in described.schema.fields}
    return described.unionByName(rest.select(*(c.alias(n) for n, c in blank.items())))


def fan_out(nodes: DataFrame, degrees: DataFrame, top: int = 40) -> DataFrame:
    per = real(nodes).select("id", "file").join(degrees, "id").groupBy("file").agg(F.sum("n_callees").alias("fan_out"))
    return per.orderBy(F.desc("fan_out"), "file").limit(top)


def module_key(callee: Column) -> Column:
    """The external subsystem of a callee: what stands before ``::``, else before the first dot, else all of it."""
    name = F.regexp_replace(callee, "^boundary:", "")
    return F.when(F.contains(name, F.lit("::")), F.substring_index(name, "::", 1)).otherwise(F.substring_index(name, ".", 1))


def externals(edges: DataFrame, samples: int = 5) -> DataFrame:
    """``module, n_calls, sample``: boundary call sites of a subsystem, and the names seen first."""
    rows = edges.where("callee like 'boundary:%'").select(module_key(F.col("callee")).alias("module"), F.regexp_replace("callee", "^boundary:", "").alias("name"), "ord")
    per = rows.groupBy("module", "name").agg(F.count("*").alias("n"), F.min("ord").alias("ord"))
    ranked = per.withColumn("nth", F.row_number().over(W.partitionBy("module").orderBy("ord", "name")))
    shown = F.array_sort(F.collect_list(F.when(F.col("nth") <= samples, F.struct("nth", "name"))))
    return ranked.groupBy("module").agg(F.sum("n").alias("n_calls"), F.transform(shown, lambda x: x["name"]).alias("sample"))


def entry_points(nodes: DataFrame, degrees: DataFrame) -> DataFrame:
    """Functions with a line that nobody calls, or that are named like an entry."""
    hint = F.col("name").rlike(f"^({'|'.join(ENTRY_HINTS)})($|_)")
    rows = real(nodes).where("line_start > 0").join(degrees, "id").where((F.col("n_callers") == 0) | hint)
    return rows.select("id", "qualname", "file", "n_callees", "n_callers")


def function_counts(nodes: DataFrame) -> DataFrame:
    return real(nodes).groupBy("file").agg(F.count("*").alias("n_functions"))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = real(nodes).agg(F.count("*").alias("n_functions"), F.countDistinct("file").alias("n_files"), F.countDistinct("class_name").alias("n_classes"))
    return n.join(edges.agg(F.count_if(F.col("call_type") == "boundary").alias("n_boundary_edges"), F.count_if(F.col("call_type") == "internal_func").alias("n_internal_edges")), F.lit(True))  # one row each
