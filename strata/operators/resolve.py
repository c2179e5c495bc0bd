"""Resolution of calls: index tables that withdraw ambiguous names, and ordered lookups over them.

A name that two modules declare resolves to neither. Lookups are left joins with dimension tables, first hit by an ordered
``coalesce``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_owner(declared: DataFrame, keys: list[str], owner: str = "module") -> DataFrame:
    """``keys, owner, ambiguous``: the one owner of each key; with several, null and ambiguous."""
    per = declared.groupBy(*keys).agg(F.count_distinct(owner).alias("n"), F.min(owner).alias("one"))
    return per.select(*keys, F.when(F.col("n") == 1, F.col("one")).alias(owner), (F.col("n") > 1).alias("ambiguous"))


def methods(types: DataFrame, members: DataFrame) -> DataFrame:
    """``module, type, methods``: sorted method names; types without any keep an empty list."""
    own = members.groupBy("module", "type").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    return types.select("module", "type").distinct().join(own, ["module", "type"], "left").select("module", "type", F.coalesce("methods", F.array().cast("array<string>")).alias("methods"))


def lookup_scoped(asked: DataFrame, table: DataFrame) -> DataFrame:
    """``ask, module``: the innermost scope that knows the name decides; if it is ambiguous there, the search ends with null.

    Asked: ``ask, name, scopes`` (innermost first); table: ``scope, name, module, ambiguous``.
    """
    each = asked.select("ask", "name", F.posexplode("scopes").alias("pos", "scope"))
    hits = each.join(table, ["scope", "name"]).groupBy("ask").agg(F.min(F.struct("pos", "ambiguous", "module")).alias("m"))
    return asked.select("ask").join(hits, "ask", "left").select("ask", F.when(~F.col("m.ambiguous"), F.col("m.module")).alias("module"))


def unresolved(hint: Column, most: int = 80) -> Column:
    return F.concat(F.lit("unresolved:"), F.substring(hint, 1, most))


def boundary(name: Column) -> Column:
    return F.concat(F.lit("boundary:"), name)


def resolve_bare(calls: DataFrame, functions: DataFrame, imports: DataFrame, types: DataFrame, type_first: bool = False) -> DataFrame:
    """``call, callee, call_type`` of bare calls: same file, same directory, then by import, else unresolved.

    Calls: ``call, module, dir, name``. Functions: ``module, dir, name``. Imports: ``module, name, target`` (a module id, or
    an outside name). Types: ``module, type, ambiguous`` from :func:`unique_owner` with key ``type``. A name imported from
    a scanned module is a function there, or a type and so a constructor; of an unscanned one, a boundary.
    """
    own = functions.select("module", "name", F.lit(True).alias("own")).distinct()
    siblings = unique_owner(functions, ["dir", "name"]).select("dir", "name", F.col("module").alias("sibling"))
    target_fn = functions.select(F.col("module").alias("target"), "name", F.lit(True).alias("free")).distinct()
    scanned = functions.select(F.col("module").alias("target")).distinct().withColumn("scanned", F.lit(True))
    kinds = types.select(F.col("type").alias("name"), F.col("module").alias("type_module"), F.col("ambiguous").alias("type_ambiguous"))
    rows = calls.join(own, ["module", "name"], "left").join(siblings, ["dir", "name"], "left").join(imports, ["module", "name"], "left")
    rows = rows.join(target_fn, ["target", "name"], "left").join(scanned, "target", "left").join(kinds, "name", "left")
    target, name = F.col("target"), F.col("name")
    one = lambda kind, callee: F.struct(F.lit(kind).alias("call_type"), callee.alias("callee"))
    as_free = F.when(F.col("free"), one("internal_func", F.concat_ws(".", target, name)))
    as_type = F.when(F.col("type_ambiguous"), one("unresolved", unresolved(name))).when(F.col("type_module") == target, one("constructor", F.concat_ws(".", target, name, F.lit("__init__"))))
    outside = F.when(F.col("scanned").isNull(), F.when(name.rlike("^[A-Z]"), one("boundary_constructor", boundary(F.concat_ws(".", target, name)))).otherwise(one("boundary", boundary(F.concat_ws(".", target, name)))))
    imported = F.when(target.isNotNull(), F.coalesce(*((as_type, as_free) if type_first else (as_free, as_type)), outside, one("unresolved", unresolved(name))))
    found = F.coalesce(F.when(F.col("own"), one("internal_func", F.concat_ws(".", "module", name))), F.when(F.col("sibling").isNotNull(), one("internal_func", F.concat_ws(".", "sibling", name))), imported, one("unresolved", unresolved(name)))
    return rows.select("call", found.alias("f")).select("call", "f.callee", "f.call_type")


def resolve_members(calls: DataFrame, member_table: DataFrame, fields: DataFrame, types: DataFrame) -> DataFrame:
    """``call, callee, call_type`` of ``self.m`` and ``self.f.m`` calls.

    Calls: ``call, module, type, field, method`` (no field: own method). Members: ``module, type, method``. Fields:
    ``module, type, field, field_type``. Own methods resolve or stay unresolved; a field's type that is declared once
    resolves to its method, any other to a boundary.
    """
    own = member_table.select("module", "type", "method", F.lit(True).alias("own")).distinct()
    kinds = types.select(F.col("type").alias("field_type"), F.col("module").alias("type_module"), "ambiguous")
    rows = calls.join(own, ["module", "type", "method"], "left").join(fields, ["module", "type", "field"], "left").join(kinds, "field_type", "left")
    one = lambda kind, callee: F.struct(F.lit(kind).alias("call_type"), callee.alias("callee"))
    mine = F.when(F.col("own"), one("self_method", F.concat_ws(".", "module", "type", "method"))).otherwise(one("unresolved", unresolved(F.concat(F.lit("self."), F.col("method")))))
    theirs = F.when(F.col("field_type").isNull(), one("unresolved", unresolved(F.concat_ws(".", F.lit("self"), "field", "method")))).when(F.col("type_module").isNotNull(), one("field_method", F.concat_ws(".", "type_module", "field_type", "method"))).otherwise(one("boundary", boundary(F.concat_ws(".", "field_type", "method"))))
    return rows.select("call", F.when(F.col("field").isNull(), mine).otherwise(theirs).alias("f")).select("call", "f.callee", "f.call_type")
