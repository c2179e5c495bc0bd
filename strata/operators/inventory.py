"""Inventory: what each function calls and is called by, declared types by file, and notes merged onto functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_n(rows: DataFrame, by: list[str], order: list[str | Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; ``nth`` is their place."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("nth") <= n)


def first_seen(rows: DataFrame, by: str, item: str, order: str, n: int) -> DataFrame:
    """``by, items``: the first ``n`` distinct items of each group, in the order in which they were first seen."""
    once = rows.groupBy(by, item).agg(F.min(order).alias("seen"))
    kept = first_n(once, [by], ["seen", item], n)
    return kept.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", item))), lambda s: s[item]).alias("items"))


def call_relations(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Internal and external call sites of declared functions; self-calls are left out.

    Internal: ``caller, callee, ord``. External: ``caller, name, ord``, the name without its marker.
    """
    kept = edges.where("call_type <> 'unresolved' and caller <> callee").join(nodes.select(F.col("id").alias("caller")), "caller", "left_semi")
    known = nodes.select(F.col("id").alias("callee"))
    inside = kept.join(known, "callee", "left_semi").select("caller", "callee", "ord")
    outside = kept.join(known, "callee", "left_anti").select("caller", F.regexp_replace("callee", "^boundary:", "").alias("name"), "ord")
    return inside, outside


def inventory(nodes: DataFrame, edges: DataFrame, most: int = 25) -> DataFrame:
    """``id, calls, called_by, ext_calls`` and their capped lengths (which differ from a node's degrees)."""
    inside, outside = call_relations(nodes, edges)
    parts = {
        "calls": first_seen(inside, "caller", "callee", "ord", most).withColumnRenamed("caller", "id"),
        "called_by": first_seen(inside, "callee", "caller", "ord", most).withColumnRenamed("callee", "id"),
        "ext_calls": first_seen(outside, "caller", "name", "ord", most).withColumnRenamed("caller", "id"),
    }
    out = nodes.where("not synthetic and line_start > 0").select("id")
    for name, part in parts.items():
        out = out.join(part.withColumnRenamed("items", name), "id", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out.select("id", *parts, *(F.size(n).alias(f"n_{n}_capped") for n in parts))


def members(nodes: DataFrame, edges: DataFrame, most: int = 6) -> DataFrame:
    """``id, calls, called_by`` of member functions: not distinct, calls as qualified names, callers as ids."""
    kept = edges.where("call_type <> 'unresolved'")
    named = nodes.select(F.col("id").alias("callee"), "qualname")
    calls = first_n(kept.join(named, "callee"), ["caller"], ["ord", "callee"], most).groupBy(F.col("caller").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "qualname"))), lambda s: s["qualname"]).alias("calls"))
    called = first_n(kept, ["callee"], ["ord", "caller"], most).groupBy(F.col("callee").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "caller"))), lambda s: s["caller"]).alias("called_by"))
    return nodes.where("not synthetic and line_start > 0").select("id").join(calls, "id", "left").join(called, "id", "left")


def type_inventory(types: DataFrame, most: int = 200) -> DataFrame:
    """``file, types``: declared types by start line, with signatures cut to ``most`` characters."""
    from strata.operators.nav import cut

    listed = F.array_sort(F.collect_list(F.struct("line_start", "name", cut(F.col("signature"), most).alias("signature"))))
    return types.groupBy("file").agg(listed.alias("types"))


def keep_last(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the last: a later declaration of a function replaces an earlier one."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("nth = 1").drop("nth")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row for each key, the first: a type's first declaration stands."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(key).orderBy(order))).where("nth = 1").drop("nth")


def merge_notes(functions: DataFrame, notes: DataFrame) -> DataFrame:
    """Notes onto functions by qualified name, else by leaf name; the first note of a key counts.

    Functions: ``file, qualname, ...``; notes: ``file, name, purpose, ord``.
    """
    by_name = keep_first(notes.withColumn("key", F.concat_ws(chr(0), "file", "name")), "key", "ord").select(F.col("file"), F.col("name").alias("qualname"), F.col("purpose").alias("exact"))
    leaf = notes.withColumn("leaf", F.substring_index(F.substring_index("name", "::", -1), ".", -1))
    by_leaf = keep_first(leaf.withColumn("key", F.concat_ws(chr(0), "file", "leaf")), "key", "ord").select("file", "leaf", F.col("purpose").alias("loose"))
    own = functions.withColumn("leaf", F.substring_index(F.substring_index("qualname", "::", -1), ".", -1))
    return own.join(by_name, ["file", "qualname"], "left").join(by_leaf, ["file", "leaf"], "left").withColumn("purpose", F.coalesce("exact", "loose")).drop("exact", "loose", "leaf")


def match_loosely(named: DataFrame, valid: DataFrame) -> DataFrame:
    """``named, path``: exact paths, else the only valid path that ends with ``/named``. Keyed by base name, so an equi-join."""
    base = lambda c: F.substring_index(c, "/", -1)
    exact = named.join(valid, F.col("named") == F.col("path"))
    rest = named.join(exact.select("named"), "named", "left_anti")
    loose = rest.withColumn("base", base(F.col("named"))).join(valid.withColumn("base", base(F.col("path"))), "base").where("endswith(path, concat('/', named))")
    only = loose.groupBy("named").agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    return exact.select("named", "path").unionByName(only.select("named", "path"))


def card_done(detail: str) -> Column:
    """Whether a card (``purpose, description, parts``, the latter its functions' purposes) is complete for a depth."""
    brief = F.coalesce("purpose", F.lit("")) != ""
    if detail == "brief":
        return brief
    return brief & ((F.coalesce("description", F.lit("")) != "") | F.coalesce(F.exists("parts", lambda p: p != ""), F.lit(False)))


def card_detail(cards: DataFrame) -> DataFrame:
    """``detail``: deep if any card has functions or a description, else brief, also of no cards."""
    deep = (F.coalesce("description", F.lit("")) != "") | (F.coalesce(F.size("parts"), F.lit(0)) > 0)
    return cards.agg(F.when(F.bool_or(deep), "deep").otherwise("brief").alias("detail"))
