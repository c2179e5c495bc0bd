"""Change between two snapshots, what it touches, and freshness checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STALE = " (stale: code changed since narration)"


def fingerprints(scanned: DataFrame, nodes: DataFrame) -> DataFrame:
    """``file, print``: each scanned file's functions as sorted ``qualname@start-end:signature``; empty without any."""
    one = F.concat(F.col("qualname"), F.lit("@"), F.col("line_start").cast("string"), F.lit("-"), F.col("line_end").cast("string"), F.lit(":"), F.col("signature"))
    own = nodes.where("kind = 'internal' and not synthetic").groupBy("file").agg(F.array_join(F.array_sort(F.collect_list(one)), "|").alias("print"))
    return scanned.select("file").distinct().join(own, "file", "left").select("file", F.coalesce("print", F.lit("")).alias("print"))


def diff(before: DataFrame, after: DataFrame, hashed: bool = True) -> DataFrame:
    """``file, status`` of added, deleted and changed files; snapshots are ``file, hash, print``.

    A file changed if its hashes differ, or its prints where a side has no hash; ``hashed=False`` compares prints only.
    """
    a, z = before.select("file", F.col("hash").alias("h0"), F.col("print").alias("p0"), F.lit(True).alias("old")), after.select("file", F.col("hash").alias("h1"), F.col("print").alias("p1"), F.lit(True).alias("new"))
    by_print = ~F.col("p0").eqNullSafe(F.col("p1"))
    changed = F.when(F.col("h0").isNotNull() & F.col("h1").isNotNull(), F.col("h0") != F.col("h1")).otherwise(by_print) if hashed else by_print
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(changed, "changed")
    return a.join(z, "file", "full_outer").select("file", status.alias("status")).where("status is not null")


def no_fact_difference(scanned: DataFrame, unparsed: DataFrame) -> DataFrame:
    """Scanned files without those that gave no facts."""
    return scanned.select("file").distinct().join(unparsed.select("file"), "file", "left_anti")


def refresh_set(*parts: DataFrame) -> DataFrame:
    """All files that any part names, once."""
    out = parts[0].select("file")
    for p in parts[1:]:
        out = out.union(p.select("file"))
    return out.distinct()


def declared_files(declarations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``name, file`` where a declaration names a function by qualified name, name or id: three equi-joins."""
    out = None
    for key in ("qualname", "name", "id"):
        part = declarations.join(nodes.select(F.col(key).alias("name"), "file").distinct(), "name")
        out = part if out is None else out.union(part)
    return out.select("name", "file").distinct()


def known_and_unknown(named: DataFrame, scanned: DataFrame) -> DataFrame:
    """``file, problem``: names in the scan without a problem, others with one."""
    s = scanned.select("file").distinct().withColumn("in", F.lit(True))
    return named.select("file").distinct().join(s, "file", "left").select("file", F.when(F.col("in").isNull(), "not in the scanned tree").alias("problem"))


def touched_stages(changes: DataFrame, assigned: DataFrame) -> DataFrame:
    return assigned.join(changes.select("file").distinct(), "file", "left_semi").where("stage <> 'unassigned'").select("stage").distinct()


def mark_stale(cards: DataFrame, changed: DataFrame) -> DataFrame:
    """Cards with their purpose marked once where the file changed."""
    c = changed.select("file").distinct().withColumn("c", F.lit(True))
    marked = F.when(F.col("c") & (F.col("purpose") != "") & ~F.endswith("purpose", F.lit(STALE)), F.concat("purpose", F.lit(STALE))).otherwise(F.col("purpose"))
    return cards.join(c, "file", "left").withColumn("purpose", marked).drop("c")


def roll_forward(live: DataFrame, old: DataFrame) -> DataFrame:
    """``id, stage``: living members keep their stage, new ones are unassigned."""
    return live.select("id").join(old.select("id", "stage"), "id", "left").select("id", F.coalesce("stage", F.lit("unassigned")).alias("stage"))


def unsafe(path: Column) -> Column:
    return path.startswith("/") | path.rlike(r"^[a-zA-Z]:") | path.rlike(r"(^|[\\/])\.\.([\\/]|$)")


def live_check(recorded: DataFrame, live: DataFrame) -> DataFrame:
    """``file, state``: recorded files that are unsafe, deleted, stale or fresh against the live tree."""
    now = live.select("file", F.col("hash").alias("now"))
    state = F.when(unsafe(F.col("file")), "unsafe").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("hash"), "stale").otherwise("fresh")
    return recorded.join(now, "file", "left").select("file", state.alias("state"))


def link_problems(links: DataFrame, pages: DataFrame) -> DataFrame:
    """``page, problem``: links without a page and pages without a link."""
    a = links.select("page").distinct().join(pages.select("page"), "page", "left_anti").withColumn("problem", F.lit("missing page"))
    return a.unionByName(pages.select("page").distinct().join(links.select("page"), "page", "left_anti").withColumn("problem", F.lit("not linked")))


def without(rows: DataFrame, done: DataFrame, key: str = "file") -> DataFrame:
    """What is left to do."""
    return rows.join(done.select(key), key, "left_anti")


def only(rows: DataFrame, chosen: DataFrame, key: str = "file") -> DataFrame:
    return rows.join(chosen.select(key), key, "left_semi")


def cached(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the cached reply of ``sha256(model, prompt, options)``, if there is one that isn't blank."""
    key = F.sha2(F.concat_ws("\n", "model", "prompt", "options"), 256)
    kept = cache.where("trim(reply) <> ''").groupBy("key").agg(F.max("reply").alias("reply"))
    return requests.withColumn("key", key).join(kept, "key", "left")


def files_from_diff(text: Column) -> Column:
    """Sorted distinct files that a unified diff names, without absolute ones, ones that climb, and /dev/null."""
    named = F.regexp_extract_all(text, F.lit(r"(?m)^[+-]{3} [ab]/(.+)$"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(named, lambda f: (f != "/dev/null") & ~unsafe(f))))


def settle_groups(org: DataFrame, alive: DataFrame) -> DataFrame:
    """Surviving groups in order: lost files go, and groups that are left empty with them."""
    kept = org.join(alive.select("file"), "file", "left_semi")
    order = kept.groupBy("stage", "title").agg(F.count("*").alias("n_files"), F.min("group_ord").alias("group_ord"))
    return order.select("stage", "title", "n_files", "group_ord")
