"""Fact tables and search: symbols, files, calls, test twins, ranked search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scrub(text: Column) -> Column:
    """On one line of a TSV."""
    return F.trim(F.regexp_replace(text, r"[\t\r\n]+", " "))


def symbols(functions: DataFrame, types: DataFrame, boundary_calls: DataFrame, stage_of: DataFrame) -> DataFrame:
    """``name, path, kind, stage, n_called_by, signature`` of functions, parsed types, and classes known by methods only.

    Functions: ``name, file, class_name, line_start, line_end, signature, n_callers``; types: ``name, file, kind,
    line_start, line_end, signature``; boundary calls: ``leaf, n``; stages: ``file, stage``. Types have no caller count.
    """
    at = lambda f, a, z: F.concat(f, F.lit(":"), a.cast("string"), F.lit("-"), z.cast("string"))
    fn = functions.join(boundary_calls.withColumnRenamed("leaf", "name"), "name", "left").select("name", "file", at(F.col("file"), F.col("line_start"), F.col("line_end")).alias("path"), F.lit("function").alias("kind"), (F.col("n_callers") + F.coalesce("n", F.lit(0))).cast("long").alias("n_called_by"), scrub(F.col("signature")).alias("signature"))
    none = F.lit(None).cast("long").alias("n_called_by")
    ty = types.select("name", "file", at(F.col("file"), F.col("line_start"), F.col("line_end")).alias("path"), F.concat(F.lit("type:"), "kind").alias("kind"), none, scrub(F.col("signature")).alias("signature"))
    derived = functions.where("class_name is not null").groupBy("file", "class_name").agg(F.min("line_start").alias("a"), F.max("line_end").alias("z"), F.count("*").alias("m"))
    derived = derived.join(types.select(F.col("name").alias("class_name"), "file"), ["file", "class_name"], "left_anti")
    cl = derived.select(F.col("class_name").alias("name"), "file", at(F.col("file"), F.col("a"), F.col("z")).alias("path"), F.lit("class-derived").alias("kind"), none, F.concat(F.col("m").cast("string"), F.lit(" method(s)")).alias("signature"))
    rows = fn.unionByName(ty).unionByName(cl).join(stage_of, "file", "left")
    return rows.select("name", "path", "kind", F.coalesce(F.nullif("stage", F.lit("")), F.lit("unassigned")).alias("stage"), "n_called_by", "signature")


def file_facts(assigned: DataFrame, cards: DataFrame, symbol_counts: DataFrame, languages: DataFrame | None = None) -> DataFrame:
    """``path, stage, role, n_symbols, purpose`` for every assigned file, and its language where languages are recorded."""
    rows = assigned.join(cards, "file", "left").join(symbol_counts, "file", "left")
    out = [F.col("file").alias("path"), F.coalesce(F.nullif("stage", F.lit("")), F.lit("unassigned")).alias("stage"), F.coalesce("role", F.lit("other")).alias("role"), F.coalesce("n_symbols", F.lit(0)).cast("long").alias("n_symbols")]
    if languages is not None:
        rows = rows.join(languages, "file", "left")
        out.append(F.coalesce("language", F.lit("?")).alias("language"))
    return rows.select(*out, scrub(F.coalesce("purpose", F.lit(""))).alias("purpose"))


def call_facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``caller, caller_at, callee, callee_at`` of distinct calls; a boundary's place names its module; unlocated ones go."""
    at = nodes.where("line_start > 0").select("id", "qualname", F.concat(F.col("file"), F.lit(":"), F.col("line_start").cast("string")).alias("at"))
    a = at.withColumnsRenamed({"id": "caller", "qualname": "caller_name", "at": "caller_at"})
    z = at.withColumnsRenamed({"id": "callee", "qualname": "callee_name", "at": "callee_at"})
    name = F.regexp_replace("callee", "^boundary:", "")
    rows = edges.where("call_type <> 'unresolved'").select("caller", "callee").distinct().join(a, "caller").join(z, "callee", "left")
    outside = F.col("callee").startswith("boundary:")
    spec = F.when(F.contains(name, F.lit("::")), F.substring_index(name, "::", 1)).otherwise(F.substring_index(name, ".", 1))
    return rows.select(F.col("caller_name").alias("caller"), "caller_at", F.when(outside, F.regexp_extract(name, r"([^.:]*)$", 1)).otherwise(F.col("callee_name")).alias("callee"), F.when(outside, F.concat(F.lit("boundary:"), spec)).otherwise(F.col("callee_at")).alias("callee_at")).where("callee_at is not null").distinct()


def twins(files: DataFrame) -> DataFrame:
    """``file, twin``: tests of a file by name, in its directory or ``__tests__`` below it.

    Test-like names give the directory and stem that they would test, so this is an equi-join.
    """
    base, folder = F.substring_index("file", "/", -1), F.when(F.contains("file", F.lit("/")), F.regexp_replace("file", "/[^/]*$", "")).otherwise("")
    rows = files.select("file", base.alias("base"), folder.alias("dir")).select("*", F.regexp_extract("base", r"^(.*?)(\.[^.]*)?$", 1).alias("stem"), F.regexp_extract("base", r"(\.[^.]*)$", 1).alias("ext"))
    forms = F.array_compact(F.array(*(F.nullif(F.regexp_extract("stem", p, 1), F.lit("")) for p in (r"^(.+)_tests?$", r"^(.+)_spec$", r"^test_(.+)$", r"^(.+)\.tests?$", r"^(.+)\.spec$"))))
    homes = F.array_compact(F.array(F.col("dir"), F.when(F.col("dir").rlike("(^|/)__tests__$"), F.regexp_replace("dir", "/?__tests__$", ""))))
    tests = rows.select(F.col("file").alias("twin"), "ext", F.explode(forms).alias("stem"), homes.alias("homes")).select("twin", "ext", "stem", F.explode("homes").alias("dir"))
    return rows.join(tests, ["dir", "stem", "ext"]).where("file <> twin").select("file", "twin").distinct()


def search(index: DataFrame, text: str, top: int = 50) -> DataFrame:
    """The best entries of ``kind, label, sub, ord`` that hold ``text``: ``label, sub, score``.

    A hit in the label goes before one in the sub-label, one at a word's start before others, an early one before later
    ones, then the kind; all entries are ranked.
    """
    q = text.lower()
    p1, p2 = F.instr(F.lower("label"), q), F.instr(F.lower("sub"), q)
    first = p1 > 0
    pos = F.when(first, p1).otherwise(p2) - 1
    before = F.when(pos == 0, "").otherwise(F.substring(F.when(first, F.col("label")).otherwise(F.col("sub")), pos, F.lit(1)))
    score = F.when(first, 400).otherwise(800) + F.when((pos == 0) | before.isin(".", "/", "_", "-", " ", ":"), 0).otherwise(200) + F.least(pos, F.lit(120)) + F.col("kind")
    return index.where(first | (p2 > 0)).withColumn("score", score.cast("int")).orderBy("score", "ord", "label").limit(top).select("kind", "label", "sub", "score")


def nearest_key(asked: DataFrame, keys: DataFrame) -> DataFrame:
    """``asked, key``: the key of least edit distance within a third at most of its length; the first key wins ties.

    Keys are a short list (``key, ord``) of known settings, so each asked name meets all of them.
    """
    pairs = asked.join(F.broadcast(keys.withColumnRenamed("key", "k")), F.levenshtein("asked", "k") <= F.least(F.lit(3), F.greatest(F.lit(1), F.floor(F.length("asked") / 4))))
    best = pairs.groupBy("asked").agg(F.min(F.struct(F.levenshtein("asked", "k").alias("d"), F.col("ord"), F.col("k"))).alias("m"))
    return asked.join(best, "asked", "left").select("asked", F.col("m.k").alias("key"))


def grep(files: DataFrame, pattern: str, top: int = 100, largest: int = 5_000_000) -> DataFrame:
    """``file, line, text`` of the first hits in file order; large files and ones with NUL bytes are skipped."""
    lines = files.where((F.length("content") <= largest) & ~F.contains("content", F.lit("\0"))).select("file", F.posexplode(F.split("content", "\n", -1)).alias("pos", "line_text"))
    hits = lines.where(F.col("line_text").rlike(pattern)).select("file", (F.col("pos") + 1).alias("line"), F.substring(F.trim("line_text"), 1, 200).alias("text"))
    return hits.orderBy("file", "line").limit(top)
