"""URL filter: a blocked Bloom filter before an exact hash join. Built of DataFrame and SQL functions only.

A list holds canonical URL rules, each a host with a path (``example.com/de/``) and a verdict. A rule fits its host and all
hosts below it, if the URL's path starts with the rule's. The keys a URL could match are its host's last labels joined with
its path's beginnings, of the numbers and lengths that hosts and paths of the list have; so a hostile URL of a million dots
gives no more keys than another. Those that the filter passes are joined with the list, which removes false positives. A URL
without a possible hit is no part of that join: it stays in its partition.

Cases: a null URL or one without ``://`` has an empty host and path; no rule gives a null rule and the default verdict; of
several fitting rules the longest wins, then the one with the longer host; a rule listed twice counts once, blocking first;
an empty list gives every URL the default verdict; very long URLs are judged whole; repeated rows give repeated results;
further columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the filter for each rule, and the most 64-bit blocks of it (8 MB); more rules let more false positives through,
#: which the join removes.
BITS_PER_RULE = 16
MAX_BLOCKS = 1 << 20
HASHED_BITS = 4


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands after the first ``://``, cut at the first of ``/ ? #``; and the rest up to ``?`` or ``#``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    plain = F.substring_index(F.substring_index(F.coalesce(rest, F.lit("")), "?", 1), "#", 1)
    slash = F.instr(plain, "/")
    return lowered(F.when(slash > 0, F.substring(plain, F.lit(1), slash - 1)).otherwise(plain)), F.when(slash > 0, F.substring(plain, slash, F.length(plain))).otherwise("")


def mask_of(h: Column) -> Column:
    """The bits of a hash within its 64-bit block."""
    out = F.lit(0).cast("long")
    for k in range(HASHED_BITS):
        bit = F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return out


def block_of(h: Column, blocks: int) -> Column:
    return F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(blocks - 1)).cast("int")


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """One row with the filter's blocks as an array, from hashes in the column ``h``."""
    full = keys.groupBy(block_of(F.col("h"), blocks).alias("at")).agg(F.bit_or(mask_of(F.col("h"))).alias("word"))
    every = keys.sparkSession.range(blocks).select(F.col("id").cast("int").alias("at"))
    words = every.join(full, "at", "left").select("at", F.coalesce("word", F.lit(0).cast("long")).alias("word"))
    return words.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]).alias("words"))


def canonical(rules: DataFrame, rule_col: str = "rule", verdict_col: str = "verdict") -> DataFrame:
    """``rule, verdict, key, host_length, path_length``: the list with its hosts lower-cased, each rule once."""
    slash = F.instr(F.col(rule_col), "/")
    host = lowered(F.when(slash > 0, F.substring(F.col(rule_col), F.lit(1), slash - 1)).otherwise(F.col(rule_col)))
    path = F.when(slash > 0, F.substring(F.col(rule_col), slash, F.length(rule_col))).otherwise("")
    rows = rules.where(F.col(rule_col).isNotNull()).select(host.alias("host"), path.alias("path"), F.col(verdict_col).alias("verdict"))
    once = rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" after "allow"
    return once.select(F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("host_length"), F.length("path").alias("path_length"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id_col, host, path, rule, verdict`` for every row; ``rules`` has the columns ``rule`` and ``verdict``."""
    listed = canonical(rules)
    of_host = F.size(F.split(F.substring_index("rule", "/", 1), "\\.", -1))
    # Few numbers each: a host has few labels, a path a bounded length.
    facts = listed.agg(F.count("*").alias("n"), F.collect_set("path_length").alias("lengths"), F.collect_set(of_host).alias("labels")).first()
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page"), host.alias("host"), path.alias("path"))
    none = F.lit(None).cast("string")
    if not facts["n"]:
        return rows.select(F.col("page").alias(id_col), "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    blocks = min(MAX_BLOCKS, 1 << max(4, (facts["n"] * BITS_PER_RULE // 64).bit_length()))
    words = bloom(listed.select(F.xxhash64("rule").alias("h")), blocks).scalar()
    dots = F.length("host") - F.length(F.replace(F.col("host"), F.lit("."), F.lit("")))
    hosts = F.array_compact(F.array(*(F.when(dots + 1 >= k, F.substring_index("host", ".", -k)) for k in sorted(facts["labels"]))))
    lengths = F.filter(F.lit(sorted(facts["lengths"])), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(hosts, lambda h: F.transform(lengths, lambda n: F.concat(h, F.substring(F.col("path"), F.lit(1), n)))))

    def passes(key: Column) -> Column:
        h = F.xxhash64(key)
        mask = mask_of(h)
        return F.element_at("words", block_of(h, blocks) + 1).bitwiseAND(mask) == mask

    asked = rows.withColumn("words", words).withColumn("keys", F.filter(keys, passes)).drop("words")
    clean = asked.where(F.size("keys") == 0).select("page", "host", "path", none.alias("rule"), F.lit(default).alias("verdict"))
    suspects = asked.where(F.size("keys") > 0).withColumn("row", F.monotonically_increasing_id()).withColumn("key", F.explode("keys")).drop("keys")
    hit = suspects.join(listed, suspects["key"] == listed["rule"], "left")
    longest = F.max(F.when(F.col("rule").isNotNull(), F.struct(F.length("rule").alias("length"), "host_length", "rule", "verdict"))).alias("best")
    best = hit.groupBy("row", "page", "host", "path").agg(longest)
    judged = best.select("page", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
    return clean.unionByName(judged).withColumnRenamed("page", id_col)
