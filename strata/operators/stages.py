"""Stages: votes, buckets, statistics, groups, trees of stages and their numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNASSIGNED = "unassigned"


def majority(votes: DataFrame, stage_order: DataFrame) -> DataFrame:
    """``file, stage, also``: a file's most voted stage (ties: the earlier stage), and its second and third choice.

    Votes: ``file, stage``; a null stage is a file without votes. Order: ``stage, ord``.
    """
    counted = votes.where("stage is not null").groupBy("file", "stage").agg(F.count("*").alias("n")).join(F.broadcast(stage_order), "stage")  # stages are few
    ranked = counted.withColumn("nth", F.row_number().over(W.partitionBy("file").orderBy(F.desc("n"), "ord"))).where("nth <= 3")
    won = ranked.groupBy("file").agg(F.max(F.when(F.col("nth") == 1, F.col("stage"))).alias("stage"), F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.struct("nth", "stage")))), lambda s: s["stage"]).alias("also"))
    rest = votes.select("file").distinct().join(won, "file", "left_anti").select("file", F.lit(UNASSIGNED).alias("stage"), F.array().cast("array<string>").alias("also"))
    return won.unionByName(rest)


def rebuild_assignment(assigned: DataFrame, stages: DataFrame) -> DataFrame:
    """``file, stage, also``: unknown stages become unassigned; ``also`` keeps known ones other than the primary."""
    known = stages.select(F.col("id").alias("known")).distinct()
    primary = assigned.join(F.broadcast(known), F.col("stage") == F.col("known"), "left").withColumn("stage", F.coalesce("known", F.lit(UNASSIGNED))).drop("known")
    pairs = primary.select("file", "stage", F.posexplode("also").alias("pos", "other")).join(F.broadcast(known), F.col("other") == F.col("known"), "left_semi").where("other <> stage")
    lists = pairs.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "other"))), lambda s: s["other"]).alias("valid"))
    return primary.select("file", "stage").join(lists, "file", "left").select("file", "stage", F.coalesce("valid", F.array().cast("array<string>")).alias("also"))


def buckets(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("stage").agg(F.count("*").alias("n_files"))


def stage_stats(sizes: DataFrame) -> DataFrame:
    """``stage, n_files, mean, floor, overloaded``: overloaded is more than the larger of 20 and 2.5 times the mean of non-empty stages."""
    mean = sizes.where("n_files > 0").agg(F.coalesce(F.avg("n_files"), F.lit(0.0)).alias("mean"))
    floor = F.greatest(F.lit(20.0), F.col("mean") * 2.5)
    return sizes.join(F.broadcast(mean), F.lit(True)).select("stage", "n_files", "mean", floor.alias("floor"), (F.col("n_files") > floor).alias("overloaded"))  # one row


def dir_rollups(cards: DataFrame, lifecycles: int = 3, purposes: int = 4) -> DataFrame:
    """``dir, n_files, roles, lifecycles, purposes`` from ``dir, file, role, lifecycle, purpose``.

    Roles by count, the commonest life cycles (not empty or "none"), and the longest purposes.
    """
    files = cards.groupBy("dir").agg(F.count("*").alias("n_files"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("nth", F.col(c).alias("x")))), lambda s: s["x"])

    def ranked(rows: DataFrame, item: str, n: int) -> DataFrame:
        counted = rows.groupBy("dir", item).agg(F.count("*").alias("n"))
        return counted.withColumn("nth", F.row_number().over(W.partitionBy("dir").orderBy(F.desc("n"), item))).where(F.col("nth") <= n)

    roles = ranked(cards, "role", 1000).withColumn("shown", F.concat("role", F.lit(":"), F.col("n").cast("string"))).groupBy("dir").agg(listed("shown").alias("roles"))
    cycles = ranked(cards.where("lifecycle <> '' and lifecycle <> 'none'"), "lifecycle", lifecycles).groupBy("dir").agg(listed("lifecycle").alias("lifecycles"))
    longest = cards.where("purpose <> ''").withColumn("nth", F.row_number().over(W.partitionBy("dir").orderBy(F.desc(F.length("purpose")), "file"))).where(F.col("nth") <= purposes).groupBy("dir").agg(listed("purpose").alias("purposes"))
    return files.join(roles, "dir", "left").join(cycles, "dir", "left").join(longest, "dir", "left")


def path_prefixes(files: DataFrame, top: int = 2) -> DataFrame:
    """``stage, prefixes``: the commonest directories of a stage's files."""
    counted = files.groupBy("stage", "dir").agg(F.count("*").alias("n"))
    kept = counted.withColumn("nth", F.row_number().over(W.partitionBy("stage").orderBy(F.desc("n"), "dir"))).where(F.col("nth") <= top)
    return kept.groupBy("stage").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "dir"))), lambda s: s["dir"]).alias("prefixes"))


def direct_files(bucket: DataFrame, ranks: DataFrame) -> DataFrame:
    """``stage, file, place``: a bucket's files by their rank, unranked ones last in bucket order."""
    joined = bucket.join(ranks, ["stage", "file"], "left")
    return joined.select("stage", "file", F.row_number().over(W.partitionBy("stage").orderBy(F.col("rank").asc_nulls_last(), "bucket_ord")).alias("place"))


def groups(org: DataFrame, bucket: DataFrame) -> DataFrame:
    """``stage, title, file``: files of the stage's groups, each in the first group that claims it; the rest has no title."""
    own = org.join(bucket.select("stage", "file"), ["stage", "file"], "left_semi")
    claimed = own.withColumn("nth", F.row_number().over(W.partitionBy("stage", "file").orderBy("group_ord"))).where("nth = 1").select("stage", "title", "file")
    rest = bucket.select("stage", "file").join(claimed, ["stage", "file"], "left_anti")
    return claimed.unionByName(rest.select("stage", F.lit(None).cast("string").alias("title"), "file"))


def direct_registers(registers: DataFrame, stage: str) -> DataFrame:
    return registers.where(F.array_contains("stages", stage))


def roots(stages: DataFrame) -> DataFrame:
    """Stages without a parent, or whose parent doesn't exist."""
    return stages.join(stages.select(F.col("id").alias("parent")), "parent", "left_anti")


def children(stages: DataFrame) -> DataFrame:
    kids = stages.where("parent is not null").groupBy("parent").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda s: s["id"]).alias("children"))
    return stages.select("id").join(kids.withColumnRenamed("parent", "id"), "id", "left").select("id", F.coalesce("children", F.array().cast("array<string>")).alias("children"))


def subtree(stages: DataFrame) -> DataFrame:
    """``ancestor, id, depth``: every stage under each stage (itself at depth 0); a cycle ends where it would repeat."""
    spark = stages.sparkSession
    stages.select("id", "parent").createOrReplaceTempView("_strata_stages")
    return spark.sql("""
        WITH RECURSIVE below(ancestor, id, depth, path) AS (
          SELECT id, id, 0, array(id) FROM _strata_stages
          UNION ALL SELECT b.ancestor, s.id, b.depth + 1, array_append(b.path, s.id) FROM below b JOIN _strata_stages s ON s.parent = b.id WHERE NOT array_contains(b.path, s.id)
        ) SELECT ancestor, id, depth FROM below""")


def subtree_files(stages: DataFrame, sizes: DataFrame) -> DataFrame:
    """``stage, n_files``: files of a stage and all under it."""
    total = subtree(stages).join(sizes.select(F.col("stage").alias("id"), "n_files"), "id", "left")
    return total.groupBy(F.col("ancestor").alias("stage")).agg(F.coalesce(F.sum("n_files"), F.lit(0)).cast("long").alias("n_files"))


def numbering(stages: DataFrame) -> DataFrame:
    """``id, number``: 1, 1.2 and so on for content stages, in order under each parent; the hidden root has none."""
    placed = stages.where("not crosscut").withColumn("nth", F.row_number().over(W.partitionBy("parent").orderBy("ord")))
    placed.select("id", "parent", "nth").createOrReplaceTempView("_strata_placed")
    return stages.sparkSession.sql("""
        WITH RECURSIVE n(id, number) AS (
          SELECT p.id, CAST(p.nth AS STRING) FROM _strata_placed p LEFT ANTI JOIN _strata_placed q ON p.parent = q.id
          UNION ALL SELECT p.id, concat(n.number, '.', CAST(p.nth AS STRING)) FROM n JOIN _strata_placed p ON p.parent = n.id
        ) SELECT id, number FROM n""")


def pager(stages: DataFrame) -> DataFrame:
    """``id, prev, next`` over content stages in order. Stages are few, so one partition holds them."""
    w = W.orderBy("ord")
    return stages.where("not crosscut").select("id", F.lag("id").over(w).alias("prev"), F.lead("id").over(w).alias("next"))


def overview(stages: DataFrame, sizes: DataFrame, narration: DataFrame) -> DataFrame:
    """``id, title, n_files, text``: every stage with its bucket's size and its narration, if any."""
    return stages.select("id", "title").join(sizes.withColumnRenamed("stage", "id"), "id", "left").join(narration.withColumnRenamed("stage", "id"), "id", "left").select("id", "title", F.coalesce("n_files", F.lit(0)).cast("long").alias("n_files"), "text")


def card_coverage(files: DataFrame, described: DataFrame) -> DataFrame:
    """``n_files, n_described`` of all files."""
    both = files.join(described.select("file").distinct().withColumn("d", F.lit(True)), "file", "left")
    return both.agg(F.count("*").alias("n_files"), F.count_if(F.col("d")).alias("n_described"))
