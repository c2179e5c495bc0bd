"""Edit plans: order checks, verification against the files, all or nothing, net changes, rollback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.functions.text import dominant_eol, is_outside, line_of, path_problem


def index_problems(edits: DataFrame) -> DataFrame:
    """``plan, pos, problem``: edit numbers that repeat, or don't rise. Edits: ``plan, pos, idx``."""
    w = W.partitionBy("plan").orderBy("pos")
    rows = edits.select("plan", "pos", "idx", F.lag("idx").over(w).alias("last"), F.count("*").over(W.partitionBy("plan", "idx")).alias("n"))
    problem = F.when(F.col("n") > 1, "duplicate").when(F.col("idx") <= F.col("last"), "not rising")
    return rows.select("plan", "pos", problem.alias("problem")).where("problem is not null")


#: Largest file that edits may rewrite, in bytes. A fixed value.
MAX_FILE_BYTES = 8 * 1024 * 1024


def _hits(text: Column, part: Column) -> Column:
    """0, 1 or 2 (for several, overlapping ones too) places of ``part`` in ``text``; two searches, so linear."""
    first = F.instr(text, part)
    again = F.call_function("locate", part, text, first + 1)
    return F.when(first == 0, 0).when(again == 0, 1).otherwise(2)


def verify(edits: DataFrame, files: DataFrame) -> DataFrame:
    """``edit, file, status, line``: each edit's old text against its file, one edit a file.

    Edits: ``edit, file, old, new``; files: ``file, content`` and, where known, ``is_dir`` and ``bad_bytes`` (a file that is
    no UTF-8 text or too large). An empty old text creates a file, or fills an empty one, at line 1; a file with content is
    not overwritten. No hit is tried once more with the file's line ends. Null paths are unsafe; a null old text counts as
    empty.
    """
    extra = [c if c in files.columns else F.lit(False).alias(c) for c in ("is_dir", "bad_bytes")]
    known = files.select("file", "content", *extra, F.lit(True).alias("stands"))
    rows = edits.select("edit", "file", F.coalesce("old", F.lit("")).alias("old")).join(known, "file", "left")
    content = F.coalesce("content", F.lit(""))
    plain = F.replace(F.col("old"), F.lit("\r\n"), F.lit("\n"))
    again = F.when(dominant_eol(content) == "crlf", F.replace(plain, F.lit("\n"), F.lit("\r\n"))).otherwise(plain)
    used = F.when(F.contains(content, F.col("old")), F.col("old")).otherwise(again)
    rows = rows.withColumn("content", content).withColumn("used", used)
    # The seek is one struct of one expression, so that status and line read it and don't repeat it.
    seek = F.struct(_hits(F.col("content"), F.col("used")).alias("hits"), F.instr(F.col("content"), F.col("used")).alias("at"))
    rows = rows.withColumn("seek", F.when(F.col("used") != "", seek))
    there, creates = F.coalesce("stands", F.lit(False)), F.col("old") == ""
    status = (
        F.when(F.col("file").isNull() | path_problem(F.col("file")).isNotNull() | is_outside(F.col("file")), "unsafe-path")
        .when(there & F.col("is_dir"), "not-a-file")
        .when(there & (F.col("bad_bytes") | (F.octet_length("content") > MAX_FILE_BYTES)), "undecodable")
        .when(~there & creates, "created")
        .when(~there, "file-missing")
        .when(creates & (F.col("content") == ""), "applied")
        .when(creates | (F.col("seek.hits") == 0), "no-match")
        .when(F.col("seek.hits") > 1, "ambiguous")
        .otherwise("applied")
    )
    judged = rows.withColumn("status", status)
    line = F.when(F.col("status") == "created", 1).when((F.col("status") == "applied") & creates, 1).when(F.col("status") == "applied", line_of(F.col("content"), F.col("seek.at")))
    return judged.select("edit", "file", "status", line.cast("int").alias("line"))


def apply_in_order(edits: DataFrame, files: DataFrame) -> DataFrame:
    """``file, content, failed``: each file after its edits in order of ``ord``, every one against what the last one left."""
    import pandas as pd

    listed = edits.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("ord", "old", "new"))).alias("edits"))  # a plan has few

    def run(parts):
        for part in parts:
            out, failed = [], []
            for content, changes in zip(part["content"], part["edits"], strict=True):
                bad = 0
                for c in changes:
                    at = content.find(c["old"]) if c["old"] else -1
                    if at < 0 or content.find(c["old"], at + 1) >= 0:
                        bad += 1
                    else:
                        content = content[:at] + c["new"] + content[at + len(c["old"]) :]
                out.append(content)
                failed.append(bad)
            yield pd.DataFrame({"file": part["file"], "content": out, "failed": failed})

    return files.join(listed, "file").select("file", "content", "edits").mapInPandas(run, "file string, content string, failed int")


def all_or_nothing(outcomes: DataFrame) -> DataFrame:
    """Outcomes of ``plan, edit, status``: in a plan with a failure, what would have been applied is skipped."""
    good = F.col("status").isin("applied", "created")
    bad = F.bool_or(~good).over(W.partitionBy("plan"))  # one pass: the verification isn't run again for a self-join
    return outcomes.select("plan", "edit", F.when(good & bad, "skipped").otherwise(F.col("status")).alias("status"))


def net_changes(files: DataFrame) -> DataFrame:
    return files.where(~F.col("original").eqNullSafe(F.col("next")))


def rollback_plan(manifest: DataFrame, live: DataFrame, force: bool = False) -> DataFrame:
    """``file, action`` from ``file, before_hash, after_hash, backup_hash`` and the live ``file, hash``."""
    rows = manifest.join(live.select("file", F.col("hash").alias("now")), "file", "left")
    action = (
        F.when(F.col("now").eqNullSafe(F.col("before_hash")), "already back").when(F.col("before_hash").isNotNull() & ~F.col("backup_hash").eqNullSafe(F.col("before_hash")), "corrupt backup")
        .when(F.col("now").eqNullSafe(F.col("after_hash")) | F.lit(force), "restore").when(F.col("now").isNull(), "absent").otherwise("changed since")
    )
    return rows.select("file", action.alias("action"))
