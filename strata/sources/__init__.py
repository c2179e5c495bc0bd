"""What is read: trees of source files, lists of corrections, and which adapter owns a file."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that no scan enters.
SKIPPED = (".git", "node_modules", "__pycache__", ".venv", "dist", "build")


def source_files(spark: SparkSession, root: str, extensions: Iterable[str], skipped: Iterable[str] = SKIPPED, most_bytes: int = 2_000_000) -> DataFrame:
    """``file, content, problem``: every file under ``root`` with one of the extensions, read by Spark's own source.

    Paths are relative to the root. A file larger than ``most_bytes`` has no content and the problem ``too large``; its
    bytes are not read. Bytes that are no UTF-8 give the problem ``undecodable``.
    """
    names = [f"*{e}" for e in extensions]
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(names) + "}").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace("path", r"^file:/*(?=/)", "")
    file = F.substring(path, F.instr(path, base) + len(base), F.length(path))
    inside = ~F.exists(F.slice(F.split(file, "/"), 1, F.size(F.split(file, "/")) - 1), lambda p: p.isin(*skipped))
    small = rows.where(F.col("length") <= most_bytes).where(inside).select(file.alias("file"), F.col("content").alias("raw"))
    text = F.when(F.is_valid_utf8(F.col("raw").cast("string")), F.col("raw").cast("string"))
    read = small.select("file", text.alias("content"), F.when(text.isNull(), "undecodable").alias("problem"))
    large = rows.where(F.col("length") > most_bytes).where(inside).select(file.alias("file"), F.lit(None).cast("string").alias("content"), F.lit("too large").alias("problem"))
    return read.unionByName(large)


def adapter_of(path: Column, extensions: Iterable[tuple[str, str]]) -> Column:
    """The language of the longest extension (``language, extension``) that a path ends with; the first one wins ties."""
    out = None
    for lang, ext in sorted(extensions, key=lambda x: -len(x[1])):
        hit = path.endswith(ext)
        out = F.when(hit, lang) if out is None else out.when(hit, lang)
    return out if out is not None else F.lit(None).cast("string")


def corrections(lines: DataFrame) -> DataFrame:
    """``line, file, page, claim, actual, notedAt, problem`` from ``line, raw`` (JSON lines): a garbled line is a problem row.

    Blank lines and null ones are left out. A valid correction names a file.
    """
    shape = "file string, page string, claim string, actual string, notedAt string"
    rows = lines.where(F.trim("raw") != "").withColumn("whole", F.try_parse_json("raw")).withColumn("c", F.from_json("raw", shape))
    problem = F.when(F.col("whole").isNull(), "not valid JSON").when(F.coalesce("c.file", F.lit("")) == "", "not a valid correction")
    return rows.select("line", "c", problem.alias("problem")).select("line", *(F.when(F.col("problem").isNull(), F.col(f"c.{n}")).alias(n) for n in ("file", "page", "claim", "actual", "notedAt")), "problem")
