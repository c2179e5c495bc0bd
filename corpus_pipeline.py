"""A corpus through five stages: toxicity, line dedup, near-dedup, benchmark decontamination, BPE.

Each stage takes all rows its predecessor kept. Rows with a null text pass all stages and encode as an empty one; rows
without an id take part but in near-dedup, where they stay; empty tables give empty results; further columns are carried. The first four return the columns of ``documents``; the last one returns
``doc_id, n_tokens, ids_sha256, decoded_sha256`` as the BPE operator gives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import bpe, decontam, linededup, minhash, toxicity
from strata.llm.common import bucket_of, materialize, table
from strata.llm.queries import tokenizer_path

#: Ids of dropped documents that may go to every executor (8 bytes each, or 16 of a digest); with more, the texts are shuffled to them.
MAX_SHIPPED = 500_000


def without(docs: DataFrame, dropped: DataFrame, key: str = "doc_id") -> DataFrame:
    """The documents whose key is not among ``dropped``."""
    dropped = materialize(dropped, "dropped")  # counted and joined, but made once
    few = dropped.count() <= MAX_SHIPPED
    return docs.join(F.broadcast(dropped) if few else dropped, key, "left_anti")


def packed(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and a struct of the rest, so that no column of the documents clashes with an operator's."""
    return docs.select("doc_id", "text", F.struct(F.lit(True).alias("__"), *(c for c in docs.columns if c not in ("doc_id", "text"))).alias("__row"))


def unpacked(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return rows.select(*((new[c] if c in new else F.col(c) if c in ("doc_id", "text") else F.col(f"__row.`{c}`")).alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; it is fitted on all documents outside the held-out fold and their labels."""
    model = toxicity.train_on_all(docs.where(bucket_of("doc_id", 4) != 2), table(spark, sf_dir, "labels"))
    judged = toxicity.score(packed(docs), model, threshold=0.3, keep=("text", "__row"))
    return unpacked(judged.where("predicted = 0"), docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines in ten or more documents stay in the first of them only; documents that lose all their lines go."""
    kept = linededup.dedup_lines(packed(docs), min_docs=10, keep="first", carry=("__row",))
    return unpacked(kept.where("n_dropped < n_lines"), docs.columns, text=F.col("kept"), n_chars=F.length("kept").cast("long"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles, similarity 0.8) the document of the least id stays."""
    groups = minhash.near_duplicates(docs, shingle=5, percent=80)
    return without(docs, groups.where("not kept").select("doc_id")).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go, told apart by id and text, as ids may repeat or be null."""
    keyed = docs.withColumn("__key", F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("|"), F.coalesce("text", F.lit(""))))))
    found = decontam.leaks(keyed, table(spark, sf_dir, "benchmark"), id_col="__key")
    return without(keyed, found.select("__key").distinct(), "__key").select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer_path(), keep_ids=False)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("decontamination", drop_leaks), ("bpe", encode)]

#: The classifier and the retrieval can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage returns is written once, so that the passes of the next one don't run it again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
