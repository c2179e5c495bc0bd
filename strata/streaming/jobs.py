"""Job logs: progress, newest snapshots, bounded logs; in batch, and as streams where a stream can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def progress(events: DataFrame) -> DataFrame:
    """``job, seq, done, pct, eta``: running done of all a job's work, and what time the rest takes at this pace.

    Events: ``job, ts, seq, weight``; the total of a job is that of its events. A total of zero is done.
    """
    w = W.partitionBy("job").orderBy("ts", "seq")
    whole = W.partitionBy("job")
    rows = events.select("job", "seq", F.sum("weight").over(w.rowsBetween(W.unboundedPreceding, 0)).alias("done"), F.sum("weight").over(whole).alias("total"), (F.unix_micros("ts") - F.unix_micros(F.min("ts").over(whole))).alias("spent"))
    pct = F.when(F.col("total") == 0, 100).otherwise(F.floor(100 * F.col("done") / F.col("total") + 0.5)).cast("int")
    eta = F.when(F.col("done") > 0, F.col("spent") / 1e6 / F.col("done") * (F.col("total") - F.col("done")))
    # Rounded as a double, in micros: rounding by decimals gives another last digit where the product is close to a half.
    return rows.select("job", "seq", F.col("done").cast("long").alias("done"), pct.alias("pct"), (F.round(eta * 1e6) / 1e6).alias("eta"))


def scope_progress(snapshots: DataFrame) -> DataFrame:
    """``job, pct``: the newest snapshot of each scope (``job, scope, seq, done, total``), together."""
    last = snapshots.groupBy("job", "scope").agg(F.max_by(F.struct("done", "total"), "seq").alias("s")).select("job", "s.*")
    part = F.sum(F.least("done", "total"))
    return last.groupBy("job").agg(F.when(F.sum("total") == 0, 100).otherwise(F.floor(100 * part / F.sum("total") + 0.5)).cast("int").alias("pct"))


def newest(events: DataFrame) -> DataFrame:
    """``job, seq, type``: the newest event of each job; on a stream in update or complete mode too."""
    return events.groupBy("job").agg(F.max_by(F.struct("seq", "type"), F.struct("ts", "seq")).alias("e")).select("job", "e.*")


def bounded_log(events: DataFrame, most: int = 512) -> DataFrame:
    """``job, seq, dropped``: a job's last lines, and how many were dropped before them."""
    rows = events.withColumn("nth", F.row_number().over(W.partitionBy("job").orderBy(F.desc("ts"), F.desc("seq")))).where(F.col("nth") <= most)
    sizes = events.groupBy("job").agg(F.count("*").alias("n"))
    return rows.join(sizes, "job").select("job", "seq", F.greatest(F.col("n") - most, F.lit(0)).cast("long").alias("dropped"))


def status(events: DataFrame) -> DataFrame:
    """``job, status``: running until an end; a failure before a cancellation before a success at the same time."""
    state = F.when(F.col("type") == "error", "failed").when(F.col("type") == "signup", "cancelled").when(F.col("type") == "purchase", "succeeded")
    ended = events.withColumn("state", state).groupBy("job").agg(F.min(F.when(F.col("state").isNotNull(), F.struct("ts", "seq", "state"))).alias("e"))
    return ended.select("job", F.coalesce("e.state", F.lit("running")).alias("status"))


def stream_newest(events: DataFrame, name: str, mode: str = "complete"):
    """A running query that keeps each job's newest event in the memory table ``name``."""
    return newest(events).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """``start, type, n``: events by time window; on a stream, later ones than ``late`` are dropped and windows are closed."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "type", "n")
