"""Settings: typed values with a reason for refusal, precedence of sources, unknown names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.operators import facts

#: What counts as true and as false, and the order of the sources.
TRUE, FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")
SOURCES = ("flag", "env", "file", "default")


def coerced(kind: Column, raw: Column, least: Column, most: Column, choices: Column) -> Column:
    """``value, problem``: the raw text as a value of its kind (bool, int, enum), in text form, or why it is refused."""
    word = F.lower(F.trim(raw))
    number = raw.try_cast("double")
    finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) != float("inf"))
    low = (F.trim(raw) == "") | ~finite | (number < least) | F.trim(raw).rlike(r"^-0+(\.0*)?$")
    answer = lambda value, problem: F.struct(value.cast("string").alias("value"), problem.cast("string").alias("problem"))
    none = F.lit(None).cast("string")
    return (
        F.when((kind == "bool") & word.isin(*TRUE), answer(F.lit("true"), none))
        .when((kind == "bool") & word.isin(*FALSE), answer(F.lit("false"), none))
        .when(kind == "bool", answer(none, F.lit("no truth value")))
        .when((kind == "int") & low, answer(none, F.lit("not an integer from the least on")))
        .when((kind == "int") & (number > most), answer(none, F.lit("above the most")))
        .when(kind == "int", answer(number.cast("long"), none))
        .when(F.array_contains(choices, raw), answer(raw, none))
        .otherwise(answer(none, F.lit("no choice")))
    )


def resolved(settings: DataFrame, given: DataFrame) -> DataFrame:
    """``setting, source, value, problem``: for each setting the first source that gives it, and what it is worth.

    Settings: ``setting, kind, least, most, choices``; given: ``setting, source, raw``. A null raw is missing, and so is an
    empty one from ``env``. A refused value stays refused: no later source stands in for it.
    """
    rank = F.array_position(F.array(*map(F.lit, SOURCES)), F.col("source"))
    there = given.where("raw is not null and not (source = 'env' and raw = '')")
    first = there.groupBy("setting").agg(F.min_by(F.struct("source", "raw"), F.struct(rank, "raw")).alias("g")).select("setting", "g.*")
    rows = settings.join(first, "setting", "left")
    got = coerced(F.col("kind"), F.col("raw"), F.col("least"), F.col("most"), F.col("choices"))
    return rows.select("setting", "source", F.when(F.col("raw").isNotNull(), got).alias("got")).select("setting", "source", "got.value", "got.problem")


def unknown_keys(given: DataFrame, known: DataFrame) -> DataFrame:
    """``asked, key``: names that no setting has (``given.asked``), with the nearest known one (``known.key, ord``)."""
    return facts.nearest_key(given.join(known.select(F.col("key").alias("asked")), "asked", "left_anti").select("asked").distinct(), known)


def usage(calls: DataFrame) -> DataFrame:
    """``who, calls, failures, elapsed``: totals; an elapsed time that is null, no number or infinite counts as 0."""
    spent = F.when(F.isnan("elapsed") | (F.abs("elapsed") == float("inf")), 0.0).otherwise(F.coalesce("elapsed", F.lit(0.0)))
    return calls.groupBy("who").agg(F.count("*").alias("calls"), F.count_if("failed").alias("failures"), F.sum(spent).alias("elapsed"))


def dry_streaks(rounds: DataFrame) -> DataFrame:
    """``who, seq, dry``: at each round, the rounds in a row, up to it, that brought nothing (``progress`` false)."""
    w = W.partitionBy("who").orderBy("seq")
    nth = rounds.select("who", "seq", "progress", F.row_number().over(w).alias("nth"))
    last = F.max(F.when(F.col("progress"), F.col("nth"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    return nth.select("who", "seq", (F.col("nth") - F.coalesce(last, F.lit(0))).cast("long").alias("dry"))


def size_chunks(items: DataFrame, most: int) -> DataFrame:
    """``file, ord, chunk``: items of ``file, ord, size`` in order; a new chunk begins where the next one would be too large.

    Where a chunk begins depends on all before it in its file, so a file's items are walked in one task.
    """
    import pandas as pd

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord")
        chunk, held, out = 0, 0, []
        for k, size in enumerate(part["size"]):
            if k and held + size > most:
                chunk, held = chunk + 1, 0
            held += size
            out.append(chunk)
        return pd.DataFrame({"file": part["file"], "ord": part["ord"], "chunk": out})

    kinds = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    return items.select("file", "ord", "size").groupBy("file").applyInPandas(walk, f"file {kinds['file']}, ord {kinds['ord']}, chunk int")
