"""Language identification by known words first, then by ever shorter character n-grams.

A word that training saw scores by its log frequency in each language. An unseen word falls back to its n-grams of the
longest length of which any is known, down to single letters; a word of which nothing is known says nothing. A document's
language has the largest sum over its words; its score is the posterior over a bounded number of words.

Cases: a null text and one without a letter are ``und`` with score 0; ties go to the first language by name; empty training
data leave every document ``und``; repeated rows give repeated results; very long texts are read whole; columns to be kept
that have an output's name are refused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import materialize, no_clash, sampled

WORD = regex.compile(r"\p{L}+")
#: Longest n-gram of the fallback.
LONGEST = 5
#: Training documents for each language (chosen by hashed id; about so many), and what the model keeps of them.
DOCS_PER_LANGUAGE = 3000
WORDS_PER_LANGUAGE = 20_000
GRAMS_PER_LENGTH = 8_000
#: Words over which a document's evidence counts in full; more of them don't make the posterior sharper.
FULL_WORDS = 40
MEMORY = 150_000
#: Languages that are learnt, the commonest ones.
MAX_LANGUAGES = 500


def grams(word: str, n: int) -> list[str]:
    padded = f"^{word}$" if n > 1 else word
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


def count_evidence(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """How often each word (n = 0) and n-gram occurs in each language: ``lang, n, item, times``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}

        def flush() -> pa.RecordBatch:
            out = []
            for lang, words in seen.items():
                pieces: Counter = Counter()
                for word, k in words.items():
                    pieces[0, word] += k
                    for n in range(1, LONGEST + 1):
                        for g in grams(word, n):
                            pieces[n, g] += k
                out += [(lang, n, item, k) for (n, item), k in pieces.items()]
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64()))], names=["lang", "n", "item", "times"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.setdefault(lang, Counter()).update(WORD.findall((text.as_py() or "").lower()))
                if sum(map(len, seen.values())) > MEMORY:
                    yield flush()
        yield flush()

    return docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(run, "lang string, n int, item string, times bigint").groupBy("lang", "n", "item").agg(F.sum("times").alias("times"))


class Model:
    """Log frequencies of words and n-grams, one column a language."""

    def __init__(self, rows: list[tuple[str, int, str, int]], totals: dict[tuple[str, int], int]):
        self.langs = sorted({lang for lang, _ in totals})
        place = {lang: k for k, lang in enumerate(self.langs)}
        counts: dict[tuple[int, str], list[float]] = {}
        for lang, n, item, times in rows:
            counts.setdefault((n, item), [0.0] * len(self.langs))[place[lang]] = times
        self.keys = {key: k for k, key in enumerate(counts)}
        table = np.array(list(counts.values()), np.float64).reshape(len(counts), len(self.langs))
        of = np.array([n for n, _ in counts], np.int64)
        self.logs = np.zeros(table.shape, np.float32)
        for n in range(LONGEST + 1):
            total = np.array([totals.get((lang, n), 0) for lang in self.langs], np.float64)
            self.logs[of == n] = np.log((table[of == n] + 0.5) / (total + 1000.0))
        if len(self.langs):
            self.logs -= self.logs.mean(axis=1, keepdims=True)


class Scorer(dict):
    """Words to rows of a table of their scores, computed when first met; emptied when full."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.table = model, np.zeros((MEMORY, len(model.langs)), np.float32)

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.table[k] = self.score(word)
        return k

    def score(self, word: str) -> np.ndarray:
        keys, logs = self.model.keys, self.model.logs
        if (k := keys.get((0, word))) is not None:
            return logs[k]
        for n in range(LONGEST, 0, -1):
            if found := [keys[n, g] for g in grams(word, n) if (n, g) in keys]:
                return logs[found].mean(axis=0)
        return np.zeros(len(self.model.langs), np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        total, count = np.zeros(len(self.model.langs)), 0
        words = WORD.findall(text.lower()) if text else []
        if not words or not self.model.langs:
            return "und", 0.0
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            if len(self) + len(part) > MEMORY:
                self.clear()
            total += self.table[np.fromiter(map(self.__getitem__, part), np.int64, len(part))].sum(axis=0, dtype=np.float64)
            count += len(part)
        best = int(np.argmax(total))
        mean = (total - total[best]) * (min(count, FULL_WORDS) / count)
        return self.model.langs[best], 1.0 / float(np.exp(mean).sum())


def train(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> Model:
    """Fit on about ``docs_per_language`` documents of each language, chosen by hashed id; rows without a language don't count."""
    docs = docs.where(F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # A column with more values than there are languages is dirty: the commonest ones are learnt.
    sizes = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()}
    if not sizes:
        return Model([], {})
    rate = F.lit(0.0)
    for lang, n in sizes.items():
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, docs_per_language / n))).otherwise(rate)
    counted = materialize(count_evidence(sampled(docs, "id", rate), "lang", "text").where("times >= 2 or n = 1"), "evidence")
    kept = []
    for lengths, most in (("n = 0", WORDS_PER_LANGUAGE), ("n > 0", GRAMS_PER_LENGTH)):
        best = counted.where(lengths)
        # The best of 32 parts of each language first, so that no task sorts a language's items.
        for by in (["lang", "n", F.pmod(F.xxhash64("item"), F.lit(32))], ["lang", "n"]):
            rank = F.row_number().over(W.partitionBy(*by).orderBy(F.desc("times"), "item"))
            best = best.withColumn("rank", rank).where(F.col("rank") <= most).drop("rank")
        kept += best.select("lang", "n", "item", "times").collect()
    totals: dict[tuple[str, int], int] = {}
    for r in kept:
        totals[r["lang"], r["n"]] = totals.get((r["lang"], r["n"]), 0) + r["times"]
    return Model([tuple(r) for r in kept], totals)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, lang_pred, score`` for every row's whole text, with the columns named in ``keep`` before them."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    lead = list(dict.fromkeys([id_col, *keep]))
    no_clash(lead, "lang_pred", "score")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in lead) + ", lang_pred string, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            found = [scorer.predict(t.as_py()) for t in batch.column(len(lead))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(lead)], pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=[*lead, "lang_pred", "score"])

    return docs.select(*lead, text_col).mapInArrow(run, schema)
