"""Benchmark decontamination by latent semantic retrieval.

1. One pass over the corpus reads its words: it counts the passages (overlapping windows) that hold each of the benchmark's
   words, and writes every document as the places of its words in the benchmark, which is all that later passes read.
2. All passages of the corpus and the benchmark's own are TF-IDF rows; a distributed randomised SVD (random range, two power
   steps; each step is a pass over all rows, summed by task) gives a latent space of far fewer dimensions than rows and words.
3. A last pass folds passages of the corpus into that space; a blocked matrix product with the items gives the cosines, and
   so the candidate items, of each. Left out are pairs that can't be leaks whatever their cosine: a common subsequence is
   no longer than the item's words that occur in the document, or in the passage's surroundings, at all.
4. A candidate is a leak if the longest common subsequence of words covers ``FULL_COVER`` of the item, or ``COVER`` of it and
   enough of its answer, which is the item's last words. So copies, also without an end, copies with changes of case,
   punctuation or line breaks, and paraphrases that keep the wording's order are found; mere shared vocabulary is not.

Cases: null and empty texts and items match nothing; an item of fewer than ``MIN_WORDS`` words is found where it is a whole
line, as everyone uses such word sequences inside lines; very long texts are searched whole; texts repeated under several
item ids give one row for each id, several texts of one id one row for the id, all items without an id one row with a null;
repeated rows of a document give one row for each; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize

#: ASCII characters that part words, as a table for bytes, and fixed values: further ones, of several bytes.
_APART = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
WIDE_APART = "\u00a0\u00ab\u00b7\u00bb\u2010\u2011\u2012\u2013\u2014\u2018\u2019\u201a\u201c\u201d\u201e\u2022\u2026\u2039\u203a\u3000\u3001\u3002\uff0c"
#: Words of a passage, and from one passage's start to the next one's.
WINDOW, STRIDE = 32, 16
MIN_WORDS = 5
#: Dimensions of the latent space, spare ones of the random range, and power steps.
RANK, SPARE, STEPS = 96, 16, 2
#: Tasks of a power step at least; each sends one row for every word of the block that it has.
STEP_TASKS = 32
#: Least cosine of a candidate, and least cover of an item and of its answer by the common subsequence.
COSINE, COVER, ANSWER_COVER = 0.35, 0.6, 0.5
#: Cover of an item that makes a leak whatever the cover of its answer.
FULL_COVER = 0.65
#: The last words of an item that count as its answer.
ANSWER_WORDS = 6
#: Passages taken at once, as with more the share of words that each lacks grows, and weights of a word by its count in one.
PASSAGES = 24
LOGS = np.append(0.0, 1 + np.log(np.arange(1, WINDOW + 1)))
#: Benchmark items up to which the index goes to every executor; more are searched in several blocks of so many.
ITEMS_PER_BLOCK = 20_000


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation, in UTF-8."""
    if not text:
        return []
    text = text.lower()
    if not text.isascii():
        for c in WIDE_APART:
            if c in text:
                text = text.replace(c, " ")
    return text.encode("utf-8", "replace").translate(_APART).split()


class Index:
    """A block of benchmark items with the words they use."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        every = [(item, words_of(text)) for item, text in items]
        self.words = [(item, w) for item, w in every if len(w) >= MIN_WORDS]
        self.short: dict[tuple[bytes, ...], list[int | None]] = {}
        for item, w in every:
            if 0 < len(w) < MIN_WORDS:
                self.short.setdefault(tuple(w), []).append(item)
        self.place = {w: k for k, w in enumerate(dict.fromkeys(w for _, own in self.words for w in own))}
        self.codes = [np.array([self.place[w] for w in own], np.int32) for _, own in self.words]
        self.kind = np.int16 if len(self.place) <= np.iinfo(np.int16).max else np.int32  # of places that are written
        self.idf = self.basis = self.latent = None

    def codes_of(self, text: str | None) -> np.ndarray:
        """Each word's place in the index, or -1."""
        words = words_of(text)
        return np.fromiter(map(self.place.get, words, repeat(-1)), np.int32, len(words))

    def short_in(self, text: str | None) -> list[int | None]:
        """Items of fewer than ``MIN_WORDS`` words that are a whole line."""
        return list({item: None for line in (text or "").split("\n") for item in self.short.get(tuple(words_of(line)), ())}) if self.short else []


def passages(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows; the last one ends with the text."""
    return np.arange(0, max(1, len(codes) - WINDOW + STRIDE), STRIDE)


def distinct_words(codes: np.ndarray) -> np.ndarray:
    """The distinct known words of every passage, on end."""
    n, last = len(passages(codes)), WINDOW // STRIDE
    parts = np.full((n + last - 1) * STRIDE, -1, np.int32)
    parts[: len(codes)] = codes
    parts = parts.reshape(-1, STRIDE)
    rows = np.sort(np.concatenate([parts[k : k + n] for k in range(last)], axis=1), axis=1)
    first = rows >= 0
    first[:, 1:] &= rows[:, 1:] != rows[:, :-1]
    return rows[first]


def encoded(docs: DataFrame, index: Index, id_col: str, text_col: str) -> tuple[np.ndarray, int, DataFrame]:
    """For each word of the index, the passages of the whole corpus that hold it; the number of all passages; and every document.

    Documents (``id, codes, short``: the places of the words as integers of the index's kind, and the short items found) are left
    out only if they hold no word of the index and no short item.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(index)
    size = len(index.place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, counts, total = shipped.value, np.zeros(size + 1, np.int64), 0
        names, kind = ["id", "codes", "short", "word", "n"], pa.null()
        for batch in batches:
            kind = batch.schema.field(0).type
            at, kept, short, words, held = [], [], [], [], 0
            for row, value in enumerate(batch.column(1)):
                text = value.as_py()
                codes = index.codes_of(text)
                if len(codes):
                    words.append(distinct_words(codes))
                    held += len(words[-1])
                    total += len(passages(codes))
                    found = index.short_in(text)
                    if found or len(words[-1]):
                        at.append(row)
                        kept.append(codes.astype(index.kind).tobytes())
                        short.append(found)
                if held > 1 << 18:
                    counts += np.bincount(np.concatenate(words), minlength=size + 1)
                    words, held = [], 0
            if words:
                counts += np.bincount(np.concatenate(words), minlength=size + 1)
            none = pa.nulls(len(at), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(kept, pa.binary()), pa.array(short, pa.list_(pa.int64())), none, none], names=names)
        counts[size] = total
        at = np.flatnonzero(counts)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(at), kind), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.list_(pa.int64())), pa.array(at), pa.array(counts[at])], names=names)

    id_type = docs.schema[id_col].dataType.simpleString()
    made = materialize(docs.select(id_col, text_col).mapInArrow(run, f"id {id_type}, codes binary, short array<bigint>, word bigint, n bigint"), "passages")
    out = np.zeros(size + 1, np.int64)
    for r in made.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r["word"]] = r["n"]
    return out[:size], int(out[size]), made.where("codes is not null").select("id", "codes", "short")


def tfidf(codes: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and weights of a passage's known words, of length one."""
    place, n = np.unique(codes[codes >= 0], return_counts=True)
    weight = (1 + np.log(n)) * idf[place]
    return place, weight / (np.linalg.norm(weight) or 1.0)


def weighted(codes: np.ndarray, n: int, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct known words of these, and their TF-IDF weights in each of the first n passages."""
    at = np.flatnonzero(codes >= 0)
    own, held, column = codes[at], np.zeros(len(idf), bool), np.empty(len(idf), np.int64)
    held[own] = True
    words = np.flatnonzero(held)
    column[words] = np.arange(len(words))
    # Counts of stretches of STRIDE words; a passage is WINDOW // STRIDE of them.
    last = WINDOW // STRIDE
    parts = np.bincount(at // STRIDE * len(words) + column[own], minlength=(n + last - 1) * len(words)).reshape(n + last - 1, len(words))
    counts = sum(parts[k : k + n] for k in range(last))
    return words, LOGS[counts] * idf[words]


def randomised_svd(rows: DataFrame, idf: np.ndarray, kind: type, rank: int = RANK) -> np.ndarray:
    """An orthonormal basis (words x dimensions) of the latent space of all passages of ``codes`` rows, which hold integers of this kind.

    The tasks hold the TF-IDF rows A; a step sends a thin matrix G and sums the tasks' A'(A G), by word and in the order of
    the tasks. The last product orders its own range by singular value (Nystrom's method), so it takes no further pass.
    """
    sc, size = rows.sparkSession.sparkContext, len(idf)
    width = min(rank + SPARE, size)
    known = sc.broadcast(idf)
    tasks = max(STEP_TASKS, 2 * sc.defaultParallelism)
    dealt = rows.coalesce(tasks)

    def gram(g: np.ndarray) -> np.ndarray:
        sent = sc.broadcast(g)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, g = known.value, sent.value
            out = np.zeros_like(g)
            for batch in batches:
                for value in batch.column(0):
                    codes = np.frombuffer(value.as_buffer(), kind)
                    starts = passages(codes)
                    for k in range(0, len(starts), PASSAGES):
                        block = starts[k : k + PASSAGES]
                        words, weights = weighted(codes[block[0] : block[-1] + WINDOW], len(block), idf)
                        weights /= np.maximum(1e-300, np.sqrt(np.einsum("ij,ij->i", weights, weights)))[:, None]
                        out[words] += weights.T @ (weights @ g.take(words, axis=0))
            used = np.flatnonzero(out.any(axis=1))
            part = pa.array(np.full(len(used), TaskContext.get().partitionId()))
            yield pa.RecordBatch.from_arrays([pa.array(used), part, pa.array(list(out[used]), pa.list_(pa.float64()))], names=["word", "part", "row"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out: dict[int, np.ndarray] = {}
            for batch in batches:
                for word, row in zip(batch.column(0).to_pylist(), batch.column(2).flatten().to_numpy().reshape(-1, width), strict=True):
                    out[word] = out[word] + row if word in out else row.copy()
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64()), pa.array(list(out.values()), pa.list_(pa.float64()))], names=["word", "row"])

        parts = dealt.mapInArrow(run, "word bigint, part bigint, row array<double>")
        total = np.zeros_like(g)
        for r in parts.repartition(8, "word").sortWithinPartitions("word", "part").mapInArrow(add, "word bigint, row array<double>").collect():  # words of the block at most
            total[r["word"]] = r["row"]
        sent.unpersist()
        return total

    q = np.random.default_rng(3).normal(size=(size, width))
    for _ in range(STEPS - 1):
        q, _ = np.linalg.qr(gram(q))
    q, _ = np.linalg.qr(q)
    y = gram(q)
    core = q.T @ y
    values, turn = np.linalg.eigh((core + core.T) / 2)
    some = values > max(1e-12 * values.max(), 1e-300)
    if not some.any():  # every passage holds every word, which then weighs nothing
        return q[:, :rank]
    return np.linalg.svd(y @ (turn[:, some] / np.sqrt(values[some])), full_matrices=False)[0][:, :rank]


def common(a: list[int], b: list[int]) -> tuple[int, int]:
    """Length of the longest common subsequence of a and b, and of the part of it in a's last ``ANSWER_WORDS`` words.

    Rows of the table are kept as sets of places (bits of an integer), so a step costs len(b) / 64 operations.
    """
    where: dict[int, int] = {}
    for k, x in enumerate(b):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(b)) - 1

    def length(part: list[int]) -> int:
        v = full
        for x in part:
            u = v & where.get(x, 0)
            v = ((v + u) | (v - u)) & full
        return len(b) - v.bit_count()

    return length(a), length(a[-ANSWER_WORDS:])


def fold(codes: np.ndarray, n: int, index: Index) -> np.ndarray:
    """The first n passages of these words in the latent space, as rows of length one, or of zeros if no word is known."""
    words, weights = weighted(codes, n, index.idf)
    vectors = weights @ index.basis[words]
    return vectors / np.maximum(1e-9 * np.maximum(1e-9, np.linalg.norm(weights, axis=1)), np.linalg.norm(vectors, axis=1))[:, None]


class Searcher:
    def __init__(self, index: Index):
        self.x = index
        self.own = [c.tolist() for c in index.codes]
        self.n = len(self.own)
        self.sizes = np.array([len(c) for c in index.codes], np.int64)
        self.longest = int(self.sizes.max(initial=0))
        self.all = self.listed(np.arange(self.n))
        self.seen = np.zeros(len(index.place), np.int32)
        self.column = np.full(len(index.place) + 1, -1, np.int64)  # the last one is for unknown words

    def listed(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words of these items on end, where each item starts, and its words' number."""
        sizes = self.sizes[items]
        return np.concatenate([self.x.codes[k] for k in items.tolist()] or [np.zeros(0, np.int64)]), np.cumsum(sizes) - sizes, sizes

    def coverable(self, codes: np.ndarray) -> np.ndarray:
        """Items of which enough words occur among these for a cover of ``COVER``; no common subsequence is longer."""
        words, starts, sizes = self.all
        self.seen[codes] = 1
        held = np.add.reduceat(self.seen.take(words), starts)
        self.seen[codes] = 0
        return np.flatnonzero(held / sizes >= COVER)

    def coverable_around(self, codes: np.ndarray, at: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The same for each of the passages (of following starts) and items, of the words around the passage.

        A subsequence is looked for within the item's length from the passage; here that is the longest of them, in stretches.
        """
        words, starts, sizes = self.listed(near)
        reach, n = -(-int(sizes.max()) // STRIDE), len(at)
        known = np.zeros(len(self.seen), bool)
        known[words] = True
        distinct = np.flatnonzero(known)
        self.column[distinct] = np.arange(len(distinct))
        first = int(at[0]) // STRIDE - reach  # stretch of the table's first row; may be before the text
        columns, wanted = self.column[codes[max(0, first * STRIDE) : int(at[-1]) + WINDOW + reach * STRIDE]], self.column[words]
        self.column[distinct] = -1
        place = np.flatnonzero(columns >= 0)
        across = 2 * reach + WINDOW // STRIDE
        held = np.zeros((n + across, len(distinct)), np.int32)
        held[place // STRIDE + max(0, -first) + 1, columns[place]] = 1
        np.cumsum(held, axis=0, out=held)  # stretches before each row's that hold the word
        inside = (held[across:] > held[:n]).take(wanted, axis=1)
        return np.add.reduceat(inside.view(np.int8), starts, axis=1, dtype=np.int32) / sizes >= COVER

    def candidates(self, codes: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """Start of a passage, item and cosine, of every passage and item with a cosine of ``COSINE`` and a chance of the cover.

        Passages are folded and multiplied with the items in blocks of ``PASSAGES``.
        """
        x, starts = self.x, passages(codes)
        for k in range(0, len(starts), PASSAGES):
            block = starts[k : k + PASSAGES]
            around = codes[max(0, block[0] - self.longest) : block[-1] + WINDOW + self.longest]
            near = self.coverable(around[around >= 0])
            if not len(near):
                continue
            likely = self.coverable_around(codes, block, near)
            rows = np.flatnonzero(likely.any(axis=1))
            if not len(rows):
                continue
            block, likely = block[rows[0] : rows[-1] + 1], likely[rows[0] : rows[-1] + 1]
            cosines = fold(codes[block[0] : block[-1] + WINDOW], len(block), x) @ x.latent[near].T
            for row, c in np.argwhere(likely & (cosines >= COSINE)).tolist():
                yield int(block[row]), int(near[c]), float(cosines[row, c])

    def leaks(self, text: str | None) -> list[tuple[int | None, float, float, float]]:
        """Item, cosine, cover and cover of the answer of each leaked item; of an item of several texts, the best of them."""
        return self.leaks_of(self.x.codes_of(text), self.x.short_in(text))

    def leaks_of(self, codes: np.ndarray, whole: list[int | None]) -> list[tuple[int | None, float, float, float]]:
        """The same, of a document's words and of the short items that it holds."""
        x = self.x
        if not self.n or not (codes >= 0).any():
            return [(item, 1.0, 1.0, 1.0) for item in whole]
        found: dict[int, tuple[float, float, float]] = {}
        for at, item, cosine in self.candidates(codes):
            own = self.own[item]
            both, answer = common(own, codes[max(0, at - len(own)) : at + WINDOW + len(own)].tolist())
            cover, last = both / len(own), answer / min(ANSWER_WORDS, len(own))
            old = found.get(item)
            if (cover >= FULL_COVER or cover >= COVER and last >= ANSWER_COVER) and (old is None or (cover, cosine) > (old[1], old[0])):
                found[item] = (cosine, cover, last)
        best: dict[int | None, tuple[float, float, float]] = dict.fromkeys(whole, (1.0, 1.0, 1.0))
        for k, v in sorted(found.items()):
            item = x.words[k][0]
            if item not in best or (v[1], v[0]) > (best[item][1], best[item][0]):
                best[item] = v
        return [(item, *v) for item, v in best.items()]


def build_index(docs: DataFrame, items: list[tuple[int | None, str | None]], text_col: str) -> Index:
    return index_and_rows(docs.select(F.lit(None).cast("bigint").alias("id"), text_col), items, "id", text_col)[0]


def index_and_rows(docs: DataFrame, items: list[tuple[int | None, str | None]], id_col: str, text_col: str) -> tuple[Index, DataFrame]:
    """The index of these items, fitted on the whole corpus, and the corpus's documents as ``encoded`` gives them."""
    spark, index = docs.sparkSession, Index(items)
    counts, total, rows = encoded(docs, index, id_col, text_col)
    index.idf = np.log((total + 1.0) / (counts + 1.0)) ** 2  # squared: common words hardly count
    if len(index.codes):
        of_items = spark.createDataFrame(pa.table({"codes": pa.array([c.astype(index.kind).tobytes() for c in index.codes], pa.binary())}))
        index.basis = randomised_svd(rows.select("codes").union(of_items), index.idf, index.kind)
        latent = []
        for codes in index.codes:
            at, value = tfidf(codes, index.idf)
            latent.append(value @ index.basis[at])
        index.latent = np.array(latent)
        index.latent /= np.maximum(1e-9, np.linalg.norm(index.latent, axis=1))[:, None]
    return index, rows


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """``id_col, item_id, cosine, cover, answer_cover``: a row for each leaked item of each document, whole texts searched.

    The benchmark is read in blocks of ``ITEMS_PER_BLOCK`` items, each of which the driver and a task can hold.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType.simpleString()
    bench = benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(bench_text_col).alias("text")).where("text is not null").distinct()
    blocks = max(1, -(-bench.count() // ITEMS_PER_BLOCK))
    out = None
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k) if blocks > 1 else bench
        index, rows = index_and_rows(docs, [tuple(r) for r in part.orderBy("item", "text").collect()], id_col, text_col)
        shipped = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shipped.value)
            for batch in batches:
                docs = zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True)
                rows = [(who, *leak) for who, codes, short in docs for leak in searcher.leaks_of(np.frombuffer(codes.as_buffer(), searcher.x.kind), short)]
                types = [batch.schema.field(0).type, pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=[id_col, "item_id", "cosine", "cover", "answer_cover"])

        found = rows.mapInArrow(run, f"`{id_col}` {id_type}, item_id bigint, cosine double, cover double, answer_cover double")
        out = found if out is None else out.unionByName(found)
    return out
