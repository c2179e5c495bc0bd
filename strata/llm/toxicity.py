"""Toxicity by weak supervision.

Many voters look at a document: a short lexicon, patterns, and words and word beginnings. The latter are suggested by the
labelled sample and, as the seeds' own votes on documents without a label suggest further ones, by the unlabelled sample.
A generative label model explains the votes on both samples: class balance, each voter's rate of firing in either class, and
the correlations of voters within a class, all by expectation maximisation. Labels only anchor it: a labelled row counts
with its label where rates are estimated, and its posterior is what the votes say. Voters that go together in a class share
their weight (an observation's worth is divided by the sum of its correlations). A linear classifier over voter counts is
trained on the posteriors of all rows of both samples, and scores whole texts.

``train`` fits on two bounded samples, which the driver holds. ``train_on_all`` fits on every document: each counts with its
label, where it has one, and once more as a document whose label isn't looked at. Its rows are the distinct combinations of
firings, which stay in a table: each round of the label model, and each Newton step of the classifier, is a pass that sends
sums of the voters' number squared at most.

Cases: null and empty texts get the score of a text without any firing; very long texts are scored whole; repeated rows give
repeated results; several labels of one id count as toxic if any is; null labels, null ids and unlabelled rows give no label;
without labels the label model rests on the votes alone, without documents only the lexicon and the patterns vote; columns
to be kept that have an output's name are refused.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import zip_longest

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import materialize, no_clash, sampled

WORD = regex.compile(r"[\p{L}\p{M}]+")
#: Insults that vote from the start.
LEXICON = ("idiot", "moron", "scum", "trash", "clown", "loser", "stupid", "pathetic", "worthless", "disgusting", "imbecile", "filthy", "hateful", "vermin")
#: Patterns that vote. An insult addressed to the reader, a shouted insult, a wish of harm.
PATTERNS = (
    rf"(?i)\byou(?:'re| are)?\s+(?:an?\s+)?(?:{'|'.join(LEXICON)})\b",
    rf"\b(?:{'|'.join(w.upper() for w in LEXICON)})\b",
    r"(?i)\b(?:kill\s+yourself|go\s+die|drop\s+dead|shut\s+up)\b",
)
#: Words of which a match of a pattern has one (of the first two), or both of a pair (of the third).
MUST_HOLD = frozenset(LEXICON)
MUST_HOLD_BOTH = (("kill", "yourself"), ("go", "die"), ("drop", "dead"), ("shut", "up"))
#: Documents of each class in the labelled sample, and documents in the unlabelled one (chosen by hashed id; about so many).
DOCS_PER_CLASS, DOCS_UNLABELLED = 3000, 4000
#: Voters kept of those that either sample suggests, the documents they need, and the share of them that is toxic.
MAX_VOTERS = 400
MIN_SUPPORT = 3
MIN_PRECISION = 0.9
#: Lengths of word beginnings that may vote.
BEGINNINGS = range(3, 8)
#: Labels up to which they go to every executor (12 bytes each); with more, the texts are shuffled to them. Tasks of a pass over firings.
MAX_SHIPPED, STEP_TASKS = 500_000, 8
#: Correlation within a class from which on voters share their weight.
TIED = 0.6
#: Share of toxic documents that is assumed where no label says it.
BALANCE = 0.1
MEMORY = 150_000
#: Values of the label column that are told apart; all above 0 are toxic.
MAX_CLASSES = 100


def pieces(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    return [f"={word}", *(word[:n] for n in BEGINNINGS if n <= len(word))]


class Votes:
    """Which voters fire on a text, and how often."""

    def __init__(self, voters: list[str]):
        self.voters = voters
        self.place = {v: k for k, v in enumerate(voters)}
        self.patterns = [regex.compile(p) for p in PATTERNS]
        self.firing: dict[str, tuple[int, ...]] = {}

    def __len__(self) -> int:
        return len(self.voters) + len(self.patterns)

    def counts(self, text: str | None) -> dict[int, int]:
        """Voter to number of firings; also the number of words at -1."""
        return self.counts_of(Counter(WORD.findall((text or "").lower())), text)

    def counts_of(self, words: Counter, text: str | None) -> dict[int, int]:
        """The same, of a text whose words are counted already."""
        out: Counter = Counter()
        for word, k in words.items():
            fires = self.firing.get(word)
            if fires is None:
                if len(self.firing) >= MEMORY:
                    self.firing.clear()
                fires = self.firing[word] = tuple(self.place[p] for p in pieces(word) if p in self.place)
            for v in fires:
                out[v] += k
        # A text without the words of which a match must consist has none.
        may = not MUST_HOLD.isdisjoint(words), any(a in words and b in words for a, b in MUST_HOLD_BOTH)
        for k, p in enumerate(self.patterns):
            if may[k == 2] and (n := len(p.findall(text))):
                out[len(self.voters) + k] = n
        out[-1] = sum(words.values())
        return dict(out)


def firings(rows: DataFrame, voters: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row ids, labels and the firings (rows x voters, as features) of a sample with ``row, label, text``."""
    shipped = rows.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes = Votes(shipped.value)
        for batch in batches:
            found = [votes.counts(t.as_py()) for t in batch.column(2)]
            at = [[v for v in f if v >= 0] for f in found]
            times = [[f[v] for v in own] for f, own in zip(found, at, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], names=["row", "label", "at", "times"])

    got = rows.select("row", "label", "text").mapInArrow(run, "row bigint, label int, at array<int>, times array<int>").orderBy("row").collect()  # a bounded sample
    x = np.zeros((len(got), len(Votes(voters))))
    for k, r in enumerate(got):
        for v, n in zip(r["at"], r["times"], strict=True):
            x[k, v] = feature(n)
    return np.array([r["row"] for r in got], np.int64), np.array([r["label"] for r in got], np.int64), x


def suggest(rows: DataFrame, believed: set[int], sizes: dict[int, int]) -> list[str]:
    """Voters that the sample suggests: pieces that hardly occur outside toxic documents, the best first.

    Labelled rows compare the classes' rates, as they are about as many of either. Rows without a label are toxic if
    ``believed`` holds them; a piece's rows themselves must be so. ``sizes`` has the labelled rows by label.
    """
    shipped = rows.sparkSession.sparkContext.broadcast(believed)
    kinds = ("named1", "named0", "open1", "open0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in kinds]

        def flush() -> pa.RecordBatch:
            every = list(set().union(*seen))
            out = pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *(pa.array([c[p] for p in every], pa.int64()) for c in seen)], names=["piece", *kinds])
            for c in seen:
                c.clear()
            return out

        for batch in batches:
            for row, label, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                kind = (0 if label else 1) if label >= 0 else (2 if row in shipped.value else 3)
                seen[kind].update({p for w in set(WORD.findall((text or "").lower())) for p in pieces(w)})
            if sum(map(len, seen)) > MEMORY:
                yield flush()
        yield flush()

    counted = rows.select("row", "label", "text").mapInArrow(run, "piece string, " + ", ".join(f"{k} bigint" for k in kinds))
    return best_pieces(counted, sizes, MIN_SUPPORT, 2 * MIN_SUPPORT)


def best_pieces(counted: DataFrame, sizes: dict[int, int], named_support: int, open_support: int) -> list[str]:
    """The voters that counts of ``piece, named1, named0, open1, open0`` suggest, with this support at least."""
    summed = counted.groupBy("piece").agg(*(F.sum(k).alias(k) for k in counted.columns[1:])).where(f"named1 >= {named_support} or open1 >= {open_support}")
    n1, n0 = max(1, sizes.get(1, 0)), max(1, sizes.get(0, 0))
    ranked: tuple[list, list] = ([], [])
    for r in summed.toLocalIterator():  # pieces of a share of the toxic rows at least
        rate1, rate0 = (r["named1"] + 0.1) / n1, (r["named0"] + 0.1) / n0
        if r["named1"] >= named_support and rate1 / (rate1 + rate0) >= MIN_PRECISION:
            ranked[0].append((-rate1 * np.log(rate1 / rate0), len(r["piece"]), r["piece"]))
        if r["open1"] >= open_support and r["open1"] >= MIN_PRECISION * (r["open1"] + r["open0"]):
            ranked[1].append((-r["open1"], len(r["piece"]), r["piece"]))
    # Both samples' voters in turn.
    return list(dict.fromkeys(p[2] for pair in zip_longest(*map(sorted, ranked)) for p in pair if p is not None))[:MAX_VOTERS]


def within_class(x: np.ndarray, weight: np.ndarray, rate: np.ndarray) -> np.ndarray:
    """Correlations of the voters in one class, rows weighing as they belong to it; near 0 for those that hardly fire in it."""
    e = ((x - rate) * np.sqrt(weight)[:, None]).astype(np.float32)
    return correlations(e.T @ e)


def correlations(cov: np.ndarray) -> np.ndarray:
    spread = np.sqrt(np.diag(cov) + 2.0)
    return cov / np.outer(spread, spread)


def label_model(fired: np.ndarray, known: np.ndarray, rounds: int = 40, balance: float = BALANCE) -> tuple[np.ndarray, np.ndarray]:
    """The posterior of each row being toxic by the votes alone, and each voter's share of a vote.

    ``fired`` is rows x voters, ``known`` holds 1, 0 or -1 (no label). A label fixes how its row counts in the estimates of
    rates and correlations, never the row's own posterior. The class balance is that of the rows without a label.
    """
    n, m = fired.shape
    if not n or not m:
        return np.where(known == 1, 1.0, 0.0), np.ones(m)
    x = fired.astype(np.float64)
    open_rows = known < 0
    prior, share = balance, np.ones(m)
    post = np.where(x.any(axis=1), 0.7, 0.05)
    for step in range(rounds):
        counts = np.where(open_rows, post, known)
        rate1 = np.clip((counts @ x + 0.2) / (counts.sum() + 1), 1e-4, 0.999)
        rate0 = np.clip(((1 - counts) @ x + 0.02) / ((1 - counts).sum() + 1), 1e-5, 0.999)
        if step % 5 == 1:
            ties = np.maximum(within_class(x, counts, rate1), within_class(x, 1 - counts, rate0))
            np.fill_diagonal(ties, 1.0)
            share = 1.0 / np.where(ties > TIED, ties, 0.0).sum(axis=1)
        if open_rows.any():
            prior = float(np.clip(post[open_rows].mean(), 0.01, 0.9))
        odds = np.log(prior / (1 - prior)) + x @ (share * np.log(rate1 / rate0)) + (1 - x) @ (share * np.log((1 - rate1) / (1 - rate0)))
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if step > 10 and np.abs(new - post).max() < 1e-4:
            post = new
            break
        post = new
    return post, share


def fit_linear(x: np.ndarray, target: np.ndarray, l2: float = 1e-4, rounds: int = 1500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps; weights of firings don't go below zero.

    Rows without any firing are alike, so they count as one row of their number and mean target.
    """
    n, m = x.shape
    still = ~x.any(axis=1)
    size = np.ones(n)
    if still.any():
        x, target, size = np.vstack([x[~still], np.zeros((1, m))]), np.append(target[~still], target[still].mean()), np.append(size[~still], still.sum())
    size = size / size.sum()
    w, b = np.zeros(m), 0.0
    v, c = w.copy(), b
    step = 1.0 / (0.25 * (np.linalg.norm(x * np.sqrt(size)[:, None], 2) ** 2 + 1) + l2)
    for k in range(rounds):
        error = size * (1 / (1 + np.exp(-(x @ v + c))) - target)
        new_w, new_b = np.maximum(0, v - step * (x.T @ error + l2 * v)), c - step * error.sum()
        pull = k / (k + 3)
        v, c, w, b = new_w + pull * (new_w - w), new_b + pull * (new_b - b), new_w, new_b
    return w, b


class Model:
    def __init__(self, votes: Votes, weights: np.ndarray, bias: float):
        self.votes, self.weights, self.bias = votes, weights, bias

    def score(self, text: str | None) -> float:
        found = self.votes.counts(text)
        found.pop(-1)
        z = self.bias + sum(self.weights[v] * feature(k) for v, k in found.items())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def feature(firings: int | np.ndarray) -> float | np.ndarray:
    return 1.0 + np.log(firings)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_class: int = DOCS_PER_CLASS, docs_unlabelled: int = DOCS_UNLABELLED) -> Model:
    """Fit on about ``docs_per_class`` labelled documents of each class and ``docs_unlabelled`` whose labels aren't looked at."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().limit(MAX_CLASSES).collect()}
    rate = F.lit(0.0)
    for label, n in sizes.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, docs_per_class / n))).otherwise(rate)
    chosen = sampled(known, "id", rate)
    small = chosen.count() <= 8 * docs_per_class  # about two times docs_per_class rows
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    named = texts.join(F.broadcast(chosen) if small else chosen, "id").select("text", "label")
    open_rate = min(1.0, docs_unlabelled / max(1, docs.count()))
    other = sampled(texts.where("id is not null"), "id", open_rate, "unlabelled").select("text", F.lit(-1).alias("label"))
    rows = materialize(named.union(other).withColumn("row", F.monotonically_increasing_id()), "voters")  # a bounded sample
    toxic = sum(n for label, n in sizes.items() if label > 0)
    return fit(rows.withColumn("label", F.least("label", F.lit(1))), float(np.clip(toxic / sum(sizes.values()), 0.01, 0.5)) if sizes else BALANCE)


def fit(rows: DataFrame, balance: float = BALANCE) -> Model:
    """The label model and the classifier from a sample of ``row, label, text``; a label is 1, 0 or -1 (none)."""
    seeds = [f"={w}" for w in LEXICON]
    ids, known, x = firings(rows, seeds)
    if not len(ids):
        votes = Votes(seeds)
        return Model(votes, np.full(len(votes), 4.0), -3.0)
    believed, _ = label_model(x > 0, np.full(len(ids), -1), balance=balance)
    more = suggest(rows, set(ids[believed > 0.5].tolist()), dict(zip(*map(np.ndarray.tolist, np.unique(known, return_counts=True)), strict=True)))
    votes = Votes(list(dict.fromkeys([*seeds, *more])))
    _, known, x = firings(rows, votes.voters)
    posterior, share = label_model(x > 0, known, balance=balance)
    # Voters that share a vote get equal parts of what it weighs.
    w, b = fit_linear(x * np.sqrt(share), posterior)
    return finished(votes, w * np.sqrt(share), b, ~x.any(axis=0))


def finished(votes: Votes, w: np.ndarray, b: float, silent: np.ndarray) -> Model:
    w[silent] = np.median(w[~silent & (w > 0)]) if (~silent & (w > 0)).any() else 4.0  # never seen in the rows: as the others
    return Model(votes, w, float(b))


def train_on_all(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on all documents and on all labels that these documents have."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    known = known.where("label >= 0").withColumn("label", F.least("label", F.lit(1)))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if known.count() <= MAX_SHIPPED:
        rows = texts.join(F.broadcast(known), "id", "left").select("label", "text")
    else:  # joined once, not by every pass; rows without an id would meet in one task
        named = texts.where("id is not null").join(known, "id", "left").select("label", "text")
        rows = materialize(named.union(texts.where("id is null").select(F.lit(None).cast("int"), "text")), "labelled")
    seeds = [f"={w}" for w in LEXICON]
    fired = firings_of_all(rows, seeds)
    sizes = {r["label"]: r["n"] for r in fired.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    if not sizes:
        votes = Votes(seeds)
        return Model(votes, np.full(len(votes), 4.0), -3.0)
    named = sizes.get(1, 0) + sizes.get(0, 0)
    balance = float(np.clip(sizes.get(1, 0) / named, 0.01, 0.5)) if named else BALANCE
    of_seeds = label_model_of_all(fired, len(Votes(seeds)), balance, named=False)[0]
    votes = Votes(list(dict.fromkeys([*seeds, *suggest_of_all(rows, seeds, of_seeds, sizes)])))
    fired = firings_of_all(rows, votes.voters)
    posterior, share, silent = label_model_of_all(fired, len(votes), balance)
    w, b = fit_linear_of_all(fired, posterior, share)
    return finished(votes, w * np.sqrt(share), b, silent)


def firings_of_all(rows: DataFrame, voters: list[str]) -> DataFrame:
    """``label, at, times, n``: how many rows have this label (or none) and these voters firing so often."""
    shipped = rows.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        votes, seen = Votes(shipped.value), Counter()

        def flush() -> pa.RecordBatch:
            label, at, times = zip(*seen, strict=True) if seen else ((), (), ())
            out = pa.RecordBatch.from_arrays([pa.array(label, pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32())), pa.array(list(seen.values()), pa.int64())], names=["label", "at", "times", "n"])
            seen.clear()
            return out

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = votes.counts(text.as_py())
                at = tuple(sorted(v for v in found if v >= 0))
                seen[label, at, tuple(found[v] for v in at)] += 1
                if len(seen) > MEMORY:
                    yield flush()
        yield flush()

    counted = rows.select("label", "text").mapInArrow(run, "label int, at array<int>, times array<int>, n bigint")
    return materialize(counted.groupBy("label", "at", "times").agg(F.sum("n").alias("n")), "firings")


def suggest_of_all(rows: DataFrame, seeds: list[str], of_seeds: tuple[float, np.ndarray], sizes: dict[int | None, int]) -> list[str]:
    """As ``suggest``, from all rows; what the seeds say of a row stands for its label. Support is the share that the samples need."""
    shipped = rows.sparkSession.sparkContext.broadcast((seeds, of_seeds))
    kinds = ("named1", "named0", "open1", "open0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, (base, weights) = shipped.value
        votes, places, of_word = Votes(voters), {}, {}
        held, counts, size = [[] for _ in kinds], np.zeros((len(kinds), 0), np.int64), 0

        def count() -> None:
            nonlocal counts, size
            counts = np.pad(counts, ((0, 0), (0, len(places) - counts.shape[1])))
            for k, own in enumerate(held):
                counts[k] += np.bincount(np.array(own, np.int64), minlength=len(places))
                own.clear()
            size = 0

        def flush() -> pa.RecordBatch:
            nonlocal counts
            count()
            out = pa.RecordBatch.from_arrays([pa.array(list(places), pa.string()), *map(pa.array, counts)], names=["piece", *kinds])
            places.clear()
            of_word.clear()
            counts = np.zeros((len(kinds), 0), np.int64)
            return out

        for batch in batches:
            for label, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = value.as_py()
                words = Counter(WORD.findall((text or "").lower()))
                found: set[int] = set()
                for w in words:
                    own = of_word.get(w)
                    if own is None:
                        own = of_word[w] = tuple(places.setdefault(p, len(places)) for p in pieces(w))
                    found.update(own)
                believed = base + sum(weights[v] for v in votes.counts_of(words, text) if v >= 0) > 0
                held[2 if believed else 3].extend(found)
                if label is not None:
                    held[0 if label else 1].extend(found)
                size += len(found)
                if size > 1 << 18:
                    count()
                    if len(places) > MEMORY:
                        yield flush()
        yield flush()

    counted = rows.select("label", "text").mapInArrow(run, "piece string, " + ", ".join(f"{k} bigint" for k in kinds))
    total = sum(sizes.values())
    return best_pieces(counted, sizes, max(MIN_SUPPORT, sizes.get(1, 0) * MIN_SUPPORT // DOCS_PER_CLASS), 2 * max(MIN_SUPPORT, total * MIN_SUPPORT // DOCS_UNLABELLED))


def summed(fired: DataFrame, width: int, work: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], list]) -> tuple[np.ndarray, float]:
    """What ``work`` finds in the rows (with a label of 1, with one of 0, all, features), all numbers on end: sums, but of the last the most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, most = None, 0.0
        for batch in batches:
            label, at, times, n = batch.columns
            label, n = label.fill_null(-1).to_numpy(), n.to_numpy().astype(np.float64)
            x = np.zeros((len(n), width))
            x[np.repeat(np.arange(len(n)), at.value_lengths().to_numpy()), at.flatten().to_numpy()] = feature(times.flatten().to_numpy())
            *sums, last = work(np.where(label == 1, n, 0), np.where(label == 0, n, 0), n, x)
            part = np.concatenate([np.ravel(v) for v in sums])
            total, most = part if total is None else total + part, max(most, float(last))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.append(total, most).tobytes()], pa.binary())], names=["sums"])

    parts = [np.frombuffer(r["sums"]) for r in fired.select("label", "at", "times", "n").coalesce(STEP_TASKS).mapInArrow(run, "sums binary").collect()]  # a row a task
    return sum(v[:-1] for v in parts), max(v[-1] for v in parts)


def told(x: np.ndarray, model: tuple[float, np.ndarray]) -> np.ndarray:
    """Posteriors by the votes, of features of their firings."""
    return 1 / (1 + np.exp(-np.clip(model[0] + (x > 0) @ model[1], -30, 30)))


def label_model_of_all(fired: DataFrame, m: int, balance: float, named: bool = True, rounds: int = 40) -> tuple[tuple[float, np.ndarray], np.ndarray, np.ndarray]:
    """As ``label_model``: the log odds of a row without votes and what each vote adds to them, the shares, and who never fires.

    Every row counts as one without a label, and with ``named`` those with a label once more with it.
    """
    model, last, prior, share = None, None, balance, np.ones(m)
    for step in range(rounds):
        tied = step % 5 == 1

        def work(ones: np.ndarray, zeros: np.ndarray, n: np.ndarray, x: np.ndarray, model=model, last=last, tied=tied) -> list:
            votes = (x > 0).astype(np.float64)
            post = told(x, model) if model else np.where(votes.any(axis=1), 0.7, 0.05)
            toxic, clean = n * post + named * ones, n * (1 - post) + named * zeros
            squares = [votes.T @ (toxic[:, None] * votes), votes.T @ (clean[:, None] * votes)] if tied else []
            return [toxic @ votes, clean @ votes, toxic.sum(), clean.sum(), n @ post, n.sum(), *squares, np.abs(post - told(x, last)).max(initial=0) if last else 1.0]

        sums, change = summed(fired, m, work)
        if step > 11 and change < 1e-4:
            break
        of1, of0, (n1, n0, post, n) = sums[:m], sums[m : 2 * m], sums[2 * m : 2 * m + 4]
        rate1 = np.clip((of1 + 0.2) / (n1 + 1), 1e-4, 0.999)
        rate0 = np.clip((of0 + 0.02) / (n0 + 1), 1e-5, 0.999)
        if tied:
            two = sums[2 * m + 4 :].reshape(2, m, m)
            ties = np.maximum(*(correlations(s - np.outer(v, r) - np.outer(r, v) + k * np.outer(r, r)) for s, v, r, k in zip(two, (of1, of0), (rate1, rate0), (n1, n0), strict=True)))
            np.fill_diagonal(ties, 1.0)
            share = 1.0 / np.where(ties > TIED, ties, 0.0).sum(axis=1)
        prior = float(np.clip(post / n, 0.01, 0.9))
        none = share * np.log((1 - rate1) / (1 - rate0))
        model, last = (float(np.log(prior / (1 - prior)) + none.sum()), share * np.log(rate1 / rate0) - none), model
    return model, share, of1 + of0 == 0


def fit_linear_of_all(fired: DataFrame, posterior: tuple[float, np.ndarray], share: np.ndarray, l2: float = 1e-4, rounds: int = 40) -> tuple[np.ndarray, float]:
    """As ``fit_linear``, to its minimum: Newton steps, each to the least of a quadratic under the same bounds."""
    m = len(share)
    penalty = np.append(np.full(m, l2), 0.0)

    def at(p: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        def work(ones: np.ndarray, zeros: np.ndarray, n: np.ndarray, x: np.ndarray) -> list:
            size, target = n + ones + zeros, told(x, posterior)
            x = np.hstack([x * np.sqrt(share), np.ones((len(n), 1))])
            z = x @ p
            guess = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
            return [size.sum(), size @ (np.logaddexp(0, z) - target * z), x.T @ (size * (guess - target)), x.T @ ((size * guess * (1 - guess))[:, None] * x), 0.0]

        sums, _ = summed(fired, m, work)
        sums = sums[1:] / sums[0]
        return float(sums[0] + penalty @ p**2 / 2), sums[1 : m + 2] + penalty * p, sums[m + 2 :].reshape(m + 1, m + 1) + np.diag(penalty + 1e-9)

    p = np.zeros(m + 1)
    loss, slope, bend = at(p)
    for _ in range(rounds):
        d, part = least_quadratic(p, slope, bend) - p, 1.0
        if np.abs(d).max() < 1e-6:
            break
        new = at(p + d)
        while new[0] > loss and part > 1e-3:
            part /= 2
            new = at(p + part * d)
        if new[0] > loss:
            break
        gain, p, (loss, slope, bend) = loss - new[0], p + part * d, new
        if gain < 1e-10:
            break
    return p[:m], float(p[m])


def least_quadratic(p: np.ndarray, slope: np.ndarray, bend: np.ndarray, rounds: int = 5000) -> np.ndarray:
    """Where ``slope`` and ``bend`` at p make the least, no number but the last being below zero; accelerated steps with restarts."""
    step = 1 / np.linalg.eigvalsh(bend)[-1]
    u, v, k = p, p, 0
    for _ in range(rounds):
        new = v - step * (slope + bend @ (v - p))
        new[:-1] = np.maximum(0, new[:-1])
        if np.abs(new - u).max() < 1e-9 and k:
            return new
        k = 0 if (v - new) @ (new - u) > 0 else k + 1
        u, v = new, new + k / (k + 3) * (new - u)
    return u


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, score, predicted`` for every row's whole text, with the columns named in ``keep`` after the id."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.votes.voters, model.weights, model.bias))
    lead = list(dict.fromkeys([id_col, *keep]))
    no_clash(lead, "score", "predicted")
    at = lead.index(text_col) if text_col in lead else len(lead)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in lead) + ", score double, predicted int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, weights, bias = shipped.value
        own = Model(Votes(voters), weights, bias)
        for batch in batches:
            found = [own.score(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(lead)], pa.array(found, pa.float64()), pa.array([int(f >= threshold) for f in found], pa.int32())], names=[*lead, "score", "predicted"])

    # A text that isn't kept comes last, under a name that no kept column has.
    return docs.select(*lead, *[F.col(text_col).alias("__text")] * (at == len(lead))).mapInArrow(run, schema)
