"""Quality by a sparse ensemble of rules.

Statistics of each whole text (character classes, words, lines, repeats) come from one pass. Small boosted trees over a
bounded labelled sample give paths; each path is a rule, a conjunction of thresholds. A lasso fits logistic weights to the
rules, and the few that keep a weight are compiled into one Spark column expression.

Cases: null and empty texts have all statistics zero and get the score of such a text; repeated rows give repeated results;
several labels of one id count as good if any is; null labels are not learnt from; without labels, with one class only, or with
too few rows for a split, every score is the share of good labels (0.5 without any).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.common import no_clash, sampled

#: The statistics, in the order in which :func:`statistics` gives them.
NAMES = (
    "chars words lines word_length line_length symbol_share odd_symbol_share mark_share exclaim_share pipe_share upper_share digit_share letter_share space_share wide_share "
    "distinct_words top_word pair_repeats repeated_lines odd_ends short_lines spare_words upper_words"
).split()
#: Documents of each class in the labelled sample (chosen by hashed id; about so many).
DOCS_PER_CLASS = 3000
TREES, DEPTH, BINS, RATE = 80, 3, 32, 0.15
#: Lasso penalty, and rules that may keep a weight.
PENALTY = 2e-4
MAX_RULES = 120

ODD = re.compile(rb"[#$%&*@^~=<>|\\{}_+]+[.,]?$")


def _class(members: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(members, np.uint8)] = True
    return out


PUNCT = _class(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
ODD_BYTES = _class(b"#$%&*@^~=<>|\\{}_+")
MARKS = _class(b".,;:?")
UPPER, LOWER, DIGIT = _class(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class(b"abcdefghijklmnopqrstuvwxyz"), _class(b"0123456789")
SPACE = _class(b" \t\n\x0b\x0c\r")


def statistics(raw: bytes) -> list[float]:
    if not raw:
        return [0.0] * len(NAMES)
    seen = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    wide = int(seen[0xC0:].sum())  # first bytes of code points beyond ASCII
    chars = int(seen[:128].sum()) + wide
    words, lines = raw.split(), raw.split(b"\n")
    n = max(1, len(words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:], strict=False)))
    upper, lower = int(seen[UPPER].sum()), int(seen[LOWER].sum())
    full = [x for x in lines if x.strip()]
    part = lambda of: float(seen[of].sum()) / chars
    odd = sum(k for w, k in counts.items() if ODD.search(w))
    shouted = sum(k for w, k in counts.items() if w.isupper() and len(w) > 1)
    return [
        float(chars), float(len(words)), float(len(lines)), (chars - float(seen[SPACE].sum())) / n, chars / len(lines),
        part(PUNCT), part(ODD_BYTES), part(MARKS), float(seen[33]) / chars, float(seen[124]) / chars,
        upper / max(1, upper + lower), part(DIGIT), (upper + lower + wide) / chars, part(SPACE), wide / chars,
        len(counts) / n, max(counts.values(), default=0) / n, 1.0 - pairs / max(1, len(words) - 1) if len(words) > 1 else 0.0, 1.0 - len(set(full)) / max(1, len(full)), odd / n,
        sum(len(x) < 30 for x in full) / max(1, len(full)), sum(k for w, k in counts.items() if len(w) <= 1) / n, shouted / n,
    ]


def with_statistics(docs: DataFrame, lead: list[str], text_col: str) -> DataFrame:
    """The columns ``lead`` and ``__<statistic>`` for every statistic."""
    fields = [f"__{n}" for n in NAMES]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in lead), *(f"{n} double" for n in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column(len(lead))]
            table = np.array(rows, np.float64).reshape(len(rows), len(NAMES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(lead)], *(pa.array(table[:, k]) for k in range(len(NAMES)))], names=[*lead, *fields])

    return docs.select(*lead, F.col(text_col).alias("__text")).mapInArrow(run, schema)


#: A rule: (statistic, is it above, threshold), all of which hold.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, gradient: np.ndarray, rows: np.ndarray, cuts: list[np.ndarray], features: np.ndarray, depth: int, path: Rule) -> list[tuple[Rule, np.ndarray]]:
    """All paths of one regression tree on the gradient, inner ones too, with their rows."""
    found = [(path, rows)] if path else []
    if not depth or len(rows) < 20:
        return found
    g, total, best = gradient[rows], gradient[rows].sum(), (1e-6, -1, 0.0)
    for f in features:
        if not len(cuts[f]):
            continue
        at = np.searchsorted(cuts[f], x[rows, f], side="left")  # the cut that is at or above the value
        n = np.cumsum(np.bincount(at, minlength=len(cuts[f]) + 1))[:-1]
        s = np.cumsum(np.bincount(at, weights=g, minlength=len(cuts[f]) + 1))[:-1]
        fit = (n >= 5) & (len(rows) - n >= 5)
        gain = np.where(fit, s**2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1) - total**2 / len(rows), 0)
        if gain.max() > best[0]:
            best = (float(gain.max()), int(f), float(cuts[f][int(gain.argmax())]))
    if best[1] < 0:
        return found
    _, f, cut = best
    above = x[rows, f] > cut
    return found + grow(x, gradient, rows[~above], cuts, features, depth - 1, (*path, (f, False, cut))) + grow(x, gradient, rows[above], cuts, features, depth - 1, (*path, (f, True, cut)))


def tree_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    rng = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[(c < x[:, f].max())] for f, c in enumerate(cuts)]
    margin, rules = np.zeros(len(y)), {}
    for _ in range(TREES):
        error = y - 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        features = rng.permutation(x.shape[1])[: max(4, x.shape[1] // 2)]
        for rule, own in grow(x, error, rows, cuts, features, DEPTH, ()):
            rules.setdefault(tuple(sorted(rule)), None)
            if len(rule) == DEPTH:
                here = holds(rule, x)
                margin += RATE * here * (error[own].mean() / max(0.02, (np.abs(error[own]) * (1 - np.abs(error[own]))).mean()))
        margin = np.clip(margin, -8, 8)
    return list(rules)


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, above, cut in rule:
        out &= (x[:, f] > cut) == above
    return out


def lasso(r: np.ndarray, y: np.ndarray, penalty: float = PENALTY, rounds: int = 600) -> tuple[np.ndarray, float]:
    """Logistic lasso by accelerated proximal steps; the classes weigh the same."""
    n, m = r.shape
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w, b = np.zeros(m), 0.0
    v, c = w.copy(), b
    step = 4.0 / (np.linalg.norm(r * np.sqrt(weight)[:, None], 2) ** 2 + 1)
    for k in range(rounds):
        error = weight * (1 / (1 + np.exp(-np.clip(r @ v + c, -40, 40))) - y)
        new = v - step * (r.T @ error)
        new = np.sign(new) * np.maximum(0, np.abs(new) - step * penalty)
        new_b = c - step * error.sum()
        pull = k / (k + 3)
        v, c, w, b = new + pull * (new - w), new_b + pull * (new_b - b), new, new_b
    return w, b


class Model:
    """Rules with their weights."""

    def __init__(self, rules: list[Rule], weights: list[float], bias: float):
        self.rules, self.weights, self.bias = rules, weights, bias

    def column(self) -> Column:
        """The score as a Spark expression over the statistics."""
        z = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            met = F.lit(True)
            for f, above, cut in rule:
                c = F.col(f"__{NAMES[f]}")
                met = met & ((c > F.lit(cut)) if above else (c <= F.lit(cut)))
            z = z + F.when(met, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def train_on(x: np.ndarray, y: np.ndarray) -> Model:
    rules = tree_rules(x, y) if len(set(y.tolist())) == 2 else []
    if not rules:
        share = float(y.mean()) if len(y) else 0.5
        return Model([], [], float(np.log((share + 1e-3) / (1 - share + 1e-3))))
    r = np.array([holds(k, x) for k in rules], np.float64).T
    w, b = lasso(r, y)
    kept = [k for k in np.argsort(-np.abs(w))[:MAX_RULES] if abs(w[k]) > 1e-3]
    if not kept:
        return Model([], [], float(b))
    w, b = lasso(r[:, kept], y, PENALTY / 4)
    return Model([rules[k] for k in kept], [float(v) for v in w], float(b))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", docs_per_class: int = DOCS_PER_CLASS) -> Model:
    """Fit on about ``docs_per_class`` labelled documents of each class."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rate = F.lit(0.0)
    for label, n in sizes.items():
        rate = F.when(F.col("label") == label, F.lit(min(1.0, docs_per_class / n))).otherwise(rate)
    chosen = F.broadcast(sampled(known, "id", rate))  # about two times docs_per_class rows
    rows = with_statistics(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id"), ["label"], "text").toPandas()
    return train_on(rows[[f"__{n}" for n in NAMES]].to_numpy(np.float64), (rows["label"] > 0).to_numpy(np.int64))


def score(docs: DataFrame, model: Model, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col, score, predicted`` for every row's whole text, with the columns named in ``keep`` after the id."""
    lead = list(dict.fromkeys([id_col, *keep]))
    no_clash(lead, "score", "predicted")
    scored = with_statistics(docs, lead, text_col).select(*lead, model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
