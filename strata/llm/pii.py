"""Personal data by candidate gradient boosting. The main path is built of SQL functions only.

Fixed formats (email, ip, card, phone) give the base spans. Generators of high recall propose further spans, also
overlapping ones: addresses written out, IPv6, cards with other separators, telephone numbers without a plus sign. Boosted
trees score a proposal by its format and the text around it; they are fitted on the driver on a third of labelled lines and
compiled into a column expression. A second third calibrates the scores (isotonic: pooled adjacent violators), and for each
kind the threshold is the least calibrated probability at which the last third reaches the wanted precision. Base spans
always stay. Of added ones that overlap the best scored is taken first, then each that overlaps none taken.

Spans of a text are put in order once and walked in blocks, so time grows in proportion to their number: spans that touch
form a run, and only within a run are pairs compared (a run is longer than the number of kinds only where kinds interlock).

Cases: null and empty texts have no spans; repeated rows give repeated results; long runs of digits or letters take linear
time, as the patterns are possessive and begin at the run's start; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: The formats of the contract. Each begins at a run's start or the last match's end, and takes whole runs.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: The generators, and words that a text must hold for them to run.
MORE = {
    "email": (r"(?i)[(\[{]at[)\]}]| dot ", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?(?:[(\[{]at[)\]}]|at) ?[a-z0-9-]{1,63}+(?:(?: ?(?:[(\[{]dot[)\]}]|dot) ?|\.)[a-z0-9-]{2,24}+){1,4}+"),
    "ip": (r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:", r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}+:){2,7}+(?::?[0-9A-Fa-f]{1,4}+){1,6}+"),
    "card": (r"[0-9]{4}[._/ -][0-9]", r"(?<![0-9])[0-9]{4}(?:[._/ -]?[0-9]{2,6}+){2,4}+"),
    "phone": (r"[0-9][)./ -]{1,2}[0-9]", r"(?<![0-9+.])(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[./ -])[0-9]{2,5}+(?:[./ -][0-9]{2,5}+){0,3}+"),
}
#: Words before a span that speak for a kind.
HINTS = {
    "email": r"(?i)(?:mail|contact|write|reach)\W*(?:\w+\W+){0,2}$",
    "ip": r"(?i)(?:\bip\b|address|host|server|ping)\W*(?:\w+\W+){0,2}$",
    "card": r"(?i)(?:card|visa|amex|credit|debit|payment)\W*(?:\w+\W+){0,2}$",
    "phone": r"(?i)(?:tel|phone|call|fax|mobile|cell|dial|sms)\W*(?:\w+\W+){0,2}$",
}
#: Characters before a span that count as context.
AROUND = 40
FEATURES = ("kind", "digits", "length", "separators", "luhn", "hint", "glued_before", "glued_after", "brackets", "letters", "colons", "sign_before", "groups")
TREES, RATE, PRECISION = 60, 0.3, 0.9
EXAMPLES = 4500
#: Elements that are walked at once: an array that grows by one is copied each time, so long walks go by blocks.
BLOCK = 64


def _add(a: Column, b: Column) -> Column:
    return a + b


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check; of no digits it doesn't."""
    n = F.length(digits)

    def worth(k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(k % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), worth), F.lit(0), _add)
    return F.when(n == 0, False).otherwise(total % 10 == 0)


def only_digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]++", "")


def valid(kind: str, match: Column) -> Column:
    """The contract's test of a base match."""
    if kind == "ip":
        small = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3
        return F.forall(F.split(match, "\\."), lambda p: small(p) & (F.when(small(p), F.concat(F.lit("0"), F.ltrim(p, F.lit("0"))).cast("int")).otherwise(999) <= 255))
    if kind == "card":
        n = F.length(only_digits(match))
        return F.when((n >= 14) & (n <= 19), luhn(only_digits(match))).otherwise(False)
    if kind == "phone":
        return F.length(only_digits(match)).between(10, 15)
    return F.lit(True)


def likely(kind: str, match: Column) -> Column:
    """What a proposal must have to be worth a score; keeps tables of short numbers out."""
    if kind in ("card", "phone"):
        return F.length(only_digits(match)).between(*((13, 19) if kind == "card" else (9, 15)))
    return F.lit(True)


def found(text: Column, pattern: str, kind: str, context: bool, test: Callable[[str, Column], Column]) -> Column:
    """Leftmost matches that don't overlap and pass ``test``, with code point offsets.

    What lies between the matches comes from a split by the same pattern; offsets are running sums of lengths. Only what
    passes is gathered, so that a text of many numbers takes linear time.
    """
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,match:string,before:string,after:string>>")

    def walk(cut: Column) -> Column:
        matches, pieces = cut["matches"], cut["pieces"]

        def step(acc: Column, k: Column) -> Column:
            match = F.element_at(matches, k + 1)
            piece = F.element_at(pieces, k + 1)
            start = acc["at"] + F.length(piece)
            end = start + F.length(match)
            before = F.right(piece, F.lit(AROUND)) if context else F.lit("")
            after = F.left(F.element_at(pieces, k + 2), F.lit(1)) if context else F.lit("")
            one = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), match.alias("match"), before.alias("before"), after.alias("after"))
            return F.struct(end.alias("at"), F.when(test(kind, match), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

        def block(acc: Column, first: Column) -> Column:
            some = F.sequence(first, F.least(first + (BLOCK - 1), F.size(matches) - 1))
            got = F.aggregate(some, F.struct(acc["at"].alias("at"), empty.alias("out")), step)
            # As an array of one element, what a block found is a variable: it is walked once.
            return F.element_at(F.transform(F.array(got), lambda g: F.struct(g["at"].alias("at"), F.concat(acc["out"], F.array(g["out"])).alias("out"))), 1)

        firsts = F.sequence(F.lit(0), F.size(matches) - 1, F.lit(BLOCK))
        spans = F.aggregate(firsts, F.struct(F.lit(0).alias("at"), F.array(empty).alias("out")), block, lambda acc: F.flatten(acc["out"]))
        return F.when(F.size(matches) > 0, spans).otherwise(empty)

    # A lambda's variable is computed once; a plain expression would be computed anew in each step.
    cut = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("matches"), F.split(text, pattern, -1).alias("pieces"))
    return F.element_at(F.transform(F.array(cut), walk), 1)


def base_spans(text: Column) -> Column:
    """All base spans that pass their test."""
    may = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][ -]?[0-9]"), "phone": text.rlike(r"\+[0-9]")}
    passing = lambda k: F.when(may[k], found(text, BASE[k], k, False, valid)).otherwise(F.array())
    return F.concat(*map(passing, KINDS))


def proposals(text: Column) -> Column:
    return F.concat(*(F.when(text.rlike(MORE[k][0]), found(text, MORE[k][1], k, True, likely)).otherwise(F.array()) for k in KINDS))


def count_of(text: Column, members: str) -> Column:
    return F.length(F.regexp_replace(text, f"[^{members}]++", ""))


def features(s: Column) -> list[Column]:
    """Numbers about a proposal, in the order of ``FEATURES``."""
    match, digits = s["match"], only_digits(s["match"])
    rank = reduce(lambda e, k: F.when(s["kind"] == KINDS[k], k).otherwise(e), range(len(KINDS)), F.lit(-1))
    hint = reduce(lambda e, k: e | ((s["kind"] == k) & s["before"].rlike(HINTS[k])), KINDS, F.lit(False))
    flag = lambda c: c.cast("int")
    out = [
        rank, F.length(digits), F.length(match), count_of(match, " ._/-"), flag((s["kind"] == "card") & luhn(digits)), flag(hint),
        flag(s["before"].rlike("[A-Za-z0-9]$")), flag(s["after"].rlike("[A-Za-z0-9]")), count_of(match, "()\\[\\]{}"), count_of(match, "A-Za-z"), count_of(match, ":"),
        flag(s["before"].rlike("[#$€£=:/._-] ?$")), F.size(F.split(match, "[^0-9A-Za-z]+", -1)),
    ]
    return [c.cast("double") for c in out]


def examples(seed: int = 5, n: int = EXAMPLES) -> list[dict]:
    """Labelled lines: sentences as people write them, filled with personal data and with numbers of other meanings.

    The formats are drawn freely (any grouping and separator, any host), not those of the generators alone, and many strings
    occur with either label: whether ``0401 223 118`` is a telephone number is told by its sentence, and not always.
    """
    rng = random.Random(seed)
    pick = rng.choice
    d = lambda k: "".join(pick("0123456789") for _ in range(k))
    w = lambda: "".join(pick("bcdfghklmnprstvw") + pick("aeiou") for _ in range(rng.randrange(1, 4))) + pick(["", "n", "s", "r"])
    grouped = lambda sizes, seps: "".join(d(k) + (pick(seps) if j < len(sizes) - 1 else "") for j, k in enumerate(sizes))

    def card() -> str:
        n = pick([14, 15, 16, 16, 16, 19])
        body = pick("3456") + d(n - 2)
        total = sum(sum(divmod(int(c) * (1 + (k + 1) % 2), 10)) for k, c in enumerate(reversed(body)))
        whole, sep = body + str(-total % 10), pick([".", "/", "_", " - ", ". ", " "])
        cut = pick([4, 4, 5, 6])
        return sep.join(whole[k : k + cut] for k in range(0, n, cut))

    def phone() -> str:
        sep = pick([" ", "-", ".", "/", " / ", ") "])
        sizes = [pick([2, 3, 4, 5]), *(pick([2, 3, 4]) for _ in range(pick([2, 2, 3])))]
        lead = pick(["", "0", "(", "(0"])
        text = grouped(sizes, [sep if sep != ") " else " "])
        return lead + (text.replace(" ", ") ", 1) if "(" in lead and " " in text else text + (")" if "(" in lead else ""))

    def number() -> str:
        return pick([lambda: grouped([pick([2, 3, 4]) for _ in range(pick([3, 4]))], pick(["-", ".", " ", "/"])), lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{d(4)}-{d(2)}-{d(2)} {d(2)}", phone])()

    def hexes(sep: str, n: int, k: int) -> str:
        return sep.join("".join(pick("0123456789abcdef") for _ in range(k)) for _ in range(n))

    address = lambda: w() + pick([" (at) ", " [at] ", "(at)", " at ", " {at} "]) + w() + pick([" (dot) ", " dot ", "[dot]", "."]) + pick(["com", "org", "de", "net", "io", "info"])
    told = {
        "email": (["Please write to {} for details", "mail: {}", "{} is how you reach me", "contact {} today", "my address, {}, still works"], address),
        "ip": (["The server answers at {}", "ping {} first", "logged in from {}", "host {} is down", "AAAA record {}"], lambda: pick([hexes(":", 8, pick([3, 4])), hexes(":", 3, 4) + "::" + hexes(":", pick([1, 2, 3]), pick([2, 4]))])),
        "card": (["paid with card {} today", "Visa {} expires soon", "charge {} please", "my credit card is {}", "{} was billed"], card),
        "phone": (["call {} after six", "Tel. {}", "Phone: {}", "my number is {}", "reach us: {}", "{} (mobile)"], phone),
    }
    other = {
        "email": (["we met at {}", "look at {} and so on", "they stood {} for long"], lambda: pick([f"{w()} at {w()}.{w()}", f"{w()} at {w()} dot {w()}", f"at {w()}.{w()} dot {w()}"])),
        "ip": (["it ran {} in all", "device {} joined", "score {} at the end", "hash {} matches"], lambda: pick([f"{d(2)}:{d(2)}:{d(2)}", hexes(":", 6, 2), f"{d(1)}:{d(2)}:{d(2)}:{d(3)}", hexes(":", pick([4, 5]), 2)])),
        "card": (["order {} shipped", "serial {}", "tracking {} is on its way", "invoice {} of May", "account {}"], lambda: pick([grouped([4, 4, 4, pick([2, 3, 4])], [pick([".", "/", "-", " "])]), f"{d(4)}/{d(2)}/{d(2)} {d(4)}", number()])),
        "phone": (["order {} shipped", "ISBN {}", "room {}", "part no. {}", "coordinates {}", "figures {} of last year", "number {}"], number),
    }
    out = []
    for k in range(n):
        good = k % 2 == 0
        kind = pick(KINDS)
        frames, make = (told if good else other)[kind]
        # One line in twelve takes the other label's sentence, so that a sentence alone decides nothing.
        frame = pick((other if good else told)[kind][0]) if rng.random() < 1 / 12 else pick(frames)
        out.append({"text": f"{w()} {w()}. " + frame.format(make()) + pick([".", ", " + w(), " " + w() + ".", ""]), "kind": kind, "label": int(good)})
    return out


class Model:
    """Trees of depth two over the features: (feature, cut, (feature, cut, low, high), (feature, cut, low, high))."""

    def __init__(self, trees: list[tuple], bias: float, steps: list[tuple[float, float]], thresholds: dict[str, float]):
        self.trees, self.bias, self.steps, self.thresholds = trees, bias, steps, thresholds

    def score(self, f: Column) -> Column:
        """The calibrated probability: the step of the margin that the trees give."""
        z = F.lit(self.bias)
        for a, cut, (b, b_cut, b0, b1), (c, c_cut, c0, c1) in self.trees:
            low = F.when(f[b] <= b_cut, b0).otherwise(b1)
            high = F.when(f[c] <= c_cut, c0).otherwise(c1)
            z = z + F.when(f[a] <= cut, low).otherwise(high)
        known = F.transform(F.array(z), lambda m: reduce(lambda e, s: F.when(m >= s[0], s[1]).otherwise(e), self.steps, F.lit(0.0)))
        return F.element_at(known, 1)

    def limit(self, kind: Column) -> Column:
        return reduce(lambda e, k: F.when(kind == k, self.thresholds[k]).otherwise(e), KINDS, F.lit(1.0))


def boost(x: np.ndarray, y: np.ndarray) -> tuple[list[tuple], float]:
    """Gradient boosting of logistic loss by Newton steps in trees of depth two."""
    share = np.clip(y.mean(), 0.01, 0.99)
    bias = float(np.log(share / (1 - share)))
    z, trees = np.full(len(y), bias), []

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float]:
        best = (0.0, 0, float("inf"))
        for f in range(x.shape[1]):
            for cut in np.unique(x[rows, f])[:-1]:
                low = x[rows, f] <= cut
                gain = g[rows][low].sum() ** 2 / (h[rows][low].sum() + 1) + g[rows][~low].sum() ** 2 / (h[rows][~low].sum() + 1) - g[rows].sum() ** 2 / (h[rows].sum() + 1)
                if gain > best[0] + 1e-12:
                    best = (float(gain), f, float(cut))
        return best[1], min(best[2], 1e9)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = y - p, p * (1 - p)
        if np.abs(g).max() < 0.02:
            break
        f, cut = split(np.arange(len(y)), g, h)
        sides = []
        for rows in (np.flatnonzero(x[:, f] <= cut), np.flatnonzero(x[:, f] > cut)):
            f2, cut2 = split(rows, g, h) if len(rows) else (0, 1e9)
            leaves = []
            for part in (rows[x[rows, f2] <= cut2], rows[x[rows, f2] > cut2]):
                step = float(RATE * g[part].sum() / (h[part].sum() + 1))
                z[part] += step
                leaves.append(step)
            sides.append((f2, cut2, *leaves))
        trees.append((f, cut, *sides))
    return trees, bias


def isotonic(margin: np.ndarray, y: np.ndarray) -> list[tuple[float, float]]:
    """Steps (least margin, probability) that rise and fit best: pooled adjacent violators, a little drawn to the middle."""
    pools: list[list[float]] = []
    for m in np.unique(margin):
        own = y[margin == m]
        pools.append([float(m), float(own.sum()), float(len(own))])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, hits, n = pools.pop()
            pools[-1][1] += hits
            pools[-1][2] += n
    return [(pools[0][0] if k else float("-inf"), (hits + 0.5) / (n + 1)) if not k else (m, (hits + 0.5) / (n + 1)) for k, (m, hits, n) in enumerate(pools)]


def margins(x: np.ndarray, trees: list[tuple], bias: float) -> np.ndarray:
    z = np.full(len(x), bias)
    for f, cut, low, high in trees:
        for side, here in ((low, x[:, f] <= cut), (high, x[:, f] > cut)):
            z += here * np.where(x[:, side[0]] <= side[1], side[2], side[3])
    return z


def scored_lines(spark: SparkSession, rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and line numbers of the proposals of labelled lines; in a line of a kind only its proposals count."""
    made = [{"line": k, **r} for k, r in enumerate(rows)]
    lines = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(made)), "array<struct<line:int,text:string,kind:string,label:int>>")).alias("r")).select("r.*")
    spans = lines.select("line", "kind", "label", F.explode(proposals(F.col("text"))).alias("s")).where("s.kind = kind or label = 0")
    table = sorted(spans.select("line", "label", F.array(*features(F.col("s"))).alias("f")).collect())  # as many as the lines have
    return np.array([r["f"] for r in table], np.float64).reshape(len(table), len(FEATURES)), np.array([r["label"] for r in table], np.float64), np.array([r["line"] for r in table], np.int64)


def train(spark: SparkSession, rows: list[dict] | None = None, precision: float = PRECISION) -> Model:
    """Fit on labelled lines (``text, kind, label``; by default those of :func:`examples`), a third each for trees,
    calibration and thresholds."""
    x, y, line = scored_lines(spark, examples() if rows is None else rows)
    part = line // 2 % 3
    trees, bias = boost(x[part == 0], y[part == 0])
    z = margins(x, trees, bias)
    steps = isotonic(z[part == 1], y[part == 1]) if (part == 1).any() else [(float("-inf"), 0.0)]
    score = probability(steps, z)
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = (part == 2) & (x[:, 0] == k)
        good = [t for _, t in steps if (score[own] >= t).sum() >= 10 and y[own][score[own] >= t].mean() >= precision]
        thresholds[kind] = min(good, default=1.1)
    return Model(trees, bias, steps, thresholds)


def probability(steps: list[tuple[float, float]], z: np.ndarray) -> np.ndarray:
    return np.array([p for _, p in steps])[np.searchsorted([m for m, _ in steps], z, side="right") - 1]


def overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (b["start"] < a["end"])


def runs(spans: Column) -> Column:
    """Spans in order of their start, as an array of runs: a span goes to the last run if it overlaps any span of it."""
    none = F.slice(spans, 1, 0)

    def step(acc: Column, s: Column) -> Column:
        touches = s["start"] < acc["end"]
        return F.struct(
            F.greatest(acc["end"], s["end"]).alias("end"),
            F.when(touches, F.concat(acc["run"], F.array(s))).otherwise(F.array(s)).alias("run"),
            F.when(touches, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["run"]))).alias("done"),
        )

    def block(acc: Column, first: Column) -> Column:
        start = F.struct(acc["end"].alias("end"), acc["run"].alias("run"), F.slice(F.array(none), 1, 0).alias("done"))
        got = F.aggregate(F.slice(spans, first, F.lit(BLOCK)), start, step)
        merged = lambda g: F.struct(g["end"].alias("end"), g["run"].alias("run"), F.concat(acc["done"], F.array(g["done"])).alias("done"))
        return F.element_at(F.transform(F.array(got), merged), 1)

    start = F.struct(F.lit(0).alias("end"), none.alias("run"), F.slice(F.array(F.array(none)), 1, 0).alias("done"))
    all_runs = F.aggregate(F.sequence(F.lit(1), F.size(spans), F.lit(BLOCK)), start, block, lambda acc: F.concat(F.flatten(acc["done"]), F.array(acc["run"])))
    return F.when(F.size(spans) > 0, all_runs).otherwise(F.array(none))


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, then end, joined by commas."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, KINDS)), s["kind"])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("b"), s["end"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, base, added``: arrays of spans (``kind, start, end, match, ...``; ``added`` with its score) for every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", base_spans(text).alias("base"), proposals(text).alias("more"))
    flagged = lambda c, is_base: F.transform(c, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(is_base).alias("base"), s["kind"].alias("kind"), s["match"].alias("match"), s["before"].alias("before"), s["after"].alias("after")))
    both = F.when(F.size("more") > 0, F.array_sort(F.concat(flagged(F.col("base"), True), flagged(F.col("more"), False)))).otherwise(F.slice(flagged(F.col("more"), False), 1, 0))
    grouped = rows.select("id", "base", both.alias("all")).select("id", "base", runs(F.col("all")).alias("runs"))
    lone = F.transform("runs", lambda r: F.filter(r, lambda s: ~s["base"] & ~F.exists(r, lambda o: o["base"] & overlap(s, o))))
    numbered = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), F.array(*features(s)).alias("f"))
    weighed = lambda s: F.struct(model.score(s["f"]).alias("score"), (-s["start"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind"), s["start"].alias("start"), s["match"].alias("match"))
    scored = grouped.select("id", "base", lone.alias("runs")).select("id", "base", F.transform("runs", lambda r: F.transform(r, numbered)).alias("runs")).select("id", "base", F.transform("runs", lambda r: F.transform(r, weighed)).alias("runs"))

    def taken(run: Column) -> Column:
        """The best of a run, then each that overlaps none taken."""
        able = F.sort_array(F.filter(run, lambda s: s["score"] >= model.limit(s["kind"])), asc=False)
        return F.aggregate(able, F.slice(run, 1, 0), lambda acc, s: F.when(F.exists(acc, lambda o: overlap(s, o)), acc).otherwise(F.concat(acc, F.array(s))))

    plain = lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["match"].alias("match"), s["score"].alias("score"))
    return scored.select(F.col("id").alias(id_col), "base", F.transform(F.flatten(F.transform("runs", taken)), plain).alias("added"))


def summary(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base spans by kind, a digest of them, and all spans."""
    counted = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    plain = lambda c: F.transform(c, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return spans.select(id_col, *map(counted, KINDS), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat(plain("base"), plain("added"))).alias("spans"))
