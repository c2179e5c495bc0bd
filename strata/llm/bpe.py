"""BPE encoding and decoding with forced-boundary splitting.

Two neighbouring start symbols that stand side by side in no token of the vocabulary can never be merged across, so the
place between them is a certain cut. Each pre-token is cut at all such places, its fragments are encoded independently and
their ids are concatenated. Pre-tokens repeat, so each task remembers a bounded number of them.

Cases: a null text counts as empty; an empty text has no tokens and decodes to the empty text; repeated rows give repeated
results; very long words take n log n steps.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: White space as Unicode has it; Python's own \s also takes the separators 0x1C-0x1F.
SPACE = "\t-\r \x85\xa0  -     　"
#: Words that are remembered with their tokens.
MEMORY = 150_000
#: Symbols from which on a fragment's merges are queued, and a rank that no merge has.
LONG = 100
NEVER = 1 << 30


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: printable Latin-1 stands for itself."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary read from a tokenizers JSON file; pickles to its plain tables."""

    def __init__(self, spec: dict):
        model = spec["model"]
        if model["type"] != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix") or spec.get("decoder"):
            raise ValueError("only plain BPE without dropout, prefix or decoder is supported")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.rank = {p: k for k, p in enumerate(pairs)}
        self.inside = self._inner_pairs(pairs)
        steps = spec["normalizer"]["normalizers"] if spec.get("normalizer") else []
        kinds = [s["type"] for s in steps]
        if kinds != ["NFC", "Replace", "Lowercase"]:
            raise ValueError(f"unknown normalizer steps: {kinds}")
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    @staticmethod
    def _inner_pairs(pairs: list[tuple[str, str]]) -> set[tuple[str, str]]:
        """Pairs of start symbols that are neighbours in some token; a merge joins the last of one with the first of another."""
        ends: dict[str, tuple[str, str]] = {}
        inside = set()
        for a, b in pairs:
            (first, last), (head, tail) = ends.get(a, (a, a)), ends.get(b, (b, b))
            inside.add((last, head))
            ends.setdefault(a + b, (first, tail))
        return inside


class _Memory(dict):
    """Computes what it lacks. When full it starts anew, but takes over from its former self what is asked for again."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.former = compute, {}

    def __missing__(self, key):
        if len(self) >= MEMORY:
            self.former = dict(self)
            self.clear()
        value = self.former.get(key)
        if value is None:
            value = self.compute(key)
        self[key] = value
        return value


class Codec:
    """Encodes and decodes whole texts by one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.letters = byte_letters()
        self.token = {i: t for t, i in vocabulary.ids.items()} | {i: t for t, i in vocabulary.special.items()}
        self.split = regex.compile(vocabulary.pattern.replace("\\s", SPACE))
        self.markers = re.compile("(" + "|".join(map(re.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.words = _Memory(self._word)

    def _fragment(self, part: list[str]) -> list[int]:
        """Merges the symbols by rank, leftmost first."""
        if len(part) > LONG:
            return self._long_fragment(part)
        rank, ids = self.v.rank.get, self.v.ids
        ranks = [rank(p, NEVER) for p in zip(part, part[1:], strict=False)]
        while ranks and (low := min(ranks)) != NEVER:
            k = ranks.index(low)
            part[k : k + 2] = [part[k] + part[k + 1]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((part[k - 1], part[k]), NEVER)
            if k < len(ranks):
                ranks[k] = rank((part[k], part[k + 1]), NEVER)
        return [ids[p] for p in part]

    def _long_fragment(self, part: list[str]) -> list[int]:
        """The same over a linked list, with a queue of the pairs that can be merged."""
        rank = self.v.rank
        after, before = [*range(1, len(part)), -1], [*range(-1, len(part) - 1)]
        queue = [(rank[p], i, p) for i, p in enumerate(zip(part, part[1:], strict=False)) if p in rank]
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if part[i] != pair[0] or j < 0 or part[j] != pair[1]:
                continue
            part[i], part[j] = pair[0] + pair[1], ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (p := (part[left], part[right])) in rank:
                    heapq.heappush(queue, (rank[p], left, p))
        ids = self.v.ids
        return [ids[p] for p in part if p]

    def _word(self, word: str) -> tuple[str, str]:
        """A pre-token's ids and tokens, each joined by one space."""
        symbols = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.v.suffix
        inside, out, start = self.v.inside, [], 0
        for k in range(1, len(symbols) + 1):
            if k == len(symbols) or (symbols[k - 1], symbols[k]) not in inside:
                out += self._fragment(symbols[start:k])
                start = k
        return " ".join(map(str, out)), " ".join(self.token[i] for i in out)

    def pretokens(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # letter by letter, so no final sigma
        return self.split.findall(text.lower())

    def encode_decode(self, text: str) -> tuple[str, str]:
        """All ids of the text joined by one space, and the decoded text."""
        if not text:
            return "", ""
        parts = self.markers.split(text) if self.markers and any(m in text for m in self.v.special) else [text]
        both = []
        for k, part in enumerate(parts):
            if k % 2:
                both.append((str(self.v.special[part]), part))
            else:
                both += map(self.words.__getitem__, self.pretokens(part))
        return " ".join([b[0] for b in both]), " ".join([b[1] for b in both])

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for i in self.encode_decode(text or "")[0].split()]

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as vocabularies without a decoder are read; unknown ids are left out."""
        return " ".join(self.token[i] for i in ids if i in self.token)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, keep_decoded: bool = False) -> DataFrame:
    """Encode every row's whole text: ``id_col, n_tokens, ids_sha256, decoded_sha256`` and, if asked for, ``ids`` and ``decoded``.

    ``path`` names a tokenizers JSON file that the driver reads; its tables go to the executors once, and their size is that
    of the file.
    """
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(Vocabulary.load(path))
    extra = [pa.field("ids", pa.list_(pa.int32()))] * keep_ids + [pa.field("decoded", pa.string())] * keep_decoded
    id_type = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(shipped.value)
        for batch in batches:
            n, ids, texts, sums, backs = [], [], [], [], []
            for text in batch.column(1):
                a, b = codec.encode_decode(text.as_py() or "")
                n.append(a.count(" ") + 1 if a else 0)
                sums.append(hashlib.sha256(a.encode()).hexdigest())
                backs.append(hashlib.sha256(b.encode()).hexdigest())
                if keep_ids:
                    ids.append(list(map(int, a.split())))
                if keep_decoded:
                    texts.append(b)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(sums, pa.string()), pa.array(backs, pa.string())]
            columns += [pa.array(ids, pa.list_(pa.int32()))] * keep_ids + [pa.array(texts, pa.string())] * keep_decoded
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256", *(f.name for f in extra)])

    schema = f"`{id_col}` {id_type.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    schema += ", ids array<int>" * keep_ids + ", decoded string" * keep_decoded
    return docs.select(id_col, text_col).mapInArrow(run, schema)
