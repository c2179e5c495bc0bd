"""MinHash near-dedup with tensored banding.

Two collections of ``BANDS`` short bands are hashed; a table key is a pair of one band from each, so 2 x BANDS bands give
BANDS squared tables. Documents travel once for each first band and are split by their second bands inside the group; a
first band with more rows than a task should hold is split before the shuffle, by the combined keys. Pairs that share a
table key and agree in enough of the sketch form blocks; within a block links are confirmed on full shingle sets.

Exact copies (equal shingle sets) are one class from the start. Inside a group a search by breadth visits each document
once: what it links to leaves the rest, so a group of near copies costs about one comparison a document instead of one a
pair, and no pair is left out, since every visited document is compared with all that are not yet in its component.

Groups too large for a task even so are cut into chunks, and the group's least document joins every chunk. What reaches it
inside its chunk is one component already, so only the others go to all chunks and are compared with every document there.
A million near copies thus travel about once, and links between any two are found: of a pair that isn't one component
already, one document at least goes everywhere. (A huge group of unlike documents would go to all chunks, each in full.)

The chance that a pair at the threshold shares no table key is 1 - (1 - (1 - J^2)^BANDS)^2: 5e-6 at J = 0.85, 7e-5 at 0.8.

Cases: null and empty texts have no shingles, are linked with nothing and stay; texts with fewer words than a shingle are
one shingle; very long texts are taken whole; rows that repeat an id are one document with several texts; rows without an id
take no part and stay; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import join_sizes, materialize
from strata.llm.components import components

#: Bands of each collection, and hashes of a band.
BANDS, WIDTH = 10, 2
HASHES = 2 * BANDS * WIDTH
#: Agreeing sketch entries of a candidate: a pair at J = 0.8 has fewer with a chance of 1e-6.
AGREE = HASHES // 2
#: Rows of a group, and shingles of a block, from which on it is cut into chunks.
CHUNK_ROWS = 2048
CHUNK_SHINGLES = 4_000_000
MEMORY = 200_000
#: Documents in blocks up to which their list (24 bytes each) goes to every executor; beyond, the texts are shuffled to it.
MAX_SHIPPED = 500_000
#: Groups that are cut into chunks, up to which their list goes to every executor.
MAX_LISTED = 1_000_000

_ODD = np.random.default_rng(20_240_601).integers(1, 1 << 63, size=HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(20_240_602).integers(1, 1 << 63, size=HASHES, dtype=np.uint64)
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _K1
    h = (h ^ (h >> np.uint64(29))) * _K2
    return h ^ (h >> np.uint64(32))


class Shingler:
    """Distinct hashed word shingles of a text."""

    def __init__(self, size: int):
        self.size, self.words = size, {}

    def shingles(self, raw: bytes) -> np.ndarray:
        words = raw.lower().split()  # bytes: A-Z and ASCII white space only
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b"\0".join(words), seed=1)], np.uint64)
        known = self.words
        if len(known) > MEMORY:
            known.clear()
        hashed = [known.get(w) for w in words]
        for k, h in enumerate(hashed):
            if h is None:
                hashed[k] = known[words[k]] = xxhash.xxh3_64_intdigest(words[k])
        h = np.array(hashed, np.uint64)
        n = len(h) - self.size + 1
        out = h[:n].copy()
        for k in range(1, self.size):
            out = (out ^ (out >> np.uint64(27))) * _K2 + h[k : k + n]
        return np.unique(mix(out))


def sketch_of(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the first collection's bands, and all hashes in 16 bits each; the second collection's are the last ones."""
    low = np.empty(HASHES, np.uint64)
    for k in range(HASHES):
        low[k] = (shingles * _ODD[k] + _ADD[k]).min()
    low = mix(low)
    first = low[: HASHES // 2].reshape(BANDS, WIDTH)
    keys = np.arange(BANDS, dtype=np.uint64)
    for k in range(WIDTH):
        keys = mix(keys * _K1 + first[:, k])
    return keys.view(np.int64), (low >> np.uint64(48)).astype(np.uint16)


def sketches(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``id, n, mark`` (a digest of the shingle set), ``keys, sketch`` for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            n, marks, keys, sketch = [], [], [], []
            for value in batch.column(1):
                own = shingler.shingles(value.as_buffer().to_pybytes() if value.is_valid else b"")
                n.append(len(own))
                if not len(own):
                    marks.append(None), keys.append(None), sketch.append(None)
                    continue
                marks.append(xxhash.xxh3_128_digest(own.tobytes()))
                k, s = sketch_of(own)
                keys.append(k), sketch.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(marks, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketch, pa.binary())], names=["id", "n", "mark", "keys", "sketch"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id bigint, n bigint, mark binary, keys array<bigint>, sketch binary")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, cut so that no group of it is split."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1], side="left"))  # where the last group starts
        if last or held and held[-1].column(0)[-1].as_py() != key[-1]:
            if done := [*held, batch.slice(0, last)]:
                yield pa.Table.from_batches(done)
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def visit(n: int, hits: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest of the relation that ``hits`` tests: which of the given rows a row is linked with."""
    rest, edges = np.arange(n), []
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            p = front.pop()
            hit = hits(p, rest)
            if hit.any():
                got = rest[hit]
                edges += [(p, int(g)) for g in got]
                front += got.tolist()
                rest = rest[~hit]
    return edges


#: Links within a group: from the sizes and payloads of its rows, a spanning forest of the relation.
Linker = Callable[[np.ndarray, list[bytes]], list[tuple[int, int]]]


def batch_of(found: list[np.ndarray]) -> pa.RecordBatch:
    a, b = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def linked(rows: DataFrame, link: Linker) -> DataFrame:
    """Edges ``a, b`` in each group of ``key, id, n, load``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            key, ids, n = (table.column(k).to_numpy() for k in range(3))
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            found = []
            for k, m in zip(start, np.diff(np.append(start, len(key))), strict=True):
                own, first = np.unique(ids[k : k + m], return_index=True)
                if len(own) > 1:
                    load = table.column(3).slice(k, m).to_pylist()
                    if edges := link(n[k : k + m][first], [load[j] for j in first]):
                        found.append(own[np.array(edges).T])
            yield batch_of(found)

    return rows.repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a bigint, b bigint")


def apart(rows: DataFrame, chunks: DataFrame, link: Linker) -> DataFrame:
    """Edges of groups (``key, id, n, load``) too large for a task; ``chunks`` has ``key, chunks``, listed as few."""
    rows = materialize(rows.join(chunks, "key"), "apart")
    deal = lambda c: F.xxhash64("key", c)
    everywhere = F.explode(F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda c: F.xxhash64("key", c)))
    at_home = rows.withColumn("deal", deal(F.pmod(F.xxhash64("id", F.lit(1)), F.col("chunks")).cast("int"))).withColumn("pivot", F.lit(False))
    pivots = rows.groupBy("key", "chunks").agg(F.min(F.struct("id", "n", "load")).alias("p")).select("key", "p.*", "chunks").withColumn("deal", everywhere).withColumn("pivot", F.lit(True))
    names = ["deal", "key", "id", "n", "load", "chunks", "pivot"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            one, ids, n = (table.column(k).to_numpy() for k in (0, 2, 3))
            lead = table.column(6).to_numpy(zero_copy_only=False)
            start = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
            found, rest = [], []
            for k, m in zip(start, np.diff(np.append(start, len(one))), strict=True):
                own, first = np.unique(ids[k : k + m], return_index=True)
                load = table.column(4).slice(k, m).to_pylist()
                edges = link(n[k : k + m][first], [load[j] for j in first])
                if edges:
                    found.append(own[np.array(edges).T])
                up = list(range(len(own)))

                def root(x: int, up: list[int] = up) -> int:
                    while up[x] != x:
                        up[x] = up[up[x]]
                        x = up[x]
                    return x

                for x, y in edges:
                    up[root(x)] = root(y)
                main = root(int(np.searchsorted(own, ids[k : k + m][lead[k : k + m]][0])))
                rest += [k + int(first[x]) for x in range(len(own)) if root(x) != main]
            edges = batch_of(found)
            left = table.take(pa.array(rest, pa.int64())).select(["key", "id", "n", "load", "chunks"])
            none = lambda size, t: pa.nulls(size, t)
            yield pa.RecordBatch.from_arrays([*edges.columns, *(none(edges.num_rows, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int32()))], names=["a", "b", "key", "id", "n", "load", "chunks"])
            for part in left.to_batches():
                yield pa.RecordBatch.from_arrays([none(part.num_rows, pa.int64()), none(part.num_rows, pa.int64()), *part.columns], names=["a", "b", "key", "id", "n", "load", "chunks"])

    first = at_home.select(names).unionByName(pivots.select(names)).repartition("deal").sortWithinPartitions("deal", "id")
    met = materialize(first.mapInArrow(settle, "a bigint, b bigint, key bigint, id bigint, n bigint, load binary, chunks int"), "met")
    edges, rest = met.where("a is not null").select("a", "b"), met.where("key is not null").drop("a", "b")
    homes = at_home.join(F.broadcast(rest.select("key").distinct()), "key", "left_semi")  # some of the groups that are listed
    again = rest.select(everywhere.alias("key"), "id", "n", "load").unionByName(homes.select(F.col("deal").alias("key"), "id", "n", "load"))
    return edges.unionByName(linked(again, link))


def listed(sizes: DataFrame, tag: str) -> DataFrame:
    """The groups that are cut, written once, and broadcast where they are few enough for it."""
    sizes = materialize(sizes, tag)
    return F.broadcast(sizes) if sizes.count() <= MAX_LISTED else sizes


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` that join all documents which share a table key and agree in the sketch."""
    rows = reps.select("id", "n", F.col("sketch").alias("load"), F.explode("keys").alias("key"))
    chunks = F.ceil(F.col("count") / CHUNK_ROWS).cast("int").alias("chunks")

    def near(p: int, rest: np.ndarray, n: np.ndarray, s: np.ndarray, b: np.ndarray) -> np.ndarray:
        fits = (100 * np.minimum(n[rest], n[p]) >= percent * np.maximum(n[rest], n[p])) & (b[rest] == b[p]).any(axis=1)
        fits[fits] = (s[rest[fits]] == s[p]).sum(axis=1) >= AGREE
        return fits

    def link(n: np.ndarray, sketch: list[bytes]) -> list[tuple[int, int]]:
        s = np.frombuffer(b"".join(sketch), np.uint16).reshape(len(n), HASHES)
        b = np.ascontiguousarray(s[:, HASHES // 2 :]).view(np.uint32)
        return visit(len(n), lambda p, rest: near(p, rest, n, s, b))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches):
            key, ids, n = (table.column(k).to_numpy() for k in range(3))
            s = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint16).reshape(len(ids), HASHES)
            b = np.ascontiguousarray(s[:, HASHES // 2 :]).view(np.uint32)
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(start, len(key)))
            i = start[size == 2]
            fits = (100 * np.minimum(n[i], n[i + 1]) >= percent * np.maximum(n[i], n[i + 1])) & (b[i] == b[i + 1]).any(axis=1)
            i = i[fits]
            i = i[(s[i] == s[i + 1]).sum(axis=1) >= AGREE]
            found = [np.stack([ids[i], ids[i + 1]])]
            for k, m in zip(start[size > 2], size[size > 2], strict=True):
                part = slice(k, k + m)
                if edges := visit(m, lambda p, rest, part=part: near(p, rest, n[part], s[part], b[part])):
                    found.append(ids[part][np.array(edges).T])
            yield batch_of(found)

    within = lambda x: x.select("key", "id", "n", "load").repartition("key").sortWithinPartitions("key", "id").mapInArrow(run, "a bigint, b bigint")
    large = materialize(rows.groupBy("key").count().where(F.col("count") > CHUNK_ROWS).select("key"), "large")
    if large.isEmpty():
        return within(rows).distinct()
    hot = listed(large, "hot")
    second = [F.xxhash64("key", F.lit(j), F.substring("load", HASHES + 4 * j + 1, 4)) for j in range(BANDS)]
    combined = materialize(rows.join(hot, "key", "left_semi").select(F.explode(F.array(*second)).alias("key"), "id", "n", "load"), "combined")
    cut = listed(combined.groupBy("key").count().where(F.col("count") > CHUNK_ROWS).select("key", chunks), "cut")
    found = within(rows.join(hot, "key", "left_anti").unionByName(combined.join(cut, "key", "left_anti").select(rows.columns)))
    return found.unionByName(apart(combined, cut, link)).distinct()


def confirmed(docs: DataFrame, blocks: DataFrame, size: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """Links ``a, b`` on full shingle sets: a spanning forest of each block."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            own = [shingler.shingles(v.as_buffer().to_pybytes() if v.is_valid else b"") for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], names=["key", "id", "n", "load"])

    def link(n: np.ndarray, own: list[bytes]) -> list[tuple[int, int]]:
        return link_sets(n, own, percent)

    members = F.broadcast(blocks) if blocks.count() <= MAX_SHIPPED else blocks
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(members, "id").select("block", "id", "text", "size")
    chunks = F.ceil(F.greatest(F.col("members") / CHUNK_ROWS, F.col("mass") / CHUNK_SHINGLES)).cast("int")
    large = materialize(blocks.groupBy(F.col("block").alias("key")).agg(F.count("*").alias("members"), F.sum("size").alias("mass")).select("key", chunks.alias("chunks")).where("chunks > 1"), "large")
    shape = "key bigint, id bigint, n bigint, load binary"
    if large.isEmpty():
        return linked(texts.select("block", "id", "text").mapInArrow(sets, shape), link)
    cut = listed(large, "cut")
    marked = texts.withColumnRenamed("block", "key")
    small = marked.join(cut, "key", "left_anti").select("key", "id", "text").mapInArrow(sets, shape)
    return linked(small, link).unionByName(apart(marked.join(cut.select("key"), "key", "left_semi").select("key", "id", "text").mapInArrow(sets, shape), cut, link))


def link_sets(n: np.ndarray, own: list[bytes], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of sets with 100 * intersection >= percent * union."""
    all_of, shared, count = np.unique(np.frombuffer(b"".join(own), np.uint64), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(n)), n)
    more = count[shared] > 1  # a shingle of one set only is in no intersection
    shared, row = shared[more], row[more]
    flag = np.zeros(len(all_of), bool)
    state = {"codes": shared, "row": row, "of": len(n)}
    start = np.searchsorted(row, np.arange(len(n) + 1))

    def hits(p: int, rest: np.ndarray) -> np.ndarray:
        if 2 * len(rest) < state["of"]:  # what has been visited leaves
            inside = np.zeros(len(n), bool)
            inside[rest] = True
            keep = inside[state["row"]]
            state.update(codes=state["codes"][keep], row=state["row"][keep], of=len(rest))
        mine = shared[start[p] : start[p + 1]]
        flag[mine] = True
        inter = np.bincount(state["row"][flag[state["codes"]]], minlength=len(n))[rest]
        flag[mine] = False
        return 100 * inter >= percent * (n[rest] + n[p] - inter)

    return visit(len(n), hits)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_shingles, component_id, kept`` for every row.

    Documents with Jaccard similarity of at least ``percent`` hundredths are linked; the component is the least id that
    links reach, and a document is kept if that is its own.
    """
    every = materialize(sketches(docs, shingle, id_col, text_col), "sketches")
    classes = every.where("n > 0 and id is not null").groupBy("mark").agg(F.min("id").alias("rep"), F.count("*").alias("n"))
    reps = every.alias("e").join(classes.alias("c"), (F.col("e.id") == F.col("c.rep")) & (F.col("e.mark") == F.col("c.mark"))).select("e.id", "e.n", "e.keys", "e.sketch")
    blocks = components(candidates(reps, percent)).withColumnRenamed("component", "block")
    sizes = every.where("n > 0").groupBy("id").agg(F.max("n").alias("size"))
    blocks = materialize(blocks.join(sizes, "id"), "blocks")
    found = components(confirmed(docs, blocks, shingle, percent, id_col, text_col))
    of_class = classes.join(found.withColumnRenamed("id", "rep"), "rep", "left").select("mark", F.coalesce("component", "rep").alias("component"), "n")
    takes_part = F.col("mark").isNotNull() & F.col("id").isNotNull()
    rows = every.select("id", F.col("n").alias("shingles"), "mark")
    joined = join_sizes(rows.where(takes_part), materialize(of_class, "classes"), "mark", rows.count(), "left").select("id", "shingles", "component")
    joined = joined.unionByName(rows.where(~takes_part).select("id", "shingles", F.lit(None).cast("long").alias("component")))
    component = F.coalesce("component", "id")
    return joined.select(F.col("id").alias(id_col), F.col("shingles").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
