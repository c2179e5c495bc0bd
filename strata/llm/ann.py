"""Nearest neighbours by a forest of random-projection trees.

A bounded sample fits a few trees of hyperplanes (each the bisector of two means grown from random points, moved to the
median), so deep that a leaf holds about ``LEAF`` rows. Every vector goes to its leaf in each tree. A query puts the roots of
all trees into one priority queue and opens what it violates least (a node costs the sum of the squared distances to the
planes on the wrong side of which the query stands), until the opened leaves hold ``budget`` rows. Leaves and queries then
meet in a shuffle by subtrees of 64 leaves, where a query names its leaves in a bit mask; large subtrees and their query
lists are dealt in chunks, and the candidates are scored exactly.

The budget is a number of rows, not a share of the table. It is measured: in the sample, and in a quarter of it, the rows
that must be opened for ``TARGET`` of the true neighbours; the power of the size between the two carries it on to the table.
So it grows more slowly than the table, and how slowly depends on the data: vectors close to noise in 64 dimensions need
half of 10,000 rows, clustered ones a few leaves.

Cases: null or zero vectors, ones with null or non-finite components and ones of another length than most take no part;
of several rows of one id the least vector stands; equal scores go to the smaller id, and of equal vectors only as many of
the smallest ids are candidates as can be in a result; fewer candidates than asked for are all returned; an empty table or
no query gives no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strata.llm.common import materialize, sampled
from strata.llm.minhash import groups

#: Vectors in the sample that fits the trees (chosen by hashed id; about so many): a fiftieth of the table within these
#: bounds. The upper one makes trees of 15 levels.
SAMPLE, MOST_SAMPLED = 20_000, 400_000
TREES = 4
#: Rows of a leaf, and sampled rows that it needs at least.
LEAF, LEAF_SAMPLE = 24, 8
#: Recall that the budget is measured for, and the number of sampled queries that measure it.
TARGET, ASKED = 0.96, 128
#: Levels of the subtree that is one group of the shuffle: its leaves are the bits of a mask.
UNIT_LEVELS = 6
#: Vectors, and queries, of a leaf from which on it is dealt in chunks.
CHUNK = 8192
#: Results that a task holds before it merges them, and before it hands them on.
HELD, MOST = 1_000_000, 4_000_000


def depth_for(rows: int, sampled: int, leaf: int = LEAF) -> int:
    """Levels at which a leaf holds about ``leaf`` rows of the table, and some of the sample at least."""
    return max(0, min(int(np.log2(max(1, rows / leaf))), int(np.log2(max(1, sampled / LEAF_SAMPLE)))))


class Forest:
    """Complete binary trees of hyperplanes, node k with the children 2k+1 and 2k+2."""

    def __init__(self, x: np.ndarray, trees: int, depth: int, seed: int = 11):
        self.depth = depth
        self.inner, self.leaves = (1 << depth) - 1, 1 << depth
        self.unit = min(depth, UNIT_LEVELS)
        self.units = self.leaves >> self.unit
        rng = np.random.default_rng(seed)
        self.normals = np.zeros((trees, self.inner, x.shape[1] if x.ndim > 1 else 0))
        self.offsets = np.zeros((trees, self.inner))
        self.shares = np.zeros((trees, self.leaves))
        for t in range(trees):
            self._fit(t, 0, np.arange(len(x)), x, rng)
            if len(x):
                self.shares[t] = np.bincount(self.leaf(x, t), minlength=self.leaves) / len(x)

    def _fit(self, t: int, node: int, rows: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> None:
        if node >= self.inner or len(rows) < 2:
            return
        a, b = x[rng.choice(rows, 2, replace=False)]
        some = x[rng.choice(rows, min(len(rows), 400), replace=False)]
        for _ in range(6):
            side = some @ (a - b) > (a @ a - b @ b) / 2
            if side.all() or not side.any():
                break
            a, b = some[side].mean(axis=0), some[~side].mean(axis=0)
        normal = (a - b) / (np.linalg.norm(a - b) or 1.0)
        along = x[rows] @ normal
        self.normals[t, node], self.offsets[t, node] = normal, np.median(along)
        above = along > self.offsets[t, node]
        self._fit(t, 2 * node + 1, rows[~above], x, rng)
        self._fit(t, 2 * node + 2, rows[above], x, rng)

    def leaf(self, x: np.ndarray, t: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            above = np.einsum("ij,ij->i", x, self.normals[t, node]) > self.offsets[t, node]
            node = 2 * node + 1 + above
        return node - self.inner

    def search(self, q: np.ndarray, budget: float) -> list[int]:
        """Leaves to open, as tree * leaves + leaf, nearest first, until they hold the share ``budget`` of the rows."""
        margins = np.einsum("tnd,d->tn", self.normals, q) - self.offsets
        queue = [(0.0, t, 0) for t in range(len(margins))]
        found, seen = [], 0.0
        while queue and seen < budget:
            cost, t, node = heapq.heappop(queue)
            if node >= self.inner:
                found.append(t * self.leaves + node - self.inner)
                seen += self.shares[t, node - self.inner]
                continue
            m = float(margins[t, node])
            heapq.heappush(queue, (cost + max(m, 0.0) ** 2, t, 2 * node + 1))
            heapq.heappush(queue, (cost + max(-m, 0.0) ** 2, t, 2 * node + 2))
        return found

    def costs(self, q: np.ndarray) -> np.ndarray:
        """The cost of every leaf for each query (queries x leaves of all trees), level by level."""
        margins = np.einsum("tnd,qd->qtn", self.normals, q, optimize=True) - self.offsets
        cost = np.zeros((len(q), len(self.offsets), 1))
        for level in range(self.depth):
            m = margins[:, :, (1 << level) - 1 : (2 << level) - 1]
            cost = np.stack([cost + np.maximum(m, 0) ** 2, cost + np.maximum(-m, 0) ** 2], axis=-1).reshape(len(q), len(self.offsets), -1)
        return cost.reshape(len(q), -1)

    def opened(self, q: np.ndarray, budget: float) -> list[np.ndarray]:
        """What :meth:`search` opens for each query.

        A cost never falls along a path, so the queue hands out leaves in ascending order of their costs. Where a large part
        of them will be opened, sorting them all is quicker than the queue, and gives the same.
        """
        share = self.shares.sum() or 1.0
        if budget < share / 16:
            return [np.array(self.search(x, budget), np.int64) for x in q]
        out, shares = [], self.shares.ravel()
        for k in range(0, len(q), 64):
            cost = self.costs(q[k : k + 64])
            order = np.argsort(cost, axis=1, kind="stable")
            before = np.cumsum(shares[order], axis=1) - shares[order]
            out += [o[b < budget] for o, b in zip(order, before, strict=True)]
        return out

    def masks(self, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves as units (tree * units + unit), and in each the bits of its leaves."""
        unit, start = np.unique(leaves >> self.unit, return_inverse=True)
        bits = np.zeros(len(unit), np.int64)
        np.bitwise_or.at(bits, start, np.int64(1) << (leaves & ((1 << self.unit) - 1)))
        return unit, bits


def measured_budget(x: np.ndarray, rows: int, k: int, trees: int, leaf: int = LEAF, target: float = TARGET) -> float:
    """Rows to open in a table of ``rows`` for ``target`` of the true neighbours, from a sample of it in random order."""
    needed: list[tuple[int, float]] = []
    for m in (len(x) // 4, len(x)):
        if m <= k:
            continue
        part = x[:m]
        f = Forest(part, trees, depth_for(m, m, leaf), seed=7)
        at = np.random.default_rng(5).permutation(m)[:ASKED]
        score = part[at] @ part.T
        score[np.arange(len(at)), at] = -np.inf
        best = np.argpartition(-score, min(k, m - 1) - 1, axis=1)[:, : min(k, m - 1)]
        own = np.stack([t * f.leaves + f.leaf(part, t) for t in range(trees)], axis=1)
        cost, shares = f.costs(part[at]), f.shares.ravel()
        order = np.argsort(cost, axis=1, kind="stable")
        before = np.empty_like(cost)
        np.put_along_axis(before, order, np.cumsum(shares[order], axis=1) - shares[order], axis=1)
        first = np.take_along_axis(before, own[best].reshape(len(at), -1), axis=1).reshape(*best.shape, trees).min(axis=2)
        needed.append((m, float(np.quantile(first, target)) * m + leaf))
    if not needed:
        return float(trees * max(rows, 1))
    (m0, n0), (m1, n1) = needed[0], needed[-1]
    power = np.clip(np.log(n1 / n0) / np.log(m1 / m0), 0.0, 1.0) if m1 > m0 else 1.0
    return n1 * max(1.0, rows / m1) ** float(power)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), width)


def usable(vector: Column, width: int) -> Column:
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & (F.size(vector) == width) & ~bad & F.exists(vector, lambda v: v != 0)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", sample: int = SAMPLE, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of largest inner product found for each row of ``is_query``.

    ``is_query`` is an expression over the column ``id``.
    """
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    raw = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(kind).alias("v")).where("id is not null and v is not null")
    widths = raw.groupBy(F.size("v").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width = widths["w"] if widths else 0
    rows = materialize(raw.where(usable(F.col("v"), width)).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    copy = F.row_number().over(W.partitionBy("v").orderBy("id"))  # one vector's smallest ids, the query's own and k more
    stored = materialize(rows.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("id", "v"), "stored")
    total = stored.count()
    wanted = max(sample, min(MOST_SAMPLED, total // 50))
    fit = [r["v"] for r in sampled(stored, "id", min(1.0, wanted / max(1, total))).select("v").collect()]
    fit = np.array(fit, np.float64).reshape(len(fit), width)
    fit = np.random.default_rng(13).permutation(np.unique(fit, axis=0) if fit.size else fit)  # equal vectors would crowd a leaf
    forest = Forest(fit, trees, depth_for(total, len(fit), leaf))
    budget = measured_budget(fit[:sample], total, k, trees, leaf) / max(1, total)
    shipped = rows.sparkSession.sparkContext.broadcast(forest)
    schema = f"id bigint, v {kind}, at array<struct<unit:bigint,bits:bigint>>"
    pairs = pa.list_(pa.struct([("unit", pa.int64()), ("bits", pa.int64())]))

    def listed(batch: pa.RecordBatch, units: list[np.ndarray], bits: list[np.ndarray]) -> pa.RecordBatch:
        flat = pa.StructArray.from_arrays([pa.array(np.concatenate([*units, np.zeros(0, np.int64)])), pa.array(np.concatenate([*bits, np.zeros(0, np.int64)]))], names=["unit", "bits"])
        ends = np.append(0, np.cumsum([len(u) for u in units])).astype(np.int32)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), flat).cast(pairs)], names=["id", "v", "at"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shipped.value
        for batch in batches:
            x = matrix(batch.column(1), width)
            at = np.stack([t * f.leaves + f.leaf(x, t) for t in range(trees)], axis=1) if len(x) else np.zeros((0, trees), np.int64)
            yield listed(batch, list(at >> f.unit), list(np.int64(1) << (at & ((1 << f.unit) - 1))))

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = shipped.value
        for batch in batches:
            masks = [f.masks(at) for at in f.opened(matrix(batch.column(1), width), budget)]
            yield listed(batch, [u for u, _ in masks], [b for _, b in masks])

    asked = rows.where(is_query).select("id", "v").mapInArrow(opened, schema)
    both = stored.mapInArrow(leaves, schema).withColumn("stored", F.lit(True)).union(asked.withColumn("stored", F.lit(False)))
    sides = materialize(both, "sides").select("id", "v", "stored", F.explode("at").alias("e")).select("id", "v", "stored", F.col("e.unit").alias("unit"), F.col("e.bits").alias("bits"))
    sizes = sides.groupBy("unit").agg(*(F.ceil(F.count(F.when(F.col("stored") == s, 1)) / CHUNK).cast("int").alias(n) for s, n in ((True, "vs"), (False, "qs"))))
    part = lambda n: F.pmod(F.xxhash64("id", F.lit(1)), n).cast("int")
    over = lambda n, f: F.transform(F.sequence(F.lit(0), n - 1), f)
    deal = F.when(
        F.col("stored"), over(F.col("qs"), lambda q: F.xxhash64("unit", part(F.col("vs")), q))
    ).otherwise(over(F.col("vs"), lambda v: F.xxhash64("unit", v, part(F.col("qs")))))
    # A row for each unit of the forest at most.
    met = sides.join(F.broadcast(sizes.where("vs > 0 and qs > 0")), "unit").select(F.explode(deal).alias("deal"), "stored", "id", "bits", "v")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for table in groups(batches):
            key, ids, bits = (table.column(c).to_numpy() for c in (0, 2, 3))
            stored = table.column(1).to_numpy()
            x = np.concatenate([matrix(c, width) for c in table.column(4).chunks])
            start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            for a, b in zip(start, np.append(start[1:], len(key)), strict=True):
                m = a + int(np.searchsorted(stored[a:b], True))  # queries first
                for q in range(a, m, 512):
                    q = slice(q, min(q + 512, m))
                    held.append(best_of(ids[q], x[q], bits[q], ids[m:b], x[m:b], bits[m:b], k))
                    size += held[-1].shape[1]
                if size > HELD:
                    held = [merged(held, k)]
                    size = held[0].shape[1]
                    if size > MOST:
                        yield batch_of(held)
                        held, size = [], 0
        if held:
            yield batch_of([merged(held, k)])

    found = met.repartition("deal").sortWithinPartitions("deal", "stored").mapInArrow(rerank, "query_id bigint, vec_id bigint, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best_of(q_ids: np.ndarray, q: np.ndarray, wants: np.ndarray, ids: np.ndarray, x: np.ndarray, bit: np.ndarray, k: int) -> np.ndarray:
    """Rows of query, id and score (as doubles' bits): the best of a block, more than k where scores are nearly equal.

    A stored row (``bit`` names its leaf) is a candidate of the queries whose ``wants`` hold its bit; only those are scored.
    """
    if not len(q_ids) or not len(ids):
        return np.zeros((3, 0), np.int64)
    rough = np.full((len(q_ids), len(ids)), -np.inf)
    for b in np.unique(bit):
        who, what = np.flatnonzero(wants & b), np.flatnonzero(bit == b)
        if len(who):
            rough[np.ix_(who, what)] = q[who] @ x[what].T
    rough[q_ids[:, None] == ids[None, :]] = -np.inf
    most = min(k, len(ids))
    edge = np.partition(rough, len(ids) - most, axis=1)[:, len(ids) - most]
    slack = 1e-9 * np.maximum(1.0, np.abs(np.where(np.isfinite(edge), edge, 0.0)))
    a, b = np.nonzero((rough >= (edge - slack)[:, None]) & np.isfinite(rough))
    score = (q[a] * x[b]).sum(axis=1)  # the same for equal vectors, wherever they stand
    return np.stack([q_ids[a], ids[b], score.view(np.int64)])


def merged(held: list[np.ndarray], k: int) -> np.ndarray:
    """Each query's k best distinct ids."""
    q, i, s = np.concatenate(held, axis=1)
    s = s.view(np.float64)
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1])) if len(q) else np.zeros(0, bool)
    q, i, s = q[first], i[first], s[first]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    keep = rank < k
    return np.stack([q[keep], i[keep], s[keep].view(np.int64)])


def batch_of(held: list[np.ndarray]) -> pa.RecordBatch:
    q, i, s = np.concatenate(held, axis=1)
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(i), pa.array(np.ascontiguousarray(s).view(np.float64))], names=["query_id", "vec_id", "score"])
