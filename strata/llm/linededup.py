"""Line dedup with two Bloom filters.

One pass over the texts hashes every line; a filter of once-seen hashes and a filter of twice-seen hashes are built from
them, in shards by the hash's first bits, so that no task holds more than its share. A line outside the twice-seen filter
is in one document only and never leaves its partition. Lines inside it are suspects: their keys, counted per partition
first, shuffle for the exact count and the choice of the first occurrence.

A key is the line with ASCII white space stripped at both ends and A-Z lower-cased. Every row counts as a document of its
own. Cases: a null or empty text is one empty line; empty keys never count as repeats; of equal first occurrences the
smallest id wins (null ids last), then the lowest line; rows repeated with the same id and text get the same result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import ASCII_SPACE, materialize, no_clash

#: Bits of the twice-seen filter for each distinct line, and the most that the filter may take. Beyond that, more lines are
#: suspects by chance and shuffle for nothing; results stay the same.
BITS_PER_LINE = 16
MAX_FILTER_BYTES = 32 << 20
#: Hashes that a task gathers before it hands them on, and keys that it counts at once.
FLUSH_HASHES = 1 << 20
FLUSH_KEYS = 1 << 17
#: Repeated keys go to every executor as a set up to these sizes; beyond, they meet the lines in a shuffled join.
MAX_SHIPPED_KEYS = 200_000
MAX_SHIPPED_BYTES = 16 << 20
HASHED_BITS = 4


def keys_of(raw: bytes) -> list[bytes]:
    return [line.strip(ASCII_SPACE) for line in raw.lower().split(b"\n")]


def raw_of(value: pa.Scalar) -> bytes:
    return value.as_buffer().to_pybytes() if value.is_valid else b""


def hash_of(key: bytes) -> int:
    return xxhash.xxh3_64_intdigest(key)


def masks(hashes: np.ndarray) -> np.ndarray:
    """The bits of a hash within its 64-bit block."""
    out = np.zeros(len(hashes), np.uint64)
    for k in range(HASHED_BITS):
        out |= np.uint64(1) << ((hashes >> np.uint64(6 * k)) & np.uint64(63))
    return out


def in_filter(words: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    shift = np.uint64(64 - int(len(words)).bit_length() + 1)
    mask = masks(hashes)
    return (words[(hashes >> shift).astype(np.int64)] & mask) == mask


def _hash_pass(docs: DataFrame, text_col: str, shard_bits: int) -> DataFrame:
    """Each task's distinct line hashes by shard, and which of them it saw in two documents or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []

        def flush() -> pa.RecordBatch:
            hashes, counts = np.unique(np.array(held, np.uint64), return_counts=True)
            held.clear()
            twice = hashes[counts > 1]
            shard = np.arange(1 << shard_bits, dtype=np.uint64) << np.uint64(64 - shard_bits)
            a, b = np.append(np.searchsorted(hashes, shard), len(hashes)), np.append(np.searchsorted(twice, shard), len(twice))
            full = np.flatnonzero(np.diff(a))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(full, pa.int32()),
                    pa.array(np.diff(a)[full], pa.int64()),
                    pa.array([hashes[a[k] : a[k + 1]].tobytes() for k in full], pa.binary()),
                    pa.array([twice[b[k] : b[k + 1]].tobytes() for k in full], pa.binary()),
                ],
                names=["shard", "n", "once", "twice"],
            )

        for batch in batches:
            for value in batch.column(0):
                keys = set(keys_of(raw_of(value)))
                keys.discard(b"")
                held += map(hash_of, keys)
                if len(held) >= FLUSH_HASHES:
                    yield flush()
        if held:
            yield flush()

    return docs.select(text_col).mapInArrow(run, "shard int, n bigint, once binary, twice binary")


def twice_seen(docs: DataFrame, text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> np.ndarray:
    """The twice-seen filter over all lines: 64-bit blocks, chosen by a hash's first bits; at most ``max_filter_bytes``."""
    shard_bits = max(6, min(16, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")).bit_length() + 1))
    hashed = materialize(_hash_pass(docs, text_col, shard_bits), "lines")
    total = hashed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    words = 1 << max(shard_bits, (total * BITS_PER_LINE // 64).bit_length())
    words = min(words, 1 << max(shard_bits, (max_filter_bytes // 8).bit_length() - 1))
    shift = np.uint64(64 - words.bit_length() + 1)

    def build(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        once, twice = np.zeros(words >> shard_bits, np.uint64), np.zeros(words >> shard_bits, np.uint64)
        first = np.int64(shard) * len(once)
        for seen, again in zip(group["once"], group["twice"], strict=True):
            hashes = np.frombuffer(seen.as_buffer(), np.uint64)
            at, mask = (hashes >> shift).astype(np.int64) - first, masks(hashes)
            hit = (once[at] & mask) == mask
            np.bitwise_or.at(twice, at[hit], mask[hit])
            np.bitwise_or.at(once, at, mask)
            hashes = np.frombuffer(again.as_buffer(), np.uint64)
            np.bitwise_or.at(twice, (hashes >> shift).astype(np.int64) - first, masks(hashes))
        return pa.table({"shard": pa.array([shard], pa.int32()), "words": pa.array([twice.tobytes()], pa.binary())})

    out = np.zeros(words, np.uint64)
    size = words >> shard_bits
    for row in hashed.groupBy("shard").applyInArrow(build, "shard int, words binary").toLocalIterator():
        out[row["shard"] * size : (row["shard"] + 1) * size] = np.frombuffer(row["words"], np.uint64)
    return out


def repeated_keys(docs: DataFrame, words: np.ndarray, min_docs: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact keys in at least ``min_docs`` documents: ``key, n_docs, first`` with the first occurrence's id and line."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(seen), pa.binary()), pa.array([v[0] for v in seen.values()], pa.int64()), pa.array([v[1][0] for v in seen.values()], pa.bool_()), pa.array([v[1][1] for v in seen.values()], ids), pa.array([v[1][2] for v in seen.values()], pa.int64())],
                names=["key", "n", "no_id", "id", "line"],
            )
            seen.clear()
            return out

        for batch in batches:
            ids = batch.schema.field(0).type
            for who, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own: dict[bytes, int] = {}
                for k, key in enumerate(keys_of(raw_of(value))):
                    own.setdefault(key, k)
                own.pop(b"", None)
                if not own:
                    continue
                keys = list(own)
                for k in np.flatnonzero(in_filter(shipped.value, np.fromiter(map(hash_of, keys), np.uint64, len(keys)))):
                    key = keys[k]
                    at = (who is None, who, own[key])
                    if (found := seen.get(key)) is None:
                        seen[key] = [1, at]
                    else:
                        found[0] += 1
                        if at[0] < found[1][0] or at[0] == found[1][0] and (at[0] and at[2] < found[1][2] or not at[0] and at[1:] < found[1][1:]):
                            found[1] = at
                if len(seen) >= FLUSH_KEYS:
                    yield flush()
        if seen:
            yield flush()

    counted = docs.select(id_col, text_col).mapInArrow(run, f"key binary, n bigint, no_id boolean, id {id_type}, line bigint")
    grouped = counted.groupBy("key").agg(F.sum("n").alias("n_docs"), F.min(F.struct("no_id", "id", "line")).alias("first"))
    return grouped.where(F.col("n_docs") >= min_docs)


def dedup_lines(docs: DataFrame, min_docs: int = 10, keep: str = "none", id_col: str = "doc_id", text_col: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES, max_shipped_keys: int = MAX_SHIPPED_KEYS, carry: tuple[str, ...] = ()) -> DataFrame:
    """Drop lines whose key is in at least ``min_docs`` documents: all of them, or (``keep='first'``) all but the first.

    Returns ``id_col, kept, n_lines, n_dropped, kept_sha256`` for every row, with the columns named in ``carry`` after the
    id; ``kept`` is the text that stays.
    """
    if keep not in ("none", "first"):
        raise ValueError("keep is 'none' or 'first'")
    no_clash([id_col, *carry], "kept", "n_lines", "n_dropped", "kept_sha256")
    words = twice_seen(docs, text_col, max_filter_bytes)
    found = materialize(repeated_keys(docs, words, min_docs, id_col, text_col), "repeats")
    n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.length("key")), F.lit(0))).first()
    if n <= max_shipped_keys and size <= MAX_SHIPPED_BYTES:
        first = {bytes(r["key"]): ((r["first"]["id"], r["first"]["line"]) if keep == "first" else None) for r in found.toLocalIterator()}
        return _drop_known(docs, first, keep, id_col, text_col, carry)
    return _drop_joined(docs, found, words, keep, id_col, text_col, carry)


def _result_schema(docs: DataFrame, lead: list[str]) -> str:
    return ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in lead) + ", kept string, n_lines bigint, n_dropped bigint, kept_sha256 string"


def _result_batch(lead: list[str], columns: list, rows: list[tuple[bytes, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [*columns, pa.array([r[0] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([hashlib.sha256(r[0]).hexdigest() for r in rows], pa.string())],
        names=[*lead, "kept", "n_lines", "n_dropped", "kept_sha256"],
    )


def _drop_known(docs: DataFrame, first: dict, keep: str, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast(first)
    lead = [id_col, *carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = shipped.value
        for batch in batches:
            rows = []
            for who, value in zip(batch.column(0).to_pylist(), batch.column(len(lead)), strict=True):
                raw = raw_of(value)
                keys = keys_of(raw)
                drop = [k for k, key in enumerate(keys) if key in first and (keep == "none" or first[key] != (who, k))]
                if drop:
                    gone = set(drop)
                    raw = b"\n".join([x for k, x in enumerate(raw.split(b"\n")) if k not in gone])
                rows.append((raw, len(keys), len(drop)))
            yield _result_batch(lead, batch.columns[: len(lead)], rows)

    return docs.select(*lead, F.col(text_col).alias("__text")).mapInArrow(run, _result_schema(docs, lead))


def _drop_joined(docs: DataFrame, found: DataFrame, words: np.ndarray, keep: str, id_col: str, text_col: str, carry: tuple[str, ...]) -> DataFrame:
    """For more repeated keys than one task should hold: suspects meet them in a join, then each text its lines to drop."""
    shipped = docs.sparkSession.sparkContext.broadcast(words)
    kind = docs.schema[id_col].dataType.simpleString()

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for who, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = raw_of(value)
                keys = keys_of(raw)
                inside = in_filter(shipped.value, np.fromiter(map(hash_of, keys), np.uint64, len(keys)))
                out += [(who, xxhash.xxh3_128_digest(raw), keys[k], int(k)) for k in np.flatnonzero(inside) if keys[k]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], batch.schema.field(0).type), *(pa.array([x[k] for x in out], t) for k, t in ((1, pa.binary()), (2, pa.binary()), (3, pa.int64())))], names=["who", "mark", "key", "at"])

    lines = docs.select(id_col, text_col).mapInArrow(suspects, f"who {kind}, mark binary, key binary, at bigint").join(found, "key")
    if keep == "first":
        lines = lines.where(~(F.col("who").eqNullSafe(F.col("first.id")) & (F.col("at") == F.col("first.line"))))
    drops = lines.groupBy("who", "mark").agg(F.collect_set("at").alias("drops"))

    lead = [id_col, *carry]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = pa.array([xxhash.xxh3_128_digest(raw_of(v)) for v in batch.column(len(lead))], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, marks], names=[*(f"c{k}" for k in range(len(lead))), "text", "mark"])

    fields = ", ".join(f"c{k} {docs.schema[c].dataType.simpleString()}" for k, c in enumerate(lead))
    texts = docs.select(*lead, F.col(text_col).alias("__text")).mapInArrow(mark, f"{fields}, text string, mark binary")
    both = texts.alias("t").join(drops.alias("d"), F.col("t.c0").eqNullSafe(F.col("d.who")) & (F.col("t.mark") == F.col("d.mark")), "left")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, drop in zip(batch.column(len(lead)), batch.column(len(lead) + 1).to_pylist(), strict=True):
                parts, gone = raw_of(value).split(b"\n"), set(drop or ())
                rows.append((b"\n".join([x for k, x in enumerate(parts) if k not in gone]), len(parts), len(gone)))
            yield _result_batch(lead, batch.columns[: len(lead)], rows)

    return both.select(*(f"t.c{k}" for k in range(len(lead))), "t.text", "d.drops").mapInArrow(apply, _result_schema(docs, lead))
