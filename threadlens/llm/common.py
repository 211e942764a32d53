"""Shared helpers of the training-data operators.

* ``map_arrow``: run a function over Arrow batches (the package is shipped to
  the executors first).
* ``text_parts``: one string column as numpy bytes + offsets, cut into parts of a
  few MB so that the working memory of a task does not depend on the batch.
* ``find_words`` / ``hash_words``: word spans and 64-bit word hashes of a whole
  part at once (no Python loop over words).
* ``id_splitters`` / ``with_block``: cut the rows into blocks of consecutive
  ``doc_id`` holding about the same number of bytes. Block numbers follow the
  ``doc_id`` order, rows with a null id come first.
"""

from __future__ import annotations

import ctypes
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package

PART_BYTES = 2_000_000
U64 = np.uint64


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema) -> DataFrame:
    ship_package(df.sparkSession)

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return freed memory to the system when a task ends: a worker lives on for the next
    stages, and what its allocators keep would count against the executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim is not None:
        trim(0)


_gave_back = 0.0


def _after_group() -> None:
    """As ``give_back``, but ten times a second at most: groups may be small and many."""
    global _gave_back
    now = time.monotonic()
    if now - _gave_back > 0.1:
        _gave_back = now
        give_back()


def per_group(fn: Callable[[pa.Table], pa.Table]):
    """``fn`` for ``applyInArrow`` on one grouping, giving back what a group leaves free."""
    def run(table):
        try:
            return fn(table)
        finally:
            _after_group()
    return run


def per_pair(fn: Callable[[pa.Table, pa.Table], pa.Table]):
    """The same for two cogrouped sides."""
    def run(left, right):
        try:
            return fn(left, right)
        finally:
            _after_group()
    return run


def arrow_batch(schema: list[tuple[str, pa.DataType]], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, pa.Array) else pa.array(c, type=t) for (_, t), c in zip(schema, columns)],
        names=[n for n, _ in schema])


def int_column(batch, name: str) -> pa.Array:
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
        col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)
    return col.cast(pa.int64())


def text_column(batch, name: str = "text") -> pa.Array:
    """The column as large_binary without nulls (a null text counts as empty)."""
    col = batch.column(batch.schema.get_field_index(name))
    if isinstance(col, pa.ChunkedArray):
        col = pa.chunked_array([c.cast(pa.large_binary()) for c in col.chunks], pa.large_binary()).combine_chunks()
        col = col if isinstance(col, pa.Array) else pa.concat_arrays(col.chunks)
    return pc.fill_null(col.cast(pa.large_binary()), b"")


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array; offsets start at 0."""
    _, off, data = col.buffers()
    offs = np.frombuffer(off, dtype=np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def text_parts(col: pa.Array, max_bytes: int = PART_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``max_bytes``
    (a longer text is a run of its own; no text is cut)."""
    if len(col) == 0:
        return
    raw, offs = buffers(col)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield lo, hi, raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


# --- words ----------------------------------------------------------------

def byte_class(members) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(members)] = True
    return table


#: words [^\x20\x09-\x0D]+
NON_SPACE = ~byte_class([0x20, *range(0x09, 0x0E)])
#: words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ once A-Z is lower case
WORD_BYTES = byte_class([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64 constants)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
_TABLE_LOWER = _TABLE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, (n - 1).bit_length())
        have = np.full(size, U64(base), dtype=U64)
        have[0] = 1
        with np.errstate(over="ignore"):
            np.cumprod(have, out=have)
        _powers[base] = have
    return have


def find_words(raw: np.ndarray, offs: np.ndarray, members: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte) of every word and the word offsets of each row."""
    if len(raw) == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = members[raw]
    before = np.empty_like(inside)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = offs[:-1]
    before[firsts[firsts < len(raw)]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[-1] = False
    after[:-1] = inside[1:]
    lasts = offs[1:]
    after[lasts[lasts > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hash_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of every word (polynomial over per-byte random values, mixed)."""
    table = _TABLE_LOWER if lower else _TABLE
    out = np.empty(len(starts), dtype=U64)
    lo = 0
    while lo < len(starts):
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PART_BYTES, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        total = np.zeros(b - a + 1, dtype=U64)
        np.cumsum(table[raw[a:b]] * _power(_BASE, b - a)[:b - a], out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = mix((total[e] - total[s]) * _power(_INV, b - a + 1)[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93))
        lo = hi
    return out


def window_hashes(h: np.ndarray, length: int, base: int = 0xC2B2AE3D27D4EB4F) -> np.ndarray:
    """Polynomial hash of ``length`` consecutive word hashes, for every start that
    fits into the array (windows across rows are masked by the caller)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(length):
        out += h[j:j + n] * U64(pow(base, j, 1 << 64))
    return out


def window_starts(word_offs: np.ndarray, length: int) -> np.ndarray:
    """Boolean per word: a window of ``length`` words of the same row starts here."""
    n = int(word_offs[-1])
    left = np.repeat(word_offs[1:], np.diff(word_offs)) - np.arange(n)
    return left >= length


# --- blocks of consecutive ids ---------------------------------------------

def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """(rows, text bytes): one aggregate over the whole table."""
    r = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text").cast("long")).alias("b")).first()
    return int(r.n), int(r.b or 0)


def id_splitters(docs: DataFrame, block_bytes: int, max_points: int = 8192) -> list[int]:
    """Ascending ids that cut the table into blocks of about ``block_bytes`` of text.

    Quantiles of the ids over all rows give fine slices, whose exact bytes are then
    counted and merged up to the target. Beyond ``max_points`` slices each slice is
    cut evenly by id. Only the slice table (bounded) reaches the driver; it decides
    balance, never results."""
    n, total = corpus_size(docs)
    blocks = max(1, -(-total // block_bytes), -(-n // 2_000_000))
    points = int(min(max_points, 8 * blocks))
    if points <= 8 or n == 0:
        return []
    q = docs.agg(F.percentile_approx("doc_id", [i / points for i in range(1, points)], 20 * points).alias("q")).first().q
    edges = sorted(set(int(x) for x in q or []))
    if not edges:
        return []
    sizes = with_block(docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).cast("long").alias("_b")), edges) \
        .groupBy("_blk").agg(F.sum("_b").alias("b")).collect()
    by = {r["_blk"]: r["b"] for r in sizes}
    target, held, out = max(1, sum(by.values()) // blocks), 0, []
    for i, edge in enumerate(edges):
        held += by.get(i, 0)
        pieces = held // target
        if pieces >= 1:
            low = out[-1] if out else (edges[i - 1] if i else edge)
            out += [low + (edge - low) * j // pieces for j in range(1, pieces)] + [edge]
            held = 0
    return sorted(set(out))


def with_block(docs: DataFrame, splitters: list[int], name: str = "_blk") -> DataFrame:
    """Add the block number: how many splitters are <= doc_id (null id: block 0)."""
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.IntegerType())])
    edges = np.asarray(splitters, dtype=np.int64)

    def add(batches):
        for batch in batches:
            ids = int_column(batch, "doc_id")
            blk = np.searchsorted(edges, pc.fill_null(ids, -2**63).to_numpy(zero_copy_only=False), side="right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(blk, pa.int32())], names=[*batch.schema.names, name])

    return map_arrow(docs, add, schema)


def pack_by(df: DataFrame, key: str = "_blk") -> DataFrame:
    """(key, _pack): the other columns' rows, per batch and key value as one compressed
    Arrow stream. Texts of one language shrink far better together than row by row, so an
    exchange of packs moves and stores a fraction of the bytes."""
    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index(key)
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            rest = pa.RecordBatch.from_arrays([c for k, c in enumerate(batch.columns) if k != at],
                                              names=[n for k, n in enumerate(batch.schema.names) if k != at])
            order = np.argsort(keys, kind="stable")
            cuts = np.flatnonzero(np.diff(keys[order])) + 1
            for rows in np.split(order, cuts) if len(keys) else []:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, rest.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rest.take(pa.array(rows)))
                yield pa.RecordBatch.from_arrays([pa.array([keys[rows[0]]], pa.int32()),
                                                  pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[key, "_pack"])

    return map_arrow(df, run, f"{key} int, _pack binary")


def unpack(table: pa.Table) -> pa.Table:
    """The rows of a group of packs."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_py()).read_all() for x in table["_pack"]])


# --- columns that only pass through -----------------------------------------

def sealed(docs: DataFrame, own: tuple[str, ...] = ("doc_id", "text")):
    """(``docs`` with every column outside ``own`` under a neutral name, restore).
    ``restore(df, added)`` gives the columns their names back; an input column named
    like an added one is replaced by it. So no input name can clash with a helper's."""
    inner = {n: n if n in own else f"x{i}" for i, n in enumerate(docs.columns)}

    def restore(df: DataFrame, added: tuple[str, ...] = ()) -> DataFrame:
        return df.select(*[F.col(c).alias(n) for n, c in inner.items() if n not in added], *added)

    return docs.select(*[F.col(f"`{n}`").alias(c) for n, c in inner.items()]), restore
