"""Substring dedup (operator 8): level-wise doubling.

A window of 20 words can only be repeated if both of its halves are, and those
only if both of their halves are. So windows of 5 words are counted first; only
where two adjacent ones are both repeated is a window of 10 words tried, and only
where two adjacent repeated ones meet is a window of 20. At the last length the
question is no longer "repeated?" but "does it start earlier?".

Shape of the job (one plan; the text is exchanged once and that exchange reused):

* Rows are cut into blocks of consecutive ``doc_id``; block numbers follow the id
  order. A block hashes its candidate windows, keeps each distinct hash once
  (so a passage held by a third of all rows is one entry per block) and sends
  sorted, packed arrays to hash shards: 4 bytes a window at the lower levels
  (a collision there only keeps a candidate), 8 bytes plus the shard bits of a
  second hash at the last.
* A shard answers every block with one bit per entry: present in another block
  (lower levels), or present in an earlier block (last level).
* The block joins the bits with what it knows itself and goes on to twice the length.

Defined results: null or empty text has no words and stays as it is; a text of
under 20 words is never changed; rows that share a ``doc_id`` (or have none: they
come first) are ordered by their text; all columns pass through. Windows are
judged on the input. The hash of a window has 64 + log2(shards) bits.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import ship_package
from .common import (NON_SPACE, U64, corpus_size, documents, find_words, hash_words, id_splitters, int_column, mix, per_group, per_pair,
                     sealed, text_column, text_parts, window_hashes, window_starts, with_block)

WINDOW = 20
FIRST = 5
BLOCK_BYTES = 8_000_000
SHARD_WINDOWS = 2_000_000
_SECOND = 0x165667B19E3779F9

_SENT = "_blk int, _level int, _shard int, _vals binary"
_BITS = "_blk int, _level int, _shard int, _n int, _bits binary"
_SENT_PA = pa.schema([("_blk", pa.int32()), ("_level", pa.int32()), ("_shard", pa.int32()), ("_vals", pa.binary())])
_BITS_PA = pa.schema([("_blk", pa.int32()), ("_level", pa.int32()), ("_shard", pa.int32()), ("_n", pa.int32()),
                      ("_bits", pa.binary())])


def _ordered(table: pa.Table) -> pa.Table:
    """Rows by (doc_id, text), so that starts follow the order of the contract."""
    ids = pc.fill_null(int_column(table, "doc_id"), -2**63).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    same = np.flatnonzero(ids[order][1:] == ids[order][:-1])
    if len(same):
        texts = text_column(table)
        keys = [(int(ids[i]), hashlib.sha256(texts[int(i)].as_py()).digest()) for i in order]
        order = order[sorted(range(len(order)), key=keys.__getitem__)]
    return table.take(pa.array(order))


class _Block:
    """Word hashes of a block and, level by level, which windows are candidates."""

    def __init__(self, table: pa.Table, bits: int, first: int, window: int):
        self.bits, self.window = bits, window
        hashes, counts = [], []
        for _, _, raw, offs in text_parts(text_column(table)):
            s, e, w = find_words(raw, offs, NON_SPACE)
            hashes.append(hash_words(raw, s, e))
            counts.append(np.diff(w))
        self.counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        self.word_offs = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        self.h = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        self.length = first
        self.win = window_hashes(self.h, first)
        self.win2 = window_hashes(self.h, first, _SECOND)
        self.at = np.flatnonzero(window_starts(self.word_offs, first)[:len(self.win)])

    def keys(self) -> tuple[np.ndarray, np.ndarray | None]:
        """Sort keys of the candidates: (shard bits + value) at the lower levels,
        (shard, 64-bit value) at the last."""
        if self.length < self.window:
            return mix(self.win[self.at]) >> U64(32 - self.bits), None
        return mix(self.win[self.at]), (mix(self.win2[self.at]) >> U64(1)) >> U64(63 - self.bits)

    def distinct(self):
        """(values, shard of each value, index of each candidate's value, first
        candidate of each value, how often it occurs)."""
        key, shard = self.keys()
        if shard is None:
            vals, first, inv, cnt = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
            return (vals & U64(0xFFFFFFFF)).astype(np.uint32), (vals >> U64(32)).astype(np.int64), inv, first, cnt
        order = np.lexsort((np.arange(len(key)), key, shard))
        k, s = key[order], shard[order]
        new = np.ones(len(k), dtype=bool)
        new[1:] = (k[1:] != k[:-1]) | (s[1:] != s[:-1])
        group = np.cumsum(new) - 1
        inv = np.empty(len(k), dtype=np.int64)
        inv[order] = group
        heads = np.flatnonzero(new)
        return k[heads], s[heads].astype(np.int64), inv, order[heads], np.diff(np.append(heads, len(k)))

    def send(self, blk: int, level: int) -> pa.Table:
        vals, shard, *_ = self.distinct()
        ids, at = np.unique(shard, return_index=True)
        ends = np.append(at[1:], len(vals))
        return pa.table([pa.array(np.full(len(ids), blk), pa.int32()), pa.array(np.full(len(ids), level), pa.int32()),
                         pa.array(ids, pa.int32()), pa.array([vals[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())],
                        schema=_SENT_PA)

    def flags(self, replies: pa.Table, level: int) -> np.ndarray:
        """One flag per distinct value, in value order (replies by shard)."""
        rows = replies.filter(pc.equal(replies["_level"], level)).sort_by("_shard").to_pylist()
        parts = [np.unpackbits(np.frombuffer(r["_bits"], np.uint8), count=r["_n"]) for r in rows]
        return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)

    def grow(self, replies: pa.Table, level: int) -> None:
        """Keep windows repeated at this length and double: both halves must be."""
        _, _, inv, _, cnt = self.distinct()
        repeated = np.zeros(len(self.win) + 1, dtype=bool)
        repeated[self.at] = (self.flags(replies, level) | (cnt > 1))[inv] if len(self.at) else False
        n = max(0, len(self.h) - 2 * self.length + 1)
        half = self.length
        self.win = self.win[:n] + self.win[half:half + n] * U64(pow(0xC2B2AE3D27D4EB4F, half, 1 << 64))
        self.win2 = self.win2[:n] + self.win2[half:half + n] * U64(pow(_SECOND, half, 1 << 64))
        self.length = 2 * half
        fits = window_starts(self.word_offs, self.length)[:n]
        self.at = np.flatnonzero(fits & repeated[:n] & repeated[half:half + n])

    def removed(self, replies: pa.Table, level: int) -> np.ndarray:
        """Words covered by a window whose words also start earlier."""
        cover = np.zeros(len(self.h) + 1, dtype=np.int64)
        if len(self.at):
            _, _, inv, first, _ = self.distinct()
            later = self.flags(replies, level)[inv]
            later |= first[inv] != np.arange(len(self.at))
            hit = self.at[later]
            np.add.at(cover, hit, 1)
            np.add.at(cover, hit + self.window, -1)
        return np.cumsum(cover)[:-1] > 0


def _answer(table: pa.Table, last: bool) -> pa.Table:
    """One shard: bits for every block that sent values."""
    table = table.sort_by("_blk")
    kind = np.uint64 if last else np.uint32
    raw = [np.frombuffer(x.as_py(), kind) for x in table["_vals"]]
    vals = np.concatenate(raw)
    order = np.argsort(vals, kind="stable")
    s = vals[order]
    same = np.zeros(len(s) + 1, dtype=bool)
    same[1:-1] = s[1:] == s[:-1]
    flag = np.empty(len(s), dtype=bool)
    flag[order] = same[:-1] if last else same[:-1] | same[1:]
    ends = np.cumsum([len(r) for r in raw])
    bits = [np.packbits(flag[e - len(r):e]).tobytes() for r, e in zip(raw, ends)]
    return pa.table([table["_blk"].combine_chunks(), table["_level"].combine_chunks(), table["_shard"].combine_chunks(),
                     pa.array([len(r) for r in raw], pa.int32()), pa.array(bits, pa.binary())], schema=_BITS_PA)


def repeated_words(docs: DataFrame, finish, schema, window: int = WINDOW, first: int = FIRST,
                   block_bytes: int = BLOCK_BYTES, shard_windows: int = SHARD_WINDOWS) -> DataFrame:
    """Run the levels and call ``finish(block table, word offsets, removed mask)``
    per block. ``window`` must be ``first`` times a power of two."""
    if window < first or window % first or (window // first) & (window // first - 1):
        raise ValueError("window must be first * 2**k")
    spark = docs.sparkSession
    ship_package(spark)
    _, total = corpus_size(docs)
    bits = min(31, max(2, int(np.ceil(np.log2(max(1, total / 6 / shard_windows))))))
    splitters = id_splitters(docs, block_bytes)
    blocks = with_block(docs, splitters)
    steps = (window // first).bit_length()

    def upto(table, replies, level):
        b = _Block(_ordered(table), bits, first, window)
        for k in range(level):
            b.grow(replies, k)
        return b

    def sender(level):
        def send(table):
            return upto(table, None, 0).send(table["_blk"][0].as_py(), 0)

        def send_after(table, replies):
            if table.num_rows == 0:
                return _SENT_PA.empty_table()
            return upto(table, replies, level).send(table["_blk"][0].as_py(), level)
        return per_pair(send_after) if level else per_group(send)

    def shard(last):
        def answer(table):
            return _answer(table, last)
        return per_group(answer)

    answers = None
    for level in range(steps):
        grouped = blocks.groupBy("_blk")
        if level:
            grouped = grouped.cogroup(answers.groupBy("_blk"))
        reply = grouped.applyInArrow(sender(level), _SENT).groupBy("_shard").applyInArrow(shard(level == steps - 1), _BITS)
        answers = answers.unionByName(reply) if level else reply

    out = T._parse_datatype_string(schema) if isinstance(schema, str) else schema

    empty = to_arrow_schema(out).empty_table()

    def end(table, replies):
        if table.num_rows == 0:
            return empty
        table = _ordered(table)
        b = _Block(table, bits, first, window)
        for k in range(steps - 1):
            b.grow(replies, k)
        return finish(table, b.word_offs, b.removed(replies, steps - 1))

    return blocks.groupBy("_blk").cogroup(answers.groupBy("_blk")).applyInArrow(per_pair(end), out)


def _kept(text: bytes, gone: np.ndarray) -> bytes:
    words = text.split()
    return b" ".join(compress(words, ~gone) if gone.any() else words)


def drop_repeats(docs: DataFrame, **kw) -> DataFrame:
    """The documents with repeated words removed from ``text`` (kept words joined
    by one space); texts without a repeat, and all other columns, unchanged."""
    docs, restore = sealed(docs)
    names = docs.columns

    def finish(table, offs, gone):
        col = text_column(table)
        plain = table["text"].combine_chunks()
        plain = plain if isinstance(plain, pa.Array) else pa.concat_arrays(plain.chunks)
        texts = [None] * table.num_rows
        for i in range(table.num_rows):
            g = gone[offs[i]:offs[i + 1]]
            texts[i] = _kept(col[i].as_py(), g).decode() if g.any() else plain[i].as_py()
        cols = [pa.array(texts, plain.type) if n == "text" else table[n] for n in names]
        return pa.table(cols, names=names)

    return restore(repeated_words(docs, finish, docs.schema, **kw))


_REPORT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def repeat_report(docs: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256."""
    def finish(table, offs, gone):
        col = text_column(table)
        total = np.concatenate([[0], np.cumsum(gone)])
        sha = [hashlib.sha256(_kept(col[i].as_py(), gone[offs[i]:offs[i + 1]])).hexdigest() for i in range(table.num_rows)]
        return pa.table([int_column(table, "doc_id"), pa.array(np.diff(offs), pa.int64()),
                         pa.array(total[offs[1:]] - total[offs[:-1]], pa.int64()), pa.array(sha, pa.string())],
                        names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return repeated_words(docs.select("doc_id", "text"), finish, _REPORT, **kw)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_report(documents(spark, sf_dir))
