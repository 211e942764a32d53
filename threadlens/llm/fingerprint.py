"""Document fingerprints (operator 1): quartile bucket digest.

Byte triplets (a byte with two later ones, four pairs of distances up to 31 bytes,
running round the end of the text) are hashed by xor of per-position random tables and
counted in 1,024 buckets. The digest holds each bucket's quartile among the buckets of
its text (2 bits) and the text's length on a logarithmic scale. Wide triplets span
several syllables, so two texts of one language differ as two texts do.

Difference of two digests: per bucket 0, 1, 2, or 6 for opposite quartiles; per
quarter octave of length beyond three, 24, ten steps at most; bounded by what two
unrelated digests reach on average (1.625 a bucket). Likeness = 1 - difference / bound.

``edited_report`` needs each document's successor by descending id: blocks of
consecutive ids (one exchange of the text) hold it for all documents but the last of a
block, whose successor is sent along as a copy; which ids those are is a table of one
row per block.

Defined results: a null text counts as empty, whose buckets are all 0 (its likeness to
another empty text is 1); rows of one id are ordered by their text; a null id comes
last; a single document is its own successor; extra columns are not used.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, documents, id_splitters, int_column, map_arrow, mix, sealed, text_column, text_parts, with_block

BUCKETS = 1024
DISTANCES = ((7, 16), (9, 23), (11, 29), (13, 31))
BOUND = 1.625 * BUCKETS
BLOCK_BYTES = 4_000_000
_TABLES = [(mix(np.arange(k << 8, (k + 1) << 8, dtype=U64)) & U64(BUCKETS - 1)).astype(np.int64) for k in range(3 * len(DISTANCES))]
_COST = np.array([0, 1, 2, 6])


def digests(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x buckets quartile codes, length code per row)."""
    n = np.diff(offs)
    counts = np.zeros((len(n), BUCKETS), np.int32)
    step = max(1, 600_000 // max(1, int(n.mean()) if len(n) else 1))
    for lo in range(0, len(n), step):
        hi = min(len(n), lo + step)
        part, o = raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        row = np.repeat(np.arange(hi - lo), n[lo:hi])
        start, size = o[:-1][row], n[lo:hi][row]
        at = np.arange(len(part)) - start
        for k, (x, y) in enumerate(DISTANCES):
            b = _TABLES[3 * k][part]
            for t, d in ((1, x), (2, y)):
                j = at + d
                over = j >= size
                j[over] %= size[over]
                b ^= _TABLES[3 * k + t][part[start + j]]
            b += row * BUCKETS
            counts[lo:hi] += np.bincount(b, minlength=(hi - lo) * BUCKETS).reshape(-1, BUCKETS).astype(np.int32)
    q = np.partition(counts, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1) if len(n) else counts
    code = sum((counts > q[:, [k * BUCKETS // 4 - 1]]).astype(np.uint8) for k in (1, 2, 3)) if len(n) else counts.astype(np.uint8)
    return code, np.minimum(255, np.round(4 * np.log2(n + 1))).astype(np.int64)


def to_string(code: np.ndarray, length: np.ndarray) -> list[str]:
    quads = code.reshape(len(code), -1, 4)
    packed = (quads[..., 0] | quads[..., 1] << 2 | quads[..., 2] << 4 | quads[..., 3] << 6).astype(np.uint8)
    return [f"{int(v):02x}{p.tobytes().hex()}" for v, p in zip(length, packed)]


def from_string(digest: str) -> tuple[np.ndarray, int]:
    packed = np.frombuffer(bytes.fromhex(digest[2:]), np.uint8)
    return np.stack([packed >> s & 3 for s in (0, 2, 4, 6)], 1).ravel(), int(digest[:2], 16)


def likeness(a: np.ndarray, a_len, b: np.ndarray, b_len) -> np.ndarray:
    """Row by row, 0 to 1."""
    body = _COST[np.abs(a.astype(np.int8) - b.astype(np.int8))].sum(axis=-1)
    beyond = np.clip(np.abs(np.asarray(a_len) - np.asarray(b_len)) - 3, 0, 10)
    return 1.0 - np.minimum(body + 24 * beyond, BOUND) / BOUND


def _digest_column(col: pa.Array):
    codes, lengths = [np.zeros((0, BUCKETS), np.uint8)], [np.zeros(0, np.int64)]
    for _, _, raw, offs in text_parts(col, 1_000_000):
        c, n = digests(raw, offs)
        codes.append(c)
        lengths.append(n)
    return np.concatenate(codes), np.concatenate(lengths)


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``fingerprint`` (an input column of that name is replaced)."""
    kept, restore = sealed(docs)
    names = [*kept.columns, "fingerprint"]

    def run(batches):
        for batch in batches:
            col = text_column(batch)
            for lo, hi, raw, offs in text_parts(col, 1_000_000):
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(to_string(*digests(raw, offs)))], names=names)

    schema = T.StructType([*kept.schema.fields, T.StructField("fingerprint", T.StringType())])
    return restore(map_arrow(kept, run, schema), ("fingerprint",))


def _with_successors(docs: DataFrame, block_bytes: int) -> DataFrame:
    """Rows with their block, and for every block a copy of its last row's successor."""
    edges = id_splitters(docs, block_bytes)
    top = with_block(docs.select("doc_id"), edges).groupBy("_blk").agg(
        F.max(F.coalesce("doc_id", F.lit(-2**63).cast("long"))).alias("top")).collect()
    tops = {r["_blk"]: r["top"] for r in top}
    blocks = sorted(tops)
    goes: dict[int, int] = {}  # id -> the block whose last row it follows
    for k, blk in enumerate(blocks):
        goes[tops[blocks[k - 1]]] = blk  # the lowest block is followed by the highest id
    cuts = np.asarray(edges, np.int64)
    ids_of = np.array(sorted(goes), np.int64)
    to = np.array([goes[i] for i in ids_of.tolist()], np.int32)

    def run(batches):
        for batch in batches:
            ids = pc.fill_null(int_column(batch, "doc_id"), -2**63).to_numpy(zero_copy_only=False)
            blk = np.searchsorted(cuts, ids, side="right").astype(np.int32)
            at = np.minimum(np.searchsorted(ids_of, ids), len(ids_of) - 1)
            copy = np.flatnonzero(ids_of[at] == ids)
            for rows, b, extra in ((np.arange(len(ids)), blk, False), (copy, to[at[copy]], True)):
                part = batch.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(b, pa.int32()), pa.array(np.full(len(rows), extra))],
                                                 names=["doc_id", "text", "_blk", "_copy"])

    return map_arrow(docs, run, "doc_id long, text string, _blk int, _copy boolean")


_REPORT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
           "near_edited double, near_next double")


def edited_report(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Fingerprints of every text and of its edit (last third replaced by the start of
    the next document by descending id), and their likenesses."""
    rows = _with_successors(docs.select("doc_id", "text"), block_bytes)

    def run(table: pa.Table) -> pa.Table:
        ids = pc.fill_null(int_column(table, "doc_id"), -2**63).to_numpy(zero_copy_only=False)
        copy = table["_copy"].combine_chunks().to_numpy(zero_copy_only=False).astype(bool)
        col = text_column(table)
        own = sorted(np.flatnonzero(~copy), key=lambda i: (-int(ids[i]), col[int(i)].as_py()))
        after = min(np.flatnonzero(copy), key=lambda i: col[int(i)].as_py())
        order = np.array([*own, after])
        col = col.take(pa.array(order))
        texts = [t.decode() for t in col.to_pylist()]
        edited = []
        for text, following in zip(texts[:-1], texts[1:]):
            k = len(text) // 3
            edited.append(text[:len(text) - k] + following[:k])
        code, length = _digest_column(col)
        edited_bytes = [t.encode() for t in edited]
        ecode, elength = _digest_column(pa.array(edited_bytes, pa.large_binary()))
        n = len(edited)
        return pa.table([int_column(table, "doc_id").take(pa.array(order[:-1])), pa.array([len(t) for t in texts[:-1]], pa.int64()),
                         pa.array([hashlib.sha256(b).hexdigest() for b in edited_bytes]), pa.array(to_string(code[:n], length[:n])),
                         pa.array(to_string(ecode, elength)), pa.array(likeness(code[:n], length[:n], ecode, elength)),
                         pa.array(likeness(code[:n], length[:n], code[1:], length[1:]))],
                        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.groupBy("_blk").applyInArrow(run, _REPORT)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_report(documents(spark, sf_dir))
