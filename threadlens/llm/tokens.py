"""Token ids as flat binary files (operator 7).

File format, in one folder:

* ``ids-<slice>.bin``      unsigned 16-bit (vocabularies up to 65,536) or 32-bit
                           integers, little-endian; the end id closes each document
* ``offsets-<slice>.bin``  64-bit integers: for each document its first id's position
                           among the ids of *all* slices, and one more: the end
* ``docs-<slice>.bin``     64-bit doc_id of each document (-2**63: null)

Slices hold consecutive ``doc_id``, in order, and documents ascend within a slice. Job:

1. Rows go to their slice (one exchange) and each slice is sorted, encoded with the
   tokenizers library and written; one row per slice (its id count) comes back.
2. Prefix sums over the slice table (bounded: one row per ``SLICE_BYTES`` of text)
   give each slice its base, and the slices write their offset files.
3. The files are memory-mapped slice by slice and read back.

A file is written under a name of its own attempt and renamed when complete, so a
task that is lost or runs twice leaves whole files. Files go through
``pyarrow.fs`` to the folder under ``spark.checkpoint.dir`` (any store it knows;
memory-mapped when the store is a mounted file system).

Texts are cut at places where the byte-level pattern always starts a token, mostly single
spaces (``find_chunks``); each distinct chunk is encoded once (``chunks``). Chunks are
found, hashed, compared and replaced by their ids as arrays; only distinct new ones become
strings.

Defined results: a null or empty text is the end id alone; a null id sorts first;
rows of one id are ordered by their text, repeated rows are all written; columns
other than doc_id and text are not used; an empty table writes no files.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir, ship_package
from .chunks import SpanCache, gather
from .common import (U64, byte_class, documents, hash_words, id_splitters, int_column, map_arrow, mix, per_group,
                     text_column, text_parts, with_block)

SLICE_BYTES = 8_000_000
# slices are small, so the cache serves several slices of a worker
MAX_CHUNKS = 1_500_000
_BLANK = byte_class([0x20, *range(0x09, 0x0E), *range(0x1C, 0x20)])
# first bytes of characters among which wider blanks are, and the bytes before their last one
_WIDE_HEAD = byte_class([0xC2, 0xE1, 0xE2, 0xE3])
_WIDE_TAIL = byte_class([0xC2, 0x9A, 0x80, 0x81])
_LETTER = byte_class([*range(0x41, 0x5B), *range(0x61, 0x7B)])
_LETTER_TAIL = byte_class(set(range(0x80, 0xC0)) - {0x97, 0xB7})     # after 0xC3
_STOPS = byte_class(b".,;:!?)%$#*\n")
_NO_ID = -2**63


class _Encoder:
    """The tokenizers library over lists of distinct chunks."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if pre.get("type") != "ByteLevel" or not pre.get("use_regex", True) or pre.get("add_prefix_space") or spec["normalizer"]:
            raise ValueError("texts are cut by the rules of the byte-level pattern; this vocabulary has others")
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        added = {i: t.content for i, t in self.lib.get_added_tokens_decoder().items()}
        # byte length of each token: one character of a byte-level token is one byte
        self.token_bytes = np.zeros(self.size, np.int64)
        for name, i in self.lib.get_vocab(with_added_tokens=True).items():
            self.token_bytes[i] = len(added[i].encode()) if i in added else len(name)

    def encode(self, chunks: list[tuple[bytes, bool]]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per chunk) of (text, without a space before it or not). Chunks that
        neither begin nor end with a blank go through the library as one text, with a space
        or a line feed between them: tokens start where they do, a line feed is a token of
        its own, and the byte lengths of the tokens say where."""
        texts = [c.decode() for c, _ in chunks]
        solo = np.fromiter((t[0].isspace() or t[-1].isspace() for t in texts), bool, len(texts))
        bare = np.fromiter((b for _, b in chunks), bool, len(texts))
        alone = np.flatnonzero(solo)
        got = self.lib.encode_batch_fast([texts[i] if bare[i] else " " + texts[i] for i in alone], add_special_tokens=False)
        flat = [np.array(e.ids, np.int64) for e in got]
        begins, lens, order, held = [], [np.fromiter(map(len, flat), np.int64, len(flat))], [alone], 0
        begins.append(np.cumsum(lens[0]) - lens[0])
        held = int(lens[0].sum())
        for between, rows in ((" ", np.flatnonzero(~solo & ~bare)), ("\n", np.flatnonzero(~solo & bare))):
            for lo in range(0, len(rows), 20_000):
                some = rows[lo:lo + 20_000]
                joint = between.join([texts[i] for i in some])
                ids = np.array(self.lib.encode_batch_fast([" " + joint if between == " " else joint], add_special_tokens=False)[0].ids, np.int64)
                size = np.fromiter((len(chunks[i][0]) for i in some), np.int64, len(some))
                # the byte where each chunk ends; a space before a chunk belongs to it
                ends = np.cumsum(size + 1) - (between != " ")
                stops = np.searchsorted(np.cumsum(self.token_bytes[ids]), ends, side="left") + 1
                starts = np.concatenate([[0], stops[:-1] + (between != " ")])
                begins.append(held + starts)
                lens.append(stops - starts)
                order.append(some)
                flat.append(ids)
                held += len(ids)
        # back into the order asked for
        place = np.argsort(np.concatenate(order), kind="stable")
        n = np.concatenate(lens)[place]
        return gather(np.concatenate(flat) if flat else np.zeros(0, np.int64), np.concatenate(begins)[place], n), n


_encoders: dict[str, tuple[_Encoder, SpanCache]] = {}


def _encoder(path: str):
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        enc = _Encoder(path)
        _encoders[path] = enc, SpanCache(enc.encode, np.int32, MAX_CHUNKS)
    return _encoders[path]


def find_chunks(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, without a space before it, chunks per text). The pattern always starts a
    token at these places, whatever follows or comes before:

    * a single space between two non-space characters (the space is left out);
    * a letter (Latin, one or two bytes) followed by one of ``_STOPS``;
    * a single line feed followed by a Latin letter.

    A space next to a byte that may belong to a wider blank is no cut; that only makes a
    chunk longer."""
    first = np.zeros(len(raw) + 1, bool)
    first[offs] = True
    prev, prev2 = np.zeros_like(raw), np.zeros_like(raw)      # 0: before the text
    prev[1:] = raw[:-1]
    prev[first[:-1]] = 0
    prev2[1:] = prev[:-1]
    prev2[first[:-1]] = 0
    at = np.flatnonzero((raw == 0x20) & ~first[1:] & ~first[:-1])
    before, after = prev[at], raw[at + 1]
    at = at[~(_BLANK[before] | _BLANK[after] | _WIDE_HEAD[after] | ((before >= 0x80) & _WIDE_TAIL[prev2[at]]))]
    bare = np.flatnonzero(_STOPS[raw] & ~first[:-1])
    bare = bare[_LETTER[prev[bare]] | ((prev2[bare] == 0xC3) & _LETTER_TAIL[prev[bare]])]
    line = np.flatnonzero((prev == 0x0A) & _LETTER[raw])
    line = line[(prev2[line] > 0x20) & (prev2[line] < 0x80)]
    begin = first[:-1].copy()
    begin[at + 1] = True
    mark = first[:-1].copy()
    for cut in (bare, line):
        begin[cut] = True
        mark[cut] = True
    starts = np.flatnonzero(begin)
    over = np.zeros(len(raw) + 1, bool)
    over[at] = over[bare] = over[line] = True
    over[offs[1:][np.diff(offs) > 0]] = True
    return starts, np.flatnonzero(over), mark[starts], np.diff(np.searchsorted(starts, offs))


def encode_bytes(path: str, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per text) of whole texts, without an end id."""
    _, cache = _encoder(path)
    starts, ends, mark, counts = find_chunks(raw, offs)
    keys = hash_words(raw, starts, ends)
    keys[mark] = mix(keys[mark] + U64(1))
    return cache.ids(raw, starts, ends, mark, keys, counts)


class _Folder:
    """Files of one output folder, through pyarrow's file systems."""

    def __init__(self, uri: str):
        from pyarrow import fs
        self.fs, self.path = fs.FileSystem.from_uri(uri)
        self.local = isinstance(self.fs, fs.LocalFileSystem)

    def write(self, name: str, arrays) -> None:
        temp = f"{self.path}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temp) as out:
            for a in arrays:
                out.write(memoryview(np.ascontiguousarray(a)).cast("B") if len(a) else b"")
        self.fs.move(temp, f"{self.path}/{name}")

    def read(self, name: str, dtype) -> np.ndarray:
        path = f"{self.path}/{name}"
        if self.fs.get_file_info(path).size == 0:
            return np.zeros(0, dtype)
        if self.local:
            return np.memmap(path, dtype=dtype, mode="r")
        with self.fs.open_input_file(path) as f:
            return np.frombuffer(f.read(), dtype)


def _slice_name(kind: str, k: int) -> str:
    return f"{kind}-{k:08d}.bin"


def write_ids(docs: DataFrame, path: str, end_id: int, folder: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Write the files of ``docs`` into ``folder`` (a URI that all executors reach);
    returns (slice, n_docs, n_ids, base), one row per slice."""
    spark = docs.sparkSession
    ship_package(spark)
    narrow = docs.select("doc_id", "text")
    sliced = with_block(narrow, id_splitters(narrow, slice_bytes), "_slice")

    def put(table: pa.Table) -> pa.Table:
        enc, _ = _encoder(path)
        dtype = np.dtype("<u2") if max(enc.size, end_id + 1) <= 1 << 16 else np.dtype("<u4")
        k = table["_slice"][0].as_py()
        ids = pc.fill_null(int_column(table, "doc_id"), _NO_ID).to_numpy(zero_copy_only=False)
        col = text_column(table)
        order = np.argsort(ids, kind="stable")
        if (ids[order][1:] == ids[order][:-1]).any():
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], col[i].as_py())))
        col = col.take(pa.array(order))
        flat, lens = [], []
        for _, _, raw, offs in text_parts(col, 1_000_000):
            got, n = encode_bytes(path, raw, offs)
            flat.append(np.insert(got, np.cumsum(n), end_id).astype(dtype))
            lens.append(n + 1)
        out = _Folder(folder)
        out.write(_slice_name("ids", k), flat)
        out.write(_slice_name("lengths", k), [np.concatenate(lens).astype("<i8")])
        out.write(_slice_name("docs", k), [ids[order].astype("<i8")])
        return pa.table({"slice": pa.array([k], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()),
                         "n_ids": pa.array([int(np.concatenate(lens).sum())], pa.int64()),
                         "width": pa.array([dtype.itemsize], pa.int32())})

    written = sliced.groupBy("_slice").applyInArrow(per_group(put), "slice int, n_docs long, n_ids long, width int").collect()
    rows, base = [], 0
    for r in sorted(written, key=lambda r: r.slice):
        rows.append((r.slice, r.n_docs, r.n_ids, r.width, base))
        base += r.n_ids
    slices = spark.createDataFrame(rows, "slice int, n_docs long, n_ids long, width int, base long") \
        .repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))

    def offsets(batches):
        out = _Folder(folder)
        for batch in batches:
            for r in batch.to_pylist():
                lens = out.read(_slice_name("lengths", r["slice"]), "<i8")
                out.write(_slice_name("offsets", r["slice"]), [r["base"] + np.concatenate([[0], np.cumsum(lens)]).astype("<i8")])
            yield batch

    done = map_arrow(slices, offsets, slices.schema).collect()
    return spark.createDataFrame(done, slices.schema).repartition(max(1, min(len(rows), 4 * spark.sparkContext.defaultParallelism)))


def read_report(slices: DataFrame, folder: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    def run(batches):
        src = _Folder(folder)
        for batch in batches:
            for r in batch.to_pylist():
                if not r["n_docs"]:
                    continue
                ids = src.read(_slice_name("ids", r["slice"]), f"<u{r['width']}")
                offs = src.read(_slice_name("offsets", r["slice"]), "<i8")
                docs = src.read(_slice_name("docs", r["slice"]), "<i8")
                at = np.asarray(offs) - int(offs[0])
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.asarray(docs), pa.int64(), mask=np.asarray(docs) == _NO_ID), pa.array(np.asarray(offs)[:-1], pa.int64()),
                     pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(slices, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A new folder (URI) under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{kind}-{uuid.uuid4().hex}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(path)
    uri = fs.makeQualified(path).toString()
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    folder = new_folder(spark, "token-ids")
    slices = write_ids(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), 2, folder)
    return read_report(slices, folder)
