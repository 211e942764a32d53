"""SentencePiece encoding and decoding (operator 3) for merge-type vocabularies.

Encoding follows the agenda of adjacent symbol pairs: of all pairs whose union is a
piece, the one with the best score (the leftmost of equals) is merged, until none is
left; characters outside the vocabulary become byte pieces. No piece holds a space
mark after another character (checked when the model is read), so a text falls into
chunks "spaces + other characters" that are encoded on their own; each distinct chunk is
encoded once. Short chunks run their agendas side by side as numpy rows (one merge
per chunk and round), long ones use a heap.

Decoding joins the pieces' bytes, turns space marks into spaces, drops control
pieces and the one space that encoding put in front.

``library_mismatches`` holds both against the sentencepiece library in Arrow batches.

No exchange, nothing broadcast: the tasks read the vocabulary file, whose path is a
parameter. Defined results: a null text counts as empty; an empty text is the begin
and end id and decodes to the empty text; other columns pass through ``encode_texts``
(which adds ``piece_ids``, ``decoded``; an input column of those names is replaced).
"""

from __future__ import annotations

import hashlib
import heapq
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .chunks import ChunkCache, gather
from .common import documents, int_column, map_arrow, sealed, text_column, text_parts

SPACE = "▁"
_CHUNK = re.compile(" +[^ ]*")
_ROWS_MAX = 40
_NONE = np.int32(2**31 - 1)


class PieceModel:
    """Vocabulary tables of a merge-type model, and its agenda."""

    def __init__(self, path: str):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        if lib.normalize("a  b ") != f"{SPACE}a{SPACE}{SPACE}b{SPACE}":
            raise ValueError("only models with an identity normaliser and a space put in front are supported")
        n = lib.get_piece_size()
        self.bos, self.eos, self.n = lib.bos_id(), lib.eos_id(), n
        names = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) for i in range(n)]
        byte = [lib.is_byte(i) for i in range(n)]
        self.by_name = {p: i for i, p in enumerate(names) if not special[i] and not byte[i] and not lib.is_unused(i)}
        self.byte_id = np.zeros(256, np.int32)
        out = []
        for i, p in enumerate(names):
            if byte[i]:
                self.byte_id[int(p[3:5], 16)] = i
                out.append(bytes([int(p[3:5], 16)]))
            elif special[i]:
                out.append(" ⁇ ".encode() if lib.is_unknown(i) else b"")
            else:
                out.append(p.replace(SPACE, " ").encode())
        self.is_byte = np.array(byte)
        self.bytes_len = np.array([len(b) for b in out], np.int64)
        self.bytes_off = np.cumsum(self.bytes_len) - self.bytes_len
        self.bytes_flat = np.frombuffer(b"".join(out), np.uint8)
        scores = sorted({lib.get_score(i) for i in self.by_name.values()}, reverse=True)
        rank = {s: k for k, s in enumerate(scores)}
        self.char = np.full(0x110000, n, np.int32)  # n: a character that is no piece
        pairs = {}
        for p, i in self.by_name.items():
            if SPACE in p.lstrip(SPACE):
                raise ValueError(f"piece {p!r} holds a space mark inside")
            if len(p) == 1:
                self.char[ord(p)] = i
                continue
            for k in range(1, len(p)):
                a, b = self.by_name.get(p[:k]), self.by_name.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = (i, rank[lib.get_score(i)])
            if any(c not in self.by_name for c in p):
                raise ValueError(f"piece {p!r} holds a character that is no piece")
        self.char[32] = self.char[ord(SPACE)]
        self.pairs = pairs
        self.pair_key = np.array(sorted(pairs), np.int64)
        self.pair_id = np.array([pairs[k][0] for k in self.pair_key.tolist()], np.int32)
        self.pair_rank = np.array([pairs[k][1] for k in self.pair_key.tolist()], np.int32)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) * (self.n + 1) + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        hit = self.pair_key[at] == key
        return np.where(hit, self.pair_id[at], 0).astype(np.int32), np.where(hit, self.pair_rank[at], _NONE)

    def _agenda_rows(self, sym: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Agendas of equally long chunks, one row each; (symbols, lengths)."""
        m, size = sym.shape
        length = np.full(m, size)
        if size < 2:
            return sym, length
        done = sym.copy()
        union, rank = self._lookup(sym[:, :-1].ravel(), sym[:, 1:].ravel())
        union, rank = union.reshape(m, -1), rank.reshape(m, -1)
        rows, sym, live = np.arange(m), sym.copy(), np.full(m, size)
        while len(rows):
            best = rank.argmin(axis=1)
            at = np.arange(len(rows))
            go = rank[at, best] != _NONE
            if not go.all():
                end = rows[~go]
                done[end, :sym.shape[1]] = sym[~go]
                length[end] = live[~go]
                rows, sym, live, union, rank, best = rows[go], sym[go], live[go], union[go], rank[go], best[go]
                at = np.arange(len(rows))
                if not len(rows):
                    break
            sym[at, best] = union[at, best]
            width = sym.shape[1]
            if width == 2:
                done[rows, :1] = sym[:, :1]
                length[rows] = 1
                break
            cols = np.arange(width - 1)
            shift = cols[None, :] + (cols[None, :] > best[:, None])
            sym = np.take_along_axis(sym, shift, 1)
            pshift = cols[None, :-1] + (cols[None, :-1] > best[:, None])
            pshift = np.minimum(pshift, width - 2)
            union, rank = np.take_along_axis(union, pshift, 1), np.take_along_axis(rank, pshift, 1)
            live = live - 1
            for side in (-1, 0):
                k = best + side
                ok = (k >= 0) & (k < width - 2)
                if ok.any():
                    r, c = at[ok], k[ok]
                    union[r, c], rank[r, c] = self._lookup(sym[r, c], sym[r, c + 1])
        return done, length

    def _agenda_heap(self, sym: list[int]) -> list[int]:
        """The agenda of one long chunk."""
        n, pairs, width = len(sym), self.pairs, self.n + 1
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []

        def push(a, b):
            if a >= 0 and b >= 0:
                got = pairs.get(sym[a] * width + sym[b])
                if got:
                    heapq.heappush(heap, (got[1], a, b, sym[a], sym[b], got[0]))

        for a in range(n - 1):
            push(a, a + 1)
        while heap:
            _, a, b, x, y, union = heapq.heappop(heap)
            if sym[a] != x or sym[b] != y or right[a] != b:
                continue
            sym[a], sym[b] = union, -1
            right[a] = right[b]
            if right[b] >= 0:
                left[right[b]] = a
            push(left[a], a)
            push(a, right[a])
        return [s for s in sym if s >= 0]

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids per chunk) without begin and end."""
        code = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.fromiter(map(len, chunks), np.int64, len(chunks))
        off = np.cumsum(size) - size
        sym = self.char[code]
        lens = np.zeros(len(chunks), np.int64)
        flat = np.empty(len(code), np.int32)
        for length in np.unique(size[size <= _ROWS_MAX]):
            which = np.flatnonzero(size == length)
            rows, n = self._agenda_rows(sym[off[which][:, None] + np.arange(length)])
            keep = np.arange(length)[None, :] < n[:, None]
            flat[(off[which][:, None] + np.arange(length))[keep]] = rows[keep]
            lens[which] = n
        for i in np.flatnonzero(size > _ROWS_MAX):
            got = self._agenda_heap(sym[off[i]:off[i] + size[i]].tolist())
            flat[off[i]:off[i] + len(got)] = got
            lens[i] = len(got)
        ids = gather(flat, off, lens)
        odd = np.flatnonzero(ids == self.n)
        if not len(odd):
            return ids, lens
        ends = np.cumsum(lens)
        out = []
        for i in range(len(chunks)):
            part = ids[ends[i] - lens[i]:ends[i]]
            if (part == self.n).any():
                lost = iter([c for c in chunks[i] if self.char[ord(c)] == self.n])
                grown = []
                for s in part.tolist():
                    grown += [s] if s != self.n else self.byte_id[list(next(lost).encode())].tolist()
                part = np.array(grown, np.int32)
                lens[i] = len(part)
            out.append(part)
        return np.concatenate(out), lens

    def decode(self, ids) -> str:
        """Text of any id sequence."""
        ids = np.asarray(ids, np.int64)
        data = gather(self.bytes_flat, self.bytes_off[ids], self.bytes_len[ids]).tobytes()
        try:
            if (self.bytes_len[ids[1:-1]] == 0).any():
                raise UnicodeDecodeError("utf-8", data, 0, 0, "bytes apart")
            text = data.decode()
        except UnicodeDecodeError:  # byte runs on their own; bytes that form no character: one mark each
            text = "".join(self._bytes_text(ids[a:b]) if self.is_byte[ids[a]] else
                           gather(self.bytes_flat, self.bytes_off[ids[a:b]], self.bytes_len[ids[a:b]]).tobytes().decode()
                           for a, b in self._runs(ids))
        shown = ids[self.bytes_len[ids] > 0]
        front = len(shown) > 0 and not self.is_byte[shown[0]] and shown[0] != 0 and text.startswith(" ")
        return text[1:] if front else text

    def _runs(self, ids):
        cut = np.flatnonzero(np.diff(self.is_byte[ids].astype(np.int8))) + 1
        edges = [0, *cut.tolist(), len(ids)]
        return zip(edges[:-1], edges[1:])

    def _bytes_text(self, ids) -> str:
        data, out, i = bytes(self.bytes_flat[self.bytes_off[ids]]), [], 0
        while i < len(data):
            for k in (1, 2, 3, 4):
                try:
                    out.append(data[i:i + k].decode())
                    i += k
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)


_models: dict[str, tuple[PieceModel, ChunkCache]] = {}


def model_at(path: str) -> tuple[PieceModel, ChunkCache]:
    """Model and chunk cache of this worker."""
    if path not in _models:
        model = PieceModel(path)
        _models[path] = model, ChunkCache(lambda new: (new, *model.encode_chunks(new)), np.int32)
    return _models[path]


def encode_strings(path: str, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, ids per text) of whole texts, without begin and end."""
    _, cache = model_at(path)
    chunks: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = _CHUNK.findall(" " + t.replace(SPACE, " "))
            chunks += found
            counts[i] = len(found)
    return cache.ids(chunks, counts)


def _encoded(batch: pa.RecordBatch, path: str):
    """(first row, end row, texts' id arrays with begin and end) per part."""
    model, _ = model_at(path)
    for lo, hi, raw, offs in text_parts(text_column(batch), 500_000):
        data = raw.tobytes()
        ids, lens = encode_strings(path, [data[a:b].decode() for a, b in zip(offs[:-1], offs[1:])])
        ends = np.cumsum(lens)
        yield lo, hi, [np.concatenate([[model.bos], ids[e - n:e], [model.eos]]).astype(np.uint32) for e, n in zip(ends, lens)]


def _tasks(run, path: str):
    """``run`` over the batches of a task; the chunk cache goes when the task ends."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            model_at(path)[1].clear()
            pa.default_memory_pool().release_unused()

    return task


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """``docs`` plus ``piece_ids`` (array of ids) and ``decoded`` (their text)."""
    kept, restore = sealed(docs)
    schema = T.StructType([*kept.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType())),
                           T.StructField("decoded", T.StringType())])

    def run(batches):
        model, _ = model_at(path)
        for batch in batches:
            for lo, hi, ids in _encoded(batch, path):
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(lo, hi - lo).columns, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32())),
                     pa.array([model.decode(x) for x in ids], pa.string())], names=schema.names)

    return restore(map_arrow(kept, _tasks(run, path), schema), ("piece_ids", "decoded"))


def piece_report(docs: DataFrame, path: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        model, _ = model_at(path)
        for batch in batches:
            doc_ids = int_column(batch, "doc_id")
            for lo, hi, ids in _encoded(batch, path):
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(lo, hi - lo), pa.array([len(x) for x in ids], pa.int64()),
                     pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                     pa.array([hashlib.sha256(model.decode(x).encode()).hexdigest() for x in ids], pa.string())], names=names)

    return map_arrow(docs.select("doc_id", "text"), _tasks(run, path),
                     "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def library_mismatches(docs: DataFrame, path: str) -> DataFrame:
    """Documents whose ids or decoded text differ from the sentencepiece library's."""
    def run(batches):
        import sentencepiece
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        model, _ = model_at(path)
        for batch in batches:
            doc_ids = int_column(batch, "doc_id")
            texts = [t.decode() for t in text_column(batch).to_pylist()]
            want = lib.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            for lo, hi, ids in _encoded(batch, path):
                wrong = [lo + k for k, x in enumerate(ids)
                         if x.tolist() != want[lo + k] or model.decode(x) != lib.decode(want[lo + k])]
                yield pa.RecordBatch.from_arrays([doc_ids.take(pa.array(wrong, pa.int64()))], names=["doc_id"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long")


def default_model() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_report(documents(spark, sf_dir), default_model())
