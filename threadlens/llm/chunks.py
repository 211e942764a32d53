"""Encoding by distinct chunk: a text is cut where no token can cross, each distinct
chunk is encoded once per cache, and whole texts are put together by array gathers.

The cache is bounded (``max_chunks`` distinct chunks, or ``MAX_IDS`` ids; then it starts anew), so a task's
memory does not grow with its input. Keys are the chunks themselves, not hashes.
"""

from __future__ import annotations

import numpy as np

MAX_CHUNKS = 300_000
MAX_IDS = 4_000_000


def gather(flat: np.ndarray, starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """flat[s:s+n] for every (s, n), one after the other."""
    ends = np.cumsum(lens)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lens), lens) + np.arange(total)]


class ChunkCache:
    """Ids of distinct chunks. ``encode(list of new chunks)`` returns (the chunks in the
    order of what follows, flat ids, lengths)."""

    def __init__(self, encode, dtype, max_chunks: int = MAX_CHUNKS):
        self._encode, self._dtype, self._max = encode, dtype, max_chunks
        self.clear()

    def clear(self):
        """Forget all chunks (at the end of a task: idle workers keep no memory)."""
        self._index: dict = {}
        self._flat = np.zeros(0, self._dtype)
        self._off = np.zeros(0, np.int64)
        self._len = np.zeros(0, np.int64)

    def ids(self, chunks: list, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all chunks in order, ids per text); counts: chunks per text."""
        if len(self._index) > self._max or len(self._flat) > MAX_IDS:
            self.clear()
        index = self._index
        new = list(set(chunks).difference(index))
        if new:
            new, flat, lens = self._encode(new)
            index.update(zip(new, range(len(index), len(index) + len(new))))
            self._off = np.concatenate([self._off, len(self._flat) + np.cumsum(lens) - lens])
            self._len = np.concatenate([self._len, lens])
            self._flat = np.concatenate([self._flat, flat.astype(self._dtype)])
        at = np.fromiter(map(index.__getitem__, chunks), np.int64, len(chunks))
        lens = self._len[at]
        ends = np.concatenate([[0], np.cumsum(lens)])
        last = np.cumsum(counts)
        return gather(self._flat, self._off[at], lens), ends[last] - ends[last - counts]


class SpanCache:
    """The same by byte spans of an array, without a Python object per chunk: spans are
    found in sorted 64-bit hashes, and the bytes of every span are compared with those of
    the cached chunk (a span whose hash is that of another chunk is encoded by itself).
    ``mark`` tells two kinds of chunks apart: equal bytes of both kinds are two chunks.
    ``encode(list of (bytes, marked))`` returns (flat ids, lengths) in that order."""

    def __init__(self, encode, dtype, max_chunks: int = MAX_CHUNKS):
        self._encode, self._dtype, self._max = encode, dtype, max_chunks
        self.clear()

    def clear(self):
        self._keys = np.zeros(0, np.uint64)          # sorted hashes
        self._row = np.zeros(0, np.int64)            # entry of each hash
        self._text = np.zeros(0, np.uint8)           # bytes of the entries, one after the other
        self._at, self._size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self._mark = np.zeros(0, bool)
        self._flat = np.zeros(0, self._dtype)
        self._off, self._len = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _add(self, raw, starts, ends, mark, keys):
        data = [raw[a:b].tobytes() for a, b in zip(starts, ends)]
        flat, lens = self._encode(list(zip(data, mark.tolist())))
        size = ends - starts
        place = np.searchsorted(self._keys, keys)
        self._row = np.insert(self._row, place, len(self._size) + np.arange(len(keys)))
        self._keys = np.insert(self._keys, place, keys)
        self._at = np.concatenate([self._at, len(self._text) + np.cumsum(size) - size])
        self._size = np.concatenate([self._size, size])
        self._text = np.concatenate([self._text, np.frombuffer(b"".join(data), np.uint8)])
        self._mark = np.concatenate([self._mark, mark])
        self._off = np.concatenate([self._off, len(self._flat) + np.cumsum(lens) - lens])
        self._len = np.concatenate([self._len, lens])
        self._flat = np.concatenate([self._flat, flat.astype(self._dtype)])

    def ids(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, mark: np.ndarray, keys: np.ndarray,
            counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all spans in order, ids per text); keys: hash of each span and its mark,
        counts: spans per text."""
        if not len(keys):
            return np.zeros(0, self._dtype), np.zeros(len(counts), np.int64)
        if len(self._size) > self._max or len(self._flat) > 4 * self._max:
            self.clear()
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        place = np.searchsorted(self._keys, distinct)
        known = place < len(self._keys)
        known[known] = self._keys[place[known]] == distinct[known]
        new = first[~known]
        if len(new):
            self._add(raw, starts[new], ends[new], mark[new], distinct[~known])
        row = self._row[np.searchsorted(self._keys, distinct)][back]
        size = ends - starts
        # equal length and mark, then byte by byte; an equal hash alone decides nothing
        other = (self._size[row] != size) | (self._mark[row] != mark)
        own = np.where(other, 0, size)
        unequal = gather(raw, starts, own) != gather(self._text, self._at[row], own)
        if unequal.any():
            other |= np.add.reduceat(np.append(unequal, False), np.minimum(np.cumsum(own) - own, len(unequal)), dtype=np.int64) \
                * (own > 0) > 0
        off, lens, flat = self._off[row], self._len[row].copy(), self._flat
        lost = np.flatnonzero(other)
        if len(lost):
            extra, n = self._encode([(raw[starts[i]:ends[i]].tobytes(), bool(mark[i])) for i in lost])
            off[lost], lens[lost] = len(flat) + np.cumsum(n) - n, n
            flat = np.concatenate([flat, extra.astype(self._dtype)])
        upto = np.concatenate([[0], np.cumsum(lens)])
        last = np.cumsum(counts)
        return gather(flat, off, lens), upto[last] - upto[last - counts]
