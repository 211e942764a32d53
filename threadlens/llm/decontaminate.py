"""Benchmark decontamination (operator 4): one FM-index per training shard.

A shard is a run of whole documents of about ``SHARD_BYTES`` inside one task. Its
words become symbols: the words of the phrase set are 1..V, every other word and
every document end is a break (no phrase can cross it), and stretches between
breaks that are shorter than the shortest phrase are left out of the indexed text.
Over that text the task builds a suffix array (prefix doubling), its
Burrows-Wheeler transform in a wavelet matrix with popcount ranks, and a sample of
suffix positions (every 16th, and the first of each stretch). All phrases are
searched backwards at once; the occurrences of matched phrases are located by
walking to a sampled position; their word spans are merged per document.

No exchange: documents stay in the task that reads them. The phrase set is the
only thing sent to the tasks; it goes in blocks whose bytes are counted first
(``MAX_PHRASE_BYTES``; one longer item is a block of its own). More than one block
means one pass over the documents per block, merged per document.

Phrases: lower-cased A-Z, words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``; every 10
consecutive words of an item, or all of an item with fewer. Words are compared by
a 64-bit hash. Defined results: null or empty text has no words and no hits; an
item without words (or null) has no phrase; an item with a null id marks words
but is not listed; repeated items count once; an empty table of either side gives
no hits; other columns pass through, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, WORD_BYTES, documents, find_words, hash_words, map_arrow, sealed, text_column, text_parts

WINDOW = 10
SHARD_BYTES = 8_000_000
MAX_PHRASE_BYTES = 32_000_000
SAMPLE = 16
_LOCATE_ROWS = 500_000


class Phrases:
    """Distinct phrases as symbol rows (right-aligned, 0 = none) with their items."""

    def __init__(self, rows: list[tuple[str | None, str | None]], window: int = WINDOW):
        rows = [(i, t) for i, t in rows if t]
        hashes = []
        for _, text in rows:
            raw = np.frombuffer(text.encode(), np.uint8)
            s, e, _ = find_words(raw, np.array([0, len(raw)]), WORD_BYTES)
            hashes.append(hash_words(raw, s, e, lower=True))
        self.alphabet = np.unique(np.concatenate([np.zeros(0, U64), *hashes]))
        self.window = window
        found: dict[bytes, set] = {}
        for (item, _), h in zip(rows, hashes):
            sym = (np.searchsorted(self.alphabet, h) + 1).astype(np.int32)
            size = min(window, len(sym))
            for k in range(len(sym) - size + 1 if size else 0):
                found.setdefault(sym[k:k + size].tobytes(), set()).add(item)
        self.keys = [np.frombuffer(k, np.int32) for k in found]
        self.items = [sorted(i for i in s if i is not None) for s in found.values()]
        self.length = np.array([len(k) for k in self.keys], dtype=np.int64)
        self.matrix = np.zeros((len(self.keys), window), dtype=np.int64)
        for r, k in enumerate(self.keys):
            self.matrix[r, window - len(k):] = k
        self.shortest = int(self.length.min()) if len(self.keys) else 0

    def symbols(self, h: np.ndarray) -> np.ndarray:
        if not len(self.alphabet):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.alphabet, h), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == h, at + 1, 0)


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Suffixes by prefix doubling. Symbol 0 ends a stretch: every 0 is smaller
    than all words and differs from every other 0, so no comparison crosses one."""
    n = len(text)
    rank = np.empty(n, dtype=np.int64)
    zero = text == 0
    rank[zero] = np.arange(int(zero.sum()))
    rank[~zero] = int(zero.sum()) + np.unique(text[~zero], return_inverse=True)[1]
    step = 1
    while True:
        after = np.zeros(n, dtype=np.int64)
        after[:n - step] = rank[step:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        new = np.ones(n, dtype=np.int64)
        new[0] = 0
        new[1:] = key[order][1:] != key[order][:-1]
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == n - 1:
            return order
        step *= 2


class WaveletMatrix:
    """rank and access over a symbol array, one packed bit row per symbol bit."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        cur = symbols.astype(np.int64)
        for bit in range(max(1, int(n_symbols).bit_length()) - 1, -1, -1):
            ones = (cur >> bit) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(packed) // 8 + 2, dtype=U64)
            words.view(np.uint8)[:len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))])[:-1]
            self.levels.append((bit, words, before, len(cur) - int(ones.sum())))
            cur = np.concatenate([cur[~ones], cur[ones]])

    @staticmethod
    def _ones(words, before, i):
        w = i >> 6
        part = words[w] & ((U64(1) << (i & 63).astype(U64)) - U64(1))
        return before[w] + np.bitwise_count(part)

    def rank(self, sym: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often ``sym`` occurs before position ``i`` (elementwise)."""
        start = np.zeros(len(i), dtype=np.int64)
        i = i.astype(np.int64)
        for bit, words, before, zeros in self.levels:
            one = (sym >> bit) & 1 == 1
            a, b = self._ones(words, before, start), self._ones(words, before, i)
            start = np.where(one, zeros + a, start - a)
            i = np.where(one, zeros + b, i - b)
        return i - start

    def access(self, i: np.ndarray) -> np.ndarray:
        sym = np.zeros(len(i), dtype=np.int64)
        for bit, words, before, zeros in self.levels:
            one = (words[i >> 6] >> (i & 63).astype(U64)) & U64(1) == 1
            ones = self._ones(words, before, i)
            sym |= one.astype(np.int64) << bit
            i = np.where(one, zeros + ones, i - ones)
        return sym


class FMIndex:
    """Backward search and sampled locate over a text of symbols 0..n_symbols."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        sa = suffix_array(text)
        prev = text[sa - 1]
        prev[sa == 0] = 0
        self.n = len(text)
        self.tree = WaveletMatrix(prev, n_symbols)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        self.sampled = (prev == 0) | (sa % SAMPLE == 0)
        self.sample_no = np.cumsum(self.sampled) - 1
        self.samples = sa[self.sampled]

    def search(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of right-aligned phrases (leading 0 = shorter)."""
        lo, hi = np.zeros(len(matrix), np.int64), np.full(len(matrix), self.n, np.int64)
        for col in range(matrix.shape[1] - 1, -1, -1):
            live = np.flatnonzero((lo < hi) & (matrix[:, col] > 0))
            sym = matrix[live, col]
            both = self.tree.rank(np.concatenate([sym, sym]), np.concatenate([lo[live], hi[live]]))
            lo[live] = self.before[sym] + both[:len(live)]
            hi[live] = self.before[sym] + both[len(live):]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows: step back to a sampled one."""
        out = np.empty(len(rows), dtype=np.int64)
        at, left, steps = np.arange(len(rows)), rows.copy(), 0
        while len(at):
            got = self.sampled[left]
            out[at[got]] = self.samples[self.sample_no[left[got]]] + steps
            at, left = at[~got], left[~got]
            sym = self.tree.access(left)
            left = self.before[sym] + self.tree.rank(sym, left)
            steps += 1
        return out


def _search_part(raw, offs, phrases: Phrases):
    """One shard: (word offsets, covered words, (row, phrase) pairs)."""
    s, e, word_offs = find_words(raw, offs, WORD_BYTES)
    n = len(s)
    none = np.zeros(n, dtype=bool), np.zeros((0, 2), np.int64)
    if n == 0 or not phrases.keys:
        return word_offs, *none
    sym = phrases.symbols(hash_words(raw, s, e, lower=True))
    first = np.zeros(n, dtype=bool)
    first[word_offs[:-1][word_offs[:-1] < n]] = True
    known = sym > 0
    start = np.flatnonzero(known & (first | np.concatenate([[True], ~known[:-1]])))
    stop = np.flatnonzero(known & np.concatenate([first[1:] | ~known[1:], [True]])) + 1
    keep = stop - start >= phrases.shortest
    start, stop = start[keep], stop[keep]
    if not len(start):
        return word_offs, *none
    size = stop - start + 1
    base = np.cumsum(size) - size
    text = np.zeros(int(size.sum()), dtype=np.int64)
    inner = np.arange(len(text)) - np.repeat(base, size)
    words = np.repeat(start, size) + inner
    real = inner < np.repeat(size - 1, size)
    text[real] = sym[words[real]]
    index = FMIndex(text, len(phrases.alphabet))
    lo, hi = index.search(phrases.matrix)
    cover = np.zeros(n + 1, dtype=np.int64)
    pairs = []
    hits = np.flatnonzero(lo < hi)
    count = hi[hits] - lo[hits]
    cut = np.searchsorted(np.cumsum(count), np.arange(_LOCATE_ROWS, int(count.sum()) + _LOCATE_ROWS, _LOCATE_ROWS), side="left") + 1
    for a, b in zip(np.concatenate([[0], cut[:-1]]), cut):
        which, c = hits[a:b], count[a:b]
        if not len(which):
            continue
        rows = np.repeat(lo[which] - (np.cumsum(c) - c), c) + np.arange(int(c.sum()))
        phrase = np.repeat(which, c)
        at = words[index.locate(rows)]
        np.add.at(cover, at, 1)
        np.add.at(cover, at + phrases.length[phrase], -1)
        pairs.append(np.unique(np.stack([np.searchsorted(word_offs, at, side="right") - 1, phrase], 1), axis=0))
    return word_offs, np.cumsum(cover)[:-1] > 0, np.concatenate(pairs) if pairs else none[1]


def _spans(hit: np.ndarray, lo: int, hi: int) -> list[tuple[int, int]]:
    h = np.concatenate([[False], hit[lo:hi], [False]])
    edge = np.flatnonzero(h[1:] != h[:-1])
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


_MARKS = "_fm_words long, _fm_spans array<struct<a:int,b:int>>, _fm_items array<string>"
_SPAN_PA = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def _mark(docs: DataFrame, shared) -> DataFrame:
    """Rows of ``docs`` with the word count, merged word spans and item ids."""
    schema = T.StructType([*docs.schema.fields, *T._parse_datatype_string(_MARKS).fields])
    names = schema.names

    def run(batches):
        phrases = shared.value
        for batch in batches:
            for lo, hi, raw, offs in text_parts(text_column(batch), SHARD_BYTES):
                word_offs, hit, pairs = _search_part(raw, offs, phrases)
                spans: list = [[]] * (hi - lo)
                items: list = [[]] * (hi - lo)
                for row in np.unique(pairs[:, 0]):
                    spans[row] = [{"a": a, "b": b} for a, b in _spans(hit, word_offs[row], word_offs[row + 1])]
                cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
                for group in np.split(pairs, cuts) if len(pairs) else []:
                    row = group[0, 0]
                    items[row] = sorted({*items[row], *(i for p in group[:, 1] for i in phrases.items[p])})
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(np.diff(word_offs), pa.int64()), pa.array(spans, _SPAN_PA),
                     pa.array(items, pa.list_(pa.string()))], names=names)

    return map_arrow(docs, run, schema)


def phrase_blocks(benchmark: DataFrame, max_bytes: int = MAX_PHRASE_BYTES) -> list[DataFrame]:
    """Split the items by hash until every block is under ``max_bytes`` of text (or
    is one item that is longer)."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").alias("words")) \
        .filter(F.length("words") > 0)
    key = F.xxhash64("item", "words")
    parts = 1
    while True:
        sizes = items.groupBy(F.pmod(key, F.lit(parts)).alias("p")) \
            .agg(F.sum(F.octet_length("words").cast("long")).alias("b"), F.countDistinct("item", "words").alias("n"))
        if not sizes.filter((F.col("b") > max_bytes) & (F.col("n") > 1)).head(1):
            used = sorted(r.p for r in sizes.select("p").collect())
            return [items.filter(F.pmod(key, F.lit(parts)) == p).distinct() for p in used]
        parts *= 2


def mark_phrases(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                 max_phrase_bytes: int = MAX_PHRASE_BYTES) -> DataFrame:
    """``docs`` plus ``_fm_words`` (word count), ``_fm_spans`` (merged word spans
    [a, b) inside a phrase) and ``_fm_items`` (item ids, sorted)."""
    sc = docs.sparkSession.sparkContext
    marked = []
    for block in phrase_blocks(benchmark, max_phrase_bytes) or [None]:
        rows = [] if block is None else [(r.item, r.words) for r in block.collect()]
        marked.append((docs, sc.broadcast(Phrases(rows, window))))
    if len(marked) == 1:
        return _mark(*marked[0])
    key = [F.col("doc_id").alias("_fm_id"), F.sha2("text", 256).alias("_fm_text")]
    narrow = [_mark(docs.select("doc_id", "text"), b).select(*key, "_fm_words", "_fm_spans", "_fm_items") for _, b in marked]
    union = narrow[0]
    for more in narrow[1:]:
        union = union.unionByName(more)
    merged = union.groupBy("_fm_id", "_fm_text").agg(
        F.max("_fm_words").alias("_fm_words"), F.array_sort(F.flatten(F.collect_set("_fm_spans"))).alias("_fm_spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("_fm_items")))).alias("_fm_items"))
    step = ("aggregate(_fm_spans, cast(array() as array<struct<a:int,b:int>>), (o, s) -> "
            "if(size(o) > 0 and s.a <= o[size(o) - 1].b, "
            "concat(slice(o, 1, size(o) - 1), array(named_struct('a', o[size(o) - 1].a, 'b', greatest(s.b, o[size(o) - 1].b)))), "
            "concat(o, array(s))))")
    merged = merged.withColumn("_fm_spans", F.expr(step))
    left = docs.select("*", *[k.alias(n) for k, n in zip(key, ("_fm_l", "_fm_r"))])
    on = F.col("_fm_l").eqNullSafe(F.col("_fm_id")) & F.col("_fm_r").eqNullSafe(F.col("_fm_text"))
    return left.join(merged, on).select(*docs.columns, "_fm_words", "_fm_spans", "_fm_items")


def remove_phrases(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """``docs`` with the merged spans cut out of ``text`` (from the first byte of a
    span's first word to the last of its last); other texts unchanged."""
    docs, restore = sealed(docs)
    marked = mark_phrases(docs, benchmark, **kw)
    names = docs.columns

    def run(batches):
        for batch in batches:
            col = text_column(batch)
            spans = batch.column(batch.schema.get_field_index("_fm_spans")).to_pylist()
            cols = [batch.column(batch.schema.get_field_index(n)) for n in names]
            at = names.index("text")
            if any(spans):
                texts = cols[at].to_pylist()
                for i, found in enumerate(spans):
                    if found:
                        data = col[i].as_py()
                        raw = np.frombuffer(data, np.uint8)
                        s, e, _ = find_words(raw, np.array([0, len(raw)]), WORD_BYTES)
                        keep, last = [], 0
                        for x in found:
                            keep.append(data[last:s[x["a"]]])
                            last = e[x["b"] - 1]
                        texts[i] = b"".join([*keep, data[last:]]).decode()
                cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return restore(map_arrow(marked, run, docs.schema))


def contamination(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.aggregate("_fm_spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return mark_phrases(docs.select("doc_id", "text"), benchmark, **kw).select(
        "doc_id", F.col("_fm_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_fm_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_fm_items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
