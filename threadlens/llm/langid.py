"""Language identification (operator 9): language-bitmask n-gram filters.

Training counts, for every language, in how many of its documents each byte 4-gram
occurs (all training documents; lower case, everything but letters as a space, at least
two bytes that are no space). A language contains a 4-gram if at least ``MIN_RATE`` of
its documents do and at least ``MIN_SHARE`` of the rate of the language where it is most
frequent. The (4-gram, language mask) table goes into one bit-sliced Bloom filter: slot i
holds one bit per language, so ``HASHES`` reads and an AND give all languages that
contain a 4-gram.

A text's votes are per-language popcounts over all its 4-grams. A language with fill f
in its slice answers by mistake with probability f^HASHES, so its share of hits is
corrected to (share - p) / (1 - p). The largest corrected share wins (ties: first name);
the score is its part of the sum.

The counts are partial aggregates of task-local counts; the filter's size follows from
the number of entries, which is at most (4-grams per document) / MIN_RATE per language, and
is checked against ``MAX_FILTER_BYTES`` (beyond it MIN_RATE is doubled) before it is broadcast.

Defined results: null text, or text without a letter, is ``und`` with score 0; a text
with letters but no hit gets the most frequent training language and its share of the
training documents; without training rows everything is ``und``; rows with null lang
don't train; other columns pass through ``identify`` (which adds ``lang_pred``,
``score``; input columns of those names are replaced).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .common import U64, documents, map_arrow, mix, sealed, text_parts

MIN_RATE = 0.01
MIN_SHARE = 0.3
HASHES = 3
MAX_FILTER_BYTES = 64_000_000
_FLUSH = 400_000
_SPACE = np.arange(256, dtype=np.uint8)
_SPACE[[*range(0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = 0x20


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _plain(col: pa.Array) -> pa.Array:
    """Lower case with a space on either side, as large_binary."""
    text = pc.utf8_lower(pc.fill_null(col.cast(pa.large_string()), ""))
    return pc.binary_join_element_wise(pa.scalar("", pa.large_string()), text, pa.scalar("", pa.large_string()),
                                       pa.scalar(" ", pa.large_string())).cast(pa.large_binary())


def grams(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, 4-gram) of every kept position."""
    if len(raw) < 4:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    b = _SPACE[raw]
    letters = (b != 0x20).astype(np.int8)
    b = b.astype(np.uint32)
    gram = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    enough = letters[:-3] + letters[1:-2] + letters[2:-1] + letters[3:] >= 2
    row = np.repeat(np.arange(len(offs) - 1, dtype=np.int32), np.diff(offs))
    keep = np.flatnonzero(enough & (row[:-3] == row[3:]))
    return row[keep], gram[keep]


def gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n): documents of the language with the 4-gram."""
    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def rows():
            for lang, parts in held.items():
                g = np.concatenate([p[0] for p in parts])
                n = np.concatenate([p[1] for p in parts])
                u, inv = np.unique(g, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(u), pa.string()), pa.array(u, pa.int64()),
                     pa.array(np.bincount(inv, n).astype(np.int64))], names=["lang", "gram", "n"])

        for batch in batches:
            langs = batch.column(batch.schema.get_field_index("lang"))
            text = _plain(batch.column(batch.schema.get_field_index("text")))
            for lo, hi, raw, offs in text_parts(text, 1_000_000):
                row, gram = grams(raw, offs)
                names, code = np.unique(np.array(langs.slice(lo, hi - lo).to_pylist(), dtype=object).astype(str), return_inverse=True)
                key = np.unique(row.astype(U64) << U64(32) | gram)
                lang_of = code[(key >> U64(32)).astype(np.int64)]
                g = (key & U64(0xFFFFFFFF)).astype(np.int64)
                for k, name in enumerate(names):
                    u, n = np.unique(g[lang_of == k], return_counts=True)
                    held.setdefault(str(name), []).append((u, n))
                    size += len(u)
                if size > _FLUSH:
                    merged = list(rows())
                    size = sum(m.num_rows for m in merged)
                    if size > _FLUSH:
                        yield from merged
                        held, size = {}, 0
                    else:
                        held = {m.column(0)[0].as_py(): [(m.column(1).to_numpy(), m.column(2).to_numpy())] for m in merged if m.num_rows}
        yield from rows()

    return map_arrow(train.select("lang", "text"), run, "lang string, gram long, n long") \
        .groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class LanguageFilter:
    """The bit-sliced Bloom filter and what deciding needs."""

    def __init__(self, langs: list[str], shares: list[float], slots: np.ndarray):
        self.langs, self.shares, self.slots = langs, shares, slots  # slots: words x n
        bits = [(slots[k // 64] >> U64(k % 64)) & U64(1) for k in range(len(langs))]
        self.mistake = np.array([float(b.mean()) ** HASHES for b in bits])

    def masks(self, gram: np.ndarray) -> np.ndarray:
        """words x n: the languages that contain each 4-gram."""
        out = None
        for at in slot_numbers(gram, self.slots.shape[1]):
            got = self.slots[:, at]
            out = got if out is None else out & got
        return out

    def decide(self, raw: np.ndarray, offs: np.ndarray) -> tuple[list, np.ndarray]:
        n_rows = len(offs) - 1
        row, gram = grams(raw, offs)
        n = np.bincount(row, minlength=n_rows).astype(float)
        mask = self.masks(gram)
        share = np.zeros((len(self.langs), n_rows))
        for k in range(len(self.langs)):
            hit = np.bincount(row, ((mask[k // 64] >> U64(k % 64)) & U64(1)).astype(np.float64), minlength=n_rows)
            p = self.mistake[k]
            share[k] = np.maximum(0.0, (hit / np.maximum(n, 1) - p) / max(1e-9, 1 - p))
        total = share.sum(axis=0)
        best = share.argmax(axis=0)
        usual = int(np.argmax(self.shares))
        best[total <= 0] = usual
        score = np.where(total > 0, share.max(axis=0) / np.maximum(total, 1e-300), self.shares[usual])
        return [self.langs[b] for b in best], np.clip(score, 0.0, 1.0)


def slot_numbers(gram: np.ndarray, n: int) -> list[np.ndarray]:
    """Slots of each 4-gram; ``n`` is a power of two."""
    h = mix(gram.astype(U64) + U64(0x9E3779B97F4A7C15))
    a, b = h & U64(0xFFFFFFFF), (h >> U64(32)) | U64(1)
    return [((a + U64(i) * b) & U64(n - 1)).astype(np.int64) for i in range(HASHES)]


def train(docs: DataFrame, min_rate: float = MIN_RATE, min_share: float = MIN_SHARE) -> LanguageFilter | None:
    """Fit on all rows of (text, lang) with a lang."""
    spark = docs.sparkSession
    rows = docs.filter("lang is not null")
    counts = sorted((r["lang"], r["count"]) for r in rows.groupBy("lang").count().collect())
    if not counts:
        return None
    langs, total = [c[0] for c in counts], sum(c[1] for c in counts)
    sizes = spark.createDataFrame([(name, k, n) for k, (name, n) in enumerate(counts)], "lang string, no int, docs long")
    rates = cut_lineage(gram_counts(rows).join(F.broadcast(sizes), "lang")
                        .select("gram", "no", (F.col("n") / F.col("docs")).alias("rate")).filter(F.col("rate") >= min_rate))
    words = -(-len(langs) // 64)
    while True:
        kept = rates.filter(F.col("rate") >= min_rate)
        kept = kept.join(kept.groupBy("gram").agg(F.max("rate").alias("top")), "gram").filter(F.col("rate") >= min_share * F.col("top"))
        entries = kept.select("gram").distinct().count()
        n = 1 << max(10, (12 * max(1, entries) - 1).bit_length())
        if n * 8 * words <= MAX_FILTER_BYTES:
            break
        min_rate *= 2

    def put(batches):
        for batch in batches:
            gram, no = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at in slot_numbers(gram, n):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(at), pa.array(no // 64, pa.int32()), pa.array(np.left_shift(U64(1), (no % 64).astype(U64)).view(np.int64))],
                    names=["slot", "word", "bit"])

    slots = map_arrow(kept.select("gram", "no"), put, "slot long, word int, bit long") \
        .groupBy("slot", "word").agg(F.bit_or("bit").alias("bits")).toPandas()
    table = np.zeros((words, n), U64)
    table[slots["word"].to_numpy(), slots["slot"].to_numpy()] = slots["bits"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilter(langs, [c[1] / total for c in counts], table)


def identify(docs: DataFrame, model: LanguageFilter | None) -> DataFrame:
    """``docs`` plus ``lang_pred`` and ``score``."""
    kept, restore = sealed(docs)
    if model is None:
        return restore(kept.select("*", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score")), ("lang_pred", "score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = kept.withColumn("_li_letter", F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False)))
    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches):
        model = shared.value
        for batch in batches:
            letter = batch.column(batch.num_columns - 1)
            text = _plain(batch.column(batch.schema.get_field_index("text")))
            for lo, hi, raw, offs in text_parts(text, 1_000_000):
                names, score = model.decide(raw, offs)
                ok = letter.slice(lo, hi - lo)
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pc.if_else(ok, pa.array(names, pa.string()), pa.scalar("und")),
                     pc.if_else(ok, pa.array(score), pa.scalar(0.0))], names=schema.names)

    return restore(map_arrow(rows, run, schema), ("lang_pred", "score"))


def language_report(docs: DataFrame) -> DataFrame:
    """Fit on the rows that are not held out; predict all of them."""
    model = train(docs.filter(~held_out()).select("text", "lang"))
    return identify(docs.select("doc_id", "text", held_out().alias("held_out")), model).drop("text")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(documents(spark, sf_dir))
