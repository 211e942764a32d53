"""Quality classifier (operator 2): interpolated modified Kneser-Ney character model.

Trained on trusted text (labelled quality 1; by crc32(doc_id) mod 4, rows 0 and 1 give
the counts, rows 3 the thresholds, rows 2 are held out), order 4. A 4-gram is one
64-bit integer, 16 bits a character (characters above U+FFFF share 2,048 codes), so
contexts and shorter grams are shifts and masks of it, and counting is SQL:

1. Documents go to blocks by the hash of their id (exchanged in compressed packs, here
   and in step 3), labels to the same blocks. A block sends each distinct 4-gram once, with its
   count in trusted text (0: only elsewhere).
2. Counts of order 4 are sums; counts of lower orders are continuation counts (distinct
   left extensions); discounts come from the counts of counts of each order. The log
   probability of every distinct 4-gram is a chain of joins with the count and context
   tables, sharded by gram; only the tables of single characters (65,536 rows at most)
   are broadcast.
3. The log probabilities go back to the blocks that asked; a block sums them per document.

Perplexity is exp(-mean log probability per character). A document is kept if its
perplexity is at most ``SLACK`` times the ``QUANTILE`` of the trusted documents of its
language that the counts have not seen (of all of them, if its language has fewer than
``MIN_TRUSTED``).

Defined results: null or empty text has no perplexity and is not kept; null lang is a
language of its own; a label table that repeats an id trusts it if all its rows do; an
unseen character has the uniform share of the unigram level; without trusted text all
perplexities are null and nothing is kept.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package
from .common import U64, corpus_size, documents, int_column, pack_by, text_column, unpack
from .langid import held_out

ORDER = 4
QUANTILE = 0.99
SLACK = 1.25
MIN_TRUSTED = 20
BLOCK_BYTES = 12_000_000
_START = 0xDFFF
_PART_CHARS = 1_000_000
_MASK = {k: (1 << 16 * k) - 1 for k in range(1, 5)}


def text_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(4-grams of all texts in order, characters per text); the first characters see
    start marks before them."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(code > 0xFFFF, 0xD800 + (code & 0x7FF), code).astype(U64)
    at = np.arange(len(code)) - np.repeat(np.cumsum(n) - n, n)
    gram = code.copy()
    for back in range(1, ORDER):
        prev = np.empty_like(code)
        prev[back:] = code[:len(code) - back]
        prev[:back] = _START
        prev[at < back] = _START
        gram |= prev << U64(16 * back)
    return gram, n


def _parts(texts: list[str]):
    lo, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= _PART_CHARS:
            yield lo, k + 1
            lo, size = k + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _merge(parts: list) -> tuple[np.ndarray, np.ndarray]:
    g = np.concatenate([p[0] for p in parts])
    c = np.concatenate([p[1] for p in parts])
    u, inv = np.unique(g, return_inverse=True)
    return u, np.bincount(inv, c).astype(np.int64)


def gram_rows(docs: pa.Table, trusted: pa.Table) -> pa.Table:
    """(_blk, gram, n): the block's distinct 4-grams and their counts in trusted text."""
    if docs.num_rows == 0:
        return pa.table({"_blk": pa.array([], pa.int32()), "gram": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
    blk, docs = docs["_blk"][0].as_py(), unpack(docs)
    ids = int_column(docs, "doc_id").to_pylist()
    good = set(int_column(trusted, "doc_id").to_pylist())
    texts = [t.decode() for t in text_column(docs).to_pylist()]
    parts = [(np.zeros(0, U64), np.zeros(0))]
    for lo, hi in _parts(texts):
        gram, n = text_grams(texts[lo:hi])
        use = np.repeat(np.array([i in good for i in ids[lo:hi]], dtype=float), n)
        u, inv = np.unique(gram, return_inverse=True)
        parts.append((u, np.bincount(inv, use)))
        if len(parts) > 8:
            parts = [_merge(parts)]
    u, c = _merge(parts)
    return pa.table({"_blk": pa.array(np.full(len(u), blk), pa.int32()),
                     "gram": pa.array(u.view(np.int64)), "n": pa.array(c, pa.int64())})


def _discounts(counts: DataFrame) -> list[float]:
    """D1, D2, D3+ of one order from its counts of counts."""
    have = {r.n: r.k for r in counts.filter("n <= 4").groupBy("n").agg(F.count(F.lit(1)).alias("k")).collect()}
    n1, n2, n3, n4 = (have.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and y else 0.5 * k
        out.append(min(max(d, 0.1), k - 0.05))
    return out


def _level(counts: DataFrame, gram, order: int):
    """(grams with their discounted share's parts, contexts with total and backoff mass)."""
    d = _discounts(counts)
    cut = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    rows = counts.select("g", (F.col("n") - cut).alias("left"), "n", cut.alias("cut"))
    ctx = rows.groupBy(F.shiftrightunsigned("g", 16).alias("h")).agg(
        F.sum("n").alias(f"t{order}"), F.sum("cut").alias(f"d{order}"))
    return rows.select(F.col("g").alias(f"g{order}"), F.col("left").alias(f"l{order}")), \
        ctx.select(F.col("h").alias(f"h{order}"), f"t{order}", f"d{order}")


def gram_log_probs(rows: DataFrame) -> DataFrame:
    """(gram, lp) for every distinct gram of ``rows`` (gram, n)."""
    sums = cut_lineage(rows.groupBy("gram").agg(F.sum("n").alias("n")))
    counts = {4: sums.filter("n > 0").select(F.col("gram").alias("g"), "n")}
    for k in (3, 2, 1):
        counts[k] = counts[k + 1].groupBy(F.col("g").bitwiseAND(F.lit(_MASK[k]).cast("long")).alias("g")).agg(F.count(F.lit(1)).alias("n"))
    counts = {k: cut_lineage(c) for k, c in counts.items()}
    alphabet = counts[1].count() + 1
    out = sums.select("gram")
    p = F.lit(1.0 / alphabet)
    for k in (1, 2, 3, 4):
        seen, ctx = _level(counts[k], F.col("g"), k)
        low = F.col("gram") if k == 4 else F.col("gram").bitwiseAND(F.lit(_MASK[k]).cast("long"))
        if k <= 2:  # at most 65,536 contexts; at order 1 also at most 65,536 grams
            ctx = F.broadcast(ctx)
        if k == 1:
            seen = F.broadcast(seen)
        out = out.select("*", low.alias("_g"), F.shiftrightunsigned(low, 16).alias("_h"))
        out = out.join(seen, F.col("_g") == F.col(f"g{k}"), "left").join(ctx, F.col("_h") == F.col(f"h{k}"), "left")
        step = F.when(F.col(f"t{k}").isNull(), p).otherwise(
            (F.coalesce(F.col(f"l{k}"), F.lit(0.0)) + F.col(f"d{k}") * p) / F.col(f"t{k}"))
        out = out.select("gram", step.alias("p"))
        p = F.col("p")
        if k < 4:
            out = out.select("gram", "p")
    return out.select("gram", F.log("p").alias("lp"))


_SCORED = "doc_id long, lang string, trusted boolean, n_chars long, log_prob double"


def _fold():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4


def score(docs: DataFrame, labels: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, lang, trusted, n_chars, log_prob): trusted marks the rows labelled so (of
    folds 0, 1 and 3); log_prob is null where there is no text or no model."""
    spark = docs.sparkSession
    ship_package(spark)
    n, size = corpus_size(docs)
    blocks = max(1, -(-size // block_bytes), -(-n // 1_000_000))
    blk = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("_blk")
    rows = pack_by(docs.select(blk, "doc_id", "text", "lang"))
    good = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality"), F.lit(0))).alias("q")) \
        .filter((F.col("q") >= 1) & ~held_out()).select(blk, "doc_id", _fold().alias("fold"))

    def count(a: pa.Table, b: pa.Table) -> pa.Table:
        return gram_rows(a, b)

    asked = rows.groupBy("_blk").cogroup(good.filter("fold < 2").groupBy("_blk")).applyInArrow(count, "_blk int, gram long, n long")
    asked = cut_lineage(asked)
    probs = gram_log_probs(asked.select("gram", "n"))
    some = asked.filter("n > 0").head(1)
    answers = asked.select("_blk", "gram").join(probs, "gram").select("_blk", "gram", "lp", F.lit(None).cast("long").alias("doc_id")) \
        .unionByName(good.select("_blk", F.lit(None).cast("long").alias("gram"), F.lit(None).cast("double").alias("lp"), "doc_id"))
    fitted = bool(some)

    def finish(table: pa.Table, got: pa.Table) -> pa.Table:
        table = unpack(table)
        ids = int_column(table, "doc_id")
        known = set(int_column(got, "doc_id").drop_null().to_pylist())
        keys = got["gram"].combine_chunks().drop_null() if got.num_rows else pa.array([], pa.int64())
        keys = keys if isinstance(keys, pa.Array) else pa.concat_arrays(keys.chunks)
        lp = got["lp"].combine_chunks().drop_null() if got.num_rows else pa.array([], pa.float64())
        lp = lp if isinstance(lp, pa.Array) else pa.concat_arrays(lp.chunks)
        k = keys.to_numpy(zero_copy_only=False).view(np.uint64)
        order = np.argsort(k)
        k, v = k[order], lp.to_numpy(zero_copy_only=False)[order]
        texts = [t.decode() for t in text_column(table).to_pylist()]
        total, size = [], []
        for lo, hi in _parts(texts):
            gram, n = text_grams(texts[lo:hi])
            sums = np.concatenate([[0.0], np.cumsum(v[np.searchsorted(k, gram)] if len(gram) else np.zeros(0))])
            ends = np.cumsum(n)
            total.append(sums[ends] - sums[ends - n])
            size.append(n)
        total, size = np.concatenate(total), np.concatenate(size)
        return pa.table([ids, table["lang"], pa.array([i in known for i in ids.to_pylist()], pa.bool_()), pa.array(size, pa.int64()),
                         pa.array(total, pa.float64(), mask=(size == 0) | (not fitted))],
                        names=["doc_id", "lang", "trusted", "n_chars", "log_prob"])

    empty = pa.table({"doc_id": pa.array([], pa.int64()), "lang": pa.array([], pa.string()), "trusted": pa.array([], pa.bool_()),
                      "n_chars": pa.array([], pa.int64()), "log_prob": pa.array([], pa.float64())})

    def end(table: pa.Table, got: pa.Table) -> pa.Table:
        return finish(table, got) if table.num_rows else empty

    return rows.groupBy("_blk").cogroup(answers.groupBy("_blk")).applyInArrow(end, _SCORED)


def quality_report(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """Per document: doc_id, lang, held_out, trusted, n_chars, perplexity, threshold, kept."""
    scored = cut_lineage(score(docs.select("doc_id", "text", "lang"), labels.select("doc_id", "quality"))
                         .withColumn("perplexity", F.exp(-F.col("log_prob") / F.col("n_chars"))))
    unseen = scored.filter((F.col("trusted") & F.col("perplexity").isNotNull()) & (_fold() == 3))
    cut = SLACK * F.percentile_approx("perplexity", quantile, 100_000)
    by_lang = unseen.groupBy(F.col("lang").alias("_lang")).agg(cut.alias("own"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= MIN_TRUSTED)
    whole = unseen.agg(cut.alias("all"))
    threshold = F.coalesce("own", "all")
    return scored.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").crossJoin(F.broadcast(whole)).select(
        "doc_id", "lang", held_out().alias("held_out"), "trusted", "n_chars", "perplexity", threshold.alias("threshold"),
        F.coalesce(F.col("perplexity") <= threshold, F.lit(False)).alias("kept"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
