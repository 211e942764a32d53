"""Sharding (operator 10): histogram sort under the law ``bytes``.

The order of rows is (60-bit hash of the text, 60-bit hash of the id, id), so rows with
equal texts are neighbours and share a shard unless a shard border falls into their
group. A row's shard is floor(shards * bytes before it / all bytes). The borders
are found by counting: the exact bytes of all rows below a set of probe keys, in one
aggregate; between the two probes that enclose a border new probes are set and only rows
there are counted; once few enough keys lie between (``FINISH_KEYS``) they settle it.
With ``tolerance`` > 0 a probe that is within that share of a shard's bytes is taken.
When a border falls into one text's group, the probes go on over the ids' hashes.

Then the rows are exchanged once, by slices of the order: even ranges of the hash cut at
the shard borders; a text that alone overfills its slice is cut by the ids' hashes too.
Slots are slice-local row numbers plus a prefix sum over the slice counts.

All steps are DataFrame expressions. Driver state: the probes' counts (bounded by
``PROBES`` per border), the borders. The overfull texts (one per slice, the largest) are a
broadcast table of at most ``MAX_SLICES`` rows.

Defined results: size = UTF-8 bytes + 1; a null text counts as empty; a null id hashes
as the empty string; repeated rows of the same id and text sit next to each other in one
shard; an empty table gives no rows; other columns pass through (input columns ``shard``
and ``slot`` are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import documents, sealed

SHARDS = 8
PROBES = 256
FINISH_KEYS = 500
SLICE_ROWS = 20_000
MAX_SLICES = 100_000
_SPAN = 1 << 60


def _hash60(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def with_keys(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Add the order keys ``_hs_t``, ``_hs_i``, ``_hs_id`` and ``_hs_size``."""
    return docs.select(
        "*", _hash60(F.coalesce(F.col(text_col), F.lit(""))).alias("_hs_t"),
        _hash60(F.coalesce(F.col(id_col).cast("string"), F.lit(""))).alias("_hs_i"), F.col(id_col).alias("_hs_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long").alias("_hs_size"))


class _Border:
    """A border being narrowed: rows before it are below ``lo`` in column ``col``
    (``_hs_t``, or ``_hs_i`` inside the one text hash ``text``)."""

    def __init__(self, target: int):
        self.target, self.col, self.text, self.lo, self.hi, self.before, self.key = target, "_hs_t", None, 0, _SPAN, 0, None

    def region(self):
        return self.col, self.text, self.lo, self.hi


def find_borders(keyed: DataFrame, shards: int, tolerance: float = 0.0, probes: int = PROBES,
                 finish_keys: int = FINISH_KEYS) -> list[tuple]:
    """First key (text hash, id hash, id) of shards 1.. (None: no row reaches it)."""
    total = keyed.agg(F.sum("_hs_size").alias("b")).first().b or 0
    borders = [_Border(-(-total * j // shards)) for j in range(1, shards)]
    slack = tolerance * total / shards
    open_ = list(borders) if total else []
    while open_:
        regions = sorted({b.region() for b in open_}, key=str)
        parts = []
        for k, (col, text, lo, hi) in enumerate(regions):
            inside = (F.col(col) >= lo) & (F.col(col) < hi) & (F.lit(True) if text is None else F.col("_hs_t") == text)
            width = -(-(hi - lo) // probes)
            parts.append(F.when(inside, F.struct(F.lit(k).alias("k"), F.expr(f"({col} - {lo}L) div {width}L").alias("bin"))))
        counted = keyed.select(F.array_compact(F.array(*parts)).alias("in"), "_hs_size", "_hs_t", "_hs_i") \
            .select(F.explode("in").alias("in"), "_hs_size", "_hs_t", "_hs_i") \
            .groupBy("in").agg(F.sum("_hs_size").alias("b"), F.count(F.lit(1)).alias("n"),
                               F.min("_hs_t").alias("t0"), F.max("_hs_t").alias("t1"),
                               F.min("_hs_i").alias("i0"), F.max("_hs_i").alias("i1")).collect()
        found: dict = {}
        for r in counted:
            found.setdefault(r["in"]["k"], []).append((r["in"]["bin"], r["b"], r["n"], r["t0"], r["t1"], r["i0"], r["i1"]))
        for border in list(open_):
            col, text, lo, hi = border.region()
            width = -(-(hi - lo) // probes)
            before = border.before
            border.lo = None
            for no, b, n, t0, t1, i0, i1 in sorted(found.get(regions.index((col, text, lo, hi)), [])):
                if before >= border.target - slack and before > 0:
                    border.key = (t0 if text is None else text, i0 if t0 == t1 else 0, None)
                    break
                if before + b > border.target or before >= border.target:
                    border.before, border.count = before, n
                    border.lo, border.hi = lo + no * width, min(hi, lo + (no + 1) * width)
                    if t0 == t1:
                        if text is None:
                            border.col, border.text, border.lo, border.hi = "_hs_i", t0, 0, _SPAN
                        elif i0 == i1:
                            border.count = 0
                            border.lo, border.hi = i0, i0 + 1
                    break
                before += b
            if border.lo is None:
                open_.remove(border)
        ready = [b for b in open_ if b.count <= finish_keys]
        if ready:
            cond = F.lit(False)
            for b in ready:
                here = (F.col(b.col) >= b.lo) & (F.col(b.col) < b.hi)
                cond = cond | (here if b.text is None else here & (F.col("_hs_t") == b.text))
            rows = keyed.filter(cond).groupBy("_hs_t", "_hs_i", "_hs_id").agg(F.sum("_hs_size").alias("b"), F.max("_hs_size").alias("one")).collect()
            rows = sorted(rows, key=lambda r: (r["_hs_t"], r["_hs_i"], r["_hs_id"] is not None, r["_hs_id"] or 0))
            for b in ready:
                before = b.before
                for r in rows:
                    v = r[b.col]
                    if b.lo <= v < b.hi and (b.text is None or r["_hs_t"] == b.text):
                        if before >= b.target:
                            b.key = (r["_hs_t"], r["_hs_i"], r["_hs_id"])
                            break
                        before += r["b"]
                else:
                    b.key = "next"
                open_.remove(b)
        for b in [b for b in borders if b.key == "next"]:
            # every row of the region starts before the border: the border is the first row after it
            after = F.col("_hs_t") > b.text if b.text is not None else F.col("_hs_t") >= b.hi
            if b.text is not None:
                after = after | ((F.col("_hs_t") == b.text) & (F.col("_hs_i") >= b.hi))
            first = keyed.filter(after).agg(F.min(F.struct("_hs_t", "_hs_i", "_hs_id")).alias("k")).first().k
            b.key = None if first is None else tuple(first)
    return [b.key for b in borders]


def _at_or_after(key) -> Column:
    t, i, d = key
    at_id = F.lit(True) if d is None else (F.col("_hs_id") >= F.lit(d))
    return (F.col("_hs_t") > t) | ((F.col("_hs_t") == t) & ((F.col("_hs_i") > i) | ((F.col("_hs_i") == i) & at_id)))


def histogram_sort(docs: DataFrame, shards: int = SHARDS, tolerance: float = 0.0, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``docs`` plus ``shard`` (0..) and ``slot`` (gapless within the shard)."""
    kept, restore = sealed(docs)
    keyed = with_keys(kept)
    narrow = cut_lineage(keyed.select("_hs_t", "_hs_i", "_hs_id", "_hs_size"))
    borders = find_borders(narrow, shards, tolerance)
    slices = max(512, min(MAX_SLICES, -(-narrow.count() // slice_rows)))
    width = -(-_SPAN // slices)
    shard = F.lit(0)
    for key in borders:
        if key is not None:
            shard = shard + F.when(_at_or_after(key), 1).otherwise(0)
    shard = shard.cast("int")
    even = F.expr(f"_hs_t div {width}L")
    full = narrow.groupBy(even.alias("e")).count().filter(F.col("count") > 2 * slice_rows).select("e")
    hot = narrow.join(F.broadcast(full), even == F.col("e"), "left_semi").groupBy(even.alias("_hs_h"), "_hs_t").count() \
        .filter(F.col("count") > slice_rows).groupBy("_hs_h").agg(F.max(F.struct("count", "_hs_t")).alias("m"))
    hot = cut_lineage(hot.select("_hs_h", F.col("m._hs_t").alias("_hs_hot"), F.expr(f"(m.count + {slice_rows - 1}) div {slice_rows}").alias("_hs_n")))

    def sliced(df: DataFrame) -> DataFrame:
        # before, inside (cut evenly by the id hash) or after the overfull text of the slice
        sub = F.when(F.col("_hs_t") == F.col("_hs_hot"), F.expr(f"1 + _hs_i div ({_SPAN - 1}L div _hs_n + 1)")) \
            .when(F.col("_hs_t") > F.col("_hs_hot"), F.col("_hs_n") + 1).otherwise(F.lit(0)).cast("long")
        return df.select("*", shard.alias("shard"), even.alias("_hs_e")).join(
            F.broadcast(hot), F.col("_hs_e") == F.col("_hs_h"), "left").withColumn("_hs_s", sub)

    where = ["shard", "_hs_e", "_hs_s"]
    counts = sliced(narrow).groupBy(*where).agg(F.count(F.lit(1)).alias("n"))
    base = counts.select(*where, (F.sum("n").over(Window.partitionBy("shard").orderBy("_hs_e", "_hs_s")) - F.col("n")).alias("_hs_base"))
    order = Window.partitionBy(*where).orderBy("_hs_t", "_hs_i", "_hs_id")
    numbered = sliced(keyed).withColumn("_hs_no", F.row_number().over(order))
    return restore(numbered.join(cut_lineage(base), where).withColumn(
        "slot", (F.col("_hs_base") + F.col("_hs_no") - 1).cast("long")), ("shard", "slot"))


def shard_report(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    return histogram_sort(docs.select("doc_id", "text"), shards).select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_report(documents(spark, sf_dir))
