"""Train / evaluation text overlap audits.

* exact mode: normalised text equality (lower case, blanks collapsed, trimmed)
  as an equi-join on the normalised text.
* contains mode: is an item's text a substring of a document? Exact, without
  comparing every (item, document) pair. A document that holds the item holds
  all its keys: the *interior* tokens of an item of three or more tokens (not the
  first and last one, which a match may cut: an interior token is delimited by
  non-word characters inside the item, hence a whole token of the document), the
  character triplets of a shorter item (pairs or single characters below three
  characters). Documents give their distinct keys, of which only those that occur in
  some item are kept; each item is joined on the key that the fewest documents hold
  (none, where no document holds one of them), and every candidate is verified with
  ``contains``. Item keys are broadcast behind a count and byte check, and shuffled
  (salted, where a key may be hot) beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlens.operators.classify import share_with_error
from threadlens.operators.skew import salted_join
from threadlens.session import cut_lineage

BROADCAST_ITEMS_MAX = 100_000
BROADCAST_BYTES_MAX = 64 << 20


def normalise(col) -> F.Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " "))


def exact_overlap(items: DataFrame, docs: DataFrame, item_id: str, item_text: str, doc_id: str,
                  doc_text: str) -> DataFrame:
    """(item_id, doc_id) pairs whose normalised texts are equal."""
    i = items.select(F.col(item_id).alias("item_id"), normalise(item_text).alias("k")).filter(F.col("k") != "")
    d = docs.select(F.col(doc_id).alias("doc_id"), normalise(doc_text).alias("k"))
    return i.join(d, "k").select("item_id", "doc_id")


def _tokens(col):
    return F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(r"\w+"), F.lit(0))


def _grams(col, n: int):
    """Every run of ``n`` characters, from every position."""
    return F.regexp_extract_all(F.coalesce(F.col(col), F.lit("")), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def _keys(values, kind: int):
    """Distinct (kind, value) keys; kind 0 is a token, 1 to 3 a run of characters."""
    return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))


def _small(rows: DataFrame, text: str, max_rows: int) -> bool:
    """Whether the rows may be broadcast: their number and the bytes of ``text`` are counted."""
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(text)).alias("b")).first()
    return size["n"] <= max_rows and (size["b"] or 0) <= BROADCAST_BYTES_MAX


def contains_overlap(items: DataFrame, docs: DataFrame, item_id: str, item_text: str, doc_id: str,
                     doc_text: str, max_items: int = BROADCAST_ITEMS_MAX) -> DataFrame:
    """Distinct (item_id, doc_id) pairs where the item's text occurs in the document. Null
    or empty items and rows with a null id are in no pair; of a repeated id every text counts."""
    named = (items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("itext"))
             .filter(F.col("item_id").isNotNull() & (F.length("itext") > 0)).withColumn("_i", F.md5("itext")))
    runs = F.when(F.size("_g3") > 0, _keys(F.col("_g3"), 3)).when(F.size("_g2") > 0, _keys(F.col("_g2"), 2)) \
        .otherwise(_keys(_grams("itext", 1), 1))
    texts = (named.select("_i", "itext").distinct()
             .withColumns({"_t": _tokens("itext"), "_g3": _grams("itext", 3), "_g2": _grams("itext", 2)})
             .withColumn("keys", F.when(F.size("_t") >= 3, _keys(F.slice("_t", 2, F.size("_t") - 2), 0)).otherwise(runs)))
    asked = cut_lineage(texts.select("_i", F.explode("keys").alias("key")).select("_i", "key.*"))
    wanted = asked.select("kind", "value").distinct()
    kinds = sorted(r["kind"] for r in wanted.select("kind").distinct().collect())   # four at most
    body = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("dtext")).filter(F.col("doc_id").isNotNull())
    of_doc = [_keys(_tokens("dtext") if k == 0 else _grams("dtext", k), k) for k in kinds]
    if not kinds:
        return named.join(body, F.lit(False)).select("item_id", "doc_id")
    held = body.select("doc_id", F.explode(F.concat(*of_doc)).alias("key")).select("doc_id", "key.*")
    held = cut_lineage(held.join(F.broadcast(wanted) if _small(wanted, "value", max_items) else wanted, ["kind", "value"], "left_semi"))
    often = held.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n"))
    rarest = (asked.join(often, ["kind", "value"], "left").groupBy("_i")
              .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "kind", "value")).alias("k"))
              .filter(F.col("k.n") > 0).select("_i", F.struct("k.kind", "k.value").alias("key")))
    held = held.select("doc_id", F.struct("kind", "value").alias("key"))
    if _small(rarest, "key.value", max_items):
        found = held.join(F.broadcast(rarest), "key")
    else:
        found = salted_join(held, rarest, "key")
    found = found.select("_i", "doc_id").distinct()
    hits = (found.join(body, "doc_id").join(named.select("_i", "itext").distinct(), "_i")
            .filter(F.col("dtext").contains(F.col("itext"))).select("_i", "doc_id").distinct())
    return hits.join(named.select("_i", "item_id").distinct(), "_i").select("item_id", "doc_id").distinct()


def without_overlap(rows: DataFrame, pairs: DataFrame, row_id: str, pair_id: str | None = None) -> DataFrame:
    """E7, anti form: the rows (all columns) that are in no pair. Ids that were found are
    made distinct before the join, so an id in many pairs is one row of it; rows with a
    null id are in no pair and stay."""
    found = pairs.select(F.col(pair_id or row_id).alias("_found")).filter(F.col("_found").isNotNull()).distinct()
    return rows.join(found, rows[row_id] == found["_found"], "left_anti")


def overlap_summary(items: DataFrame, pairs: DataFrame, item_id: str) -> DataFrame:
    """G11 over items: n, share found, standard error, documents touched."""
    flagged = items.select(F.col(item_id).alias("item_id")).join(
        pairs.select("item_id").distinct().withColumn("_f", F.lit(True)), "item_id", "left")
    per_item = flagged.agg(*share_with_error(F.coalesce(F.col("_f"), F.lit(False))))
    docs = pairs.agg(F.countDistinct("doc_id").alias("n_docs_touched"))
    return per_item.withColumn("_k", F.lit(1)).join(docs.withColumn("_k", F.lit(1)), "_k").drop("_k")


def seen_flags(eval_rows: DataFrame, train_rows: DataFrame, text_col: str) -> DataFrame:
    """Add ``seen`` = the normalised text occurs in the training rows (a
    left join on the distinct normalised training texts)."""
    seen = train_rows.select(normalise(text_col).alias("_k")).distinct().withColumn("seen", F.lit(True))
    return (eval_rows.withColumn("_k", normalise(text_col)).join(seen, "_k", "left")
            .withColumn("seen", F.coalesce("seen", F.lit(False))).drop("_k"))
