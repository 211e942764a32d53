"""Vector column expressions: L2 norm / normalisation, hashed text vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def as_double(vec) -> Column:
    """float elements -> double first, so sums agree across engines."""
    return F.transform(_c(vec), lambda x: x.cast("double"))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable
    (SQL has no LET; a one-element transform binds it). Without this, an
    expression used inside a per-element lambda is re-evaluated per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def l2_norm(vec) -> Column:
    return F.sqrt(F.aggregate(as_double(vec), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def l2_normalize(vec) -> Column:
    """H2: v / |v|; the zero vector stays zero. The vector and its norm are
    each computed once per row."""
    return let(as_double(vec), lambda v: let(l2_norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n))
                                             .otherwise(v)))


def term_bucket(term, dim: int) -> Column:
    """Stable bucket of a term: first 8 hex digits of md5, mod dim (same in
    any engine with md5)."""
    return F.pmod(F.conv(F.substring(F.md5(_c(term)), 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")


def hashed_tf_vectors(df: DataFrame, id_col: str, text_col: str, dim: int = 256,
                      out_col: str = "embedding") -> DataFrame:
    """H1 built-in encoder (no model needed): lower-cased tokens of >= 2 word
    characters, hashed into ``dim`` buckets, weight 1 + ln(count), L2
    normalised; returns (id, dense array<double>). Rows without tokens get
    the zero vector.

    One pass over ``df``: explode_outer (a row without tokens keeps one null
    term) -> partial aggregate per (id, bucket) -> one collect per id, bounded
    by ``dim`` entries."""
    toks = (df.select(id_col, F.explode_outer(F.regexp_extract_all(F.lower(F.coalesce(F.col(text_col), F.lit(""))),
                                                                   F.lit(r"\b\w\w+\b"), 0)).alias("term"))
            .withColumn("bucket", term_bucket("term", dim))
            .groupBy(id_col, "bucket").agg(F.count("term").alias("tf")))
    entry = F.when(F.col("tf") > 0, F.struct("bucket", (F.lit(1.0) + F.log(F.col("tf").cast("double"))).alias("w")))
    sparse = toks.groupBy(id_col).agg(F.map_from_entries(F.collect_list(entry)).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    return sparse.select(id_col, l2_normalize(dense).alias(out_col))
