"""Ordinal position inside a group without sorting a hot group in one task.

``row_number() over (partition by g order by k)`` sends a whole group to one
task. When one group can hold a third of all rows, that task is the job. Here
the rows are cut into chunks at quantiles of ``k`` over the whole table (so the
values of ``k`` may be sparse); rows are numbered inside each (g, chunk) and a
prefix sum of chunk sizes, over the much smaller table of chunks, is added back.
A null group is a group; a null key comes first in it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 1 << 16  # rows may hold texts: a chunk is what one task reads
MAX_CHUNKS = 256


def chunk_edges(df: DataFrame, order_col: str, chunk_rows: int = CHUNK_ROWS) -> list[int]:
    """Ascending key values that start a chunk: quantiles over all rows, in one
    aggregate (at most ``MAX_CHUNKS`` - 1 values)."""
    q = [i / MAX_CHUNKS for i in range(1, MAX_CHUNKS)]
    r = df.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(order_col, q, 20 * MAX_CHUNKS).alias("q")).first()
    chunks = min(MAX_CHUNKS, -(-r.n // chunk_rows))
    if chunks <= 1 or not r.q:
        return []
    step = MAX_CHUNKS / chunks
    return sorted({int(r.q[min(len(q) - 1, max(0, round(i * step) - 1))]) for i in range(1, chunks)})


def ordinal_within(df: DataFrame, group_col: str, order_col: str, out_col: str,
                   chunk_rows: int = CHUNK_ROWS, tie_col: str | None = None) -> DataFrame:
    """Add ``out_col`` = 1-based position of the row in its group, ordered by
    ``order_col`` (a long; ``tie_col`` breaks ties). Same values as
    ``row_number() over (partition by group order by order_col, tie_col)``."""
    order = [F.col(order_col)] + ([F.col(tie_col)] if tie_col else [])
    edges = chunk_edges(df, order_col, chunk_rows)
    if not edges:  # one chunk: the whole table is no larger than a chunk
        return df.withColumn(out_col, F.row_number().over(Window.partitionBy(group_col).orderBy(*order)))
    starts = F.array(*[F.lit(e).cast("long") for e in edges])
    chunk = F.coalesce(F.size(F.filter(starts, lambda e: e <= F.col(order_col))), F.lit(0))
    chunked = df.withColumn("_chunk", F.when(F.col(order_col).isNull(), F.lit(0)).otherwise(chunk))
    local = chunked.withColumn(
        "_local", F.row_number().over(Window.partitionBy(group_col, "_chunk").orderBy(*order)))
    sizes = chunked.groupBy(group_col, "_chunk").agg(F.count(F.lit(1)).alias("_n"))
    offsets = sizes.select(
        F.col(group_col).alias("_og"), F.col("_chunk").alias("_oc"),
        F.coalesce(F.sum("_n").over(Window.partitionBy(group_col).orderBy("_chunk")
                                    .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    return (local.join(offsets, F.col(group_col).eqNullSafe(F.col("_og")) & (F.col("_chunk") == F.col("_oc")))
            .withColumn(out_col, (F.col("_offset") + F.col("_local")).cast("int"))
            .drop("_chunk", "_local", "_offset", "_og", "_oc"))
