"""H8, H3: a vector index in cells on files, probed or searched exactly.

Index (``build_cells``). Every vector is normalised and goes to the nearest of ``n_cells``
centres (``pivot_centres``: vectors of the table itself, chosen by a hash of their id, so
that any engine can repeat the choice; or ``kmeans_centres``). The rows are written once,
partitioned by shard (neighbouring cells share one) and sorted by cell inside a file, so
both the folder names and the row group ranges of the cell column prune a scan. Beside
them is one row per cell: centre, number of vectors, radius (the largest distance of its
vectors to the centre). A hot cell is dealt over several files. The index is published as a
version (``index_store.publish``); readers of the one before are not disturbed.

Search (``search``). The queries travel to the index, never the index to the queries: a
block of queries of a checked size is broadcast, the scan of the visited cells scores its
Arrow batches by numpy products and keeps the ``k`` best of each query per task; a group
limit merges the tasks. There is no exchange of index rows and no row per pair.
* probe (H8): a query visits its ``n_probe`` nearest cells, found on the centres.
* exact (H3): first the cells nearest to the query until they hold ``first`` * k vectors;
  their k-th best score is a floor. For unit vectors |q - v| >= |q - c| - radius, so a cell
  with 1 - (|q - c| - radius)^2 / 2 under the floor holds nothing better. The second pass
  visits the cells that stay; the result is that of a search of everything.

Scores are rounded to ``DIGITS`` digits before ranking, ties go to the smaller vector id; a
zero vector scores 0. Null vectors, and vectors with a null or non-finite element, are left
out of the index; as queries they have no hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadlens.functions.vectors import as_double, l2_normalize
from threadlens.session import cut_lineage, ship_package
from threadlens.sources import index_store

DIGITS = 12
BLOCK_BYTES = 32 << 20      # query vectors broadcast at once
SHARDS = 64
FILE_ROWS = 1 << 18
VECTORS = "cell int, vector_id long, dist double, vector array<double>, shard int"
HITS = "query_id long, vector_id long, score double"


def _usable(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vector_id, vector): normalised vectors of finite elements."""
    fine = F.forall("v", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    return (df.select(F.col(id_col).cast("long").alias("vector_id"), as_double(vec_col).alias("v"))
            .filter(F.col("v").isNotNull() & fine).select("vector_id", l2_normalize("v").alias("vector")))


def _matrix(col) -> np.ndarray:
    """Rows of a list column (of equal lengths) as float64."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    if len(col) == 0:
        return np.zeros((0, 0))
    return np.asarray(col.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(col), -1)


# --- centres ----------------------------------------------------------------------

def pivot_centres(index: DataFrame, n_cells: int, id_col: str = "vector_id", vec_col: str = "embedding",
                  seed: int = 42) -> np.ndarray:
    """The vectors with the smallest md5('seed-id') (ties by id), in that order: a top-n of
    ``n_cells`` rows, whose size is a parameter. Zero vectors are no centres."""
    rows = (_usable(index, id_col, vec_col).filter(F.exists("vector", lambda x: x != 0))
            .orderBy(F.md5(F.concat(F.lit(f"{seed}-"), F.col("vector_id").cast("string"))), "vector_id").limit(n_cells)
            .select("vector").toArrow())
    return _matrix(rows["vector"])


def kmeans_centres(index: DataFrame, n_cells: int, id_col: str = "vector_id", vec_col: str = "embedding",
                   seed: int = 7, fit_rows: int = 500_000) -> np.ndarray:
    """Centres of ``pyspark.ml`` k-means on about ``fit_rows`` rows chosen by a hash of the id
    (a documented bound; every row is indexed)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    rows = _usable(index, id_col, vec_col)
    n = rows.count()
    share = F.pmod(F.xxhash64("vector_id", F.lit(seed)), F.lit(1_000_000)) < F.lit(int(min(1.0, fit_rows / max(1, n)) * 1_000_000))
    model = KMeans(k=n_cells, seed=seed, maxIter=10, featuresCol="f").fit(rows.filter(share).select(array_to_vector("vector").alias("f")))
    centres = np.asarray(model.clusterCenters(), np.float64)
    norm = np.linalg.norm(centres, axis=1, keepdims=True)
    return np.divide(centres, norm, out=np.zeros_like(centres), where=norm > 0)


# --- index ------------------------------------------------------------------------

def _assigned(rows: DataFrame, centres: np.ndarray, shards: int) -> DataFrame:
    schema = [("cell", pa.int32()), ("vector_id", pa.int64()), ("dist", pa.float64()), ("vector", pa.list_(pa.float64())),
              ("shard", pa.int32())]

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                v = _matrix(part.column(1))
                near = np.round(v @ centres.T, DIGITS)
                cell = near.argmax(1)  # the first of equally near ones
                gap = v - centres[cell]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int32()), part.column(0).cast(pa.int64()), pa.array(np.sqrt((gap * gap).sum(1))),
                     part.column(1).cast(pa.list_(pa.float64())), pa.array(cell * shards // len(centres), pa.int32())],
                    names=[n for n, _ in schema])

    ship_package(rows.sparkSession)
    return rows.mapInArrow(run, VECTORS)


def build_cells(index: DataFrame, path: str, centres: np.ndarray, id_col: str = "vector_id", vec_col: str = "embedding",
                shards: int = SHARDS, file_rows: int = FILE_ROWS) -> str:
    """Write the index of ``index`` as a new version under ``path``; returns its folder."""
    spark = index.sparkSession
    if len(centres) == 0:
        raise ValueError("an index needs at least one centre")
    shards = min(shards, len(centres))
    rows = cut_lineage(_assigned(_usable(index, id_col, vec_col), centres, shards))
    sizes = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()  # at most ``shards`` rows
    files = {r.shard: -(-r.n // file_rows) for r in sizes}
    deal = F.element_at(F.create_map(*[F.lit(x) for kv in files.items() for x in kv]), F.col("shard")) if files else F.lit(1)
    dealt = rows.withColumn("_file", F.pmod(F.xxhash64("vector_id"), deal))

    def write(folder: str) -> None:
        (dealt.repartition(max(1, sum(files.values())), "shard", "_file").sortWithinPartitions("shard", "cell", "vector_id")
         .drop("_file").write.partitionBy("shard").parquet(f"{folder}/vectors"))
        stats = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("dist").alias("radius"))
        table = spark.createDataFrame([(i, c.tolist(), i * shards // len(centres)) for i, c in enumerate(centres)],
                                      "cell int, centre array<double>, shard int")
        table.join(stats, "cell", "left").fillna(0, ["n"]).fillna(0.0, ["radius"]).coalesce(1).write.parquet(f"{folder}/cells")

    return index_store.publish(spark, path, write)


class CellIndex:
    """A published index: the cell table is read once (its size is that of the centres)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.folder = spark, index_store.current(spark, path)
        cells = spark.read.parquet(f"{self.folder}/cells").orderBy("cell").toArrow()
        self.centres = _matrix(cells["centre"])
        self.counts = cells["n"].to_numpy()
        self.radius = cells["radius"].to_numpy()
        self.shard = cells["shard"].to_numpy()

    def scan(self, cells: np.ndarray) -> DataFrame:
        """The vectors of some cells: folders by shard, row groups by cell."""
        every = len(cells) == len(self.centres)
        rows = self.spark.read.schema(VECTORS).parquet(f"{self.folder}/vectors")
        if every:
            return rows
        return rows.filter(F.col("shard").isin(np.unique(self.shard[cells]).tolist()) & F.col("cell").isin(cells.tolist()))


def _best(query: np.ndarray, vector: np.ndarray, score: np.ndarray, k: int):
    """The k best (score, then smaller vector id) of every query, as flat arrays."""
    order = np.lexsort((vector, -score, query))
    query, vector, score = query[order], vector[order], score[order]
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]]) if len(query) else np.zeros(0, int)
    rank = np.arange(len(query)) - np.repeat(first, np.diff(np.r_[first, len(query)]))
    keep = rank < k
    return query[keep], vector[keep], score[keep]


def _visit(index: CellIndex, ids: np.ndarray, q: np.ndarray, visits: np.ndarray, k: int, exclude_self: bool) -> DataFrame:
    """(query_id, vector_id, score): the k best per query and task over the visited cells;
    ``visits`` is queries x cells. Queries, ids and visits are broadcast."""
    spark = index.spark
    ship_package(spark)
    cells = np.flatnonzero(visits.any(axis=0) & (index.counts > 0))
    if len(cells) == 0:
        return spark.createDataFrame([], HITS)
    sent = spark.sparkContext.broadcast((ids, q, {int(c): np.flatnonzero(visits[:, c]) for c in cells}))

    def run(batches):
        ids, q, asked = sent.value
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            cell, vid = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            vectors = _matrix(batch.column(2))
            found = [held]
            for c in np.unique(cell):
                at, who = np.flatnonzero(cell == c), asked.get(int(c))
                for lo in range(0, len(who), max(1, 4_000_000 // len(at))):
                    some = who[lo:lo + max(1, 4_000_000 // len(at))]
                    s = np.round(q[some] @ vectors[at].T, DIGITS) + 0.0
                    if exclude_self:
                        s[ids[some][:, None] == vid[at][None, :]] = -np.inf
                    keep = np.ones(s.shape, bool) if len(at) <= k else s >= np.partition(s, len(at) - k, axis=1)[:, len(at) - k][:, None]
                    keep &= np.isfinite(s)
                    r, col = np.nonzero(keep)
                    found.append((some[r], vid[at][col], s[r, col]))
            held = _best(*[np.concatenate(x) for x in zip(*found)], k)
        if len(held[0]):
            yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])],
                                             names=["query_id", "vector_id", "score"])

    return index.scan(cells).select("cell", "vector_id", "vector").mapInArrow(run, HITS)


def _ranked(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vector_id").asc())
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vector_id", "score")


def _nearest(near: np.ndarray, n: int) -> np.ndarray:
    """Mask of the n nearest cells per query (ties by the smaller cell)."""
    order = np.argsort(-np.round(near, DIGITS), axis=1, kind="stable")[:, :n]
    mask = np.zeros(near.shape, bool)
    np.put_along_axis(mask, order, True, 1)
    return mask


def _blocks(queries: DataFrame, id_col: str, vec_col: str, block_bytes: int):
    """(ids, matrix) of query blocks under the byte bound; the cut is a hash of the id."""
    q = cut_lineage(_usable(queries, id_col, vec_col))
    size = q.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("d")).first()
    n = max(1, -(-int(size.n) * 8 * int(size.d or 1) // block_bytes))
    for b in range(n):
        rows = (q if n == 1 else q.filter(F.pmod(F.xxhash64("vector_id"), F.lit(n)) == b)).toArrow()
        if rows.num_rows:
            yield rows["vector_id"].to_numpy(), _matrix(rows["vector"])


def search(index: CellIndex, queries: DataFrame, k: int, query_id: str = "query_id", query_vec: str = "embedding",
           n_probe: int | None = None, exclude_self: bool = False, first: int = 4, block_bytes: int = BLOCK_BYTES,
           report: list | None = None) -> DataFrame:
    """(query_id, rank, vector_id, score): probe mode with ``n_probe``, else exact. ``report``
    collects (queries, cells that hold vectors, cells scored in total) per query block."""
    out = None
    for ids, q in _blocks(queries, query_id, query_vec, block_bytes):
        near = q @ index.centres.T
        if n_probe is not None:
            visits = _nearest(near, n_probe)
            hits = _ranked(_visit(index, ids, q, visits, k, exclude_self), k)
        else:
            order = np.argsort(-near, axis=1, kind="stable")
            enough = np.cumsum(index.counts[order], axis=1) - index.counts[order] < first * k + exclude_self
            visits = np.zeros(near.shape, bool)
            np.put_along_axis(visits, order, enough, 1)
            # the floor of every query is read twice: once on the driver (a number a query)
            start = cut_lineage(_ranked(_visit(index, ids, q, visits, k, exclude_self), k))
            floor = np.full(len(ids), -np.inf)
            kth = start.filter(F.col("rank") == k).select("query_id", "score").toArrow()
            by_id = np.argsort(ids, kind="stable")
            at = np.searchsorted(ids[by_id], kth["query_id"].to_numpy())
            floor[by_id[at]] = kth["score"].to_numpy()
            # |q - c| from the product; a zero query or vector only makes the bound looser
            gap = np.sqrt(np.maximum((q * q).sum(1)[:, None] + (index.centres ** 2).sum(1)[None, :] - 2 * near, 0))
            best = 1 - np.maximum(gap - index.radius[None, :] - 1e-9, 0) ** 2 / 2
            more = (best >= floor[:, None] - 1e-9) & ~visits
            hits = _ranked(start.select("query_id", "vector_id", "score")
                           .unionByName(_visit(index, ids, q, more, k, exclude_self)), k)
            visits |= more
        if report is not None:
            report.append((len(ids), int((index.counts > 0).sum()), int((visits & (index.counts > 0)[None, :]).sum())))
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        return index.spark.createDataFrame([], "query_id long, rank int, vector_id long, score double")
    return cut_lineage(out)
