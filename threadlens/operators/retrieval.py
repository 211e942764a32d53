"""Exact cosine top-k, parity, self-retrieval, graded evidence.

Exact top-k for many queries (``topk_cosine``)
----------------------------------------------
Every query must meet every index vector, but no (query, vector) pair is ever
a row. Both sides are packed into chunks (a row holds a matrix of at most
``CHUNK_BYTES``), dealt to partitions of about ``PART_BYTES``, and every query
partition meets every index partition in a task of a cartesian product, which copies no
vector into a shuffle for it. A task scores a pair of chunks at a time with a numpy matrix
product (in slices of bounded memory), carries the k best of the queries of one chunk and
emits those: k rows per query and index partition, merged by a final window
(``row_number() <= k`` per query, planned as a group limit). A Python worker holds one pair
of chunks and the batch it came in, whatever the totals; nothing passes through the driver
but the counts that size the grid. Pairs are sent to the workers one by one.

``probe`` mode (H8) replaces "every shard" by the query's nearest coarse
cells, each index vector living in its own cell (k-means centroids); hot cells
are split into sub-shards so no task grows with a cell holding a third of the
index. Its cells are cogroups of blocks of queries and sub-shards.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadlens.functions.vectors import as_double
from threadlens.session import arrow_rows, cut_lineage, ship_package

HIT_SCHEMA = "query_id long, vector_id long, score double"
CHUNK_BYTES = 4 << 20     # of a packed matrix
PART_BYTES = 32 << 20     # of the chunks of a partition
PAIR_BUDGET = 250_000     # scores held at once
BLOCK_ROWS, SHARD_ROWS = 2048, 4096
PROBE_BLOCK_ROWS, PROBE_SHARD_ROWS = 8192, 65536
_NO_ID = -2**63           # a null id


def _grid(n: int, rows: int) -> int:
    return max(1, int(math.ceil(n / max(1, rows))))


def _stack(series: pd.Series) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series])


def _normalize_rows(m: np.ndarray) -> np.ndarray:
    if m.size == 0:
        return m
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _select_topk(sc: np.ndarray, ids: np.ndarray, vid: np.ndarray, kk: int, floor: np.ndarray | None = None):
    """Per row of ``sc``: the kk best columns by (score desc, vector id asc),
    vectorised: a row-wise partition finds each row's cut, one lexsort orders
    the survivors (ties at the cut included), a rank-within-row keeps kk. Where every row has a
    ``floor`` (the last of kk hits that it has already), only scores that reach it are looked at."""
    n = sc.shape[1]
    if floor is not None and np.isfinite(floor).all():
        mask = sc >= floor[:, None]
    elif kk < n:
        cut = np.partition(sc, n - kk, axis=1)[:, n - kk]
        mask = sc >= cut[:, None]
    else:
        mask = np.ones(sc.shape, dtype=bool)
    mask &= np.isfinite(sc)
    r, c = np.nonzero(mask)
    order = np.lexsort((vid[c], -sc[r, c], r))
    r, c = r[order], c[order]
    if len(r) == 0:
        return ids[:0], vid[:0], np.zeros(0)
    start = np.r_[0, np.flatnonzero(np.diff(r)) + 1]
    rank = np.arange(len(r)) - np.repeat(start, np.diff(np.r_[start, len(r)]))
    keep = rank < kk
    return ids[r[keep]], vid[c[keep]], sc[r[keep], c[keep]]


def _score_pair(qid, qm, vid, vm, k: int, exclude_self: bool, metric: str, floor: np.ndarray | None = None):
    """(numbers of query rows, vector ids, scores): per row of ``qm`` the k best rows of ``vm``, or
    those of them that reach its ``floor``."""
    if metric == "cosine":        # full formula, no pre-normalisation (H4's second path)
        qn = np.sqrt((qm * qm).sum(1))
        vn = np.sqrt((vm * vm).sum(1))
    else:                         # inner product of L2-normalised vectors
        qm, vm = _normalize_rows(qm), _normalize_rows(vm)
    step = max(1, PAIR_BUDGET // len(vid))
    out = []
    for s in range(0, len(qid), step):
        sc = qm[s:s + step] @ vm.T
        if metric == "cosine":
            den = np.outer(qn[s:s + step], vn)
            sc = np.divide(sc, den, out=np.zeros_like(sc), where=den > 0)
        ids = qid[s:s + step]
        if exclude_self:
            sc = np.where(ids[:, None] == vid[None, :], -np.inf, sc)
        out.append(_select_topk(sc, np.arange(s, s + len(ids)), vid, min(k, len(vid)), None if floor is None else floor[s:s + step]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _cell_topk(k: int, exclude_self: bool, metric: str):
    def fn(_key, q: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        if len(q) == 0 or len(v) == 0:
            return pd.DataFrame({"query_id": [], "vector_id": [], "score": []})
        qid = q["qid"].to_numpy(np.int64)
        rows, vi, sv = _score_pair(qid, _stack(q["qv"]), v["vid"].to_numpy(np.int64), _stack(v["iv"]), k, exclude_self, metric)
        return pd.DataFrame({"query_id": qid[rows], "vector_id": vi, "score": sv})
    return fn


def _packed(df: DataFrame, rows: int, name: str) -> DataFrame:
    """(``name``, ``name``_ids, ``name``_vecs): the (id, vector) rows of ``df`` in chunks of at
    most ``rows`` vectors and ``CHUNK_BYTES``, as the bytes of 64-bit numbers."""
    names = [name, f"{name}_ids", f"{name}_vecs"]

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids, vecs = batch.column(0).fill_null(_NO_ID), batch.column(1)
            lens = vecs.value_lengths().unique()
            if vecs.null_count or len(lens) > 1:
                raise ValueError("vectors must be of one length and not null")
            dim = lens[0].as_py()
            step = max(1, min(rows, CHUNK_BYTES // (8 * max(1, dim))))
            for lo in range(0, batch.num_rows, step):
                part = vecs.slice(lo, step).flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([ids.slice(lo, step).to_numpy(zero_copy_only=False).tobytes()], pa.binary()),
                     pa.array([part.tobytes()], pa.binary())], names=names)
                number += 1

    return cut_lineage(df.mapInArrow(run, f"{name} long, {name}_ids binary, {name}_vecs binary"))


def _dealt(chunks: DataFrame, name: str, at_least: int) -> DataFrame:
    size = chunks.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(f"{name}_vecs").cast("long")).alias("b")).first()
    return chunks.repartition(max(1, min(size.n, at_least), -(-(size.b or 0) // PART_BYTES)))


def _matrix(ids, vecs) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids.as_buffer(), np.int64)
    return i, np.frombuffer(vecs.as_buffer(), np.float64).reshape(len(i), -1)


def _best(found: list, k: int):
    """Per query row (its number is in front) the k best of the hits ``found``."""
    row, q, v, s = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((v, -s, row))
    row, q, v, s = row[order], q[order], v[order], s[order]
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
    keep = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) < k
    return row[keep], q[keep], v[keep], s[keep]


def _floor(row: np.ndarray, score: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-th score of each of ``n`` query rows with k hits; none for others."""
    hits = np.bincount(row, minlength=n)
    out, full = np.full(n, -np.inf), hits == k
    out[full] = score[np.cumsum(hits)[full] - 1]
    return out


def _chunk_pairs(k: int, exclude_self: bool, metric: str):
    def run(batches):
        now, best = None, None

        def hits():
            return pa.RecordBatch.from_arrays([pa.array(x) for x in best[1:]], names=["query_id", "vector_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                q, q_ids, q_vecs, _, v_ids, v_vecs = (c[i] for c in batch.columns)
                if q.as_py() != now:      # the pairs of a query chunk come one after the other
                    if best is not None:
                        yield hits()
                    now, best = q.as_py(), None
                    qid, qm = _matrix(q_ids, q_vecs)
                vid, vm = _matrix(v_ids, v_vecs)
                floor = _floor(best[0], best[3], len(qid), k) if best is not None else None
                rows, vi, sv = _score_pair(qid, qm, vid, vm, k, exclude_self, metric, floor)
                found = (rows, qid[rows], vi, sv)
                best = _best([best, found] if best is not None else [found], k)
        if best is not None:
            yield hits()

    return run


def topk_cosine(queries: DataFrame, index: DataFrame, k: int, query_id: str = "query_id",
                query_vec: str = "embedding", vector_id: str = "vector_id", index_vec: str = "embedding",
                exclude_self: bool = False, metric: str = "ip", block_rows: int | None = None,
                shard_rows: int | None = None, query_cells: DataFrame | None = None,
                index_cells: DataFrame | None = None, materialize_index: bool = True) -> DataFrame:
    """H3: (query_id, rank, vector_id, score) for the k best index vectors of
    every query; ties by vector id ascending; k is clipped to the index size.

    ``exclude_self`` drops the pair whose ids are equal (self-retrieval over
    one table). ``metric='cosine'`` computes dot / (|q| |v|) directly (H4).
    ``query_cells`` (query_id, cell) / ``index_cells`` (vector_id, cell) switch
    to probe mode (H8): a query is scored only against vectors of its cells.
    """
    spark = queries.sparkSession
    ship_package(spark)
    par = spark.sparkContext.defaultParallelism
    q = queries.select(F.col(query_id).cast("long").alias("qid"), as_double(query_vec).alias("qv"))
    v = index.select(F.col(vector_id).cast("long").alias("vid"), as_double(index_vec).alias("iv"))
    # Both sides are materialised once in the checkpoint folder: the encoder upstream (text
    # cleaning, hashing, joins) must not run again for the scoring pass.
    if query_cells is None:
        qc = _dealt(_packed(q, block_rows or BLOCK_ROWS, "q"), "q", 2 * par)
        vc = _dealt(_packed(v, shard_rows or SHARD_ROWS, "v"), "v", 1)
        hits = qc.hint("shuffle_replicate_nl").crossJoin(vc).mapInArrow(_chunk_pairs(k, exclude_self, metric), HIT_SCHEMA)
    else:
        # probe mode: cell sizes decide how many sub-shards a cell is cut into
        q, shard_rows = cut_lineage(q), shard_rows or PROBE_SHARD_ROWS
        if materialize_index:           # pass False when ``index`` is already a checkpoint
            v = cut_lineage(v)
        n_q = q.count()
        blocks = max(_grid(n_q, block_rows or PROBE_BLOCK_ROWS), min(par, _grid(n_q, 256)))
        qb = F.pmod(F.xxhash64("qid"), F.lit(blocks)).cast("int")
        sizes = index_cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
        subs = sizes.select("cell", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(shard_rows))).cast("int")
                            .alias("n_sub"))
        vc = index_cells.select(F.col(vector_id).cast("long").alias("vid"), "cell").join(subs, "cell")
        v2 = v.join(vc, "vid")
        vx = (v2.withColumn("shard", F.col("cell").cast("long") * F.lit(1 << 20)
                            + F.pmod(F.xxhash64("vid"), F.col("n_sub")).cast("long"))
              .withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
              .select("vid", "iv", "shard", "qb"))
        qc = query_cells.select(F.col(query_id).cast("long").alias("qid"), "cell").join(subs, "cell")
        qx = (q.join(qc, "qid").withColumn("qb", qb)
              .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n_sub") - 1)))
              .withColumn("shard", F.col("cell").cast("long") * F.lit(1 << 20) + F.col("sub").cast("long"))
              .select("qid", "qv", "qb", "shard"))
        hits = (qx.groupBy("qb", "shard").cogroup(vx.groupBy("qb", "shard"))
                .applyInPandas(_cell_topk(k, exclude_self, metric), HIT_SCHEMA))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("vector_id").asc())
    # k rows per query: small, and read by several consumers (evidence, replies,
    # decisions), so the Python scoring pass runs once.
    ranked = (hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
              .select("query_id", F.col("rank").cast("int").alias("rank"), "vector_id", "score"))
    if query_cells is not None:
        return cut_lineage(ranked)
    with arrow_rows(spark, 1):      # a row is a pair of chunks, up to 8 MB
        return cut_lineage(ranked)


def parity(hits_a: DataFrame, hits_b: DataFrame, tol: float = 1e-4) -> DataFrame:
    """H4: compare two top-k results on (query_id, rank): same id and scores
    within ``tol``; one row (n_pairs, n_mismatch)."""
    a = hits_a.select("query_id", "rank", F.col("vector_id").alias("a_id"), F.col("score").alias("a_s"))
    b = hits_b.select("query_id", "rank", F.col("vector_id").alias("b_id"), F.col("score").alias("b_s"))
    j = a.join(b, ["query_id", "rank"], "full_outer")
    bad = (F.col("a_id").isNull() | F.col("b_id").isNull() | (F.col("a_id") != F.col("b_id"))
           | (F.abs(F.col("a_s") - F.col("b_s")) > tol))
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(bad).alias("n_mismatch"))


def relevance_metrics(hits: DataFrame, relevant: DataFrame, n_queries_df: DataFrame, k: int) -> DataFrame:
    """H5: hit@1, hit@k and MRR@k over all queries in ``n_queries_df``
    (query_id); ``relevant`` holds (query_id, vector_id) pairs that count.
    A query with no hit scores 0 (it still counts in the denominator)."""
    flagged = hits.join(relevant.withColumn("_rel", F.lit(True)), ["query_id", "vector_id"], "left")
    per_q = (flagged.filter(F.col("_rel") & (F.col("rank") <= k))
             .groupBy("query_id").agg(F.min("rank").alias("first_rank")))
    allq = n_queries_df.select("query_id").distinct().join(per_q, "query_id", "left")
    n = F.count(F.lit(1))
    return allq.agg(
        n.alias("n_queries"),
        F.round(F.count_if(F.col("first_rank") == 1) / F.greatest(n, F.lit(1)), 6).alias("hit_at_1"),
        F.round(F.count_if(F.col("first_rank").isNotNull()) / F.greatest(n, F.lit(1)), 6).alias("hit_at_k"),
        F.round(F.sum(F.coalesce(F.lit(1.0) / F.col("first_rank"), F.lit(0.0))) / F.greatest(n, F.lit(1)), 6)
         .alias("mrr_at_k"))


def graded_summary(judged: DataFrame) -> DataFrame:
    """H7: distinct queries, rows, three means, share of relevance 2, rows with
    relevance >= 2, rows with relevance 0."""
    return judged.agg(
        F.countDistinct("query_id").alias("n_queries"), F.count(F.lit(1)).alias("n_rows"),
        F.round(F.avg("issue_similarity"), 6).alias("mean_issue_similarity"),
        F.round(F.avg("response_usefulness"), 6).alias("mean_response_usefulness"),
        F.round(F.avg("relevance"), 6).alias("mean_relevance"),
        F.round(F.avg((F.col("relevance") == 2).cast("double")), 6).alias("share_relevance_2"),
        F.count_if(F.col("relevance") >= 2).alias("n_good"),
        F.count_if(F.col("relevance") == 0).alias("n_bad"))


def coarse_cells(index: DataFrame, queries: DataFrame, n_cells: int, n_probe: int, vector_id: str = "vector_id",
                 query_id: str = "query_id", vec: str = "embedding", seed: int = 7):
    """H8: k-means cells over the normalised index (pyspark.ml), each vector's
    cell, and each query's ``n_probe`` nearest cells. The centroid matrix is
    n_cells x dim (a parameter, not data-sized) and travels in the task
    closure; queries are scored against it in Arrow batches."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    from threadlens.functions.vectors import l2_normalize
    ship_package(index.sparkSession)
    iv = index.select(F.col(vector_id).alias("vid"), array_to_vector(l2_normalize(vec)).alias("features"))
    model = KMeans(k=n_cells, seed=seed, maxIter=20, featuresCol="features").fit(iv)
    cells = model.transform(iv).select(F.col("vid").cast("long").alias(vector_id),
                                       F.col("prediction").cast("int").alias("cell"))
    cent = _normalize_rows(np.asarray(model.clusterCenters(), dtype=np.float64))
    p = min(n_probe, len(cent))

    def probe(batches):
        for b in batches:
            if len(b) == 0:
                continue
            m = _normalize_rows(_stack(b["qv"]))
            sc = m @ cent.T
            order = np.argsort(-sc, axis=1, kind="stable")[:, :p]
            yield pd.DataFrame({query_id: np.repeat(b["qid"].to_numpy(np.int64), p),
                                "cell": order.reshape(-1).astype(np.int32)})
    qn = queries.select(F.col(query_id).cast("long").alias("qid"), as_double(vec).alias("qv"))
    probes = qn.mapInPandas(probe, f"{query_id} long, cell int")
    return cells, probes
