"""H2-H5, H8, A4: vector edge cases (FIXTURES 3, vectors)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.functions.vectors import l2_normalize
from threadlens.operators import retrieval
from threadlens.sources import index_store

SCHEMA = "id long, embedding array<float>"


def brute_topk(q, v, k, exclude_self=False):
    out = {}
    for qi, qv in q:
        qv = np.asarray(qv, float)
        scores = []
        for vi, vv in v:
            if exclude_self and qi == vi:
                continue
            vv = np.asarray(vv, float)
            d = np.linalg.norm(qv) * np.linalg.norm(vv)
            scores.append((-(qv @ vv / d if d > 0 else 0.0), vi))
        out[qi] = [vi for _, vi in sorted(scores)[:k]]
    return out


def test_edge_cases(spark):
    idx = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, [0.6, 0.8])]
    qs = [(10, [1.0, 0.1]), (11, [0.0, 0.0])]
    i = spark.createDataFrame(idx, SCHEMA)
    q = spark.createDataFrame(qs, SCHEMA)
    hits = retrieval.topk_cosine(q, i, 10, query_id="id", vector_id="id")
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vector_id, round(r.score, 6)))
    assert [v for v, _ in got[10]][:2] == [1, 2]          # equal vectors: tie by id
    assert len(got[10]) == 5                               # k larger than the index: clipped
    assert got[10][-1] == (4, 0.0)                         # zero vector scores 0
    assert all(s == 0.0 for _, s in got[11])               # zero query
    assert [v for v, _ in got[11]] == [1, 2, 3, 4, 5]


def test_random_against_brute_force(spark):
    rnd = np.random.default_rng(3)
    idx = [(i, rnd.normal(size=8).astype(np.float32).tolist()) for i in range(300)]
    i = spark.createDataFrame(idx, SCHEMA)
    for kw in ({}, {"block_rows": 16, "shard_rows": 40}):
        hits = retrieval.topk_cosine(i, i, 4, query_id="id", vector_id="id", exclude_self=True, **kw)
        got = {}
        for r in hits.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vector_id)
        assert got == brute_topk(idx, idx, 4, exclude_self=True)


def test_parity_and_normalise(spark):
    rnd = np.random.default_rng(5)
    idx = [(i, (rnd.normal(size=6) * 3).astype(np.float32).tolist()) for i in range(100)]
    i = spark.createDataFrame(idx, SCHEMA)
    a = retrieval.topk_cosine(i, i, 5, query_id="id", vector_id="id")
    b = retrieval.topk_cosine(i, i, 5, query_id="id", vector_id="id", metric="cosine")
    p = retrieval.parity(a, b).first()
    assert p.n_pairs == 500 and p.n_mismatch == 0
    norms = i.select(F.aggregate(l2_normalize("embedding"), F.lit(0.0), lambda s, x: s + x * x).alias("n")).collect()
    assert all(abs(r.n - 1.0) < 1e-9 for r in norms)


def test_relevance_metrics(spark):
    hits = spark.createDataFrame([(1, 1, 7, 0.9), (1, 2, 1, 0.8), (2, 1, 5, 0.9), (2, 2, 6, 0.5)],
                                 "query_id long, rank int, vector_id long, score double")
    rel = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "query_id long, vector_id long")
    m = retrieval.relevance_metrics(hits, rel, rel.select("query_id"), 5).first()
    assert m.n_queries == 3 and m.hit_at_1 == 0.0 and m.hit_at_k == pytest.approx(1 / 3, abs=1e-6)
    assert m.mrr_at_k == pytest.approx((0.5 + 0 + 0) / 3, abs=1e-6)  # rounded to 6 dp


def test_index_store_roundtrip(spark, tmp_path):
    recs = spark.createDataFrame([(30, [3.0, 4.0]), (10, [1.0, 0.0]), (20, [0.0, 2.0])],
                                 "conversation_id long, embedding array<float>")
    idx, meta = index_store.load_index(spark, str(tmp_path / "idx"), build_from=recs)
    assert [(r.vector_id, r.conversation_id) for r in idx.orderBy("vector_id").collect()] == [(0, 10), (1, 20), (2, 30)]
    m = meta.first()
    assert (m.dim, m.ntotal, m.metric) == (2, 3, "inner_product_normalized_cosine")
    idx2, _ = index_store.load_index(spark, str(tmp_path / "idx"))
    assert idx2.count() == 3


def test_probe_search_finds_exact_within_cells(spark):
    rnd = np.random.default_rng(9)
    idx = [(i, rnd.normal(size=4).astype(np.float32).tolist()) for i in range(200)]
    i = spark.createDataFrame(idx, SCHEMA)
    cells, probes = retrieval.coarse_cells(i, i, 4, 4, vector_id="id", query_id="id")
    approx = retrieval.topk_cosine(i, i, 3, query_id="id", vector_id="id", query_cells=probes, index_cells=cells)
    exact = retrieval.topk_cosine(i, i, 3, query_id="id", vector_id="id")
    # probing every cell is exact
    assert sorted(map(tuple, approx.select("query_id", "vector_id").collect())) == \
        sorted(map(tuple, exact.select("query_id", "vector_id").collect()))


def test_chunks_bound_what_a_worker_holds(spark, monkeypatch):
    """Chunks of bounded bytes, no pair of vectors in a row, null ids as before; the rows are
    those of one whole product."""
    rnd = np.random.default_rng(2)
    idx = [(i if i % 50 else None, rnd.normal(size=16).tolist()) for i in range(400)]
    i = spark.createDataFrame(idx, "id long, embedding array<double>").repartition(3)
    monkeypatch.setattr(retrieval, "CHUNK_BYTES", 8 * 16 * 32)
    packed = retrieval._packed(i.select("id", "embedding"), 1000, "v")
    assert packed.agg(F.max(F.octet_length("v_vecs"))).first()[0] <= 8 * 16 * 32
    assert packed.agg(F.sum(F.octet_length("v_ids"))).first()[0] == 8 * 400
    monkeypatch.setattr(retrieval, "PART_BYTES", 8 * 16 * 64)
    hits = retrieval.topk_cosine(i, i, 3, query_id="id", vector_id="id").filter("query_id > 0").collect()
    v = np.array([x for _, x in idx])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([-2**63 if x is None else x for x, _ in idx])
    want = {int(q): ids[np.lexsort((ids, -(v[n] @ v.T).round(12)))[:3]].tolist() for n, q in enumerate(ids) if q > 0}
    got = {}
    for r in sorted(hits, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append(r.vector_id)
    assert got == want
    with pytest.raises(Exception, match="one length"):
        retrieval.topk_cosine(spark.createDataFrame([(1, [1.0]), (2, None)], SCHEMA).coalesce(1), i, 1, query_id="id", vector_id="id")


def test_search_sends_pairs_of_chunks_one_by_one(spark, monkeypatch):
    """A worker holds a pair or two, not the 64 MB of pairs that fill an Arrow batch."""
    plain = retrieval._chunk_pairs

    def watched(*args):
        run = plain(*args)

        def one(batches):
            def each():
                for b in batches:
                    if b.num_rows > 1:
                        raise ValueError(f"{b.num_rows} pairs at once")
                    yield b
            return run(each())
        return one

    monkeypatch.setattr(retrieval, "_chunk_pairs", watched)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.standard_normal(4).astype(np.float32)]) for i in range(60)]
    df = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    hits = retrieval.topk_cosine(df, df, 3, query_id="id", vector_id="id", exclude_self=True, block_rows=7, shard_rows=5)
    got = {}
    for r in hits.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vector_id)
    assert got == brute_topk(rows, rows, 3, exclude_self=True)
    assert spark.conf.get(setting) == before


def test_batch_rows_come_back_after_the_last_job(spark):
    from threadlens.session import ARROW_ROWS, arrow_rows
    before = spark.conf.get(ARROW_ROWS)
    first, second = arrow_rows(spark, 1), arrow_rows(spark, 1)
    first.__enter__()
    second.__enter__()
    first.__exit__(None, None, None)
    assert spark.conf.get(ARROW_ROWS) == "1"
    second.__exit__(None, None, None)
    assert spark.conf.get(ARROW_ROWS) == before


def test_later_chunks_look_only_at_scores_that_reach_the_kth(monkeypatch):
    """The hits of a query over many chunks, ties at the k-th score included, without a partition
    of the chunks after the first."""
    import numpy as np
    import pyarrow as pa

    from threadlens.operators import retrieval

    rng = np.random.default_rng(3)
    qm, vm = rng.integers(-2, 3, (40, 4)).astype(float), rng.integers(-2, 3, (300, 4)).astype(float)
    parts = []
    partition = np.partition
    monkeypatch.setattr(np, "partition", lambda *a, **k: parts.append(1) or partition(*a, **k))
    rows = [(0, np.arange(40).tobytes(), qm.tobytes(), i, np.arange(i, i + 50).tobytes(), vm[i:i + 50].tobytes()) for i in range(0, 300, 50)]
    batch = pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=list("abcdef"))
    for metric in ("ip", "cosine"):
        got = pa.Table.from_batches(retrieval._chunk_pairs(5, True, metric)([batch])).to_pylist()
        _, ids, scores = retrieval._score_pair(np.arange(40), qm, np.arange(300), vm, 5, True, metric)
        assert [r["vector_id"] for r in got] == ids.tolist()
        assert [r["score"] for r in got] == pytest.approx(scores.tolist())
    assert len(parts) == 4      # the first chunk and the whole, for both metrics
