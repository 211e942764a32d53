"""H8, H3: the written cell index against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from threadlens.operators import cells, retrieval
from threadlens.sources import index_store

SCHEMA = "id long, embedding array<double>"


def build(spark, tmp_path, rows, n_cells, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "index")
    cells.build_cells(df, path, cells.pivot_centres(df, n_cells, "id"), "id", **kw)
    return df, cells.CellIndex(spark, path)


def clustered(n, groups, dim, seed=1, spread=0.08):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dim))
    return [(i, (centres[i % groups] + spread * rng.normal(size=dim)).tolist()) for i in range(n)]


def hits_of(df):
    return sorted((r.query_id, r.rank, r.vector_id, round(r.score, 9)) for r in df.collect())


def brute(queries, rows, k, exclude_self=False):
    out = []
    unit = lambda v: np.asarray(v) / (np.linalg.norm(v) or 1.0)
    for qid, qv in queries:
        scored = sorted((-round(float(unit(qv) @ unit(v)), 12) + 0.0, i) for i, v in rows if not (exclude_self and i == qid))[:k]
        out += [(qid, r + 1, i, round(-s + 0.0, 9)) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def test_exact_equals_brute_force_and_skips_most_cells(spark, tmp_path):
    rows = clustered(360, 18, 12)
    df, index = build(spark, tmp_path, rows, 30)
    report = []
    got = cells.search(index, df, 4, "id", report=report)
    assert hits_of(got) == brute(rows, rows, 4)
    queries, full, scored = report[0]
    assert scored < 0.5 * queries * full
    assert hits_of(cells.search(index, df, 4, "id", exclude_self=True, block_bytes=20_000)) == brute(rows, rows, 4, True)


def test_exact_without_structure_ties_zero_vectors_and_bad_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(120)] + [(500 + i, [0.0] * 5) for i in range(3)]
    rows += [(600 + i, [1.0, 0.0, 0.0, 0.0, 0.0]) for i in range(20)] + [(700 + i, [-2.0, 0.0, 0.0, 0.0, 0.0]) for i in range(20)]
    bad = [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0]), (902, [float("nan"), 0.0, 0.0, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    df, index = build(spark, tmp_path, rows + bad, 9, shards=3, file_rows=30)
    got = cells.search(index, df, 7, "id")
    assert hits_of(got) == brute(rows, rows, 7)
    one = cells.search(index, df, 1000, "id")  # k beyond the index
    assert one.count() == len(rows) ** 2
    assert cells.search(index, df.limit(0), 3, "id").collect() == []


def test_scan_reads_only_probed_cells(spark, tmp_path):
    rows = clustered(2000, 20, 8)
    _, index = build(spark, tmp_path, rows, 20, shards=20)
    scan = index.scan(np.array([3, 7]))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "PushedFilters: [In(cell" in plan
    assert {r.cell for r in scan.select("cell").distinct().collect()} <= {3, 7}
    files = {f.split("shard=")[1].split("/")[0] for f in scan.inputFiles()}
    assert len(files) == 20  # the table; what is read is decided by the filters:
    read = scan.select(F.input_file_name().alias("f")).distinct().collect()
    assert {r.f.split("shard=")[1].split("/")[0] for r in read} <= {"3", "7"}
    one = cells._visit(index, np.array([1]), np.array([rows[1][1]]), np.eye(20, dtype=bool)[[3]], 2, False)
    assert "Exchange" not in one._jdf.queryExecution().executedPlan().toString()


def test_five_thousand_cells(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(6000)]
    df, index = build(spark, tmp_path, rows, 5000, shards=8)
    few = rows[:40]
    got = cells.search(index, spark.createDataFrame(few, SCHEMA), 3, "id")
    assert hits_of(got) == brute(few, rows, 3)
    # the older probe mode with large cell numbers
    own = spark.createDataFrame([(i, 4000 + i % 7) for i, _ in rows[:300]], "id long, cell int")
    some = spark.createDataFrame(rows[:300], SCHEMA)
    h = retrieval.topk_cosine(some, some, 1, query_id="id", vector_id="id", query_cells=own, index_cells=own)
    assert {(r.query_id, r.vector_id) for r in h.collect()} == {(i, i) for i, _ in rows[:300]}


def test_probe_recall_and_kmeans_centres(spark, tmp_path):
    rows = clustered(600, 12, 6, spread=0.2)
    df = spark.createDataFrame(rows, SCHEMA)
    path = str(tmp_path / "km")
    cells.build_cells(df, path, cells.kmeans_centres(df, 10, "id"), "id")
    index = cells.CellIndex(spark, path)
    want = {(q, v) for q, _, v, _ in brute(rows, rows, 5)}
    got = {(r.query_id, r.vector_id) for r in cells.search(index, df, 5, "id", n_probe=3).collect()}
    assert len(got & want) >= 0.9 * len(want)


def test_versions(spark, tmp_path):
    path = str(tmp_path / "versions")
    a = spark.createDataFrame([(1, [1.0, 0.0])], SCHEMA)
    b = spark.createDataFrame([(2, [0.0, 1.0]), (3, [1.0, 1.0])], SCHEMA)
    cells.build_cells(a, path, np.eye(2), "id")
    old = cells.CellIndex(spark, path)

    def dies(folder):
        b.write.parquet(f"{folder}/vectors")
        raise RuntimeError("killed before the manifest")

    with pytest.raises(RuntimeError):
        index_store.publish(spark, path, dies)
    assert index_store.current(spark, path) == old.folder
    cells.build_cells(b, path, np.eye(2), "id")
    new = cells.CellIndex(spark, path)
    assert new.folder != old.folder and int(new.counts.sum()) == 2
    assert old.scan(np.array([0, 1])).count() == 1  # readers of the old version go on
    with pytest.raises(FileNotFoundError):
        index_store.load_index(spark, str(tmp_path / "none"))
