import corpus_pipeline
import __spark_entry__
from threadlens.llm import decontaminate, minhash, substring

D = "/root/testdata/sf0.01"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    names, columns, before = [], docs.columns, docs
    tables = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, D).write.parquet(f"{tmp_path}/{name}")
        before = spark.read.parquet(f"{tmp_path}/{name}")
        tables.append(before)
        names.append(name)
    assert all(t.columns == columns for t in tables[:-1])
    counts = [docs.count(), *[t.count() for t in tables]]
    assert counts[0] > counts[1] > counts[2] == counts[3] == counts[4] == counts[5]
    # nothing is left for the stages' own operators to find
    assert minhash.component_report(tables[1], percent=80, shingle=5, bands=32).filter("not kept").count() == 0
    bench = spark.read.parquet(f"{D}/benchmark.parquet")
    assert decontaminate.contamination(tables[3], bench).filter("contaminated").count() == 0
    assert substring.repeat_report(tables[1]).agg({"n_removed": "sum"}).first()[0] > 0
    assert tables[4].filter("not round_trip or n_tokens < 2").count() == 0


def test_odd_and_empty_inputs(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, docs, D)
            if name != corpus_pipeline.STAGES[-1][0]:
                assert got.columns == docs.columns
            assert (got.count() == 0) == (docs is no_docs)


def test_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_every_stage_writes_clashing_columns(spark, odd_docs, tmp_path):
    """Each stage's output is written and read again; columns pass through by value."""
    import corpus_pipeline
    from pyspark.sql import functions as F
    docs = odd_docs.withColumn("n_tokens", F.lit("mine")).withColumn("round_trip", F.lit("mine")).withColumn("grp", F.lit("g"))
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path / name)
        stage(spark, docs, "/root/testdata/sf0.001").write.parquet(path)
        got = spark.read.parquet(path)
        assert set(docs.columns) <= set(got.columns)
        kept = [c for c in docs.columns if c not in ("doc_id", "text", "n_tokens", "round_trip", "piece_ids")]
        before = {tuple(r) for r in docs.select("doc_id", *kept).collect()}
        assert {tuple(r) for r in got.select("doc_id", *kept).collect()} <= before
        if name == "sentencepiece":
            kinds = dict(got.dtypes)
            assert (kinds["n_tokens"], kinds["round_trip"], kinds["decoded"]) == ("bigint", "boolean", "string")
            assert got.filter("not round_trip").count() == 0
