"""H1: a caller's model, started once per worker process."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from threadlens.functions.encoders import embed


def counting_model(folder):
    def make():
        tempfile.mkstemp(prefix=f"{os.getpid()}-", dir=folder)
        return lambda texts: [[len(t), t.count("a")] for t in texts]
    return make


def test_one_model_per_worker(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.range(0, 4000, 1, 64).select("id", F.repeat(F.lit("ab"), (F.col("id") % 7).cast("int")).alias("text"))
    got = embed(df, "text", counting_model(folder), batch_rows=10)
    assert got.filter((F.col("embedding")[0] != 2 * (F.col("id") % 7)) | (F.col("embedding")[1] != F.col("id") % 7)).count() == 0
    starts = os.listdir(folder)
    assert 1 <= len(starts) == len({s.split("-")[0] for s in starts}) < 64


def test_odd_rows(spark):
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a" * 100_000, None)], "id long, `a text` string, embedding string")
    got = embed(df, "a text", counting_model(folder))
    assert got.columns == df.columns
    assert [list(r.embedding) for r in got.orderBy("id").collect()] == [[0, 0], [0, 0], [100_000, 100_000]]
    assert embed(df.limit(0), "a text", counting_model(folder)).count() == 0


@pytest.mark.parametrize("bad", [lambda t: [[1.0]] * (len(t) + 1), lambda t: [[1.0] * (i + 1) for i in range(len(t))]])
def test_wrong_output_is_refused(spark, bad):
    df = spark.createDataFrame([("a",), ("b",)], "text string").coalesce(1)
    with pytest.raises(Exception, match="the model gave"):
        embed(df, "text", lambda: bad).collect()
