"""K2 reruns against the same checkpoint and redelivered messages do not duplicate
output; K3 stream windows equal the batch windows."""

import datetime
import glob
import os
import tempfile

from pyspark.sql import functions as F

from conftest import SF_SMALL
from threadlens.functions.rules import TEST_LEXICON, TEST_RULES
from threadlens.plans import catalog
from threadlens.plans import triage as triage_plan
from threadlens.streaming import stream


def test_triage_stream_rerun_is_idempotent(spark):
    idx = triage_plan.index_side(catalog._records(spark, SF_SMALL))
    out_dir = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    kw = dict(k=3, rules=TEST_RULES, lex=TEST_LEXICON, prepare=lambda s: catalog._user_turns(s, "_arrived"), glob="conversations.parquet",
              out_dir=out_dir)
    first = stream.run_triage_stream(spark, SF_SMALL, catalog.CONV_SCHEMA, idx, **kw)
    n1 = spark.read.parquet(first).count()
    second = stream.run_triage_stream(spark, SF_SMALL, catalog.CONV_SCHEMA, idx, **kw)
    assert first == second and spark.read.parquet(second).count() == n1
    assert n1 == catalog._user_turns(catalog._t(spark, SF_SMALL, "conversations")).count()
    assert os.path.isdir(os.path.join(out_dir, "_checkpoint"))


def test_monitor_stream_is_the_whole_batch(spark):
    """Every window, the one still open at the end of the source too."""
    s = catalog.QUERIES["decision_rate_stream"](spark, SF_SMALL)
    b = catalog.QUERIES["decision_rate_hourly"](spark, SF_SMALL)
    assert sorted(map(tuple, s.collect())) == sorted(map(tuple, b.collect())) != []


def test_monitor_over_several_batches(spark):
    """Windows that several files feed end with the sum of all of them."""
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    schema = "ts timestamp, event_type string"
    for day, minutes in enumerate(([0, 1, 59], [61, 62], [58, 63, 300])):
        rows = [(datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m), "a") for m in minutes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
    out = stream.run_decision_monitor(spark, f"{base}/in", schema, F.lit("x"), out_dir=f"{base}/out",
                                      files_per_batch=1, watermark="3 hours")
    assert len(glob.glob(f"{out}/batch_id=*")) >= 3
    got = {r.window_start.hour: r.n_rows for r in stream.read_monitor(spark, out).collect()}
    assert got == {0: 4, 1: 3, 5: 1}


def test_redelivered_messages_are_triaged_once(spark):
    """The same message in a second file, and in a later run, gives no second row."""
    idx = triage_plan.index_side(catalog._records(spark, SF_SMALL))
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    schema = "message_id long, text string"

    def deliver(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")

    def run():
        out = stream.run_triage_stream(spark, f"{base}/in", schema, idx, k=1, rules=TEST_RULES, lex=TEST_LEXICON,
                                       out_dir=f"{base}/out", files_per_batch=1)
        return sorted(((r.message_id, r.query) for r in spark.read.parquet(out).collect()), key=str)

    deliver([(1, "my order is late"), (2, "refund please"), (None, "no id here"), (4, "  ")])
    deliver([(2, "refund please"), (3, "the screen broke"), (None, "no id here")])
    first = [(1, "my order is late"), (2, "refund please"), (3, "the screen broke"), (None, "no id here"), (None, "no id here")]
    assert run() == first
    deliver([(1, "my order is late"), (5, "new one")])
    assert run() == sorted([*first, (5, "new one")], key=str)


def test_a_table_may_be_a_folder_of_files(spark):
    base = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.range(40).repartition(4).write.parquet(f"{base}/conversations.parquet")
    spark.range(40, 50).coalesce(1).write.parquet(f"{base}/one")
    [one] = glob.glob(f"{base}/one/*.parquet")
    for folder, name, n in ((base, "conversations.parquet", 40), (f"{base}/one", os.path.basename(one), 10)):
        seen = []
        q = (stream._files(spark, folder, "id long", name, None).writeStream.foreachBatch(lambda b, _: seen.append(b.count()))
             .option("checkpointLocation", tempfile.mkdtemp(prefix="run-", dir="/tmp")).trigger(**stream.ALL_THERE_IS).start())
        q.awaitTermination()
        assert sum(seen) == n
