"""Hot keys: one parent with most of the replies, one conversation with most
of the rows. Results must equal the unchunked definitions."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from threadlens.operators import records, threads
from threadlens.operators.ordering import ordinal_within
from threadlens.sources.tables import coerce_messages

SCHEMA = ("tweet_id string, author_id string, inbound string, text string, response_tweet_id string, "
          "in_response_to_tweet_id string")


@pytest.mark.parametrize("hot_rows", [1_000_000, 100])
def test_hub_message(spark, hot_rows):
    rows = [("1", "AppleSupport", "False", "root", None, None)]
    rows += [(str(i), "c", "True", "@AppleSupport me too", None, "1") for i in range(2, 3000)]
    rows += [(str(i), "AppleSupport", "False", "reply", None, str(i - 1000)) for i in range(3000, 3500)]
    # second-level hub: 600 replies to message 5, so a pointer stays hot after round 0
    rows += [(str(i), "c", "True", "@AppleSupport also", None, "5") for i in range(4000, 4600)]
    df = coerce_messages(spark.createDataFrame(rows, SCHEMA))
    got = threads.build_threads(df, chunk_rows=64, hot_rows=hot_rows).collect()
    assert len(got) == len(rows)
    assert {r.conversation_id for r in got} == {1}
    assert sorted(r.thread_order for r in got) == list(range(1, len(rows) + 1))


def test_split_hot_join_equals_join(spark):
    from threadlens.operators.skew import split_hot_join
    facts = spark.createDataFrame([(i, 0 if i % 2 else i % 7) for i in range(2000)], "id long, k long")
    dim = spark.createDataFrame([(k, f"v{k}") for k in range(7)], "k long, v string")
    a = sorted(map(tuple, split_hot_join(facts, dim, "k", hot_rows=50).select("id", "k", "v").collect()))
    b = sorted(map(tuple, facts.join(dim, "k").select("id", "k", "v").collect()))
    assert a == b and len(a) == 2000


def test_ordinal_within_equals_row_number(spark):
    data = [(0 if i % 3 else 1, (i * 7919) % 100_003, i) for i in range(5000)]
    df = spark.createDataFrame(data, "g int, k long, tie long")
    got = ordinal_within(df, "g", "k", "pos", chunk_rows=97, tie_col="tie")
    want = df.withColumn("pos", F.row_number().over(Window.partitionBy("g").orderBy("k", "tie")))
    assert sorted(map(tuple, got.select("g", "k", "tie", "pos").collect())) == \
        sorted(map(tuple, want.select("g", "k", "tie", "pos").collect()))


def test_hot_conversation_records(spark):
    rows = [(1, i, "AppleSupport" if i % 4 == 0 else "u", f"w{i}") for i in range(1, 2000)]
    rows += [(2, 1, "u", "q"), (2, 2, "AppleSupport", "a")]
    df = spark.createDataFrame(rows, "conversation_id long, thread_order long, author_id string, text string")
    got = {r.conversation_id: r for r in records.build_records(df, chunk_width=50).collect()}
    hot = got[1]
    assert hot.n_messages == 1999 and hot.n_support_turns == 499
    assert hot.text == " ".join(f"w{i}" for i in range(1, 2000))
    assert hot.transcript.endswith("[1999] w1999")
    assert got[2].transcript == "[1] q [2] a"
