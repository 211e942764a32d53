"""A1-A3: quoted multi-line CSV round trip, required columns."""

import os
import tempfile

import pytest

from threadlens.sources.tables import read_csv, require_columns, write_table


def test_multiline_csv_roundtrip(spark):
    rows = [(1, 'line one\nline "two"\n\nend', "a|b"), (2, "plain", ""), (3, None, "7")]
    df = spark.createDataFrame(rows, "id int, generated_reply string, evidence_ids string")
    path = os.path.join(tempfile.mkdtemp(prefix="run-", dir="/tmp"), "out")
    write_table(df.coalesce(1), path, fmt="csv")
    back = read_csv(spark, path, "id int, generated_reply string, evidence_ids string")
    got = {r.id: r for r in back.collect()}
    assert len(got) == 3 and got[1].generated_reply == rows[0][1] and got[3].generated_reply is None


def test_required_columns(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    assert require_columns(df, ["a"]) is df
    with pytest.raises(ValueError, match=r"\['c', 'z'\]"):
        require_columns(df, ["z", "a", "c"], "input")


def test_coerce_ids(spark):
    from threadlens.sources.tables import coerce_messages
    rows = [("914271473914281984", " Support ", "True", None, "914271473914281985.0"),
            ("x1", "u", "false", "t", "nan"), ("7.0", "u", "TRUE", "t", None)]
    df = spark.createDataFrame(rows, "tweet_id string, author_id string, inbound string, text string, "
                                     "in_response_to_tweet_id string")
    got = coerce_messages(df).collect()
    assert got[0].tweet_id == 914271473914281984 and got[0].in_response_to_tweet_id == 914271473914281985
    assert got[0].author_id == "Support" and got[0].inbound is True and got[0].text == ""
    assert got[1].tweet_id is None and got[1].in_response_to_tweet_id is None and got[1].inbound is False
    assert got[2].tweet_id == 7
