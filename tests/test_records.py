"""D1-D4 on crafted conversations (FIXTURES 3, records)."""

from threadlens.operators import records

SCHEMA = "conversation_id long, thread_order long, author_id string, text string"
ROWS = [
    # support only -> dropped
    (1, 1, "AppleSupport", "hello"), (1, 2, "AppleSupport", "again"),
    # customer only -> dropped
    (2, 1, "u", "hi"), (2, 2, "u", "there"),
    # one turn -> dropped
    (3, 1, "u", "single"),
    # empty-after-clean turn in the middle, unsorted input; numbering must not skip
    (4, 3, "AppleSupport", "Try a restart &amp; reset"), (4, 1, "u", "@AppleSupport my phone"),
    (4, 2, "u", "!!! 😀"), (4, 4, "u", "worked https://x.y thanks"),
    # other author counts as customer
    (5, 1, "someone", "question"), (5, 2, "applesupport", "answer"),
]


def test_records(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r.conversation_id: r for r in records.build_records(df).collect()}
    assert set(got) == {4, 5}
    r = got[4]
    assert r.text == "my phone Try a restart reset worked thanks"
    assert r.transcript == "[1] my phone [2] Try a restart reset [3] worked thanks"
    assert r.customer_turns == "my phone worked thanks"
    assert r.support_turns == "Try a restart reset"
    assert (r.n_messages, r.n_customer_turns, r.n_support_turns) == (3, 2, 1)
    assert got[5].customer_turns == "question"


def test_records_chunked_equals_single_chunk(spark):
    rows = [(9, i, "AppleSupport" if i % 3 == 0 else "u", f"turn {i}") for i in range(1, 40)]
    df = spark.createDataFrame(rows, SCHEMA)
    a = records.build_records(df, chunk_width=4).first()
    b = records.build_records(df, chunk_width=4096).first()
    assert a == b
    assert a.transcript.startswith("[1] turn 1 [2] turn 2") and "[39] turn 39" in a.transcript


def test_sampling_helpers(spark):
    df = spark.createDataFrame([(i, 1, "u", "x") for i in range(20)], SCHEMA)
    first = [r.conversation_id for r in records.first_n_by_id(df, 5).collect()]
    assert sorted(first) == [0, 1, 2, 3, 4]
    s1 = [r.conversation_id for r in records.seeded_sample(df, 5).collect()]
    s2 = [r.conversation_id for r in records.seeded_sample(df, 5).collect()]
    assert s1 == s2 and len(set(s1)) == 5


def test_unknown_author_is_a_customer(spark):
    df = spark.createDataFrame([(1, 1, None, "where is it"), (1, 2, "support", "on the way"), (1, 3, "system", "note")],
                               "conversation_id long, thread_order long, author_id string, text string")
    r = records.build_records(df, support_author="support", drop_roles=["system"]).first()
    assert r.customer_turns == "where is it" and r.n_messages == 2 and r.n_customer_turns == 1
