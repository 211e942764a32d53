"""Overlap pairs and their anti form on hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from threadlens.operators import audit


def test_anti_form_keeps_rows_in_no_pair(spark):
    items = spark.createDataFrame([(1, "one two three four"), (2, "not there at all"), (3, None), (4, ""), (None, "x y z w"),
                                   (1, "one two three four"), (5, "two")], "item_id long, text string")
    docs = spark.createDataFrame([(10, "zero one two three four five"), (11, "one two three four"), (12, None), (13, "other")],
                                 "doc_id long, body string")
    pairs = audit.contains_overlap(items, docs, "item_id", "text", "doc_id", "body")
    assert sorted(set(map(tuple, pairs.collect()))) == [(1, 10), (1, 11), (5, 10), (5, 11)]
    left = audit.without_overlap(items, pairs, "item_id")
    assert left.columns == items.columns
    assert sorted((str(r.item_id), r.text) for r in left.collect() if r.text) == [("2", "not there at all"), ("None", "x y z w")]
    assert left.count() == 4
    assert sorted(r.doc_id for r in audit.without_overlap(docs, pairs, "doc_id").collect()) == [12, 13]


def test_anti_form_without_pairs_or_rows(spark):
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    none = items.limit(0)
    pairs = audit.exact_overlap(items, none, "item_id", "text", "item_id", "text").toDF("item_id", "doc_id")
    assert audit.without_overlap(items, pairs, "item_id").count() == 1
    assert audit.without_overlap(none, pairs, "item_id").count() == 0
    assert audit.without_overlap(items, pairs, "item_id", "doc_id").count() == 1


@pytest.mark.parametrize("max_items", [100_000, 0])
def test_contains_equals_comparing_all_pairs(spark, max_items):
    """Items of one character to many tokens, cut words, blanks, line ends and characters
    outside the basic plane, against Python's ``in``; broadcast and shuffled keys."""
    rng = random.Random(3)
    bits = ["a", "b", " ", "ab", "\n", "\u00e9", "\U0001F600", "the", " the ", ".", "cat ", "x1"]
    docs = [(i % 110, "".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    docs += [(None, "the cat"), (500, None), (501, "")]
    items = [(i % 70, "".join(rng.choice(bits) for _ in range(rng.randint(1, 9)))) for i in range(80)]
    for k, (_, text) in enumerate(docs[:40]):
        if len(text) > 4:
            at = rng.randrange(len(text) - 3)
            items.append((100 + k, text[at:at + rng.randint(1, 30)]))
    items += [(None, "the"), (300, None), (301, ""), (302, "zzz"), (303, "q"), (304, "a" * 9)]
    got = audit.contains_overlap(spark.createDataFrame(items, "i long, s string"), spark.createDataFrame(docs, "d long, t string"),
                                 "i", "s", "d", "t", max_items=max_items)
    pairs = [tuple(r) for r in got.collect()]
    want = {(i, d) for i, s in items for d, t in docs if i is not None and d is not None and s and t and s in t}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and len(want) > 500


def test_contains_plan_has_no_nested_loop(spark):
    items = spark.createDataFrame([(1, "on"), (2, "one two three four")], "i long, s string")
    docs = spark.createDataFrame([(1, "one two three four five")], "d long, t string")
    got = audit.contains_overlap(items, docs, "i", "s", "d", "t")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert got.count() == 2


def test_the_split_carries_no_texts(spark):
    """Rows that are numbered inside a class are narrow, and a chunk of them is small."""
    from threadlens.operators import ordering
    from threadlens.plans import catalog
    rows = catalog._doc_split(spark, "/root/testdata/sf0.001")
    assert rows.agg(F.max(F.length("clean"))).first()[0] == 64 and ordering.CHUNK_ROWS <= 1 << 16
