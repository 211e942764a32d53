"""Hand-worked reply graphs, and random graphs against a recursive-SQL closure."""

import random

import duckdb
import pandas as pd
import pytest

from threadlens.operators import threads
from threadlens.sources.tables import coerce_messages

SCHEMA = ("tweet_id string, author_id string, inbound string, text string, response_tweet_id string, "
          "in_response_to_tweet_id string")


def closure(rows):
    """(id, root, order) by recursive SQL over (id, support, mentions, parent) and
    (src, dst) tables: another engine, set-based."""
    con = duckdb.connect()
    con.register("m", pd.DataFrame([(r[0], r[1], r[2], r[4]) for r in rows], columns=["id", "support", "mentions", "parent"])
                 .astype({"parent": "Int64"}))
    con.register("listed", pd.DataFrame([(r[0], d) for r in rows for d in r[3]] or [(-1, -1)], columns=["src", "dst"]))
    return {r[0]: (r[1], r[2]) for r in con.execute("""
        WITH RECURSIVE up AS (SELECT a.id, a.parent FROM m a JOIN m b ON b.id = a.parent),
        edge AS (SELECT id AS src, parent AS dst FROM up UNION SELECT parent, id FROM up
                 UNION SELECT src, dst FROM listed WHERE dst IN (SELECT id FROM m)),
        reach AS (SELECT id FROM m WHERE support UNION SELECT e.dst FROM reach JOIN edge e ON e.src = reach.id),
        step AS (SELECT id, id AS cur, 0 AS n FROM m
                 UNION ALL SELECT step.id, up.parent, n + 1 FROM step JOIN up ON up.id = step.cur
                 WHERE n <= (SELECT count(*) FROM m)),
        top AS (SELECT id, arg_max(cur, n) AS root, max(n) > (SELECT count(*) FROM m) AS looped FROM step GROUP BY id),
        kept AS (SELECT m.id, CASE WHEN looped THEN m.id ELSE root END AS root FROM m JOIN top USING (id)
                 WHERE (support OR mentions) AND m.id IN (SELECT id FROM reach))
        SELECT id, root, row_number() OVER (PARTITION BY root ORDER BY id) FROM kept""").fetchall()}


CRAFTED = [
    # chain of three: customer -> support -> customer
    ("1", "cust1", "True", "my phone @AppleSupport", "2", None),
    ("2", "AppleSupport", "False", "dm us", "3", "1"),
    ("3", "cust1", "True", "thanks @applesupport", None, "2"),
    # parent id not in the table
    ("10", "AppleSupport", "False", "hello", None, "999"),
    ("11", "cust2", "True", "@AppleSupport still broken", None, "10"),
    # two-cycle with a tail leading into it
    ("20", "AppleSupport", "False", "a", None, "21"),
    ("21", "cust3", "True", "@AppleSupport b", None, "20"),
    ("22", "cust3", "True", "@AppleSupport tail", None, "21"),
    # self-parent with a reply
    ("30", "AppleSupport", "False", "self", None, "30"),
    ("31", "cust4", "True", "@AppleSupport reply to self", None, "30"),
    # response listed by one row whose own parent pointer is null (reached forward only)
    ("40", "AppleSupport", "False", "see reply", "41", None),
    ("41", "cust5", "True", "@AppleSupport listed only", None, None),
    # handle spellings: two accepted, one not
    ("50", "AppleSupport", "False", "x", None, None),
    ("51", "cust6", "True", "@APPLESUPPORT third spelling", None, "50"),
    ("52", "cust6", "True", "@applesupport second spelling", None, "50"),
    # list cells of every shape
    ("60", " applesupport ", "False", "multi", "61,62", None),
    ("61", "c7", "True", "@AppleSupport a", "[63]", None),
    ("62", "c7", "True", "@AppleSupport b", "nan", None),
    ("63", "c7", "True", "@AppleSupport c", "64,x", None),
    ("64", "c7", "True", "@AppleSupport d", None, None),
    # not reachable from support at all
    ("70", "c8", "True", "@AppleSupport alone", None, None),
    # bad id
    ("x1", "c9", "True", "@AppleSupport bad id", None, None),
]


def run(spark, rows, **kw):
    df = coerce_messages(spark.createDataFrame(rows, SCHEMA))
    got = threads.build_threads(df, **kw).select("tweet_id", "conversation_id", "thread_order").collect()
    return {r.tweet_id: (r.conversation_id, r.thread_order) for r in got}


# worked out by hand: id -> (conversation, position)
EXPECTED = {
    1: (1, 1), 2: (1, 2), 3: (1, 3),                  # chain
    10: (10, 1), 11: (10, 2),                         # missing parent: stops at the last present message
    20: (20, 1), 21: (21, 1), 22: (22, 1),            # a cycle and its tail keep their own ids
    30: (30, 1), 31: (31, 1),                         # self-parent is a cycle
    40: (40, 1), 41: (41, 1),                         # listed response, reached forward only
    50: (50, 1), 52: (50, 2),                         # 51: not an accepted spelling
    60: (60, 1), 61: (61, 1), 62: (62, 1), 63: (63, 1), 64: (64, 1),   # "61,62", "[63]", "64,x"
}


def test_crafted_graph(spark):
    assert run(spark, CRAFTED) == EXPECTED


@pytest.mark.parametrize("seed", [7, 8])
def test_random_graphs_against_recursive_sql(spark, seed):
    rnd = random.Random(seed)
    plain, cells = [], []
    for i in range(1, 300):
        parent = rnd.choice([None, None] + [rnd.randint(1, 320) for _ in range(3)])
        listed = [rnd.randint(1, 320) for _ in range(rnd.choice([0, 0, 1, 2]))]
        support, mention = rnd.random() < 0.25, rnd.random() < 0.5
        plain.append((i, support, mention, listed, parent))
        cells.append((str(i), "AppleSupport" if support else "u1", "True", "@AppleSupport hi" if mention else "plain",
                      ",".join(map(str, listed)) or None, None if parent is None else str(parent)))
    assert run(spark, cells) == closure(plain)


def test_metrics(spark):
    df = coerce_messages(spark.createDataFrame(CRAFTED, SCHEMA))
    m = threads.thread_metrics(threads.build_threads(df)).first()
    assert m.n_rows == 19 and m.n_conversations == 15 and m.n_support == 7


def test_long_listed_chain_and_bounds(spark):
    rows = [(str(i), "AppleSupport" if i == 1 else "c", "True", "@AppleSupport", str(i + 1), None) for i in range(1, 13)]
    assert set(run(spark, rows)) == set(range(1, 13))
    edges = spark.createDataFrame([(i, i + 1) for i in range(5)], "src long, dst long")
    with pytest.raises(RuntimeError):
        threads.reachable_units(spark.createDataFrame([(0,)], "unit long"), edges, max_rounds=2)
    chain = spark.createDataFrame([(i, i - 1 if i else None) for i in range(20)], "id long, parent long")
    with pytest.raises(RuntimeError):
        threads.resolve_roots(chain, max_rounds=2).count()


def test_last_row_of_an_id_counts(spark):
    rows = [("1", "AppleSupport", "False", "a", None, None, "1"), ("2", "c", "True", "@AppleSupport old", None, "1", "2"),
            ("2", "c", "True", "@AppleSupport new", None, None, "3")]
    df = coerce_messages(spark.createDataFrame(rows, SCHEMA + ", seq string"))
    assert {r.tweet_id for r in threads.build_threads(df, row_order="seq").collect()} == {1}
    got = threads.latest_messages(df, "seq").collect()
    assert {(r.tweet_id, r.text) for r in got} == {(1, "a"), (2, "@AppleSupport new")}


def walk(rows):
    """id -> root for rows (id, support, mention, listed, parent) in input order, ids repeated:
    the last row of an id speaks for it, every row is a reply to its parent."""
    last, replies = {}, {}
    for r in rows:
        last[r[0]] = r
        replies.setdefault(r[4], set()).add(r[0])
    seen, todo = set(), [r[0] for r in rows if r[1]]
    while todo:
        i = todo.pop()
        if i in seen or i not in last:
            continue
        seen.add(i)
        todo += [*last[i][3], *replies.get(i, ()), *([last[i][4]] if last[i][4] is not None else [])]
    out = {}
    for i in seen:
        if last[i][1] or last[i][2]:
            at, path = i, set()
            while last[at][4] in last and at not in path:
                path.add(at)
                at = last[at][4]
            out[i] = i if at in path else at
    return out


@pytest.mark.parametrize("seed", [3, 4])
def test_repeated_ids_against_a_walk(spark, seed, tmp_path):
    rnd = random.Random(seed)
    plain, cells = [], []
    for _ in range(400):
        i, parent = rnd.randint(1, 180), rnd.choice([None, None, rnd.randint(1, 190)])
        listed = [rnd.randint(1, 190) for _ in range(rnd.choice([0, 0, 0, 1]))]
        support, mention = rnd.random() < 0.1, rnd.random() < 0.5
        plain.append((i, support, mention, listed, parent))
        cells.append((str(i), "AppleSupport" if support else "u1", "True", "@AppleSupport hi" if mention else "plain",
                      ",".join(map(str, listed)) or None, None if parent is None else str(parent)))
    want = walk(plain)
    assert {i: v[0] for i, v in run(spark, cells).items()} == want
    # the same from a file that is read in many splits
    path = str(tmp_path / "m")
    spark.createDataFrame(cells, SCHEMA).coalesce(1).write.option("header", True).csv(path)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        table = spark.read.option("header", True).schema(SCHEMA).csv(path)
        got = threads.build_threads(coerce_messages(table)).select("tweet_id", "conversation_id").distinct().collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert {r.tweet_id: r.conversation_id for r in got} == want
    n = sum(1 for r in plain if r[0] in want)
    assert threads.build_threads(coerce_messages(spark.createDataFrame(cells, SCHEMA))).count() == n


def test_closure_in_few_rounds(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(400)] + [(i, 10_000 + i) for i in range(0, 400, 3)], "src long, dst long")
    rounds = []
    got = threads.reachable_units(spark.createDataFrame([(0,)], "unit long"), chain, rounds=rounds)
    assert {r.unit for r in got.collect()} == {*range(401), *range(10_000, 10_400, 3)}
    assert len(rounds) <= 12, rounds
    rnd = random.Random(6)
    pairs = {(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(500)} | {(i, (i + 1) % 90 + 400) for i in range(400, 490)}
    seen, todo = set(), [5, 430]
    while todo:
        at = todo.pop()
        if at not in seen:
            seen.add(at)
            todo += [d for s, d in pairs if s == at]
    got = threads.reachable_units(spark.createDataFrame([(5,), (430,)], "unit long"), spark.createDataFrame(sorted(pairs), "src long, dst long"))
    assert {r.unit for r in got.collect()} == seen


def test_long_chain_needs_few_rounds(spark):
    rows = [("1", "AppleSupport", "False", "root", None, None)]
    rows += [(str(i), "AppleSupport", "False", "t", None, str(i - 1)) for i in range(2, 300)]
    got = run(spark, rows)
    assert all(v[0] == 1 for v in got.values()) and got[299][1] == 299


def test_order_by_time(spark):
    rows = [("1", "cust", "True", "@AppleSupport q", None, None, "2017-10-31 22:10:00"),
            ("3", "AppleSupport", "False", "a", None, "1", "2017-10-31 22:11:00"),
            ("2", "cust", "True", "@AppleSupport more", None, "1", "2017-10-31 22:12:00")]
    df = coerce_messages(spark.createDataFrame(rows, SCHEMA + ", created_at string"))
    by_id = {r.tweet_id: r.thread_order for r in threads.build_threads(df).collect()}
    by_time = {r.tweet_id: r.thread_order for r in threads.build_threads(df, order_by="created_at").collect()}
    assert by_id == {1: 1, 2: 2, 3: 3}
    assert by_time == {1: 1, 3: 2, 2: 3}
