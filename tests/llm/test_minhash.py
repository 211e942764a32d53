import re

import numpy as np
import pytest

from threadlens.llm import minhash

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, size=3):
    w = WORD.findall((text or "").encode().lower())
    if len(w) >= size:
        return frozenset(tuple(w[k:k + size]) for k in range(len(w) - size + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def brute(rows, percent=85, size=3):
    """All pairs, then the smallest id reachable."""
    sets = {i: shingles(t, size) for i, t in rows if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def check(df, rows, **kw):
    got = minhash.component_report(df, **kw).collect()
    want = brute(rows, kw.get("percent", 85), kw.get("shingle", 3))
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (*want[r.doc_id], want[r.doc_id][1] == r.doc_id)


def test_against_brute_force(small):
    check(small, [(r.doc_id, r.text) for r in small.collect()])


def test_odd_rows(odd_docs, no_docs):
    # one text per id (rows of one id are one document)
    docs = odd_docs.filter("text is null or text <> 'another text of the same id'")
    check(docs, [(r.doc_id, r.text) for r in docs.collect()])
    assert minhash.component_report(no_docs).count() == 0
    kept = minhash.keep_first(odd_docs)
    ids = [r.doc_id for r in kept.collect()]
    assert kept.columns == odd_docs.columns and 5 in ids and 6 not in ids and None in ids and 1 in ids and 2 in ids


def test_rows_of_one_id_with_different_texts(spark):
    """Every row is a document: the near copy of either text finds it, in either order."""
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    for rows in ([(1, a), (1, b), (2, b + " x"), (3, a + " y")], [(3, a + " y"), (2, b + " x"), (1, b), (1, a)]):
        got = minhash.component_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r.component_id == 1 for r in got) and len(got) == 4


def test_large_groups_in_small_blocks(spark, monkeypatch):
    """Blocks of 16: a hub that links most copies, copies that only other copies link, and
    members that nothing links."""
    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = np.random.default_rng(8)
    base, rows = [f"w{k}" for k in range(200)], []
    for k in range(150):
        words = list(base)
        for at in rng.choice(200, int(rng.integers(1, 14)), replace=False):
            words[at] = f"n{k}x{at}" if k % 3 else f"m{at}"
        rows.append((k + 5, " ".join(words)))
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows, percent=93)


def test_chain_and_hub_groups(spark):
    """Links that only hold through others, a hub whose copies are unlike each other,
    and members below the threshold in shared buckets."""
    rng = np.random.default_rng(3)
    base = [f"w{k}" for k in range(400)]
    rows, doc = [], 0
    for start in range(0, 60, 6):  # chain: neighbours overlap by 0.9 or so
        rows.append((doc, " ".join([f"c{k}" for k in range(start, start + 120)])))
        doc += 1
    rows.append((1000, " ".join(base)))  # hub, not the smallest id
    for k in range(40):
        words = list(base)
        for at in rng.choice(400, 9, replace=False):
            words[at] = f"n{k}x{at}"
        rows.append((100 + k, " ".join(words)))
    rng.shuffle(rows)
    rows = [(int(i), str(t)) for i, t in rows]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**63, 900).astype(np.uint64)
    b = np.concatenate([a[:700], rng.integers(0, 2**63, 200).astype(np.uint64)])
    sig = minhash.circulant_signatures(np.concatenate([a, b]), np.array([0, 900, 1800]), 512)
    assert abs((sig[:, 0] == sig[:, 1]).mean() - 700 / 1100) < 0.06


@pytest.mark.parametrize("percent,size", [(80, 5)])
def test_other_parameters(small, percent, size):
    check(small, [(r.doc_id, r.text) for r in small.collect()], percent=percent, shingle=size, bands=32)


def test_label_rounds_do_not_multiply_the_estimated_size(spark):
    """A chain of ids in mixed order takes rounds of joins; the size that the planner expects
    of their result (a number on the driver) stays that of a table, whatever the rounds."""
    ids = np.random.default_rng(3).permutation(14).tolist()
    links = spark.createDataFrame(list(zip(ids[:-1], ids[1:])), "a long, b long")
    label = spark.createDataFrame([(i, (0, i)) for i in ids], "id long, root struct<rank:long,id:long>")
    found = minhash.components(links, label)
    size = found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(size).bit_length() < 400
    assert {(r.id, r.comp) for r in found.collect()} == {(i, 0) for i in ids}


def test_label_rounds_take_tasks_by_rows(spark, monkeypatch):
    """Exchanges of many partitions do not make a round of few labels many tasks; more rows do."""
    ids = np.random.default_rng(4).permutation(40).tolist()
    links = spark.createDataFrame(list(zip(ids[:-1], ids[1:])), "a long, b long")
    label = spark.createDataFrame([(i, (0, i)) for i in ids], "id long, root struct<rank:long,id:long>")
    rounds = []
    monkeypatch.setattr(minhash, "held", lambda rows, hold=minhash.held: rounds.append(rows.rdd.getNumPartitions()) or hold(rows))
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "60")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        assert {(r.id, r.comp) for r in minhash.components(links, label).collect()} == {(i, 0) for i in ids}
        assert max(rounds[1:]) <= spark.sparkContext.defaultParallelism
        monkeypatch.setattr(minhash, "TASK_ROWS", 2)
        rounds.clear()
        assert {(r.id, r.comp) for r in minhash.components(links, label).collect()} == {(i, 0) for i in ids}
        assert max(rounds[1:]) == 39
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
