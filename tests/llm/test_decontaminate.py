import hashlib
import re

import numpy as np
import pytest

from threadlens.llm import decontaminate
from threadlens.llm.decontaminate import FMIndex, WaveletMatrix

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def brute(docs, items, window=10):
    phrases = {}
    for i, t in items:
        w = words(t)
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            phrases.setdefault(tuple(w[k:k + n]), set()).add(i)
    out = []
    for i, t in docs:
        w = words(t)
        hit, found = [False] * len(w), set()
        for n in {len(p) for p in phrases}:
            for k in range(len(w) - n + 1):
                got = phrases.get(tuple(w[k:k + n]))
                if got is not None:
                    hit[k:k + n] = [True] * n
                    found |= {str(x) for x in got if x is not None}
        sha = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((i, len(w), sum(hit), len(found), sha, any(hit)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "Shared3 shared4; SHARED5 shared6 shared7 shared8 shared9 shared10 shared11 shared12 shared13"), (2, "a"),
            (3, None), (4, ""), (5, "!!!"), (None, "very large id"), (6, "two three four"), (6, "two three four"),
            (7, "three four"), (7, "nowhere to be found in any of these texts at all, really not")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 37, 1000)
    tree = WaveletMatrix(x, 37)
    i = rng.integers(0, 1001, 300)
    s = rng.integers(0, 38, 300)
    assert tree.rank(s, i).tolist() == [int((x[:a] == b).sum()) for a, b in zip(i, s)]
    at = np.arange(1000)
    assert tree.access(at).tolist() == x.tolist()


def test_index_finds_every_occurrence():
    rng = np.random.default_rng(2)
    text = rng.integers(1, 4, 500)
    text[[99, 200, 499]] = 0
    index = FMIndex(text, 3)
    for pattern in ([1], [2, 3], [1, 1, 2], [3, 3, 3, 3, 3, 3, 3, 3, 3, 1]):
        lo, hi = index.search(np.array([[0] * (10 - len(pattern)) + pattern]))
        got = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if lo[0] < hi[0] else []
        assert got == [k for k in range(500) if text[k:k + len(pattern)].tolist() == pattern]


def test_against_brute_force(spark, small):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    docs = [(r.doc_id, r.text) for r in small.collect()]
    same(decontaminate.contamination(small, bench).collect(), brute(docs, [(r.item_id, r.text) for r in bench.collect()]))


@pytest.mark.parametrize("bound", [10**6, 30])
def test_odd_rows_in_one_block_and_several(odd_docs, items, bound):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    want = brute(docs, [(r.item_id, r.text) for r in items.collect()])
    same(decontaminate.contamination(odd_docs, items, max_phrase_bytes=bound).collect(), want)


def test_remove_cuts_only_spans(odd_docs, items, no_docs):
    got = decontaminate.remove_phrases(odd_docs, items.filter("item_id = 6"))
    assert got.columns == odd_docs.columns
    text = {r.doc_id: r.text for r in got.collect()}
    before = {r.doc_id: r.text for r in odd_docs.collect()}
    assert text[12] == before[12].replace("two three four", "")
    assert all(text[i] == before[i] for i in before if i not in (12, 13))
    assert decontaminate.remove_phrases(no_docs, items).count() == 0
    assert decontaminate.contamination(odd_docs, items.limit(0)).filter("contaminated").count() == 0
