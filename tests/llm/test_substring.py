import hashlib
import re

import pytest

from threadlens.llm import substring

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=20):
    """Rows in (id, text) order; a window is a repeat if its words were seen before."""
    seen, out = set(), []
    for i, text in rows:
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for k in range(len(words) - window + 1):
            key = tuple(words[k:k + window])
            if key in seen:
                gone[k:k + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest()))


def rows_of(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("kw", [{}, {"block_bytes": 40_000, "shard_windows": 500}])
def test_against_brute_force(small, kw):
    rows = substring.repeat_report(small, **kw).collect()
    same(rows, brute(in_order(rows_of(small))))


def test_odd_rows(odd_docs):
    same(substring.repeat_report(odd_docs, block_bytes=50_000).collect(), brute(in_order(rows_of(odd_docs))))


def test_other_window(odd_docs):
    same(substring.repeat_report(odd_docs, window=12, first=3).collect(), brute(in_order(rows_of(odd_docs)), 12))
    with pytest.raises(ValueError):
        substring.repeat_report(odd_docs, window=18, first=5)


def test_drop_repeats_keeps_columns_and_clean_texts(odd_docs, no_docs):
    got = substring.drop_repeats(odd_docs)
    assert got.columns == odd_docs.columns
    texts = {(r.doc_id, r.text) for r in got.collect()}
    assert (9, rows_of(odd_docs.filter("doc_id = 9"))[0][1]) in texts
    assert (10, "") in texts and (1, None) in texts and (3, " \n\t ") in texts
    assert substring.drop_repeats(no_docs).count() == 0
    assert substring.repeat_report(no_docs).count() == 0
