import hashlib
import zlib
from collections import Counter

import pytest

from threadlens.llm import sharding


def h60(s):
    return int(hashlib.md5(s.encode()).hexdigest()[:15], 16)


def brute(rows, shards=8):
    """Sort by (text hash, id hash, id); a key's shard is by the bytes before it."""
    keyed = sorted((h60(t or ""), h60("" if i is None else str(i)), i is not None, i or 0, len((t or "").encode()) + 1,
                    zlib.crc32((t or "").encode())) for i, t in rows)
    total, before, out, slots, last, shard = sum(r[4] for r in keyed), 0, [], Counter(), None, 0
    for t, k, known, i, size, crc in keyed:
        if (t, k, i) != last:
            shard, last = shards * before // total, (t, k, i)
        out.append((i if known else None, size, crc, shard, slots[shard]))
        slots[shard] += 1
        before += size
    return out


def key(r):
    return r[0] is None, r[0] or 0, *r[1:]


@pytest.mark.parametrize("slice_rows", [20_000, 7])
def test_against_brute_force(small, odd_docs, slice_rows, monkeypatch):
    monkeypatch.setattr(sharding, "FINISH_KEYS", 3)
    for docs in (small, odd_docs):
        got = sharding.histogram_sort(docs, slice_rows=slice_rows).select("doc_id", "text", "shard", "slot").collect()
        want = brute([(r.doc_id, r.text) for r in docs.collect()])
        got = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), r["shard"], r.slot) for r in got]
        assert sorted(got, key=key) == sorted(want, key=key)


def test_one_text_holds_most_rows(spark):
    rows = [(i, "the same text over and over" if i % 3 else f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.histogram_sort(docs, slice_rows=20).collect()
    want = brute(rows)
    assert sorted((r.doc_id, r["shard"], r.slot) for r in got) == sorted((r[0], r[3], r[4]) for r in want)
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += len(r.text) + 1
    assert max(sizes.values()) - min(sizes.values()) <= 2 * 29


def test_tolerance_stops_early_within_bounds(small):
    rows = sharding.histogram_sort(small, tolerance=0.2).collect()
    sizes = Counter()
    for r in rows:
        sizes[r["shard"]] += len(r.text.encode()) + 1
    mean = sum(sizes.values()) / 8
    largest = max(len(r.text.encode()) + 1 for r in rows)
    assert all(abs(s - mean) <= 0.4 * mean + largest for s in sizes.values())


def test_report_and_empty(odd_docs, no_docs):
    r = sharding.shard_report(odd_docs).collect()
    assert len(r) == odd_docs.count() and {x.law for x in r} == {"bytes"} and {x.grown_shard for x in r} == {None}
    assert sharding.shard_report(no_docs).count() == 0
    assert sorted(sharding.histogram_sort(odd_docs).columns) == sorted(odd_docs.columns)
