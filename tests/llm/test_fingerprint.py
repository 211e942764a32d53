import hashlib

import numpy as np

from threadlens.llm import fingerprint


def edits(rows):
    """Descending id, ties by text; null ids last."""
    rows = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    out = []
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        m = len(t) // 3
        out.append((i, len(t), hashlib.sha256((t[:len(t) - m] + n[:m]).encode()).hexdigest()))
    return out


def key(r):
    return r[0] is None, r[0] or 0, *r[1:]


def test_edits_follow_the_next_document(small, odd_docs):
    for docs, size in ((small, 4_000_000), (small, 20_000), (odd_docs, 4_000_000), (odd_docs, 100_000)):
        got = [(r.doc_id, r.n_chars, r.edited_sha256) for r in fingerprint.edited_report(docs, size).collect()]
        want = edits([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert sorted(got, key=key) == sorted(want, key=key)


def test_likeness_ranks_edits_over_other_documents(small):
    rows = fingerprint.edited_report(small).collect()
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)
    long = [r for r in rows if r.n_chars > 200]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.98
    digest = {}
    for r in rows:
        digest.setdefault(r.edited_sha256, set()).add(r.edited_fingerprint)
    assert all(len(s) == 1 for s in digest.values())


def test_strings_hold_the_digest(odd_docs, no_docs):
    rows = fingerprint.edited_report(odd_docs).collect()
    for r in rows:
        (a, m), (b, n) = fingerprint.from_string(r.fingerprint), fingerprint.from_string(r.edited_fingerprint)
        assert abs(float(fingerprint.likeness(a, m, b, n)) - r.near_edited) < 1e-12
    assert fingerprint.edited_report(no_docs).count() == 0
    got = fingerprint.fingerprints(odd_docs)
    by_text = {}
    for r in got.collect():
        by_text.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(s) == 1 for s in by_text.values())
    assert sorted(got.columns) == sorted(odd_docs.columns)


def test_counts_by_hand():
    """Bucket counts of one text, triplet by triplet."""
    text = b"a short text, read round its end"
    counts = np.zeros(fingerprint.BUCKETS, int)
    for p in range(len(text)):
        for k, (x, y) in enumerate(fingerprint.DISTANCES):
            t = fingerprint._TABLES
            at = (text[p], text[(p + x) % len(text)], text[(p + y) % len(text)])
            counts[t[3 * k][at[0]] ^ t[3 * k + 1][at[1]] ^ t[3 * k + 2][at[2]]] += 1
    q = np.sort(counts)[[255, 511, 767]]
    want = (counts[:, None] > q[None, :]).sum(1)
    code, _ = fingerprint.digests(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    assert code[0].tolist() == want.tolist()
