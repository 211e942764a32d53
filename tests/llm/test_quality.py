import math
import zlib
from collections import Counter

import pytest

from threadlens.llm import quality

START = "\udfff"


def brute(train, texts):
    """Interpolated modified Kneser-Ney over character 4-grams, by dictionaries."""
    counts = {4: Counter()}
    for t in train:
        padded = START * 3 + t
        counts[4].update(padded[k:k + 4] for k in range(len(t)))
    for k in (3, 2, 1):
        counts[k] = Counter(g[-k:] for g in counts[k + 1])
    parts = {}
    for k, c in counts.items():
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        d = [min(max(j - (j + 1) * y * n[j + 1] / n[j] if n[j] and y else 0.5 * j, 0.1), j - 0.05) for j in (1, 2, 3)]
        total, mass = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            mass[g[:-1]] += d[min(x, 3) - 1]
        parts[k] = d, total, mass

    def p(gram):
        out = 1 / (len(counts[1]) + 1)
        for k in (1, 2, 3, 4):
            d, total, mass = parts[k]
            g = gram[-k:]
            if total[g[:-1]]:
                x = counts[k][g]
                out = ((x - d[min(x, 3) - 1] if x else 0) + mass[g[:-1]] * out) / total[g[:-1]]
        return out

    for t in texts:
        padded = START * 3 + t
        yield sum(math.log(p(padded[k:k + 4])) for k in range(len(t)))


@pytest.mark.parametrize("block", [12_000_000, 50_000])
def test_log_probabilities_against_brute_force(spark, small, block):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    good = {r.doc_id for r in labels.filter("quality = 1").collect()}
    rows = small.collect()
    train = [r.text for r in rows if r.doc_id in good and zlib.crc32(str(r.doc_id).encode()) % 4 < 2]
    got = {r.doc_id: r for r in quality.score(small, labels, block).collect()}
    assert len(got) == len(rows)
    for r, want in zip(rows[::5], brute(train, [r.text for r in rows[::5]])):
        assert got[r.doc_id].n_chars == len(r.text) and abs(got[r.doc_id].log_prob - want) < 1e-6 * abs(want)


def test_bad_documents_have_the_higher_perplexity(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = quality.quality_report(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").filter("held_out").collect()
    kept = {q: [r.kept for r in rows if r.quality == q] for q in (0, 1)}
    assert sum(kept[1]) > 0.97 * len(kept[1]) and sum(kept[0]) < 0.15 * len(kept[0])


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, q) for i, q in ((5, 1), (12, 1), (13, 1), (6, 1), (7, 1), (7, 0), (9, None), (None, 1))],
                                   "doc_id long, quality int")
    rows = quality.quality_report(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count()
    assert all((r.perplexity is None) == (r.n_chars == 0) for r in rows) and not any(r.kept for r in rows if r.n_chars == 0)
    assert quality.quality_report(no_docs, labels).count() == 0
    none = quality.quality_report(odd_docs, labels.limit(0)).collect()
    assert len(none) == len(rows) and not any(r.kept or r.perplexity is not None for r in none)
