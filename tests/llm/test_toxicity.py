import itertools

import numpy as np

from threadlens.llm import toxicity


def kernel(a, b, decay=toxicity.DECAY, length=toxicity.SUBSEQUENCE):
    """Straight from the definition: every pair of equal subsequences."""
    total = 0.0
    for i in itertools.combinations(range(len(a)), length):
        for j in itertools.combinations(range(len(b)), length):
            if all(a[x] == b[y] for x, y in zip(i, j)):
                total += decay ** (i[-1] - i[0] + 1 + j[-1] - j[0] + 1)
    return total


def test_kernel_is_the_definition():
    pairs = [("moron", "moron"), ("clown", "clxown"), ("abcabc", "cabbage"), ("aaaa", "aaaaa"), ("xyz", "abc")]
    got = toxicity.subsequence_kernel(toxicity._matrix([a for a, _ in pairs]), toxicity._matrix([b for _, b in pairs]))
    assert np.allclose(got, [kernel(a, b) for a, b in pairs], rtol=1e-5)


def test_inserted_letters_and_gaps_still_match():
    marks = toxicity.Landmarks(["idiot", "worthless"])
    value = marks.compare(["idiot", "idxiot", "idioot", "worthxless", "haereding", "the"])
    assert np.allclose(value[0, 0], 1) and (value[1:3, 0] > 0.5).all() and value[3, 1] > 0.5 and not value[4:].any()
    f = toxicity.Features(marks)
    plain = f.of(["you idiot here"])
    assert np.allclose(f.of(["you i.d.i.o.t here"]), plain)
    assert f.of(["x i d i o t x"]).any() and not f.of(["", "nothing at all"]).any()


def test_masked_words_and_all_pairs():
    marks = ["loser", "clown", "trash", "worthless", "pathetic", "scum", "idiot", "ümläut", "aaaa"]
    masked = ["l*ser", "cl*wn", "tr*sh", "w*rthl*ss", "p*th*tic"]
    value = toxicity.Landmarks(marks).compare([toxicity.letters(w) for w in masked])
    assert (value[np.arange(5), np.arange(5)] > 0.5).all()
    words = [toxicity.letters(w) for w in masked] + ["scumbag", "idxixot", "umlaut", "aaa", "aaaaaa", "losers", "日本語", "ab", "", "worthlessnes"]
    for floor in (0.0, 0.5):
        got = toxicity.Landmarks(marks).compare(words, floor=floor)
        for i, a in enumerate(words):
            for j, b in enumerate(marks):
                v = kernel(a, b) / np.sqrt(kernel(a, a) * kernel(b, b)) if len(a) > 2 else 0.0
                assert np.isclose(got[i, j], v if v >= floor else 0.0, rtol=1e-4), (a, b)
    assert toxicity.Landmarks([]).compare(["word"]).shape == (1, 0)


def test_background_sets_what_lower_values_count_for():
    marks = toxicity.Landmarks(["idiot", "loser"])
    f = lambda word: toxicity.Features(marks).of([word])
    assert not f("idxixot").any()
    counts = np.zeros((2, 101))
    counts[0, 20], counts[1, 45] = 900, 900  # clean words reach 0.2 with idiot, 0.45 with loser
    marks.learn(counts, 1_000_000)
    assert np.allclose(f("idxixot")[0], f("idiot")[0]) and marks.floor[0] < 0.37
    assert not f("loxxxser").any() and not f("ixdxixoxt").any()  # as clean words: 0.31, 0.16
    marks.learn(counts, 1000)  # too few words to tell
    assert not f("idxixot").any() and np.allclose(marks.floor, 0.5)


def test_two_and_more_inserted_letters_and_suffixes(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    words = ["scum", "idiot", "clown", "trash", "stupid", "garbage", "pathetic", "worthless", "disgusting"]
    marks = toxicity.Landmarks(words)
    sample = docs.select("doc_id", "text").join(labels.select("doc_id", "toxic"), "doc_id")
    counts, n = toxicity.background(sample, marks)
    texts = [r.text for r in sample.filter("toxic = 0").select("text").collect()]
    assert n == sum(len(toxicity.words_of(t)) for t in texts)
    marks.learn(counts, n)
    thrice = {}
    for j, w in enumerate(words):
        two = [w[:a] + "x" + w[a:b] + "x" + w[b:] for a in range(1, len(w)) for b in range(a, len(w))]
        three = [w[:1] + "x" + w[1:2] + "x" + w[2:3] + "x" + w[3:], w[:2] + "xxx" + w[2:]]
        longer = [w + "s", w + "bag", w + "bags", w + "heads"]
        found = [(marks.similarity(forms)[:, j] > 0).mean() for forms in (two, three, longer)]
        assert found[0] >= 0.65 and found[2] == 1, (w, found)
        thrice[w] = found[1] > 0
    # three letters take some words as far away as ordinary words of clean text are
    assert sum(thrice.values()) >= 6, thrice


def test_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    some = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = toxicity.fit_default(some, labels)
    rows = toxicity.score_texts(some.filter(toxicity.held_out()), model).join(labels, "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted for r in toxic]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.02


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (4, 0), (5, None), (None, 1), (7, 0), (7, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    rows = toxicity.score_texts(odd_docs, model).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.score_texts(no_docs, model).count() == 0
    none = toxicity.fit(no_docs, labels.limit(0))
    kept = toxicity.drop_toxic(odd_docs, none)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def test_svm_separates():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3))
    y = np.where(x @ [1.0, -2.0, 0.5] + 0.3 > 0, 1, -1)
    w, b = toxicity.fit_svm(x, y)
    assert (np.sign(x @ w + b) == y).mean() > 0.97
    slope, _ = toxicity.fit_logistic(x @ w + b, (y + 1) / 2)
    assert slope > 0
