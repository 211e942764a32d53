import numpy as np
import pyarrow as pa

from threadlens.llm import langid


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(rows) > 100 and np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in langid.language_report(odd_docs).collect()}
    assert got[1].lang_pred == "und" and got[2].lang_pred == "und" and got[3].lang_pred == "und" and got[14].lang_pred == "und"
    assert got[4].lang_pred != "und" and got[8].lang_pred in ("en", "de", "fr")
    assert langid.language_report(no_docs).count() == 0
    nothing = langid.identify(odd_docs, None)
    assert nothing.filter("lang_pred <> 'und'").count() == 0 and sorted(nothing.columns) == sorted(odd_docs.columns)


def test_counts_are_document_counts(spark):
    docs = spark.createDataFrame([("abcd abcd", "xx"), ("ABCD", "xx"), ("zabcd", "yy"), (None, "yy")], "text string, lang string")
    got = {(r.lang, int(r.gram).to_bytes(4, "big")): r.n for r in langid.gram_counts(docs).collect()}
    assert got[("xx", b"abcd")] == 2 and got[("yy", b"abcd")] == 1 and got[("xx", b" abc")] == 2


def test_filter_has_no_false_negatives_and_many_languages():
    rng = np.random.default_rng(7)
    langs = [f"l{k:03d}" for k in range(70)]
    slots = np.zeros((2, 1 << 14), np.uint64)
    grams = rng.integers(0, 2**32, (70, 20))
    for k in range(70):
        for at in langid.slot_numbers(grams[k], 1 << 14):
            np.bitwise_or.at(slots[k // 64], at, np.uint64(1) << np.uint64(k % 64))
    model = langid.LanguageFilter(langs, [1 / 70] * 70, slots)
    for k in range(70):
        assert ((model.masks(grams[k])[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).all()
    other = model.masks(rng.integers(0, 2**32, 5000))
    rate = np.mean([((other[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean() for k in range(70)])
    assert rate <= 3 * model.mistake.mean() + 0.001


def test_grams_stay_inside_rows():
    text = langid._plain(pa.array(["ab1cd", "", "xyz"]))
    from threadlens.llm.common import buffers
    row, gram = langid.grams(*buffers(text))
    got = {(int(r), int(g).to_bytes(4, "big")) for r, g in zip(row, gram)}
    assert got == {(0, b" ab "), (0, b"ab c"), (0, b"b cd"), (0, b" cd "), (2, b" xyz"), (2, b"xyz ")}
