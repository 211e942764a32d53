import pytest

CLASHES = ("fingerprint", "shard", "slot", "lang_pred", "score", "predicted", "piece_ids", "decoded", "_blk", "_slice",
           "_hs_t", "_fm_words", "_mh_id", "_li_letter", "x0", "comp", "rep", "key", "id", "a", "b", "w", "n")

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))

TEXTS = [
    (1, None, "en"), (2, "", "en"), (3, " \n\t ", None), (4, "a", "en"), (None, "a row without an id", "en"),
    (5, LONG, "de"), (6, LONG, "de"), (7, "the same row twice, the same row twice", "en"),
    (7, "the same row twice, the same row twice", "en"), (7, "another text of the same id", None),
    (8, "Ünïcode 日本語 ▁ mark   <s> </s> <|endoftext|> \U0001F600 x", None),
    (9, "before " + PASSAGE + " after", "en"), (10, PASSAGE + " " + PASSAGE, "en"), (11, "x" * 3000, "fr"),
    (12, "one two three four five six seven eight nine ten eleven twelve " * 12, "en"),
    (13, "one two three four five six seven eight nine ten eleven twelve " * 12 + "thirteen", "en"),
    (14, "123 456 !!! ...", "en"), (-5, "a negative id", "en"), (2**62, "a very large id", "en"),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the
    operators' own."""
    names = ["doc_id", "text", "lang", "source", "n_chars", *CLASHES]
    rows = [(i, t, lang, None, None, *[f"{c}?" for c in CLASHES]) for i, t, lang in TEXTS]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)
    return spark.createDataFrame(rows, schema).select(*names)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
