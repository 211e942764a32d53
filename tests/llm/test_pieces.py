import random

import numpy as np
import pytest

from threadlens.llm import pieces

PATH = pieces.default_model()


@pytest.fixture(scope="module")
def lib():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_library_agrees_on_documents(small, odd_docs, no_docs):
    assert pieces.library_mismatches(small, PATH).count() == 0
    assert pieces.library_mismatches(odd_docs, PATH).count() == 0
    assert pieces.library_mismatches(no_docs, PATH).count() == 0


def test_random_texts_and_ids(lib):
    rng = random.Random(5)
    texts = ["".join(rng.choice(" ▁abcdehlotin<>0x\né日🙂\x01") for _ in range(rng.randint(0, 80))) for _ in range(3000)]
    ids, lens = pieces.encode_strings(PATH, texts)
    ends = np.cumsum(lens)
    assert [ids[e - n:e].tolist() for e, n in zip(ends, lens)] == lib.encode(texts)
    model, _ = pieces.model_at(PATH)
    some = [[rng.randint(0, 400) if rng.random() < 0.7 else rng.randint(0, 31999) for _ in range(rng.randint(0, 12))] for _ in range(3000)]
    assert [model.decode(x) for x in some] == [lib.decode(x) for x in some]


def test_both_agendas_agree():
    model, _ = pieces.model_at(PATH)
    rng = random.Random(6)
    for _ in range(200):
        word = " " + "".join(rng.choice("thereandtion") for _ in range(rng.randint(1, 39)))
        row, _ = model.encode_chunks([word])
        assert row.tolist() == model._agenda_heap(model.char[[ord(c) for c in word]].tolist())


def test_encode_texts_and_report(odd_docs, lib):
    got = pieces.encode_texts(odd_docs, PATH)
    assert got.columns == [c for c in odd_docs.columns if c not in ("piece_ids", "decoded")] + ["piece_ids", "decoded"]
    for r in got.collect():
        want = lib.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.piece_ids == want and r.decoded == lib.decode(want)
    assert pieces.piece_report(odd_docs, PATH).count() == odd_docs.count()
