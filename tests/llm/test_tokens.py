import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadlens.llm import tokens
from threadlens.llm.common import buffers

PATH = public_tokenizers.path("byte_bpe_50k.json")


def brute(rows):
    lib, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode())):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("slice_bytes", [8_000_000, 30_000])
def test_files_hold_every_document(spark, small, odd_docs, slice_bytes):
    for docs in (small, odd_docs):
        folder = tokens.new_folder(spark, "test")
        slices = tokens.write_ids(docs, PATH, 2, folder, slice_bytes)
        got = sorted(map(tuple, tokens.read_report(slices, folder).collect()), key=lambda r: r[1])
        assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty_table(spark, no_docs):
    folder = tokens.new_folder(spark, "test")
    slices = tokens.write_ids(no_docs, PATH, 2, folder)
    assert tokens.read_report(slices, folder).count() == 0


def test_flat_format(spark, odd_docs):
    folder = tokens.new_folder(spark, "test")
    tokens.write_ids(odd_docs, PATH, 2, folder)
    src = tokens._Folder(folder)
    ids, offs = src.read("ids-00000000.bin", "<u2"), src.read("offsets-00000000.bin", "<i8")
    assert isinstance(ids, np.memmap) and offs[0] == 0 and offs[-1] == len(ids) and (ids[offs[1:] - 1] == 2).all()


def encoded(texts):
    col = pa.array([t.encode() for t in texts], pa.large_binary())
    ids, lens = tokens.encode_bytes(PATH, *buffers(col))
    ends = np.cumsum(lens)
    return [ids[e - n:e].tolist() for e, n in zip(ends, lens)]


def test_chunking_is_exact():
    texts = ["", " ", "a  b", "a \x1cb", "x <|endoftext|> y", "it's we'll '  s", "a\n\n b\n c ", " lead", "trail  ", "a  b",
             "\u00a0 a \u00a0b c\u00a0 d", "x\u3000 y \u3000z", "x \u2003y\u2028 z\u1680 w", "\u00e9t\u00e9 \u00e0 \u00ab o\u00f9 \u00bb", "a\x85 b \x85c",
             "end.\nNext, a!?\n\nTwo\n \nx \u00e9t\u00e9.\u00e0\u00d7, it's. 's, a'll.b\n", "a.\u2003\nB c%%%\x85\nd", "\na.\u3000\nb",
             "\u4e00 \u4e01\u4e02 \u0430 \u0431", "", "\U0001f600 \U0001f601"]
    lib = Tokenizer.from_file(PATH)
    assert encoded(texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert encoded(texts[::-1]) == encoded(texts)[::-1] and encoded([]) == [] and encoded([""]) == [[]]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab's .,1\n\t%|<>\x1c\x85\u00a0\u2003\u3000\u00e9\u4e00", max_size=16), max_size=6))
def test_any_text_is_exact(texts):
    lib = Tokenizer.from_file(PATH)
    assert encoded(texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_equal_hashes_are_told_apart(monkeypatch):
    """All chunks share a hash: the bytes decide, and the ids stay those of the library."""
    monkeypatch.setattr(tokens, "hash_words", lambda raw, s, e: np.zeros(len(s), np.uint64))
    monkeypatch.setattr(tokens, "_encoders", {})
    texts = ["one two one", "two one", "onf two", "one", "", "on two"]
    lib = Tokenizer.from_file(PATH)
    assert encoded(texts) == [lib.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_small_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "_encoders", {})
    monkeypatch.setattr(tokens, "MAX_CHUNKS", 3)
    texts = ["one two one", "three four five six seven", "one two", "eight"]
    lib = Tokenizer.from_file(PATH)
    assert [encoded([t])[0] for t in texts] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
