import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyframe.llm import tokens
from tallyframe.llm.common import shared_dir

from .conftest import odd_texts


@pytest.fixture(scope="module")
def library():
    import public_tokenizers

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda t: [*own.encode(t or "", add_special_tokens=False).ids, tokens.END_ID]


@pytest.mark.parametrize(("n", "top"), [(0, 0), (1, 0), (1, 9), (500, 70000), (4000, 4000), (300, 2**31), (200, 3), (40, 2**64 - 1), (3, 2**63), (20000, 900)])
def test_elias_fano(n, top):
    values = np.sort(np.random.default_rng(n).integers(0, top, n, np.uint64, endpoint=True))
    parts = tokens.EliasFano.encode(values)
    coded = tokens.EliasFano(n, **parts)
    assert np.array_equal(coded.select(np.arange(n)), values)
    some = np.random.default_rng(1).permutation(n)[:50]
    assert np.array_equal(coded.select(some), values[some])
    with pytest.raises(IndexError):
        coded.select(np.array([n]))
    if n > 100 and top > n:
        assert 8 * (len(parts["low"]) + len(parts["high"]) + len(parts["ranks"])) <= 1.07 * n * (2 + np.ceil(np.log2(top / n))) + 64


def test_gaps_of_any_width():
    values = np.array([0, 0, 5, 10**9, 10**9, 10**9 + 1, *range(2 * 10**9, 2 * 10**9 + 3000)], np.uint64)
    coded = tokens.EliasFano(len(values), **tokens.EliasFano.encode(values))
    assert np.array_equal(coded.select(np.arange(len(values))), values)


def test_other_tokenizers_are_given_whole_texts(tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = tokens.Encoder(path), Tokenizer.from_file(path)
    assert not own.by_words and tokens.Encoder().by_words
    texts = [t or "" for t in odd_texts()]
    ids, ends = own.encode(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, ends[:-1])] == [[*library.encode(t, add_special_tokens=False).ids, tokens.END_ID] for t in texts]


def test_worker_tables_are_bounded_in_bytes(library, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_BYTES", 4000)
    own, rng = tokens.Encoder(), random.Random(2)
    for _ in range(20):
        texts = ["".join(rng.choices("abcdexyz", k=rng.choice([5, 9, 3000]))) for _ in range(40)]
        ids, ends = own.encode(pa.array(texts))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library(t) for t in texts]
        assert max(map(len, own.known)) <= tokens.LONGEST and own.n_bytes < 8000
    long = "z" * 2_000_000
    assert own.encode(pa.array([long]))[0].tolist()[:-1] == library(long)[:-1]


def test_words_give_the_ids_of_whole_texts(library, monkeypatch):
    rng = random.Random(6)
    parts = [*"abéßÿ×'SsTt \n\t\x1c̀́İΣσ½²٣中|.,!-_", "<|endoftext|>", "<|STARTOFTEXT|>", " 's", "The ", "n't "]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(1500)] + [t or "" for t in odd_texts()]
    monkeypatch.setattr(tokens, "CACHE_WORDS", 200)
    own = tokens.Encoder()
    for i in range(0, len(texts), 100):
        ids, ends = own.encode(pa.array(texts[i : i + 100]))
        assert [x.tolist() for x in np.split(ids, ends[:-1])] == [library(t) for t in texts[i : i + 100]]


@pytest.mark.parametrize("segment", [1 << 20, 64])
def test_files_round_trip(spark, make, nothing, library, monkeypatch, segment):
    texts = odd_texts()
    ids = [i * 7 % 101 for i in range(len(texts))]
    ids[3] = ids[4] = 55
    path = shared_dir(spark, "t")
    monkeypatch.setattr(tokens, "SEGMENT_IDS", segment)
    tokens.write(make(texts, ids), path)
    rows = sorted(tokens.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted(ids)
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        at += len(r.ids)
    want = sorted((i, library(t)) for i, t in zip(ids, texts, strict=True))
    assert sorted((r.doc_id, r.ids) for r in rows) == want
    crc = {(r.doc_id, r.ids_crc32) for r in tokens._documents(spark, path, ids=False).collect()}
    assert crc == {(i, zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in want}


def test_null_ids_and_empty_tables(spark, make, nothing, library):
    path = shared_dir(spark, "t")
    tokens.write(make(["a b", "c", "d"], [None, 1, None]), path)
    rows = sorted(tokens.read(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 1] and rows[2].ids == library("c")
    path = shared_dir(spark, "t")
    tokens.write(make(["a", "b", "c", "d"], [2**63 - 1, -(2**63), 0, -5]), path)
    assert [r.doc_id for r in sorted(tokens.read(spark, path).collect(), key=lambda r: r.start)] == [-(2**63), -5, 0, 2**63 - 1]
    path = shared_dir(spark, "t")
    tokens.write(nothing, path)
    assert tokens.read(spark, path).count() == 0
