import itertools
import os
import random
from zlib import crc32

import numpy as np
import pytest

from tallyframe.llm import langid

from .conftest import SCHEMA

SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "sch ung bei zt ver".split(), "cc": "éo qui eau oux chê".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture
def labelled(spark):
    rng = random.Random(2)
    rows = [(i, text(rng, lang := "aa bb cc".split()[i % 3], rng.randint(15, 60)), lang if i % 10 else None) for i in range(240)]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 ... !!", "cc"), (1003, text(rng, "aa", 9000), "aa"), (1003, text(rng, "bb", 40), None)]
    return spark.createDataFrame([(*r, "s", 1, 7, "x", "x", "x", "x", "x", None) for r in rows], SCHEMA)


def test_forward_backward_equals_enumeration(monkeypatch):
    rng = np.random.default_rng(1)
    lengths, move = np.array([3, 1, 4]), rng.normal(size=(3, 3))
    monkeypatch.setattr(langid, "SCALE", 2)
    emit = rng.normal(size=(8, 3))
    got, pairs = langid.forward_backward(emit, lengths, move, True)
    at, want_pairs = 0, np.zeros((3, 3))
    for n in lengths.tolist():
        total, marginal = 0.0, np.zeros((n, 3))
        inner = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=n):
            w = np.exp(sum(emit[at + i, y] for i, y in enumerate(path)) + sum(move[a, b] for a, b in itertools.pairwise(path)))
            total += w
            for i, y in enumerate(path):
                marginal[i, y] += w
            for a, b in itertools.pairwise(path):
                inner[a, b] += w
        assert np.allclose(got[at : at + n], marginal / total)
        want_pairs += inner / total
        at += n
    assert np.allclose(pairs, want_pairs)


def test_held_out_accuracy_and_odd_rows(labelled):
    field = langid.train(labelled)
    assert field.labels == ["aa", "bb", "cc"]
    rows = {(r.doc_id, r.n_words): r for r in langid.identify(labelled, field).collect()}
    assert len(rows) == 245
    for (i, _), r in rows.items():
        assert r.held_out == (crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
    own = [r for (i, _), r in rows.items() if i < 240]
    assert sum(r.lang_pred == "aa bb cc".split()[r.doc_id % 3] for r in own) == 240
    assert [rows[i, 0].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and rows[1000, 0].score == 0
    assert rows[1003, 9000].lang_pred == "aa" and rows[1003, 40].lang_pred == "bb"
    kept = langid.keep(labelled, field)
    assert kept.columns == labelled.columns and kept.count() == 242


def test_words_of_code_switched_text_are_labelled(labelled):
    rng = random.Random(8)
    field = langid.train(labelled)
    parts = [text(rng, lang, 12) for lang in ("aa", "bb", "cc")]
    marginals = langid.Labeller(field).marginals([langid.words_of(" ".join(parts))])
    want = np.repeat([0, 1, 2], [len(p.split()) for p in parts])
    assert (marginals.argmax(axis=1) == want).mean() > 0.9


def test_predictions_ignore_labels_ids_and_the_cache(spark, labelled, monkeypatch):
    field = langid.train(labelled)
    t = [r.text for r in labelled.limit(30).collect()]
    one = langid.Labeller(field).judge(t)
    monkeypatch.setattr(langid, "CACHE_WORDS", 10)
    small = langid.Labeller(field)
    assert [small.judge([u])[0][0] for u in t] == [x[0] for x in one]


def test_no_labels_and_empty_table(spark, nothing, make):
    assert langid.identify(nothing, langid.train(nothing)).count() == 0
    none = make(["hello there"]).selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert [r.lang_pred for r in langid.identify(none, langid.train(none)).collect()] == ["und"]


def test_samples_are_bounded_whatever_the_ids(spark):
    rng = random.Random(4)
    for one in (None, 12345, 3, 4, 8):
        rows = [(one, text(rng, lang := "aa bb cc".split()[i % 3], 20), lang) for i in range(900)]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        got = langid.sampled(df, most=90, longest=1 << 20).collect()
        held = crc32(("" if one is None else str(one)).encode()) % 4 == 2
        assert len(got) == (0 if held else 90)
        assert held or sorted({r.lang for r in got}) == ["aa", "bb", "cc"]
        assert all(r.lang_pred != "und" for r in langid.identify(df, langid.train(df)).limit(5).collect()) or held
    same = spark.createDataFrame([(None, "ka lo mi", "aa")] * 500 + [(None, f"tu re {i}", "aa") for i in range(5)], "doc_id long, text string, lang string")
    assert langid.sampled(same).count() == 6


def test_samples_are_bounded_in_bytes(spark):
    rng = random.Random(5)
    rows = [(i, text(rng, "aa", 3000), "aa") for i in range(8)] + [(i, text(rng, "bb", 20), "bb") for i in range(8, 60)] + [(99, text(rng, "bb", 9000), "bb")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.sampled(df, longest=1000).collect()
    assert sum(r.lang == "aa" for r in got) == 1 and max(len(r.text.encode()) for r in got if r.lang == "bb") <= 1000


def test_training_sees_every_word_of_a_sampled_text():
    rng = random.Random(6)
    late = text(rng, "aa", 3000) + " zzyzx zzyzx zzyzx"
    field = langid.fit([(late, "aa"), (text(rng, "bb", 300), "bb")])
    assert "zzyzx" in field.lexicon
    weights = field.weights[langid.BUCKETS + field.lexicon["zzyzx"]]
    assert weights[0] > weights[1] and not np.array_equal(weights, field.weights[langid.BUCKETS])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_held_out_accuracy_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    told = langid.op10_language_id(spark, "/root/testdata/sf0.01")
    rows = docs.select("doc_id", "lang").join(told, "doc_id").filter("held_out and lang is not null and lang_pred != 'und'").collect()
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) > 0.95 * len(rows)
