import hashlib
import random
import re

from tallyframe.llm import decontaminate

from .conftest import odd_texts, prose


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def plain(text, items):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        for p in [w[i : i + 13] for i in range(max(1, len(w) - 12))] if w else []:
            for i in range(len(own) - len(p) + 1):
                if own[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
    return len(own), sorted(hit), sorted(found)


def cases():
    rng = random.Random(9)
    items = [(i, prose(rng, 30)) for i in range(8)] + [(8, "Seven quiet gardens"), (9, "salt"), (10, None), (11, ""), (12, "!?"), (13, "\u65e5\u672c\u8a9e"), (14, "Seven quiet gardens")]
    texts = odd_texts() + [
        items[0][1].upper(),
        "pre " + " ".join(items[1][1].split()[5:22]) + " post",
        " ".join(items[2][1].split()[:12]),
        "SEVEN, quiet... gardens!",
        "saltsalt salt",
        "x" + items[3][1],
        items[4][1] + items[5][1],
    ]
    return items, texts


def test_search_equals_brute_force(spark, make, monkeypatch):
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    for n_bytes in (decontaminate.PASS_BYTES, 500):  # one pass, and several
        monkeypatch.setattr(decontaminate, "PASS_BYTES", n_bytes)
        found = decontaminate.search(make(texts), bench)
        got = {r.doc_id: r for r in found.collect()}
        told = {r.doc_id: r for r in decontaminate.verdicts(found).collect()}
        for i, t in enumerate(texts):
            n, hit, found = plain(t, items)
            assert (got[i].n_words, got[i].hits, got[i].items) == (n, hit, found), t
            assert told[i].items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()
            assert told[i].contaminated == (len(hit) > 0 and 20 * len(hit) >= n)


def test_items_without_or_of_one_id(spark, make):
    bench = spark.createDataFrame([(None, "alpha beta gamma"), (None, "delta echo"), (5, "golf hotel"), (5, "golf india")], "item_id long, text string")
    texts = ["alpha beta gamma", "delta echo", "golf hotel golf india delta echo", "none"]
    got = {r.doc_id: r for r in decontaminate.verdicts(decontaminate.search(make(texts), bench)).collect()}
    assert [(got[i].n_hit, got[i].n_items) for i in range(4)] == [(3, 1), (2, 1), (6, 2), (0, 0)]
    assert got[2].items_sha256 == hashlib.sha256(b"5").hexdigest() and got[0].items_sha256 == hashlib.sha256(b"").hexdigest()


def test_columns_of_the_input_keep_their_names_and_values(spark, monkeypatch):
    df = spark.createDataFrame([(1, "alpha beta", 10, "h", "i", "r"), (2, "other", 11, None, "i", "r")], "doc_id long, text string, n_words long, hits string, items string, row string")
    bench = spark.createDataFrame([(1, "alpha beta"), (2, "zulu yankee " * 40)], "item_id long, text string")
    for n_bytes in (decontaminate.PASS_BYTES, 64):
        monkeypatch.setattr(decontaminate, "PASS_BYTES", n_bytes)
        found, names = decontaminate.searched(df, bench)
        assert names == ["_n_words", "_hits", "_items"]
        assert sorted(tuple(r) for r in found.collect()) == [(1, "alpha beta", 10, "h", "i", "r", 2, [0, 1], ["1"]), (2, "other", 11, None, "i", "r", 1, [], [])]
        assert [tuple(r) for r in decontaminate.clean(df, bench).collect()] == [(2, "other", 11, None, "i", "r")]


def test_a_long_item_is_cut_without_losing_a_window(spark, make, monkeypatch):
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 400)
    rng = random.Random(3)
    long = prose(rng, 300)
    w = long.split()
    texts = [" ".join(["x", *w[i : i + 13], "y"]) for i in range(0, len(w) - 13)]
    monkeypatch.setattr(decontaminate, "PASS_BYTES", 900)
    rows = decontaminate.search(make(texts), spark.createDataFrame([(1, long)], "item_id long, text string")).collect()
    assert len(rows) == len(texts) and all(len(r.hits) >= 13 and r.items == ["1"] for r in rows)


def test_many_patterns_with_one_suffix_block():
    words = [f"w{i}" for i in range(4000)]
    group = decontaminate.Group([f" {w} same closing words of all of them and more for every one ".encode() for w in words])
    data = f" w77 same closing words of all of them and more for every one w78 same {words[5]} ".encode() * 200 + bytes(8)
    assert len(list(group.find(data))) == 200


def test_clean_and_empty_tables(spark, make, nothing):
    items, texts = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    kept = decontaminate.clean(make(texts), bench)
    assert kept.columns == make(texts).columns
    want = {i for i, t in enumerate(texts) if not (p := plain(t, items))[1] or 20 * len(p[1]) < p[0]}
    assert {r.doc_id for r in kept.collect()} == want
    assert decontaminate.clean(nothing, bench).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.clean(make(texts), none).count() == len(texts)
