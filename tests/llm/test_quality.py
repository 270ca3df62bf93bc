import os
import random
from collections import Counter

import zstandard

from tallyframe.llm import quality

from .conftest import odd_texts, prose

SPACES = " \t\n\x0b\x0c\r"


def plain(text):
    words, now = [], ""
    for c in text or "":
        if c in SPACES:
            words += [now] if now else []
            now = ""
        else:
            now += c
    words += [now] if now else []
    lines, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(SPACES):
            dup += line in lines
            lines.add(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count = Counter(windows)
    inside = {i + j for i, w in enumerate(windows) if count[w] > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(inside)


def verdict(text, failed):
    """Whether a text is kept, by a one-shot compressor for each piece and the bands as they are stated."""
    data = (text or "").encode()
    ratio = lambda x: len(x) / len(zstandard.compress(x, quality.LEVEL))
    fits = lambda x: next(low <= ratio(x) <= high for most, low, high in quality.BANDS if len(x) < most)
    if failed or not data:
        return False
    chunks = [data[i : i + 4096] for i in range(0, len(data), 4096)] if len(data) > 4096 else []
    return fits(data) and sum(len(c) for c in chunks if not fits(c)) <= 0.3 * len(data)


def test_counts_match_a_plain_version(make):
    rng = random.Random(5)
    part = prose(rng, 9)
    noise = "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=9000))
    mixed = " ".join(noise[i : i + 8] for i in range(0, 9000, 9))
    texts = [*odd_texts(), prose(rng, 3000), prose(rng, 1200) + " " + part * 9 + prose(rng, 1500) + part * 9, mixed, prose(rng, 900) + " " + mixed, prose(rng, 9000), f"{part} x {part}", "a b\na b\n\n \na b", "#*$%&|<> #", " ".join([part] * 5)]
    got = {r.doc_id: r for r in quality.quality(make(texts)).collect()}
    for i, t in enumerate(texts):
        n, chars, symbols, dup, again = plain(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == (n, chars, symbols, dup, again)
        assert got[i].base_failed == (n < 20 or 100 * again > 30 * n)
        assert got[i].kept == verdict(t, got[i].base_failed), t
    assert {True, False} == {got[i].kept for i in got}


def test_compression_bands():
    own = zstandard.ZstdCompressor(level=quality.LEVEL)
    rng = random.Random(1)
    assert quality.compression(prose(rng, 900).encode(), own)[0]
    assert not quality.compression(b"spam " * 2000, own)[0]
    assert not quality.compression(os.urandom(5000), own)[0]
    half = prose(rng, 1500).encode() + b"buy now " * 1200
    assert quality.compression(half, own)[2] > 0 and not quality.compression(half, own)[0]
    assert quality.compression(b"", own) == (True, 0.0, 0)


def test_empty_table(nothing):
    assert quality.quality(nothing).count() == 0
