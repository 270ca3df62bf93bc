"""Content-defined blocks: the part of a corpus in which a string of a given length can repeat.

A window is `size` units (bytes or words) of one text. Each window picks an anchor, the gram of `gram` units with the
smallest hash in it, the leftmost of equals; so equal windows pick equal grams at equal places. Consecutive windows with one
anchor make a run, and the units they cover are its block. Where an anchor's gram occurs once in the corpus, none of
the run's windows repeats; this leaves out most of a corpus at the price of one hash for each run.
"""

from __future__ import annotations

import numpy as np

#: Odd base of the polynomial hash modulo 2**64, which only picks anchors, and multipliers of its finalizer.
BASE = 0x9E3779B97F4A7C15
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
PLACE = np.uint64((1 << 24) - 1)
SECTION = 1 << 21
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def finished(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n."""
    if base not in _powers or len(_powers[base][0]) <= n:
        size = max(n + 1, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            both.append(np.cumprod(x))
        _powers[base] = (both[0], both[1])
    return _powers[base]


class Hashes:
    """Hashes of the stretches of a unit sequence; equal stretches have equal ones wherever they are."""

    def __init__(self, units: np.ndarray, base: int):
        self.up, self.down = powers(base, len(units))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(units * self.up[: len(units)])])

    def grams(self, size: int) -> np.ndarray:
        """Of every stretch of `size` units."""
        n = max(0, len(self.sums) - size)
        return finished((self.sums[size:] - self.sums[:n]) * self.down[:n])


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The minimum over every `width` consecutive keys, by doubling."""
    have, step = keys, 1
    while 2 * step <= width:
        have = np.minimum(have[:-step], have[step:])
        step *= 2
    rest = width - step
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have


def runs(units: np.ndarray, lengths: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of texts: (text's number, first window's place in the text, number of windows, anchor's place after
    that of the first window, anchor's hash).

    `units` holds the 64-bit codes of texts one after another, `lengths` their lengths. Texts of SECTION units or more are
    cut into sections that share no window; a run that this cuts is two runs with one anchor.
    """
    if len(units) >= SECTION:
        found = []
        begin = np.cumsum(lengths) - lengths
        for i, (b, n) in enumerate(zip(begin.tolist(), lengths.tolist(), strict=True)):
            step = SECTION - size
            for s in range(0, max(1, n - size + 1), step):
                e = min(n, s + step + size - 1)
                t, place, *rest = _runs(units[b + s : b + e], np.array([e - s]), size, gram)
                found.append((t + i, place + s, *rest))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))
    return _runs(units, lengths, size, gram)


def _runs(units: np.ndarray, lengths: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    begin = np.cumsum(lengths) - lengths
    none = np.zeros(0, np.int64)
    if len(units) < size:
        return (none,) * 4 + (none.view(np.uint64),)
    grams = Hashes(units, BASE).grams(gram)
    keys = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    anchor = (least(keys, size - gram + 1) & PLACE).astype(np.int64)
    n = np.maximum(lengths - size + 1, 0)
    own = np.repeat(np.arange(len(lengths)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + begin[own]
    if not len(at):
        return (none,) * 4 + (none.view(np.uint64),)
    picked = anchor[at]
    start = np.flatnonzero(np.concatenate([[True], (picked[1:] != picked[:-1]) | (own[1:] != own[:-1])]))
    count = np.diff(np.append(start, len(at)))
    text, place = own[start], at[start]
    return text, place - begin[text], count, picked[start] - place, grams[picked[start]]
