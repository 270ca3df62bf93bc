"""Weight files of convolutional networks: a header of five 32-bit integers, then 32-bit floats layer by layer."""

from __future__ import annotations

import struct

import numpy as np

HEADER = struct.Struct("<5i")


def layers(blocks: list[dict[str, str]]) -> list[tuple[int, bool, int, int, int]]:
    """(place among the blocks after the first, normalised, filters, channels in, kernel size) of each convolution.

    A route's channels are those of the layers it names together; a shortcut and everything else keep what came before.
    """
    channels, out = [int(blocks[0].get("channels", 3))], []
    for i, b in enumerate(blocks[1:]):
        now = channels[-1]
        if b["type"] == "convolutional":
            filters, size = int(b["filters"]), int(b["size"])
            out.append((i, b.get("batch_normalize", "0") != "0", filters, now, size))
            now = filters
        elif b["type"] == "route":
            named = [int(x) for x in b["layers"].split(",")]
            now = sum(channels[x + 1 if x >= 0 else len(channels) + x] for x in named)
        channels.append(now)
    return out


def load(blocks: list[dict[str, str]], data: bytes, cutoff: int | None = None) -> tuple[tuple[int, ...], dict[int, dict[str, np.ndarray]]]:
    """The header, and arrays by layer: bias, and for normalised layers scale, mean and variance, then the kernels. With `cutoff` only blocks before it."""
    header = HEADER.unpack_from(data)
    values, at = np.frombuffer(data, "<f4", offset=HEADER.size), 0
    out: dict[int, dict[str, np.ndarray]] = {}
    for place, normalised, filters, channels, size in layers(blocks):
        if cutoff is not None and place >= cutoff:
            break
        own = {}
        for name in ("bias", "scale", "mean", "variance") if normalised else ("bias",):
            own[name] = values[at : at + filters]
            at += filters
        n = filters * channels * size * size
        own["kernel"] = values[at : at + n].reshape(filters, channels, size, size)
        at += n
        out[place] = own
    return header, out


def save(header: tuple[int, ...], arrays: dict[int, dict[str, np.ndarray]]) -> bytes:
    return HEADER.pack(*header) + b"".join(a.astype("<f4").tobytes() for place in sorted(arrays) for a in arrays[place].values())
