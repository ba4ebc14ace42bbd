"""Words of whole texts as 64-bit hashes, computed over the bytes of an Arrow batch with numpy.

A word is a run of bytes other than space and \\t \\n \\v \\f \\r; A-Z are lower-cased, all other bytes count as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_STATE: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (the splitmix finaliser)."""
    x = x + _GOLDEN  # a copy, which is changed in place from here on
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values() -> np.ndarray:
    """One random 64-bit number for each byte; A-Z share those of a-z."""
    if "bytes" not in _STATE:
        values = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019))
        values[65:91] = values[97:123]
        _STATE["bytes"] = values
    return _STATE["bytes"]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64."""
    if "powers" not in _STATE or len(_STATE["powers"]) < n:
        size = max(n, 1 << 20)
        for name, base in (("powers", _BASE), ("inverse", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _STATE[name] = np.cumprod(steps, dtype=np.uint64)
    return _STATE["powers"][:n], _STATE["inverse"][:n]


def forget() -> None:
    """Drop the powers, which take 16 bytes for each byte of the largest text slice so far; they are made again when asked for."""
    for name in ("powers", "inverse"):
        _STATE.pop(name, None)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column behind each other, and each row's bounds in them; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(column) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0] if len(column) else np.zeros(1, np.int64)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the bounds of its words among all."""
    inside = ~_BLANK[data]
    before = np.empty(len(data), bool)
    after = np.empty(len(data), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edges = offsets[(offsets < len(data))]
    before[edges] = False
    after[edges[edges > 0] - 1] = False
    if len(data):
        before[0] = after[-1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word in order, and for each row the bounds of its words among all."""
    data, offsets = text_bytes(column)
    starts, ends, bounds = word_spans(data, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), bounds
    power, inverse = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(byte_values()[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts]), bounds


def shingle_sets(column: pa.Array, width: int = 5) -> list[np.ndarray]:
    """For each row the sorted distinct hashes of its `width`-word shingles; fewer words make one shingle, none an empty set."""
    words, bounds = word_hashes(column)
    factors = powers(width + 1)[0][1:]
    rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        rolled += words[k : len(words) - width + 1 + k] * factors[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= width:
            one = np.sort(rolled[a : b - width + 1])
            keep = np.empty(len(one), bool)
            keep[0] = True
            np.not_equal(one[1:], one[:-1], out=keep[1:])
            out.append(one[keep])
        elif b > a:
            out.append(mix(np.sum(words[a:b] * factors[: b - a], keepdims=True, dtype=np.uint64) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
