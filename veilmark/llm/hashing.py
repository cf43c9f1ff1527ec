"""Hashes of bytes, words and shingles with numpy, alike in every process."""

from __future__ import annotations

import re

import numpy as np

SPACE = re.compile(rb"[\x20\x09-\x0d]")
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_RANDOM = np.random.default_rng(20_240_601)
BYTE = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # of each byte value
BASE = int(_RANDOM.integers(1, 1 << 62)) * 4 + 1
_INVERSE = pow(BASE, -1, 1 << 64)
_PLACE = _RANDOM.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PART = 1 << 20
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1) modulo 2 ** 64."""
    have = _powers.get(base)
    if have is None or have.size < n:
        size = 1 << max(12, n - 1).bit_length()
        have = np.full(size, base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        _powers[base] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums from which :func:`window_hashes` reads the hash of any window."""
    out = np.zeros(data.size + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(BASE, data.size), out=out[1:])
    return out


def window_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of bytes [start, end) for each pair, the same for equal bytes wherever they stand."""
    return mixed((sums[ends] - sums[starts]) * powers(_INVERSE, sums.size)[starts] + (ends - starts).astype(np.uint64))


def word_hashes(text: bytes) -> np.ndarray:
    """Hash of each word, words being runs of bytes that are not ASCII white space."""
    out, at = [], 0
    while at < len(text):
        end = len(text)
        if end - at > PART:
            cut = SPACE.search(text, at + PART)
            end = cut.start() if cut else end
        data = np.frombuffer(text, np.uint8, end - at, at)
        word = np.zeros(data.size + 2, np.int8)
        word[1:-1] = ~_IS_SPACE[data]
        step = np.diff(word)
        starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        if starts.size:
            out.append(window_hashes(prefix_sums(data), starts, ends))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes | None, words: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ``words`` words, ASCII case ignored; a shorter text is one shingle."""
    word = word_hashes((text or b"").lower())
    n = min(words, word.size)
    if not n:
        return word
    total = np.full(word.size - n + 1, _PLACE[32 + n], np.uint64)
    for k in range(n):
        total += word[k:word.size - n + 1 + k] * _PLACE[k]
    return np.unique(mixed(total))
