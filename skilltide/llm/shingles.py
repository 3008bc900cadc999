"""Hashed words and word shingles of a text, in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
PART = 1 << 20
MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15
_rng = np.random.default_rng(20240607)
OF_BYTE = _rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
OF_PLACE = _rng.integers(1, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread each bit of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and their inverses."""
    if len(_powers.get("up", ())) < size:
        length = max(1 << 16, 1 << (size - 1).bit_length())
        for name, factor in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(length, factor, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"][:size], _powers["down"][:size]


def pieces(raw: bytes, size: int = PART) -> Iterator[bytes]:
    """Parts of at most about ``size`` bytes, cut where white space is (a longer word stays whole)."""
    at = 0
    while len(raw) - at > size:
        end = at + size
        while end < len(raw) and not SPACE[raw[end]]:
            end += 1
        yield raw[at:end]
        at = end
    yield raw[at:]


def word_hashes(raw: bytes) -> np.ndarray:
    """One 64-bit hash for each word, in order."""
    out = []
    for part in pieces(raw):
        codes = np.frombuffer(part, np.uint8)
        inside = ~SPACE[codes]
        edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        if not len(edge):
            continue
        up, down = powers(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(OF_BYTE[codes] * up, out=sums[1:])
        starts, ends = edge[::2], edge[1::2]
        out.append(mixed((sums[ends] - sums[starts]) * down[starts]))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """The different shingles of ``width`` words in ascending order of their hash; a text of fewer
    words is one shingle, one without words has none. A-Z count as a-z."""
    words = word_hashes((text or "").encode().translate(LOWER))
    size = min(width, len(words))
    if not size:
        return words
    sums = np.zeros(len(words) - size + 1, np.uint64)
    for i in range(size):
        sums += words[i:len(words) - size + 1 + i] * OF_PLACE[i]
    return np.unique(mixed(sums + OF_PLACE[32 + size]))
