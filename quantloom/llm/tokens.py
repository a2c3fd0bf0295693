"""Hashes of the tokens of many texts at once, by array operations on their UTF-8 bytes."""

from __future__ import annotations

import numpy as np

_RNG = np.random.default_rng(20240229)
#: A random odd value for each byte, and the base of the rolling sum and its inverse modulo 2**64.
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    while len(_POWERS["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            own = _POWERS[name]
            _POWERS[name] = np.concatenate([own, own * np.uint64(pow(base, len(own), 1 << 64))])
    return _POWERS["up"][:n], _POWERS["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values over all bits, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


#: Bytes that are hashed at once (more where a token is longer): what bounds the memory taken.
CHUNK = 1 << 18


def slices(texts: list, limit: int = 1 << 20):
    """(begin, end) of consecutive texts of about ``limit`` bytes or characters together, one at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t) > limit:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if texts:
        yield begin, len(texts)


def token_hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, first byte's place) of every maximal run of bytes that are ``inside``."""
    hashes, starts, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
    while at < len(raw):
        to = min(at + CHUNK, len(raw))
        while to < len(raw) and inside[to]:
            ahead = inside[to : to + CHUNK]
            gap = int(ahead.argmin())
            to += gap if not ahead[gap] else len(ahead)
        h, start = _hashes(raw[at:to], inside[at:to])
        hashes.append(h)
        starts.append(start + at)
        at = to
    return np.concatenate(hashes), np.concatenate(starts)


def _hashes(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    padded = np.concatenate([[False], inside, [False]])
    edge = np.flatnonzero(padded[1:] != padded[:-1])
    start, stop = edge[::2], edge[1::2]
    up, down = _powers(len(raw) + 1)
    rolling = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUE[raw] * up[: len(raw)], out=rolling[1:])
    return mix((rolling[stop] - rolling[start]) * down[start] + (stop - start).astype(np.uint64)), start
