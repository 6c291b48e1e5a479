"""Hashes of character n-grams of many words at once."""

from __future__ import annotations

import numpy as np

_C = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(27))


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, one after the other, and each text's length."""
    joined = "".join(texts)
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64), np.array([len(t) for t in texts], np.int64)


#: One odd multiplier for each place of an n-gram.
_PLACES = np.array([mix(np.array([k], np.uint64) * _C + _C)[0] | np.uint64(1) for k in range(64)], np.uint64)


def _seal(total: np.ndarray, seed: np.ndarray, size: np.ndarray) -> np.ndarray:
    return mix(mix(total + seed) + size.astype(np.uint64) * _C)


def keys(seed: np.ndarray, codes: np.ndarray, end: np.ndarray, size: np.ndarray, longest: int) -> np.ndarray:
    """Hashes of the n-grams of ``size`` (at most ``longest``) code points that end before ``end``."""
    total = np.zeros(len(end), np.uint64)
    for back in range(1, longest + 1):
        total += np.where(back <= size, codes[np.maximum(end - back, 0)] * _PLACES[back], np.uint64(0))
    return _seal(total, seed, size)


def window_keys(seed: np.ndarray, codes: np.ndarray, longest: int) -> np.ndarray:
    """As ``keys``, for the n-gram of ``longest`` code points that ends with each code point; the first ``longest`` - 1 have none (0)."""
    out = np.zeros(len(codes), np.uint64)
    n = len(codes) - longest + 1
    if n > 0:
        total = codes[longest - 1 :] * _PLACES[1]
        for back in range(2, longest + 1):
            total += codes[longest - back : longest - back + n] * _PLACES[back]
        out[longest - 1 :] = _seal(total, seed[longest - 1 :], np.array([longest]))
    return out


def find(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each wanted key, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted
