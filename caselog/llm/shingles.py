"""64-bit hashes of words and of runs of words, the same in every process."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from xxhash import xxh3_64_intdigest

from caselog.llm.common import worker_cache

#: Words whose hash a worker keeps before it starts anew (about 17 MB).
CACHE_WORDS = 100_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxh3_64_intdigest(word)
        return value


_known = _Hashes()


def _drop() -> bool:
    some = bool(_known)
    _known.clear()
    return some


worker_cache("word hashes", _drop)


def word_hashes(words: list[bytes]) -> np.ndarray:
    if len(_known) > CACHE_WORDS:
        _known.clear()
    return np.fromiter(map(_known.__getitem__, words), np.uint64, len(words))


@lru_cache
def _factors(k: int) -> np.ndarray:
    """Odd factors for the words of a run, one set for every length."""
    return np.array([xxh3_64_intdigest(f"{k}/{j}") | 1 for j in range(k)], np.uint64)


def run_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every run of ``k`` consecutive words."""
    n = max(0, len(hashes) - k + 1)
    total = np.zeros(n, np.uint64)
    for j, factor in enumerate(_factors(k)):
        total += hashes[j:j + n] * factor
    total ^= total >> np.uint64(31)
    total *= np.uint64(0x9E3779B97F4A7C15)
    return total ^ (total >> np.uint64(29))
