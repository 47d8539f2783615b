"""Word shingles and their hashes, as near-duplicate operators take them."""

from __future__ import annotations

from itertools import repeat

import numpy as np
from xxhash import xxh64_intdigest

BITS = 64


def hashes(data: bytes | None, k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; a text of fewer words is one shingle, one without words none."""
    words = data.lower().split() if data else []  # both act on ASCII only
    if not words:
        return np.empty(0, np.uint64)
    grams = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) >= k else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, grams, repeat(42)), np.uint64, max(1, len(words) - k + 1))


def fingerprint(h: np.ndarray) -> int:
    """SimHash as a signed number: a bit is 1 if it is set in over half the hashes."""
    votes = np.zeros(BITS, np.int64)
    for low in range(0, h.size, 8192):
        votes += np.unpackbits(h[low : low + 8192].view(np.uint8)).reshape(-1, BITS).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * votes > h.size).view(np.int64)[0])
