"""Words of texts as small integers, block by block, for exact counts inside a task."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 16 << 20
_SLICE = 4 << 20


class Vocabulary:
    """Numbers words in the order in which a block meets them."""

    def __init__(self):
        self._codes: dict[bytes, int] = defaultdict()
        self._codes.default_factory = self._codes.__len__

    def __len__(self) -> int:
        return len(self._codes)

    def code(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self._codes.__getitem__, words), np.int64, len(words))

    def words(self, start: int = 0) -> list[bytes]:
        return list(self._codes)[start:]

    def array(self) -> pa.Array:
        return pa.array(list(self._codes), pa.binary())


def slices(raw: bytes, blank: bytes = b" ", size: int = 1 << 40) -> Iterator[bytes]:
    """Cut a text that is long into parts at blanks; no word is cut."""
    lo, size = 0, min(size, _SLICE)
    while len(raw) - lo > size:
        at = raw.rfind(blank, lo, lo + size)
        if at < 0:
            at = raw.find(blank, lo + size)
        if at < 0:
            break
        yield raw[lo:at + 1]
        lo = at + 1
    yield raw[lo:] if lo else raw


def added(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sums of 64-bit values for each."""
    if not len(key):
        return key, *values
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[first], *(np.add.reduceat(v[order], first) for v in values)
