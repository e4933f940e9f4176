"""A minimal perfect hash of distinct 64-bit keys, built and asked in whole arrays.

Each level hashes the keys that are left into a bit array half as large again; keys that are alone on their bit stay there,
the others go down a level. A key's index is the number of set bits before its own. That is about three bits a key. Keys
that were never given get the index of another key or none, so whoever asks compares the key that is stored at the index.
"""

from __future__ import annotations

import numpy as np

_ODD, _ONE, _TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit numbers for each seed."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(seed + 1) * _ODD
        x = (x ^ (x >> np.uint64(30))) * _ONE
        x = (x ^ (x >> np.uint64(27))) * _TWO
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """index(keys) of the distinct keys given to build() is a permutation of 0 ... n - 1."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray) -> None:
        self.sizes, self.words = sizes, words
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        left, sizes, bits = keys.astype(np.uint64), [], []
        while len(left):
            size = -(-3 * len(left) // 128) * 64
            place = (mixed(left, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[place]]
        return cls(np.array(sizes, np.int64), np.concatenate(bits) if bits else np.empty(0, np.uint64))

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The index of each key; -1 for a key that no level holds."""
        out = np.full(len(keys), -1, np.int64)
        asked, first = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            if not len(asked):
                break
            place = (mixed(keys[asked], level) % np.uint64(size)).astype(np.int64) + first
            word, bit = self.words[place >> 6], (place & 63).astype(np.uint64)
            here = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1)))
            out[asked[here]] = self.before[place[here] >> 6] + below[here]
            asked = asked[~here]
            first += size
        return out

    def dump(self) -> bytes:
        return np.concatenate([[len(self.sizes)], self.sizes, self.words.view(np.int64)]).astype("<i8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> PerfectHash:
        all_ = np.frombuffer(data, "<i8")
        n = int(all_[0])
        return cls(all_[1 : n + 1], all_[n + 1 :].view(np.uint64))
