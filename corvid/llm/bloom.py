"""A log-frequency Bloom filter: as many bits for an entry at any size.

A key of level q is entered q times, as (key, 1) to (key, q); its level is found by asking upwards from 1 until an entry is
missing. With all levels 1 it is a plain Bloom filter. Keys are 64-bit hashes; a key's segment is its low bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from corvid.llm.common import mix

#: Bits for one entry, probes of one entry, segments; levels are below the last.
ENTRY_BITS, PROBES, SEGMENTS, MOST_LEVELS = 12, 5, 4096, 256


@dataclass(frozen=True)
class Filter:
    bits: np.ndarray
    segment: int

    def entered(self, keys: np.ndarray, q: int = 1) -> np.ndarray:
        """Which keys have an entry of level q, as positions."""
        alive = np.arange(len(keys))
        base = keys % np.uint64(SEGMENTS) * np.uint64(self.segment)
        first, second = _hashes(keys, q)
        with np.errstate(over="ignore"):
            for i in range(PROBES):
                at = base[alive] + (first[alive] + np.uint64(i) * second[alive]) % np.uint64(self.segment)
                alive = alive[self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
                if not len(alive):
                    break
        return alive

    def levels(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.int64)
        alive = np.arange(len(keys))
        q = 1
        while len(alive) and q < MOST_LEVELS:
            alive = alive[self.entered(keys[alive], q)]
            out[alive] = q
            q += 1
        return out


def _hashes(keys: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    return mix(keys, 100 + q), mix(keys, 5000 + q) | np.uint64(1)


def of(keys: np.ndarray, levels: np.ndarray) -> Filter:
    """The filter of keys and levels in memory, ENTRY_BITS bits an entry however many there are."""
    segment = int(max(2048, -(-int(levels.sum()) * ENTRY_BITS // SEGMENTS // 64) * 64))
    bits = np.zeros(SEGMENTS * segment, bool)
    for q in range(1, int(levels.max(initial=0)) + 1):
        keys, levels = keys[levels >= q], levels[levels >= q]
        base = keys % np.uint64(SEGMENTS) * np.uint64(segment)
        first, second = _hashes(keys, q)
        with np.errstate(over="ignore"):
            for i in range(PROBES):
                bits[(base + (first + np.uint64(i) * second) % np.uint64(segment)).astype(np.int64)] = True
    return Filter(np.packbits(bits, bitorder="little"), segment)
