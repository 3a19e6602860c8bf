"""CRC-32 of joined strings from the CRCs and lengths of their parts, for whole arrays at once."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Fixed value: the polynomial of CRC-32, bits reflected.
POLYNOMIAL = 0xEDB88320
#: Lengths up to 2^48 bytes.
STEPS = 48


def _applied(step: np.ndarray, crc: np.ndarray) -> np.ndarray:
    """A linear map, given by what it makes of each value of each of the four bytes."""
    return step[0][crc & 255] ^ step[1][(crc >> 8) & 255] ^ step[2][(crc >> 16) & 255] ^ step[3][crc >> 24]


@lru_cache(maxsize=1)
def _steps() -> list[np.ndarray]:
    """What 1, 2, 4, 8 ... zero bytes after a string make of its CRC."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(POLYNOMIAL), one >> 1)
    values = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    steps = [np.stack([one[v & 255] ^ (v >> 8) for v in values])]
    while len(steps) < STEPS:
        steps.append(np.stack([_applied(steps[-1], row) for row in steps[-1]]))
    return steps


def joined(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs of a + b from those of a (first) and b (second) and the bytes of b (length)."""
    crc, length = np.array(first, np.uint32), np.asarray(length, np.int64)
    for k, step in enumerate(_steps()):
        if not (length >> k).any():
            break
        own = (length >> k) & 1 == 1
        crc[own] = _applied(step, crc[own])
    return crc ^ np.asarray(second, np.uint32)
