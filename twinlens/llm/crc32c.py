"""CRC-32C (Castagnoli) of many byte strings at once, with NumPy (a task's helper).

A checksum is linear over GF(2), so every string is cut into blocks of 256 bytes
(zeros in front change nothing once the start value is folded into the first four
bytes), all blocks are summed side by side four bytes a step, and the blocks of a
string are joined pairwise: shift the left one past the right one and add.
"""

from __future__ import annotations

import numpy as np

POLYNOMIAL = 0x82F63B78         # fixed value: the reflected Castagnoli polynomial
MASK_DELTA = 0xA282EAD8         # fixed value: the masking constant of the public record format
BLOCK = 256


def _byte_step(r: np.ndarray) -> np.ndarray:
    for _ in range(8):
        r = (r >> np.uint32(1)) ^ np.where(r & np.uint32(1), np.uint32(POLYNOMIAL), np.uint32(0))
    return r


class _Shift:
    """Moves a register past a fixed number of zero bytes, by two 16-bit tables."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high

    def __call__(self, r: np.ndarray) -> np.ndarray:
        return self.low[r & np.uint32(0xFFFF)] ^ self.high[r >> np.uint32(16)]

    def doubled(self) -> _Shift:
        return _Shift(self(self.low), self(self.high))


def _four_bytes() -> _Shift:
    low = np.arange(1 << 16, dtype=np.uint32)
    high = low << np.uint32(16)
    for _ in range(4):
        low, high = _byte_step(low), _byte_step(high)
    return _Shift(low, high)


_shifts: list[_Shift] = []      # past 4, 8, 16, ... bytes


def _shift(power: int) -> _Shift:
    if not _shifts:
        _shifts.append(_four_bytes())
    while len(_shifts) <= power:
        _shifts.append(_shifts[-1].doubled())
    return _shifts[power]


def _slow(data: bytes) -> int:
    r = 0xFFFFFFFF
    for b in data:
        r ^= b
        for _ in range(8):
            r = (r >> 1) ^ (POLYNOMIAL if r & 1 else 0)
    return r ^ 0xFFFFFFFF


def crc32c(buf: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Checksums (uint32) of the strings ``buf[start : start + size]``."""
    start, size = np.asarray(start, dtype=np.int64), np.asarray(size, dtype=np.int64)
    out = np.zeros(len(start), dtype=np.uint32)
    for k in np.flatnonzero(size < 4):
        out[k] = _slow(buf[start[k]:start[k] + size[k]].tobytes())
    long = np.flatnonzero(size >= 4)
    if not len(long):
        return out
    start, size = start[long], size[long]
    blocks = -(-size // BLOCK)
    ends = np.cumsum(blocks) * BLOCK
    padded = np.zeros(int(ends[-1]), dtype=np.uint8)
    for a, n, e in zip(start.tolist(), size.tolist(), ends.tolist(), strict=True):
        padded[e - n:e] = buf[a:a + n]
    for j in range(4):
        padded[ends - size + j] ^= np.uint8(0xFF)
    columns = np.ascontiguousarray(padded.view("<u4").reshape(-1, BLOCK // 4).T)
    step, r = _shift(0), np.zeros(columns.shape[1], dtype=np.uint32)
    for word in columns:
        r = step(r ^ word)
    power = BLOCK.bit_length() - 3                        # the shift past one block
    while len(r) > len(long):
        place = np.repeat(np.cumsum(blocks), blocks) - 1 - np.arange(len(r))      # from its string's end
        halved = (blocks + 1) // 2
        into = np.repeat(np.cumsum(halved), blocks) - 1 - place // 2
        joined, blocks = np.zeros(int(halved.sum()), dtype=np.uint32), halved
        right = place % 2 == 0
        joined[into[right]] = r[right]
        joined[into[~right]] ^= _shift(power)(r[~right])
        r, power = joined, power + 1
    out[long] = r ^ np.uint32(0xFFFFFFFF)
    return out


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotated by 15 bits plus a constant, so that a checksum of data that holds
    checksums stays telling."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)
