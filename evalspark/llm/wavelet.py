"""A wavelet matrix over token ids: succinct bit planes with rank and select."""

from __future__ import annotations

import numpy as np

BLOCK = 512  # bits between two stored ranks


class WaveletMatrix:
    """``bits`` planes of ``n`` bits. Plane by plane, ids with a zero bit move stably before those with a one.

    Stored per plane: the packed bits, the number of ones before every 512th
    bit, and the number of zeros. An empty sequence has empty planes.
    """

    def __init__(self, n: int, planes: list[bytes], ranks: list[bytes], zeros: list[int]):
        self.n, self.zeros = n, zeros
        self.planes = [np.frombuffer(p, np.uint8) for p in planes]
        self.ranks = [np.frombuffer(r, np.uint32) for r in ranks]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        if len(ids) and int(ids.max()) >> bits:
            raise ValueError("an id needs more planes")
        values = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        planes, ranks, zeros = [], [], []
        for bit in range(bits - 1, -1, -1):
            ones = (values >> values.dtype.type(bit)) & values.dtype.type(1) != 0
            packed = np.packbits(ones)
            padded = np.zeros(-(-len(packed) * 8 // BLOCK) * BLOCK // 8, np.uint8)
            padded[: len(packed)] = packed
            counts = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            planes.append(packed.tobytes())
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32).tobytes())
            low = values[~ones]
            zeros.append(len(low))
            values = np.concatenate([low, values[ones]])
        return cls(len(ids), planes, ranks, zeros)

    def parts(self) -> tuple[int, list[bytes], list[bytes], list[int]]:
        return self.n, [p.tobytes() for p in self.planes], [r.tobytes() for r in self.ranks], self.zeros

    def _ones(self, plane: int, i: int) -> int:
        """The ones among the first ``i`` bits of a plane."""
        block = i // BLOCK
        total, begin = int(self.ranks[plane][block]), block * BLOCK // 8
        total += int(np.bitwise_count(self.planes[plane][begin: i // 8]).sum())
        return total + ((int(self.planes[plane][i // 8]) >> (8 - i % 8)).bit_count() if i % 8 else 0)

    def _bit(self, plane: int, i: int) -> int:
        return int(self.planes[plane][i // 8]) >> (7 - i % 8) & 1

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for plane in range(len(self.planes)):
            bit, ones = self._bit(plane, i), self._ones(plane, i)
            i = self.zeros[plane] + ones if bit else i - ones
            value = value << 1 | bit
        return value

    def rank(self, token: int, i: int) -> int:
        """How often ``token`` stands before place ``i``."""
        begin, end = self._range(token, i)
        return end - begin

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences before ``i`` lie after the last plane."""
        if token >> len(self.planes):
            return 0, 0
        begin, end = 0, i
        for plane in range(len(self.planes)):
            a, b = self._ones(plane, begin), self._ones(plane, end)
            if token >> (len(self.planes) - 1 - plane) & 1:
                begin, end = self.zeros[plane] + a, self.zeros[plane] + b
            else:
                begin, end = begin - a, end - b
        return begin, end

    def select(self, token: int, k: int) -> int:
        """The place of the ``k``-th occurrence of ``token``, from 0."""
        begin, end = self._range(token, self.n)
        if not 0 <= k < end - begin:
            raise IndexError(k)
        place = begin + k
        for plane in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - plane) & 1
            want = place - self.zeros[plane] if one else place
            place = self._find(plane, want, bool(one))
        return place

    def _find(self, plane: int, k: int, one: bool) -> int:
        """The place of the ``k``-th one (or zero) of a plane."""
        low, high = 0, self.n - 1
        while low < high:
            middle = (low + high) // 2
            ones = self._ones(plane, middle + 1)
            if (ones if one else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def decode(self) -> np.ndarray:
        """All ids, by undoing the moves from the last plane up."""
        bits = len(self.planes)
        values = np.zeros(self.n, np.uint16 if bits <= 16 else np.uint32)
        for plane in range(bits - 1, -1, -1):
            ones = np.unpackbits(self.planes[plane], count=self.n).view(bool)
            above = np.empty_like(values)
            above[~ones] = values[: self.zeros[plane]]
            above[ones] = values[self.zeros[plane]:] | values.dtype.type(1 << (bits - 1 - plane))
            values = above
        return values
