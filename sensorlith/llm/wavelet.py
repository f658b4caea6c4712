"""A wavelet matrix of token ids in one compressed file.

The ids of a shard are stored bit by bit, the highest first. Each plane has the bits of all ids in the order that the
planes above give: ids with bit 0 first, then those with bit 1, each in the order they had. Counts of the ones before
every ``RANK_BITS`` bits make ``rank`` quick, and with it access to one id, counting and finding an id in a range
without decoding the rest. Planes are cut into blocks that are compressed where that makes them smaller; a directory says
where each block is, so a reader fetches only the blocks that it looks into.

File: magic, length of the header (4 bytes, little endian), header (JSON), then the sections that it lists.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import zstandard

MAGIC = b"SLTOKWM1"
RANK_BITS = 4096
BLOCK_BYTES = 1 << 16


def _pack(data: bytes) -> tuple[bytes, bool]:
    small = zstandard.ZstdCompressor(level=1).compress(data)
    return (small, True) if len(small) < len(data) * 0.97 else (data, False)


def planes(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """The bits of each plane, the highest first."""
    out = []
    for level in range(bits - 1, -1, -1):
        one = (ids & ids.dtype.type(1 << level)).astype(bool)
        out.append(one)
        ids = np.concatenate([ids.take(np.flatnonzero(~one)), ids.take(np.flatnonzero(one))])  # quicker than masks
    return out


def build(ids: np.ndarray, doc_ids: np.ndarray, first: np.ndarray) -> bytes:
    """A file of the documents' ids, one after another; ``first`` has where each document begins, and the end."""
    ids = ids.astype(np.uint16 if not len(ids) or ids.max() < 1 << 16 else np.uint32, copy=False)
    bits = max(1, int(ids.max(initial=0)).bit_length())
    body, sections, at = [], {}, 0

    def add(data: bytes) -> list:
        nonlocal at
        packed, squeezed = _pack(data)
        body.append(packed)
        at += len(packed)
        return [at - len(packed), len(packed), squeezed]

    sections["doc_ids"] = add(doc_ids.astype("<i8").tobytes())
    sections["first"] = add(np.diff(first, prepend=0).astype("<u4").tobytes())
    sections["planes"], sections["ranks"], sections["zeros"] = [], [], []
    for one in planes(ids, bits):
        packed = np.packbits(one, bitorder="little").tobytes()
        sections["planes"].append([add(packed[a : a + BLOCK_BYTES]) for a in range(0, len(packed), BLOCK_BYTES)])
        per = np.array([np.count_nonzero(one[a : a + RANK_BITS]) for a in range(0, len(one), RANK_BITS)], np.int64)
        sections["ranks"].append(add(np.concatenate([[0], np.cumsum(per)]).astype("<u4").tobytes()))
        sections["zeros"].append(int(len(one) - per.sum()))
    header = json.dumps({"n": len(ids), "bits": bits, "documents": len(doc_ids), **sections}).encode()
    return b"".join([MAGIC, len(header).to_bytes(4, "little"), header, *body])


class Shard:
    """A reader; ``file`` has ``seek`` and ``read``."""

    def __init__(self, file) -> None:
        self.file = file
        start = self._raw(0, len(MAGIC) + 4)
        if start[: len(MAGIC)] != MAGIC:
            raise ValueError("not a token shard")
        size = int.from_bytes(start[len(MAGIC) :], "little")
        self.header = json.loads(self._raw(len(start), size))
        self.base = len(start) + size
        self.n, self.bits = self.header["n"], self.header["bits"]
        self.zeros = self.header["zeros"]
        self.block = lru_cache(maxsize=64)(self._block)
        self.ranks = lru_cache(maxsize=None)(lambda level: np.frombuffer(self._section(self.header["ranks"][level]), "<u4"))

    def _raw(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        return self.file.read(size)

    def _section(self, place: list) -> bytes:
        at, size, squeezed = place
        data = self._raw(self.base + at, size)
        return zstandard.ZstdDecompressor().decompress(data) if squeezed else data

    def _block(self, level: int, number: int) -> np.ndarray:
        return np.frombuffer(self._section(self.header["planes"][level][number]), np.uint8)

    @property
    def doc_ids(self) -> np.ndarray:
        return np.frombuffer(self._section(self.header["doc_ids"]), "<i8")

    @property
    def first(self) -> np.ndarray:
        return np.cumsum(np.frombuffer(self._section(self.header["first"]), "<u4"), dtype=np.int64)

    def bit(self, level: int, i: int) -> int:
        return int(self.block(level, i // 8 // BLOCK_BYTES)[i // 8 % BLOCK_BYTES]) >> (i % 8) & 1

    def rank(self, level: int, i: int) -> int:
        """Ones before place ``i`` of a plane."""
        start = i // RANK_BITS * RANK_BITS
        ones = int(self.ranks(level)[i // RANK_BITS])
        if i > start:  # rank samples divide blocks evenly
            block = self.block(level, start // 8 // BLOCK_BYTES)
            low = start // 8 % BLOCK_BYTES
            ones += int(np.unpackbits(block[low : low + (i - start + 7) // 8], count=i - start, bitorder="little").sum())
        return ones

    def select(self, level: int, one: int, k: int) -> int:
        """Place of the ``k``-th (from 0) one, or zero, of a plane."""
        low, high = 0, self.n - 1
        while low < high:
            middle = (low + high) // 2
            ones = self.rank(level, middle + 1)
            if (ones if one else middle + 1 - ones) > k:
                high = middle
            else:
                low = middle + 1
        return low

    def access(self, i: int) -> int:
        """The id at place ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for level in range(self.bits):
            one, ones = self.bit(level, i), self.rank(level, i)
            value = value << 1 | one
            i = self.zeros[level] + ones if one else i - ones
        return value

    def _narrow(self, token: int, low: int, high: int) -> tuple[int, int]:
        for level in range(self.bits):
            a, b = self.rank(level, low), self.rank(level, high)
            low, high = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (low - a, high - b)
        return low, high

    def count(self, token: int, low: int = 0, high: int | None = None) -> int:
        """How often an id occurs from place ``low`` to before ``high``."""
        if token < 0 or token >> self.bits:
            return 0
        a, b = self._narrow(token, low, self.n if high is None else high)
        return b - a

    def locate(self, token: int, k: int) -> int:
        """Place of the ``k``-th (from 0) occurrence of an id."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        i = self._narrow(token, 0, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            i = self.select(level, one, i - self.zeros[level] if one else i)
        return i

    def all(self) -> np.ndarray:
        """All ids, from the lowest plane back to the order of the documents."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        out = np.zeros(self.n, kind)
        for level in range(self.bits - 1, -1, -1):
            packed = np.concatenate([np.zeros(0, np.uint8), *(self._block(level, k) for k in range(len(self.header["planes"][level])))])
            one = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            ids, zeros = np.empty_like(out), self.zeros[level]
            ids[np.flatnonzero(~one)] = out[:zeros]
            ids[np.flatnonzero(one)] = out[zeros:] | kind(1 << (self.bits - 1 - level))
            out = ids
        return out
