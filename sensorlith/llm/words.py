"""Words and word sequences of whole texts as arrays of 64-bit hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D. Texts are hashed in blocks that
end at white space, so that the arrays of a very long text stay small while they are made.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK = 1 << 20
_RADIX = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the result."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the radix and of its inverse modulo 2**64."""
    up, down = (np.full(size, r, np.uint64) for r in (_RADIX, pow(_RADIX, -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


@cache
def _bytes_table(lane: int, lower: bool) -> np.ndarray:
    table = mix(np.arange(1, 257, dtype=np.uint64) + np.uint64(lane << 20))
    if lower:
        table[0x41:0x5B] = table[0x61:0x7B]
    return table


class Words:
    """The words of a batch of texts: ``hashes``, ``starts`` and ``ends`` (bytes in ``data``), and
    ``first``: the number of the first word of each text, with one entry more than texts."""

    def __init__(self, texts: list[bytes], lane: int = 0, lower: bool = False) -> None:
        self.data = b"\n".join([*texts, b""]) or b"\n"
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        parts = list(_blocks(self.data, lane, lower))
        self.starts, self.ends, self.hashes = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.uint64 if i == 2 else np.int64) for i in range(3))
        self.first = np.searchsorted(self.starts, self.offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)


def _blocks(data: bytes, lane: int, lower: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    whole, at, table = np.frombuffer(data, np.uint8), 0, _bytes_table(lane, lower)
    while at < len(whole):
        end = min(len(whole), at + BLOCK)
        while end < len(whole) and not _SPACE[whole[end - 1]]:
            end = min(len(whole), end + BLOCK) if not _SPACE[whole[end : end + BLOCK]].any() else end + int(np.argmax(_SPACE[whole[end : end + BLOCK]])) + 1
        block = whole[at:end]
        solid = np.zeros(len(block) + 2, bool)
        np.logical_not(_SPACE[block], out=solid[1:-1])
        edges = np.flatnonzero(solid[1:] != solid[:-1])
        starts, ends = edges[0::2], edges[1::2]
        up, down = _powers(1 << max(20, int(len(block)).bit_length()))
        sums = np.zeros(len(block) + 1, np.uint64)
        np.cumsum(table[block] * up[: len(block)], out=sums[1:])
        yield starts + at, ends + at, mix((sums[ends] - sums[starts]) * down[starts])
        at = end


def sequences(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of the ``length`` words from each word on; the last ``length - 1`` words start none."""
    if len(hashes) < length:
        return np.zeros(0, np.uint64)
    if length == 1:
        return mix(hashes)

    def power(k: int) -> np.uint64:
        return np.uint64(pow(_RADIX, k, 1 << 64))

    total, covered, piece, span = None, 0, hashes, 1
    while True:  # binary digits of the length: piece covers span words
        if length & span:
            total = piece if total is None else total[: len(piece) - covered] + power(covered) * piece[covered:]
            covered += span
        if span * 2 > length:
            break
        piece = piece[:-span] + power(span) * piece[span:]
        span *= 2
    return mix(total[: len(hashes) - length + 1])


def starts_within(words: Words, length: int) -> np.ndarray:
    """Numbers of the words from which ``length`` words of the same text go on."""
    n = len(words) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    last = np.repeat(words.first[1:], words.counts)[:n]
    return np.flatnonzero(np.arange(n) + length <= last)


def shingles(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of all distinct word sequences of each text, sorted by both. A text of
    fewer words has its whole sequence as one; a text without words has none."""
    at = starts_within(words, length)
    owner, value = [words.text_of[at]], [sequences(words.hashes, length)[at]]
    counts = words.counts
    for n in range(1, length):
        short = np.flatnonzero(counts == n)
        if len(short):
            owner.append(short)
            value.append(mix(sequences(words.hashes, n)[words.first[short]] + np.uint64(n)))
    owner, value = np.concatenate(owner), np.concatenate(value)
    order = np.argsort(owner, kind="stable")
    owner, value = owner[order], value[order]
    bounds = np.searchsorted(owner, np.arange(len(counts) + 1)).tolist()
    for a, b in zip(bounds, bounds[1:]):
        value[a:b].sort()
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts have about ``limit`` bytes, or one longer text."""
    if not batch.num_rows:
        return
    sizes = np.fromiter((len(x) if x else 0 for x in batch.column(column).cast(pa.large_binary()).to_pylist()), np.int64, batch.num_rows)
    at = 0
    while at < batch.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at : at + 50_000]), limit, "right")))
        yield batch.slice(at, n)
        at += n
