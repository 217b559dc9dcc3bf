"""Words and lines of whole UTF-8 texts, segmented a block of rows at a time.

The texts of an Arrow batch are one byte buffer plus offsets, so word borders,
character counts and word hashes are numpy operations over the whole block
instead of Python loops per word.  A block holds about ``BLOCK_BYTES`` of text
(one text is never cut), which bounds a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: odd multiplier of the rolling hash and its inverse modulo 2**64
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = np.ones(1, dtype=np.uint64)
_inverses = np.ones(1, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
        steps[1:] = np.uint64(_INVERSE)
        _inverses = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n], _inverses[:n]


@dataclass
class Block:
    """``rows`` texts from row ``first`` of the batch: bytes and offsets."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1

    @cached_property
    def _sums(self) -> np.ndarray:
        powers, _ = _tables(len(self.data) + 1)
        out = np.zeros(len(self.data) + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=out[1:])
        return out

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal spans have equal hashes."""
        _, inverses = _tables(len(self.data) + 1)
        h = (self._sums[ends] - self._sums[starts]) * inverses[starts]
        return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and row of the maximal runs of ``inside`` bytes; a run
        never crosses from one text into the next."""
        n = len(inside)
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = inside[1:]
        starts = np.flatnonzero(inside & (~before | edge[:-1]))
        ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        return starts, ends, np.searchsorted(self.offsets, starts, side="right") - 1

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(~SPACE[self.data])

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends (without the newline) and row of non-empty lines."""
        return self.spans(self.data != 0x0A)

    def per_row(self, values: np.ndarray) -> np.ndarray:
        """Sum of a per-byte array over each text."""
        sums = np.zeros(len(values) + 1, dtype=np.int64)
        np.cumsum(values, out=sums[1:], dtype=np.int64)
        return sums[self.offsets[1:]] - sums[self.offsets[:-1]]

    def count(self, rows: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """Number (or weight) of items per text, from the items' rows."""
        return np.bincount(rows, weights=weights, minlength=self.rows)


def lowered(block: Block) -> Block:
    """The block with A-Z lower-cased."""
    return Block(block.first, LOWER[block.data], block.offsets)


def blocks(texts: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of whole texts, in row order; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, places, data = texts.buffers()
    offsets = np.frombuffer(places, dtype=np.int64)[texts.offset : texts.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield Block(first, raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last
