"""Keys that any two linked n-gram sets have in common, for certain.

A linked pair differs in at most ``d`` n-grams (``d`` follows from the sizes).
The range of hash values is cut into more than ``d`` parts, so two linked sets
hold the very same n-grams in one part at least; a set's keys are the digests of
its parts.  Sizes fall in groups wider than a link can stretch, and keys are made
for a set's own group and the next, so that linked sets use the same parts (none
where ``d`` is 0: such sets link only if equal).  Up to ``SPARE`` parts more than
needed leave room for parts that happen to be empty; a set with more empty ones
has keys for these too.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from starloom.llm.text_bytes import mix

SPARE = 4
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def size_groups(largest: int, percent: int) -> np.ndarray:
    """Least sizes of the groups: linked sets are in one group or in neighbours."""
    starts = [1]
    while starts[-1] <= largest:
        starts.append(max(starts[-1] + 1, -(-starts[-1] * 100 // percent)))
    return np.array(starts, dtype=np.int64)


def part_keys(rows: np.ndarray, keys: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all parts of all sets.  ``rows`` and ``keys`` are a
    block's n-grams in the order (row, hash); ``size`` is each row's set size."""
    filled = np.flatnonzero(size)
    if not len(filled):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    groups = size_groups(int(size.max()) * 2 * 100 // percent + 2, percent)
    own = np.searchsorted(groups, size, side="right") - 1
    out_rows, out_keys = [], []
    mixed = mix(keys + _GOLD)
    for step in (0, 1):
        tag = own + step
        most = groups[tag + 1] - 1  # largest size that uses this tag
        differ = (100 - percent) * 2 * most // (100 + percent)
        spare = np.minimum(SPARE, differ // 4)
        parts = differ + 1 + spare
        part = ((keys >> np.uint64(32)) * parts[rows].astype(np.uint64)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (part[1:] != part[:-1]))))
        row, at = rows[first], part[first]
        digest = np.add.reduceat(mixed, first)
        # sets with so many empty parts that the filled ones may all differ
        held = np.bincount(row, minlength=len(size))
        for r in filled[(parts - held > spare)[filled]]:
            gone = np.setdiff1d(np.arange(parts[r], dtype=np.uint64), at[row == r])
            row, at = np.concatenate([row, np.full(len(gone), r)]), np.concatenate([at, gone])
            digest = np.concatenate([digest, np.zeros(len(gone), np.uint64)])
        place = (tag[row].astype(np.uint64) << np.uint64(40)) + at
        use = differ[row] > 0
        out_rows.append(row[use])
        out_keys.append(mix(digest ^ mix(place + _GOLD))[use])
    return np.concatenate(out_rows), np.concatenate(out_keys)


def key_lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """The values of each of ``n`` rows as a list."""
    order = np.argsort(rows, kind="stable")
    ends = np.concatenate(([0], np.cumsum(np.bincount(rows, minlength=n)))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values[order].view(np.int64)))
