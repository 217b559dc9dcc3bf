"""Packing by best-fit decreasing.

Documents are cut into full windows first; what remains of each is packed,
longest first, into the open window with the least sufficient room.  Open
windows are counted by their remaining room in the leaves of a segment tree,
so the tightest fit is found in a walk of logarithmic length.

Spark encodes the texts where they are read, stores one small row a piece,
and deals pieces by a hash of their identity into groups of about
``GROUP_PIECES`` pieces, each packed by one task.  The number of groups
follows the number of pieces, so no task grows with the corpus, and a group
leaves at most a few windows part-filled.

Edge cases: a null or empty text is the end id alone; a document of exactly a
window's size is one full window; equal lengths are taken by doc_id, then
start; repeated rows are pieces of their own; a null doc_id sorts first; an empty table gives no
pieces; input columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.library_tokens import library_table, vocabulary
from starloom.llm.store import stored
from starloom.llm.token_files import SLICE, with_end

WINDOW = 4096
GROUP_PIECES = 50_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = PIECES + ", sequence_id long, offset long"


class OpenWindows:
    """Open windows by remaining room: a segment tree of counts over the room
    0..capacity, and the windows themselves by room."""

    def __init__(self, capacity: int) -> None:
        self.size = 1 << capacity.bit_length()
        self.counts = [0] * (2 * self.size)
        self.windows: dict[int, list[int]] = {}

    def add(self, room: int, window: int) -> None:
        self.windows.setdefault(room, []).append(window)
        self._count(room, 1)

    def _count(self, room: int, step: int) -> None:
        node = room + self.size
        while node:
            self.counts[node] += step
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, window) with the least room >= need."""
        node, counts = need + self.size, self.counts
        if not counts[node]:
            while node > 1 and (node & 1 or not counts[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if counts[2 * node] else 2 * node + 1
        room = node - self.size
        window = self.windows[room].pop()
        self._count(room, -1)
        return room, window


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of each piece; ``lengths`` are descending and
    at most ``capacity``."""
    windows = np.empty(len(lengths), dtype=np.int64)
    offsets = np.empty(len(lengths), dtype=np.int64)
    free, n = OpenWindows(capacity), 0
    for i, length in enumerate(lengths.tolist()):
        found = free.take(length) if length < capacity else None
        if found is None:
            found, n = (capacity, n), n + 1
        room, window = found
        windows[i], offsets[i] = window, capacity - room
        if room > length:
            free.add(room - length, window)
    return windows, offsets


def pieces(docs: DataFrame, tokenizer_path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """One row a piece: the encoded document and its end id, cut into windows."""
    vocab = vocabulary(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(vocab.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                values, offsets = with_end(*table.encode_array(batch.column(1)), end_id)
                raw = memoryview(np.ascontiguousarray(values, dtype="<u4")).cast("B")
                sizes = np.diff(offsets)
                parts = -(-sizes // window)  # every document has its end id
                doc = np.repeat(np.arange(len(sizes)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * window
                length = np.minimum(window, sizes[doc] - start)
                first = (offsets[doc] + start) * 4
                spans = zip(first.tolist(), (first + length * 4).tolist(), strict=True)
                crc = [zlib.crc32(raw[a:b]) for a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, type=pa.int64()), pa.array(sizes[doc])],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, PIECES)


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    end_id: int,
    window: int = WINDOW,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Pieces of ``docs`` with their sequence and offset.  ``sequence_id`` is
    unique (group number in the high half, window number in the low half)."""
    cut = pieces(docs, tokenizer_path, end_id, window).withColumn("uid", F.monotonically_increasing_id())
    cut = stored(cut, "pieces")
    groups = max(1, -(-cut.count() // group_pieces))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "uid"), F.lit(groups)))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(
            ["length", "doc_id", "start"], ascending=[False, True, True], na_position="first", kind="stable"
        )
        windows, offsets = best_fit_decreasing(group["length"].to_numpy(), window)
        group["sequence_id"] = (group["g"].to_numpy() << 32) | windows
        group["offset"] = offsets
        return group.drop(columns=["g", "uid"])

    return dealt.groupBy("g").applyInPandas(pack, PACKED)
