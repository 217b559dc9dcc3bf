"""Encode whole texts through a bounded table of already encoded chunks.

A text is cut where, with the pre-tokenizers used here, tokens surely end: after
a newline, between a word and closing punctuation, and before blanks.  A text's
ids are its chunks' ids one after another, and each distinct chunk is encoded
once per worker.  That needs texts whose only blanks are space and newline; any
other blank or control separator, or a special token's string in the text, sends
the whole text to the encoder at once (``encode_whole``).

The table has two generations: a full one replaces the older, and what is met
again moves up.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa

from starloom.llm.text_bytes import Block, blocks

_ODD = re.compile(r"[^\S \n]")
#: a word or a newline or closing punctuation, each where a token must end
#: after it; else all up to the next blank
_WITH_BLANKS = re.compile(
    r" ?[^\W\d_]+(?=[ \n.,!?;:]|$)|\n(?= ?[^ \n])|[.,!?;:]+(?=[ \n]|$)|[ \n]*[^ \n]+|[ \n]+"
)
#: the same where blanks are no tokens and texts are lower-cased (U+0130 then
#: ends in a mark, not in a letter)
_WITHOUT_BLANKS = re.compile(r"[^\W\d_\u0130]+(?=[ \n.,!?;:]|$)|[.,!?;:]+(?=[ \n]|$)|[^ \n]+")

_CLOSES, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_CLOSES[[ord(c) for c in ".,!?;:"]] = True
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True

#: entries of a generation of a worker's table
MAX_ENTRIES = 250_000
#: characters of text that are looked at together
GROUP_CHARS = 1 << 20


def _gather(pool: np.ndarray, places: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``pool`` that begin at ``places``, one after another."""
    total = np.cumsum(sizes)
    count = int(total[-1]) if len(total) else 0
    return pool[np.repeat(places - (total - sizes), sizes) + np.arange(count)]


class _Learned:
    """Ids of chunks by the chunks' 64-bit hashes, which are kept sorted."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.places, self.sizes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(0, dtype="<u4")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key would stand, and whether it is there."""
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at, np.zeros(len(keys), dtype=bool)
        return at, self.keys[np.minimum(at, len(self.keys) - 1)] == keys

    def add(self, keys: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Learn new keys (sorted) with their ids one after another."""
        at = np.searchsorted(self.keys, keys)
        self.places = np.insert(self.places, at, len(self.pool) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, at, sizes)
        self.keys = np.insert(self.keys, at, keys)
        self.pool = np.concatenate([self.pool, ids])


class ChunkTable:
    """``encode_many``: chunks to little-endian 32-bit ids, one bytes each; ``encode_whole``: the same for one odd text; ``keep_blanks``:
    whether blanks belong to tokens; ``specials``: strings that make a text
    odd."""

    def __init__(
        self,
        encode_many: Callable[[list[str]], list[bytes]],
        encode_whole: Callable[[str], bytes],
        keep_blanks: bool,
        specials: Iterable[str],
        max_entries: int = MAX_ENTRIES,
    ) -> None:
        self.encode_many, self.encode_whole = encode_many, encode_whole
        self.cut = (_WITH_BLANKS if keep_blanks else _WITHOUT_BLANKS).findall
        self.keep_blanks = keep_blanks
        self.specials = tuple(specials)
        self.max_entries = max_entries
        self.table: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.by_hash, self.older_hash = _Learned(), _Learned()

    def _odd(self, text: str) -> bool:
        return _ODD.search(text) is not None or any(s in text for s in self.specials)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; a null text has none."""
        out: list[bytes] = []
        group: list[str] = []
        size = 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size >= GROUP_CHARS:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, texts: list[str]) -> list[bytes]:
        if len(self.table) > self.max_entries:
            self.table, self.older = {}, self.table
        cut = [None if self._odd(t) else self.cut(t) for t in texts]
        known = self.table.keys()
        missing: set[str] = set()
        for chunks in cut:
            if chunks:
                missing.update(chunks)
        missing = {c for c in missing if c not in known}
        self._learn(missing)
        look = self.table.__getitem__
        return [
            self.encode_whole(t) if chunks is None else b"".join(map(look, chunks))
            for t, chunks in zip(texts, cut, strict=True)
        ]

    def _learn(self, missing: set[str]) -> None:
        table, older = self.table, self.older
        for chunk in missing & older.keys():
            table[chunk] = older[chunk]
        new = list(missing - older.keys())
        table.update(zip(new, self.encode_many(new), strict=True))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of an Arrow array of texts and each text's offset in them.

        Plain texts are cut and told apart by byte arithmetic on the whole
        block (64-bit hashes of chunks); odd ones go through ``encode``."""
        values, counts = [np.zeros(0, dtype="<u4")], [np.zeros(1, dtype=np.int64)]
        for block in blocks(texts):
            odd = self._odd_rows(block)
            ids, lengths = self._plain_block(block, ~odd)
            at = np.flatnonzero(odd)
            if len(at):
                raw = block.data.tobytes()
                cut = [raw[block.offsets[i] : block.offsets[i + 1]].decode() for i in at]
                found = [np.frombuffer(x, dtype="<u4") for x in self.encode(cut)]
                ends = np.cumsum(lengths)
                parts, last = [], 0
                for i, own in zip(at.tolist(), found, strict=True):
                    parts += [ids[last : ends[i]], own]
                    last = ends[i]
                    lengths[i] = len(own)
                ids = np.concatenate([*parts, ids[last:]])
            values.append(ids)
            counts.append(lengths)
        return np.concatenate(values), np.cumsum(np.concatenate(counts))

    def _odd_rows(self, block: Block) -> np.ndarray:
        """Texts with blanks or controls other than space and newline, with
        ``<|`` (special tokens), or, where blanks count, with blanks side by
        side or at an end."""
        d = block.data
        if not len(d):
            return np.zeros(block.rows, dtype=bool)
        bad = (d < 0x20) & (d != 0x0A)
        one = np.append(d[1:], 0)
        high = np.flatnonzero(d >= 0xC2)
        lead, second = d[high], one[high]
        third = d[np.minimum(high + 2, len(d) - 1)]
        wide = (lead == 0xC2) & ((second == 0x85) | (second == 0xA0))
        wide |= (lead == 0xE1) & (second == 0x9A)
        wide |= (lead == 0xE2) & (second == 0x80) & ((third <= 0x8A) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
        wide |= (lead == 0xE2) & (second == 0x81) & (third == 0x9F)
        wide |= (lead == 0xE3) & (second == 0x80) & (third == 0x80)
        bad[high[wide]] = True
        bad |= (d == 0x3C) & (one == 0x7C)
        if self.keep_blanks:
            blank = (d == 0x20) | (d == 0x0A)
            bad |= blank & np.append(blank[1:], True)
            filled = np.flatnonzero(np.diff(block.offsets))
            firsts, lasts = block.offsets[filled], block.offsets[filled + 1] - 1
            bad[firsts] |= blank[firsts]
            bad[lasts] |= blank[lasts]
        return block.per_row(bad) > 0

    def _plain_block(self, block: Block, plain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, row = block.words
        mine = plain[row] if len(row) else np.zeros(0, dtype=bool)
        starts, ends, row = starts[mine], ends[mine], row[mine]
        lengths = np.zeros(block.rows, dtype=np.int64)
        if not len(starts):
            return np.zeros(0, dtype="<u4"), lengths
        d = block.data
        before = d[np.maximum(starts - 1, 0)]
        kind = np.where(starts == block.offsets[row], 0, np.where(before == 0x0A, 2, 1))
        if not self.keep_blanks:
            kind[:] = 0
        # closing punctuation after a plain letter is a chunk of its own
        split = (ends - starts >= 2) & _CLOSES[d[ends - 1]] & _LETTER[d[np.maximum(ends - 2, 0)]]
        place = np.arange(len(starts)) + np.cumsum(split) - split
        n = len(starts) + int(split.sum())
        s, e, k = np.empty(n, np.int64), np.empty(n, np.int64), np.zeros(n, np.int64)
        s[place], e[place], k[place] = starts, ends - split, kind
        tails = place[split] + 1
        s[tails], e[tails] = ends[split] - 1, ends[split]
        rows = np.empty(n, np.int64)
        rows[place], rows[tails] = row, row[split]
        keys = block.hashes(s, e) + k.astype(np.uint64)
        distinct, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        places, sizes, pool = self._ids_of(distinct, block, s[first], e[first], k[first])
        each = sizes[inverse]
        lengths += np.bincount(rows, weights=each, minlength=block.rows).astype(np.int64)
        return _gather(pool, places[inverse], each), lengths

    def _ids_of(self, keys: np.ndarray, block: Block, s, e, kind) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place and number of each key's ids in a pool, and the pool."""
        if len(self.by_hash.keys) > self.max_entries:
            self.by_hash, self.older_hash = _Learned(), self.by_hash
        table, older = self.by_hash, self.older_hash
        at, known = table.find(keys)
        gone = np.flatnonzero(~known)
        if len(gone):
            there, met = older.find(keys[gone])
            there = there[met]
            sizes = older.sizes[there]
            table.add(keys[gone[met]], sizes, _gather(older.pool, older.places[there], sizes))
            new = gone[~met]
            raw = block.data.tobytes()
            prefix = ("", " ", "\n")
            spans = zip(s[new].tolist(), e[new].tolist(), kind[new].tolist(), strict=True)
            found = self.encode_many([prefix[c] + raw[x:y].decode() for x, y, c in spans])
            sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
            table.add(keys[new], sizes, np.frombuffer(b"".join(found), dtype="<u4"))
            at, _ = table.find(keys)
        return table.places[at], table.sizes[at], table.pool
