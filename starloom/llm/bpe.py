"""Byte-level BPE, encoding and decoding, by contiguous rank arrays.

A word is an array of parts and, beside it, an array with the rank of each
adjacent pair.  Again and again the smallest rank is found by a scan, its
boundary is deleted and the ranks of the two neighbouring pairs are looked up
anew.  Short words of equal length lie in one matrix, a row a word, so a scan
is one row-wise minimum over all of them.  Words longer than ``SHORT`` bytes,
where repeated scans would be quadratic, keep their parts in a linked list
with a heap of ranks and give the same merges.

Edge cases: a null or empty text has no ids and decodes to the empty text;
special-token strings in a text become their ids, as in the library; of equal
ranks the leftmost pair merges first; ids outside the vocabulary decode to
nothing; repeated rows get equal results; an empty table gives an empty one.
"""

from __future__ import annotations

import heapq
import json

import numpy as np
import regex

from starloom.llm.chunks import ChunkTable

SHORT = 40
NONE = np.int32(2**31 - 1)
#: Fixed value: the pre-tokenization pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """Printable stand-ins of the 256 byte values in vocabulary files."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in shown}
    hidden = (b for b in range(256) if b not in set(shown))
    return letters | {chr(256 + i): b for i, b in enumerate(hidden)}


class RankBpe:
    """Encoder and decoder for a byte-level BPE tokenizer file's text."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = byte_letters()
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        self.byte_id = np.zeros(256, dtype=np.int64)
        for letter, value in letters.items():
            self.byte_id[value] = vocab[letter]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in merges], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.pair_keys = keys[order]
        self.pair_rank = order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        self.specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token_bytes: dict[int, bytes] = {
            i: bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
            for token, i in vocab.items()
        } | {i: s.encode() for s, i in self.specials.items()}
        self.pieces = regex.compile(PATTERN).findall
        self.by_special = (
            regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.specials, key=len, reverse=True)) + ")")
            if self.specials
            else None
        )
        self.table = ChunkTable(self.encode_chunks, self.encode_odd, True, self.specials)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``NONE`` where the pair does not merge."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.pair_keys, keys), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == keys, self.pair_rank[at], NONE)

    def _merge_rows(self, parts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merge words of equal length, one a row; (row numbers, final parts)
        by number of parts."""
        rows = np.arange(len(parts))
        ranks = self.ranks(parts[:, :-1], parts[:, 1:])
        done = []
        while True:
            width = parts.shape[1]
            if width == 1:
                done.append((rows, parts))
                return done
            at = ranks.argmin(axis=1)
            low = ranks[np.arange(len(rows)), at]
            over = low == NONE
            if over.any():
                done.append((rows[over], parts[over]))
                rows, parts, ranks, at, low = (x[~over] for x in (rows, parts, ranks, at, low))
                if not len(rows):
                    return done
            line = np.arange(len(rows))
            parts = parts[np.arange(width) != at[:, None] + 1].reshape(len(rows), width - 1)
            parts[line, at] = self.merged[low]
            ranks = ranks[np.arange(width - 1) != at[:, None]].reshape(len(rows), width - 2)
            left = np.flatnonzero(at > 0)
            ranks[left, at[left] - 1] = self.ranks(parts[left, at[left] - 1], parts[left, at[left]])
            right = np.flatnonzero(at < width - 2)
            ranks[right, at[right]] = self.ranks(parts[right, at[right]], parts[right, at[right] + 1])

    def _merge_long(self, word: bytes) -> np.ndarray:
        """One long word: linked list of parts and a heap of (rank, place)."""
        parts = self.byte_id[np.frombuffer(word, dtype=np.uint8)]
        n = len(parts)
        first = self.ranks(parts[:-1], parts[1:])
        heap = [(int(r), i) for i, r in enumerate(first.tolist()) if r != NONE]
        heapq.heapify(heap)
        ids = parts.tolist()
        rank = first.tolist() + [int(NONE)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        look = self._rank_dict()

        def refresh(i: int) -> None:
            j = after[i]
            rank[i] = look.get((ids[i] << 32) | ids[j], int(NONE)) if j < n else int(NONE)
            if rank[i] != NONE:
                heapq.heappush(heap, (rank[i], i))

        while heap:
            r, i = heapq.heappop(heap)
            if rank[i] != r:
                continue
            j = after[i]
            ids[i], rank[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            refresh(i)
            if before[i] >= 0:
                refresh(before[i])
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return np.array(out, dtype=np.int64)

    def _rank_dict(self) -> dict[int, int]:
        if not hasattr(self, "_dict"):
            self._dict = dict(zip(self.pair_keys.tolist(), self.pair_rank.tolist(), strict=True))
        return self._dict

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Little-endian 32-bit ids of each pre-token."""
        out: list[bytes] = [b""] * len(pieces)
        by_length: dict[int, list[int]] = {}
        for i, piece in enumerate(pieces):
            if len(piece) > SHORT:
                out[i] = self._merge_long(piece).astype("<u4").tobytes()
            elif piece:
                by_length.setdefault(len(piece), []).append(i)
        for length, at in by_length.items():
            raw = np.frombuffer(b"".join([pieces[i] for i in at]), dtype=np.uint8)
            for rows, parts in self._merge_rows(self.byte_id[raw].reshape(len(at), length)):
                width = 4 * parts.shape[1]
                ids = parts.astype("<u4").tobytes()
                for k, row in enumerate(rows.tolist()):
                    out[at[row]] = ids[k * width : (k + 1) * width]
        return out

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk; one that is a single word needs no pattern."""
        out: list[bytes] = [b""] * len(chunks)
        flat: dict[bytes, int] = {}
        whole: list[tuple[int, int]] = []
        cut: list[tuple[int, list[int]]] = []
        for i, chunk in enumerate(chunks):
            if chunk.isalpha() or (chunk[:1] == " " and chunk[1:].isalpha()):
                whole.append((i, flat.setdefault(chunk.encode(), len(flat))))
            else:
                cut.append((i, [flat.setdefault(p.encode(), len(flat)) for p in self.pieces(chunk)]))
        ids = self.encode_pieces(list(flat))
        for i, k in whole:
            out[i] = ids[k]
        for i, ks in cut:
            out[i] = b"".join([ids[k] for k in ks])
        return out

    def encode_odd(self, text: str) -> bytes:
        parts = self.by_special.split(text) if self.by_special else [text]
        out = []
        for part in parts:
            if part in self.specials:
                out.append(np.array([self.specials[part]], dtype="<u4").tobytes())
            elif part:
                out.append(self.encode_chunks([part])[0])
        return b"".join(out)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of whole texts as little-endian 32-bit integers."""
        return self.table.encode(texts)

    def encode_array(self, texts) -> list[bytes]:
        """The same for an Arrow array of texts."""
        values, offsets = self.table.encode_array(texts)
        raw, at = values.tobytes(), (offsets * 4).tolist()
        return [raw[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def decode(self, ids: bytes) -> str:
        """The text of such ids; invalid UTF-8 becomes U+FFFD."""
        look = self.token_bytes
        values = np.frombuffer(ids, dtype="<u4").tolist()
        try:
            raw = b"".join(map(look.__getitem__, values))
        except KeyError:
            raw = b"".join(look.get(v, b"") for v in values)
        return raw.decode("utf-8", "replace")


_encoders: dict[tuple, RankBpe] = {}


def encoder(text: str) -> RankBpe:
    """The worker's encoder for a tokenizer file's text."""
    key = (len(text), hash(text))
    if key not in _encoders:
        _encoders[key] = RankBpe(text)
    return _encoders[key]
