"""Alignment of two tokenizers' tokens over each distinct text.

Documents are grouped by their full text first (an aggregate, so copies are
combined before the shuffle).  Each distinct text is encoded and aligned once;
how many documents a linked id pair occurs in is the sum over distinct texts of
their copies; and the measures go back to the documents by the text's SHA-256.

A (a byte-level BPE file of the tokenizers library) and B (a sentencepiece BPE
model whose pieces hold a blank only in front) encode space + text.  Both end a
token before a blank that follows a non-blank character, so a text is cut there
into chunks, and each distinct chunk is encoded and aligned once per worker
while its table lasts: no group crosses such a cut.  B's pieces are checked for
that when the model is loaded; if one held an inner blank, whole texts would be
the chunks.

Groups are cut where tokens of A and B end at the same byte.  All tokens of a
group are linked, but the pairs of a group are listed by distinct ids, with
their number of occurrences.

Edge cases: null and empty texts, and texts whose bytes do not come back from A
or B (such as those with U+2581), have no tokens: zeros and an empty string;
special tokens' strings in a text are plain text; a very long text is one row, as
it is in the input; equal pair counts are all highest; repeated rows and null
doc_ids stay rows; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.bpe import byte_letters
from starloom.llm.skew import BROADCAST_ROWS, split_join
from starloom.llm.store import stored

#: chunks that a worker's table holds before it starts anew
MAX_CHUNKS = 100_000
#: characters of text that are looked at together, and of new chunks that are
#: encoded as one string
GROUP_CHARS = 1 << 20
JOINED = 4096
#: chunks that are learnt, and texts that are put together, at once; less than
#: 16 bits number them (see ``_sums``)
AT_ONCE = 32_768
TEXTS = 512
#: A pair's code is its A id times this, plus its B id.
B_IDS = 1 << 31
#: pairs of one group that are listed one by one; larger groups by distinct ids
LISTED = 4096

_before_blank = re.compile(r"(?<=\S)(?= )")
_blank_pair = re.compile(r"\s ")


def _places(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, .. of each run, one run after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)


def _sums(owner: np.ndarray, code: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, code) in order, and the sum of their times.  An owner
    has at most 16 bits, a code at most 47."""
    key = (owner.astype(np.int64) << 47) | code
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    summed = np.add.reduceat(times[order], first) if len(key) else times
    return key[first] >> 47, key[first] & ((1 << 47) - 1), summed


class _Chunks:
    """Alignments of chunks: numbers, pairs with their times, and groups as
    text, each in the order in which the chunks were learnt."""

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.numbers = np.zeros((0, 4), dtype=np.int64)
        self.starts, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.shown: list[str] = []
        self.odd: set[int] = set()  # chunks whose bytes do not come back

    def add(self, chunks: list[str], numbers, owner, codes, times, shown, odd) -> None:
        base = len(self.shown)
        self.place.update(zip(chunks, range(base, base + len(chunks)), strict=True))
        sizes = np.bincount(owner, minlength=len(chunks))
        self.starts = np.concatenate([self.starts, len(self.codes) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.codes, self.times = np.concatenate([self.codes, codes]), np.concatenate([self.times, times])
        self.numbers = np.concatenate([self.numbers, numbers])
        self.shown += shown
        self.odd.update(base + i for i in odd)


class Aligner:
    """Encodes chunks by both tokenizers and keeps their alignment."""

    def __init__(self, a_text: str, b_model: bytes) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_text)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=b_model)
        letters = byte_letters()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)
        ]
        self.a_size, self.b_size = (np.array(list(map(len, x)), dtype=np.int64) for x in (self.a_bytes, self.b_bytes))
        # an id with each sign that may follow it in the shown groups
        self.signed = [f"{i}{sign}" for i in range(max(len(self.a_bytes), len(pieces))) for sign in ",|;"]
        self.cuttable = not any(re.search("[^▁]▁", p) for p in pieces)
        self.blank_b = self.b.piece_to_id("▁")
        self.known = _Chunks()

    def chunks(self, text: str) -> list[str]:
        """Chunks of space + text, each without the blank it begins with."""
        if not text:
            return []
        if not self.cuttable:
            return [text]
        if _blank_pair.search(text) or text[:1] == " ":
            return [x[1:] for x in _before_blank.split(f" {text}")]
        return text.split(" ")

    def learn(self, chunks: list[str]) -> None:
        """Align chunks that the table does not hold yet.  They are joined to
        strings, in which a cut before a blank is as safe as in a text; chunks
        that end in a blank, and those of a string whose bytes do not come
        back, are encoded alone."""
        plain = [c for c in chunks if c and not c[-1].isspace()] if self.cuttable else []
        alone = [c for c in chunks if not c or c[-1].isspace()] if self.cuttable else list(chunks)
        strings: list[list[str]] = []
        size = JOINED
        for c in plain:
            if size >= JOINED:
                strings.append([])
                size = 0
            strings[-1].append(c)
            size += len(c) + 1
        fine: list[str] = []
        a_ids: list[int] = []
        b_ids: list[int] = []
        joined = [" ".join(x) for x in strings]
        a_found = self.a.encode_batch_fast([f" {x}" for x in joined], add_special_tokens=False)
        for own, text, a, b in zip(strings, joined, a_found, self.b.encode(joined, num_threads=1), strict=True):
            if self._comes_back(text, a.ids, b):
                fine += own
                a_ids += a.ids
                b_ids += b
            else:
                alone += own
        if fine:
            sizes = np.fromiter((len(c.encode()) + 1 for c in fine), dtype=np.int64, count=len(fine))
            self.known.add(fine, *self._align(sizes, np.array(a_ids, dtype=np.int64), np.array(b_ids, dtype=np.int64)), [])
        for c in alone:
            a = self.a.encode_batch_fast([f" {c}"], add_special_tokens=False)[0].ids
            b = self.b.encode(c) if c else [self.blank_b]
            if self._comes_back(c, a, b):
                size = np.array([len(c.encode()) + 1])
                self.known.add([c], *self._align(size, np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)), [])
            else:
                none = np.zeros(0, dtype=np.int64)
                self.known.add([c], np.zeros((1, 4), np.int64), none, none, none, [""], [0])

    def _comes_back(self, text: str, a: list[int], b: list[int]) -> bool:
        raw = f" {text}".encode()
        return b"".join(map(self.a_bytes.__getitem__, a)) == raw and b"".join(map(self.b_bytes.__getitem__, b)) == raw

    def _align(self, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
        """(numbers, owner, codes, times, shown) of chunks that lie one after
        another: their sizes in bytes and all their ids."""
        a_end, b_end, ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b]), np.cumsum(sizes)
        cuts = np.intersect1d(a_end, b_end, assume_unique=True)  # ends of groups
        a_group, b_group = np.searchsorted(cuts, a_end), np.searchsorted(cuts, b_end)
        chunk = np.searchsorted(ends, cuts)  # of each group
        a_many, b_many = np.bincount(a_group, minlength=len(cuts)), np.bincount(b_group, minlength=len(cuts))
        count = len(sizes)
        each = lambda of, weights=None: np.bincount(of, weights, count).astype(np.int64)
        links = a_many * b_many
        numbers = np.stack([each(chunk[a_group]), each(chunk[b_group]), each(chunk), np.zeros(count, np.int64)], axis=1)
        np.add.at(numbers[:, 3], chunk, links)
        # pairs: each A token of a group meets the group's B tokens
        b_first = np.cumsum(b_many) - b_many
        listed = links <= LISTED
        mine = np.flatnonzero(listed[a_group])
        width = b_many[a_group[mine]]
        left, right = np.repeat(a[mine], width), b[_places(b_first[a_group[mine]], width)]
        owner, codes = np.repeat(chunk[a_group[mine]], width), left * B_IDS + right
        times = np.ones(len(codes), dtype=np.int64)
        a_first = np.cumsum(a_many) - a_many
        for g in np.flatnonzero(~listed):
            x, nx = np.unique(a[a_first[g] : a_first[g] + a_many[g]], return_counts=True)
            y, ny = np.unique(b[b_first[g] : b_first[g] + b_many[g]], return_counts=True)
            owner = np.concatenate([owner, np.full(len(x) * len(y), chunk[g])])
            codes = np.concatenate([codes, (x[:, None] * B_IDS + y).ravel()])
            times = np.concatenate([times, np.outer(nx, ny).ravel()])
        return numbers, *_sums(owner, codes, times), self._show(a, b, a_group, b_group, chunk, count)

    def _show(self, a, b, a_group, b_group, chunk, count: int) -> list[str]:
        """The groups of each chunk as text, each followed by a semicolon."""
        a_last = np.append(a_group[1:] != a_group[:-1], True)
        b_last = np.append(b_group[1:] != b_group[:-1], True)
        # tokens in the order group, A before B
        group = np.concatenate([2 * a_group, 2 * b_group + 1])
        order = np.argsort(group, kind="stable")
        sign = np.concatenate([a * 3 + a_last, b * 3 + 2 * b_last])[order].tolist()
        ends = np.cumsum(np.bincount(chunk[group >> 1], minlength=count)).tolist()
        look = self.signed.__getitem__
        return ["".join(map(look, sign[lo:hi])) for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]

    def align(self, texts: list[str]) -> Iterator[tuple]:
        """(numbers, digests, sizes, codes, times) of texts that lie together:
        a row of numbers and a digest a text, the number of its distinct pairs,
        and all their codes and times; an empty text has none."""
        for lo, hi in _groups_of(texts):
            if len(self.known.place) > MAX_CHUNKS:
                self.known = _Chunks()
            cut = [self.chunks(t) for t in texts[lo:hi]]
            self._know({c for chunks in cut for c in chunks})
            look = self.known.place.__getitem__
            at = [list(map(look, chunks)) for chunks in cut]
            if self.known.odd:
                for i, own in enumerate(at):  # an odd chunk: the whole text decides
                    if len(own) > 1 and not self.known.odd.isdisjoint(own):
                        self._know({texts[lo + i]})
                        at[i] = [self.known.place[texts[lo + i]]]
            yield self._together(at)

    def _know(self, chunks: set[str]) -> None:
        new = sorted(chunks - self.known.place.keys())
        for lo in range(0, len(new), AT_ONCE):
            self.learn(new[lo : lo + AT_ONCE])

    def _together(self, at: list[list[int]]) -> tuple:
        known = self.known
        flat = np.fromiter((i for own in at for i in own), dtype=np.int64)
        row = np.repeat(np.arange(len(at)), [len(own) for own in at])
        numbers = np.zeros((len(at), 4), dtype=np.int64)
        np.add.at(numbers, row, known.numbers[flat])
        width = known.sizes[flat]
        places = _places(known.starts[flat], width)
        owner, codes, times = _sums(np.repeat(row, width), known.codes[places], known.times[places])
        shown = ["".join([known.shown[i] for i in own])[:-1] for own in at]
        digests = [hashlib.sha256(x.encode()).hexdigest() if x else "" for x in shown]
        return numbers, digests, np.bincount(owner, minlength=len(at)), codes, times


def _groups_of(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``GROUP_CHARS`` characters together."""
    lo = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= GROUP_CHARS:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


_aligners: dict[str, Aligner] = {}


def _aligner(a_text: str, b_model: bytes) -> Aligner:
    key = hashlib.sha256(a_text.encode() + b_model).hexdigest()
    if key not in _aligners:
        _aligners[key] = Aligner(a_text, b_model)
    return _aligners[key]


MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def aligned_texts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """(key, copies, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times)
    of each distinct non-empty text; ``key`` is its SHA-256, ``pairs`` the codes
    of its linked id pairs and ``times`` their occurrences."""
    texts = docs.where(F.col("text") != "").groupBy("text").agg(F.count("*").alias("copies"))
    sent = docs.sparkSession.sparkContext.broadcast((Path(a_path).read_text(encoding="utf-8"), Path(b_path).read_bytes()))
    names = ["key", "copies", *MEASURES, "groups_sha256", "pairs", "times"]
    schema = f"key binary, copies long, {', '.join(f'{m} long' for m in MEASURES)}, groups_sha256 string, pairs array<long>, times array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(*sent.value)
        for whole in batches:
            for at in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(at, TEXTS)
                row = 0
                for numbers, digests, sizes, codes, times in aligner.align(batch.column("text").to_pylist()):
                    own = batch.slice(row, len(digests))
                    row += len(digests)
                    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                    yield pa.RecordBatch.from_arrays(
                        [
                            own.column("key"), own.column("copies"), *(pa.array(numbers[:, i]) for i in range(4)), pa.array(digests),
                            *(pa.ListArray.from_arrays(ends, pa.array(x)) for x in (codes, times)),
                        ],
                        names=names,
                    )

    keyed = texts.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")
    return keyed.mapInArrow(run, schema)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, count, best, texts): documents that hold each linked id pair,
    whether that is its A id's highest count, and how many distinct texts."""
    pairs = aligned.select("copies", F.explode("pairs").alias("pair")).groupBy("pair")
    pairs = stored(pairs.agg(F.sum("copies").alias("count"), F.count("*").alias("texts")), "align-pairs")
    a_id = F.shiftright("pair", 31)
    highest = pairs.groupBy(a_id.alias("a_id")).agg(F.max("count").alias("highest"))
    best = (F.col("count") == F.col("highest")).alias("best")
    return pairs.withColumn("a_id", a_id).join(highest, "a_id").select("pair", "count", best, "texts")


def align_documents(docs: DataFrame, a_path: str, b_path: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256)
    of every row of ``docs``.  Up to ``broadcast_rows`` pairs, or texts, are
    broadcast where they are joined; more are shuffled, but for the most
    frequent."""
    aligned = stored(aligned_texts(docs, a_path, b_path), "align-texts")
    counts = stored(pair_counts(aligned), "align-counts")
    links = aligned.select("key", F.explode(F.arrays_zip("pairs", "times")).alias("l"))
    links = links.select("key", F.col("l.pairs").alias("pair"), F.col("l.times").alias("times"))
    sums = split_join(links, counts, "pair", "texts", broadcast_rows).groupBy("key").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("count")).alias("count_sum"),
    )
    measures = stored(aligned.drop("pairs", "times").join(sums, "key", "left"), "align-measures")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2("text", 256)).alias("key"), (F.coalesce("text", F.lit("")) != "").alias("filled"))
    rows = stored(rows, "align-rows")
    found = split_join(rows.where("filled"), measures, "key", "copies", broadcast_rows // 10)
    found = found.unionByName(rows.where("NOT filled"), allowMissingColumns=True)
    number = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (*MEASURES, "n_best", "count_sum")]
    return found.select("doc_id", *number, F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
