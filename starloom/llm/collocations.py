"""Phrase collocations by set-oriented relational mining.

The occurrence relation of length k holds, for each occurrence of a phrase, its
piece, its position in it and its words.  It is persisted in sorted segments: a
row of the table is the share of a few megabytes of text, with the columns
piece, position and words in the order (piece, position), packed and compressed.
Pieces are never cut, so a segment joins with itself alone.

* Length 1 is written while the texts are cut.
* ``Segment.extended``: occurrences of frequent phrases are merge-joined with
  those one position on in the same piece.
* The joined groups are counted, in the segment first, then by an aggregate.
* ``Relation.frequent``: only occurrences of groups counted often enough (a
  semi-join) are extended again; from length 2 on they are persisted before.

The semi-join's right side is broadcast as 64-bit hashes up to
``BROADCAST_GROUPS`` groups and as a Bloom filter of at most ``FILTER_BYTES``
up to ``FILTER_GROUPS``; beyond, each segment's distinct groups meet the
frequent ones by a shuffled semi-join and go back to their segment.  All keep
every frequent group; what else a hash lets through is not frequent and falls
out of the next count, so results are exact either way.

A worker holds one Arrow batch of about ``BATCH_BYTES`` and one segment.

Words are carried as 64-bit hashes of language and word.  A second hash of each
tells whether two share the first; then all but one of them get another, and
the texts are cut anew.  The words themselves are fetched for candidates only.

Edge cases: a null text is empty; a null language is ``und``; an empty text or
one without words adds nothing; a text of any length is read whole (its pieces
are one segment); repeated rows count as often as they occur; equal scores are
ordered by count, then by the phrase in UTF-8 byte order; an empty table gives
an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.store import arrow_batches, stored
from starloom.llm.text_bytes import blocks, lowered, mix

SEGMENT_BYTES = 2 << 20
BROADCAST_GROUPS = 2_000_000
#: bytes of a Bloom filter, and the groups up to which one is made (four bits each)
FILTER_BYTES = 32 << 20
FILTER_GROUPS = 64_000_000
BATCH_BYTES = 4 << 20
SLICES = 64
_GOLD = np.uint64(0x9E3779B97F4A7C15)

#: bytes that end a piece, and those that also end a word
ENDS_PIECE = np.zeros(256, dtype=bool)
ENDS_PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
ENDS_WORD = ENDS_PIECE.copy()
ENDS_WORD[[0x20, 0x09]] = True

#: (language, word) -> its first hash, which others share, and its new one
Renamed = dict[tuple[str, str], tuple[int, int]]


def _zip(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unzip(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def _pack(values: np.ndarray) -> bytes:
    """Hashes as they are, other whole numbers in their narrowest type."""
    narrow = values if values.dtype == np.uint64 else values.astype(np.min_scalar_type(int(values.max(initial=0))))
    if narrow.dtype == np.uint64 and values.dtype != np.uint64:
        narrow = values.astype(np.int64)
    return narrow.dtype.char.encode() + _zip(narrow.tobytes())


def _unpack(packed: bytes) -> np.ndarray:
    found = np.frombuffer(_unzip(packed[1:]), dtype=np.dtype(chr(packed[0])))
    return found if found.dtype == np.uint64 else found.astype(np.int64)


class Segment:
    """Sorted occurrences: pieces, positions, and for each word of the phrase
    its place among the segment's distinct items."""

    def __init__(self, piece: np.ndarray, at: np.ndarray, items: np.ndarray, words: list[np.ndarray]) -> None:
        self.piece, self.at, self.items, self.words = piece, at, items, words

    def where(self, rows: np.ndarray) -> Segment:
        return Segment(self.piece[rows], self.at[rows], self.items, [w[rows] for w in self.words])

    def extended(self) -> Segment:
        """Merge-join of the occurrences with those one position on in the same
        piece, which begin with the words that these end with."""
        place = (self.piece << 32) + self.at
        right = np.minimum(np.searchsorted(place, place + 1), max(len(place) - 1, 0))
        left = np.flatnonzero(place[right] == place + 1)
        longer = self.where(left)
        longer.words.append(self.words[-1][right[left]])
        return longer

    def groups(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Items of the distinct phrases, word by word, and their counts."""
        code, high = self.words[0], len(self.items)
        for w in self.words[1:]:
            if high * len(self.items) >= 1 << 62:
                values, code = np.unique(code, return_inverse=True)
                high = len(values)
            code, high = code * len(self.items) + w, high * len(self.items)
        _, first, counts = np.unique(code, return_index=True, return_counts=True)
        return [self.items[w[first]] for w in self.words], counts

    def keys(self) -> np.ndarray:
        return _group_keys([self.items[w] for w in self.words])

    def packed(self) -> list[bytes]:
        used, places = np.unique(np.concatenate(self.words), return_inverse=True)
        places = places.reshape(len(self.words), -1)
        return [_pack(np.diff(self.piece, prepend=0)), _pack(self.at), _pack(self.items[used]), *map(_pack, places)]


def _columns(k: int) -> list[str]:
    """Packed columns of a segment of length k."""
    return ["piece", "at", "items", *(f"w{i + 1}" for i in range(k))]


def _segment(batch: pa.RecordBatch, i: int, k: int) -> Segment:
    steps, at, items, *words = (_unpack(batch.column(c)[i].as_py()) for c in _columns(k))
    return Segment(np.cumsum(steps), at, items, words)


def _group_keys(words: list[np.ndarray]) -> np.ndarray:
    """A 64-bit hash of each group of words."""
    key = mix(words[0])
    for w in words[1:]:
        key = mix(key * _GOLD + w)
    return key


def _among(values: np.ndarray, known: np.ndarray | Filter) -> np.ndarray:
    """Which values are among the known ones, which are sorted or in a filter."""
    if isinstance(known, Filter):
        return known.has(values)
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class Filter:
    """A Bloom filter of group keys: ``SLICES`` parts of ``2**log`` bits each.  A
    key's first bits choose its part; ``probes`` of its bits are set there."""

    def __init__(self, log: int, probes: int, bits: np.ndarray) -> None:
        self.log, self.probes, self.bits = log, probes, bits

    @staticmethod
    def shape(groups: int) -> tuple[int, int]:
        """``log`` and ``probes`` for so many groups: ten bits each at least, as
        far as ``FILTER_BYTES`` go."""
        most = (FILTER_BYTES * 8 // SLICES).bit_length() - 1
        log = min(max((10 * groups // SLICES).bit_length(), 6), most)
        return log, min(4, max(1, round(0.7 * (SLICES << log) / max(groups, 1))))

    @staticmethod
    def slices(keys: np.ndarray) -> np.ndarray:
        return keys >> np.uint64(64 - SLICES.bit_length() + 1)

    @staticmethod
    def places(keys: np.ndarray, log: int, probes: int) -> Iterator[np.ndarray]:
        """Each probe's bit within the key's part."""
        for i in range(1, probes + 1):
            yield mix(keys + np.uint64(int(_GOLD) * i % (1 << 64))) >> np.uint64(64 - log)

    def has(self, keys: np.ndarray) -> np.ndarray:
        base = self.slices(keys) << np.uint64(self.log)
        found = np.ones(len(keys), dtype=bool)
        for place in self.places(keys, self.log, self.probes):
            at = base + place
            found &= (self.bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
        return found


def _filter(groups: DataFrame, n: int):
    """A broadcast :class:`Filter` of ``n`` groups (w1 .. wk).  Its parts are made
    apart, so neither a task nor the driver holds the groups themselves."""
    log, probes = Filter.shape(n)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _group_keys([column.to_numpy().view(np.uint64) for column in batch.columns])
            yield pa.RecordBatch.from_arrays([pa.array(Filter.slices(found).astype(np.int32)), pa.array(found.view(np.int64))], names=["slice", "key"])

    def part(table: pa.Table) -> pa.Table:
        found = table.column("key").to_numpy().view(np.uint64)
        bits = np.zeros(1 << (log - 3), dtype=np.uint8)
        for place in Filter.places(found, log, probes):
            np.bitwise_or.at(bits, place >> np.uint64(3), np.uint8(1) << (place & np.uint64(7)).astype(np.uint8))
        return pa.table({"slice": pa.array([table.column("slice")[0].as_py()], pa.int32()), "bits": pa.array([bits.tobytes()])})

    parts = groups.mapInArrow(keys, "slice int, key long").groupBy("slice").applyInArrow(part, "slice int, bits binary").collect()
    bits = np.zeros(SLICES << (log - 3), dtype=np.uint8)
    for r in parts:
        bits[r["slice"] << (log - 3) : (r["slice"] + 1) << (log - 3)] = np.frombuffer(r["bits"], dtype=np.uint8)
    return groups.sparkSession.sparkContext.broadcast(Filter(log, probes, bits))


_VOCABULARY = ["items", "counts", "checks", "langs", "words"]


def _occurrences(docs: DataFrame, bits: int, renamed: Renamed) -> DataFrame:
    """Segments of length 1, each with its vocabulary: counts, second hashes,
    languages and words of its items, and the words of each language counted."""
    names = [*_columns(1), *_VOCABULARY[1:], "lang_names", "lang_counts"]
    schema = ", ".join(f"{n} binary" for n in names[:-2]) + ", lang_names array<string>, lang_counts array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = np.array([old for old, _ in renamed.values()], dtype=np.uint64)
        for batch in batches:
            named = pc.dictionary_encode(pc.fill_null(batch.column(0), "und"))
            lang, langs = named.indices.to_numpy(), named.dictionary.to_pylist()
            seeds = [xxhash.xxh64_intdigest(x.encode()) for x in langs]
            for block in map(lowered, blocks(batch.column(1), SEGMENT_BYTES)):
                starts, ends, row = block.spans(~ENDS_WORD[block.data])
                if not len(starts):
                    continue
                raw, own = block.data.tobytes(), lang[block.first + row]
                piece = np.cumsum(ENDS_PIECE[block.data])[starts] + row
                first = np.flatnonzero(np.concatenate(([True], piece[1:] != piece[:-1])))
                at = np.arange(len(piece)) - np.repeat(first, np.diff(np.append(first, len(piece))))
                item = mix(block.hashes(starts, ends) ^ np.array(seeds, dtype=np.uint64)[own]) >> np.uint64(64 - bits)
                for i in np.flatnonzero(np.isin(item, shared)):
                    _, item[i] = renamed.get((langs[own[i]], raw[starts[i] : ends[i]].decode()), (0, item[i]))
                items, place, word, counts = np.unique(item, return_index=True, return_inverse=True, return_counts=True)
                words = [raw[x:y] for x, y in zip(starts[place].tolist(), ends[place].tolist(), strict=True)]
                code = own[place]
                checks = [xxhash.xxh64_intdigest(w, seeds[c]) for w, c in zip(words, code.tolist(), strict=True)]
                line = [
                    _pack(np.diff(piece, prepend=0)), _pack(at), _pack(items), _pack(word), _pack(counts),
                    _pack(np.array(checks, dtype=np.uint64)), _pack(code), _zip(b"\n".join(words)),
                    langs, np.bincount(own, minlength=len(langs)).tolist(),
                ]
                yield pa.RecordBatch.from_arrays([pa.array([x]) for x in line], names=names)

    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    return texts.mapInArrow(run, schema).withColumn("segment", F.monotonically_increasing_id())


def _word_counts(segments: DataFrame) -> DataFrame:
    """(w1, n, low, high): each item's count, and the least and greatest second
    hash of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [[_unpack(x.as_py()) for x in column] for column in batch.columns]
            if not parts[0]:
                continue
            items, counts, checks = map(np.concatenate, parts)
            order = np.lexsort((checks, items))
            items, counts, checks = items[order], counts[order], checks[order]
            first = np.flatnonzero(np.concatenate(([True], (items[1:] != items[:-1]) | (checks[1:] != checks[:-1]))))
            columns = [items[first].view(np.int64), np.add.reduceat(counts, first), checks[first].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["w1", "n", "low"])

    parts = segments.select(*_VOCABULARY[:3]).mapInArrow(run, "w1 long, n long, low long")
    return parts.groupBy("w1").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("low").alias("high"))


def _words_of(segments: DataFrame, needed: DataFrame, limits: Limits) -> DataFrame:
    """Distinct (w1, lang, word) of the items ``needed`` (w1)."""
    needed = needed.select("w1")
    known, exact = _known(needed, limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                items, langs = (_unpack(batch.column(c)[i].as_py()) for c in ("items", "langs"))
                here = np.flatnonzero(_among(mix(items), known.value)) if known else np.arange(len(items))
                words = _unzip(batch.column("words")[i].as_py()).split(b"\n")
                names = batch.column("lang_names")[i].as_py()
                columns = [items[here].view(np.int64), [names[c] for c in langs[here].tolist()], [words[k].decode() for k in here.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), *(pa.array(c, pa.string()) for c in columns[1:])], names=["w1", "lang", "word"])

    rows = segments.select("items", "langs", "words", "lang_names").mapInArrow(run, "w1 long, lang string, word string")
    return (rows if exact else rows.join(needed, "w1", "left_semi")).distinct()


#: groups up to which their keys are broadcast, and up to which a filter is
Limits = tuple[int, int]


def _known(groups: DataFrame, limits: Limits):
    """A broadcast of the keys of some groups (w1 .. wk), or of a filter of them,
    or None where they are too many; and whether it lets no other key through
    but by a clash of hashes."""
    n = groups.count()
    if n <= limits[0]:
        rows = groups.toArrow()
        words = [rows.column(c).to_numpy().view(np.uint64) for c in rows.column_names]
        return groups.sparkSession.sparkContext.broadcast(np.sort(_group_keys(words))), True
    return (_filter(groups, n) if n <= limits[1] else None), False


def _vocabulary(docs: DataFrame, bits: int, limits: Limits) -> tuple[DataFrame, DataFrame]:
    """The segments of length 1 and the count of each word (w1, n), where no
    two words share an item."""
    renamed: Renamed = {}
    while True:
        segments = stored(_occurrences(docs, bits, renamed), "phrases-1")
        counts = stored(_word_counts(segments), "phrases-counts")
        shared = counts.where("low <> high").select("w1")
        if shared.isEmpty():
            return segments, counts.select("w1", "n")
        # hashes of 64 bits that meet are few; all but the least word move
        stays = Window.partitionBy("w1").orderBy("lang", "word")
        moves = _words_of(segments, shared, limits).withColumn("place", F.row_number().over(stays)).where("place > 1")
        for r in moves.collect():
            tag = hashlib.blake2b(f"{r['lang']}\n{r['word']}".encode(), digest_size=8, salt=str(len(renamed)).encode()).digest()
            renamed[r["lang"], r["word"]] = (r["w1"] % (1 << 64), int.from_bytes(tag, "little"))


class _Frequent:
    """Semi-join of a segment's occurrences with frequent groups: their keys as
    a broadcast, or in a column of the segment."""

    def __init__(self, column: str | None, sent) -> None:
        self.column, self.sent = column, sent

    def __call__(self, segment: Segment, batch: pa.RecordBatch, i: int) -> Segment:
        known = self.sent.value if self.column is None else np.sort(np.array(batch.column(self.column)[i].as_py(), np.int64).view(np.uint64))
        if len(segment.words) == 1:  # once for each item
            return segment.where(_among(mix(segment.items), known)[segment.words[0]])
        return segment.where(_among(segment.keys(), known))


def _extend(segment: Segment, batch: pa.RecordBatch, i: int) -> Segment:
    return segment.extended()


class Relation:
    """Segments of length ``k`` and what is done to each when it is read."""

    def __init__(self, segments: DataFrame, k: int, steps: tuple = ()) -> None:
        self.segments, self.k, self.steps = segments, k, steps
        self.length = k + sum(s is _extend for s in steps)

    def extended(self) -> Relation:
        return Relation(self.segments, self.k, (*self.steps, _extend))

    def _map(self, make: Callable[[Segment, pa.RecordBatch, int], pa.RecordBatch], schema: str) -> DataFrame:
        k, steps = self.k, self.steps

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    segment = _segment(batch, i, k)
                    for step in steps:
                        segment = step(segment, batch, i)
                    if len(segment.at):
                        yield make(segment, batch, i)

        more = [s.column for s in steps if isinstance(s, _Frequent) and s.column]
        return self.segments.select("segment", *_columns(k), *more).mapInArrow(run, schema)

    def counts(self) -> DataFrame:
        """(w1 .. wk, n) of all phrases."""
        names = [f"w{i + 1}" for i in range(self.length)]

        def make(segment: Segment, batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
            words, n = segment.groups()
            return pa.RecordBatch.from_arrays([*(pa.array(w.view(np.int64)) for w in words), pa.array(n)], names=[*names, "n"])

        return self._map(make, ", ".join(f"{n} long" for n in [*names, "n"])).groupBy(*names).agg(F.sum("n").alias("n"))

    def frequent(self, groups: DataFrame, limits: Limits) -> Relation:
        """The occurrences of the groups (w1 .. wk)."""
        names = [f"w{i + 1}" for i in range(self.length)]
        groups = groups.select(*names)
        known, _ = _known(groups, limits)
        if known:
            return Relation(self.segments, self.k, (*self.steps, _Frequent(None, known)))

        def make(segment: Segment, batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
            words, n = segment.groups()
            columns = [pa.repeat(batch.column("segment")[i], len(n)), *(pa.array(w.view(np.int64)) for w in words)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(_group_keys(words).view(np.int64))], names=["segment", *names, "key"])

        column = f"known{self.length}"
        own = self._map(make, ", ".join(f"{n} long" for n in ["segment", *names, "key"])).join(groups, names, "left_semi")
        own = own.groupBy("segment").agg(F.collect_list("key").alias(column))
        return Relation(stored(self.segments.join(own, "segment"), "phrases-known"), self.k, (*self.steps, _Frequent(column, None)))

    def persisted(self) -> Relation:
        names = _columns(self.length)

        def make(segment: Segment, batch: pa.RecordBatch, i: int) -> pa.RecordBatch:
            line = [batch.column("segment")[i].as_py(), *segment.packed()]
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in line], names=["segment", *names])

        schema = "segment long, " + ", ".join(f"{n} binary" for n in names)
        return Relation(stored(self._map(make, schema), f"phrases-{self.length}"), self.length)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)) in exact decimals."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    over = (exact(a) * exact(a)).cast("decimal(32,0)") * F.lit(1000000).cast("decimal(7,0)")
    return F.call_function("div", over.cast("decimal(38,0)"), (exact(left) * exact(right)).cast("decimal(38,0)"))


def phrase_collocations(
    docs: DataFrame,
    least: int = 10,
    inside_percent: int = 50,
    top: int = 2000,
    broadcast_groups: int = BROADCAST_GROUPS,
    bits: int = 64,
    filter_groups: int = FILTER_GROUPS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases
    of two or three words that occur ``least`` times or more, without those
    that occur inside a longer one ``inside_percent`` of their times or more.
    ``bits``: width of the words' hashes."""
    with arrow_batches(docs.sparkSession, BATCH_BYTES):  # all that workers do is written within
        return _phrases(docs, least, inside_percent, top, (broadcast_groups, filter_groups), bits)


def _phrases(docs: DataFrame, least: int, inside_percent: int, top: int, limits: Limits, bits: int) -> DataFrame:
    segments, counted = _vocabulary(docs, bits, limits)
    totals = segments.select(F.explode(F.map_from_arrays("lang_names", "lang_counts")).alias("lang", "n"))
    totals = totals.groupBy("lang").agg(F.sum("n").alias("total")).where("total > 0")
    often = F.col("n") >= least
    singles = stored(counted.where(often), "phrases-singles")
    one = Relation(segments, 1).frequent(singles, limits).extended()
    pairs = stored(one.counts().where(often), "phrases-pairs")
    two = one.frequent(pairs, limits).persisted().extended()
    triples = stored(two.counts().where(often), "phrases-triples")
    used = pairs.select(F.explode(F.array("w1", "w2")).alias("w1")).distinct()
    words = stored(_words_of(segments, used, limits).join(singles, "w1"), "phrases-words")

    def word(at: str, tag: str) -> DataFrame:
        return words.select(F.col("w1").alias(at), F.col("word").alias(f"t{tag}"), F.col("n").alias(f"f{tag}"))

    def pair(x: str, y: str, count: str) -> DataFrame:
        return pairs.select(F.col("w1").alias(x), F.col("w2").alias(y), F.col("n").alias(count))

    # longer candidates, dropped or not, that hold a pair
    around = triples.select("w1", "w2", "n").union(triples.select("w2", "w3", "n"))
    around = around.groupBy("w1", "w2").agg(F.max("n").alias("longer"))
    two = pairs.join(around, ["w1", "w2"], "left")
    two = two.where(F.col("longer").isNull() | (100 * F.col("longer") < inside_percent * F.col("n")))
    two = two.join(word("w1", "1"), "w1").join(word("w2", "2"), "w2")
    two = two.select(
        "w1", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("n").alias("a"),
        F.col("f1").alias("l"), F.col("f2").alias("r"),
    ).withColumn("score", _score("a", "l", "r"))
    three = triples.join(word("w1", "1"), "w1").join(word("w2", "2"), "w2").join(word("w3", "3"), "w3")
    three = three.join(pair("w1", "w2", "f12"), ["w1", "w2"]).join(pair("w2", "w3", "f23"), ["w2", "w3"])
    cuts = F.least(
        F.struct(_score("n", "f1", "f23").alias("score"), F.lit(1).alias("k"), F.col("f1").alias("l"), F.col("f23").alias("r")),
        F.struct(_score("n", "f12", "f3").alias("score"), F.lit(2).alias("k"), F.col("f12").alias("l"), F.col("f3").alias("r")),
    )
    three = three.select("w1", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("n").alias("a"), cuts.alias("cut"))
    three = three.select("w1", "phrase", "a", "cut.l", "cut.r", "cut.score")
    found = two.unionByName(three).join(words.select("w1", "lang"), "w1")
    # a language's phrases are ranked in SLICES parts first, so one task sees
    # at most that many times the rows that are asked for
    found = found.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(SLICES)))
    by = (F.desc("score"), F.desc("a"), "phrase")
    for part in (["lang", "slice"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*by))
        found = found.withColumn("rank", rank).where(F.col("rank") <= top)
    best = found
    return best.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
