"""Near-duplicate documents by min-max hashing.

A text's set is its distinct shingles of lower-cased words.  Each of
``PERMUTATIONS`` hash functions gives two signature values, the minimum and
the maximum over the set, so half the hash evaluations fill a signature.
Bands of six values (minima and maxima of three functions) make the keys under
which texts become candidates; at a similarity of 0.8 a pair shares none of
the 32 keys with probability 6e-5.  Small sets, where that chance is larger, have
keys that any two linked ones share for certain too (``part_keys``): links between
sets of up to ``SMALL`` shingles are all found.

Links are confirmed on full sets (as 64-bit hashes of the shingles).  Equal
sets are one class first, so copies cost one row each.  Classes that share a
key are a bucket, and its pairs are not listed: each member meets the
bucket's hub, unless a filter on signature bits drops the pair, links give
components, and then only members outside the bucket's largest component are
compared again, first with other hubs of it (``HUB_ROUNDS``; buckets of one
component are done, and new links merge the components so far), last, without the
filter, with all members of other components, chunk by chunk in tasks that return
links only.  So no pair that shares a key and is not already connected is left
out, and a bucket of many copies of one text costs one comparison a member.
Components come from ``components``; all steps are joins and aggregates over stored
tables, and keys that many classes share are joined apart (``skew``).

Edge cases: a text with fewer words than a shingle is one shingle as a whole;
a null or empty text, or one of blanks only, has an empty set and links with
nothing; a row with a null doc_id takes part, and its component's id is the
smallest non-null one; repeated rows are in one class; equal similarities need
no order; an empty table gives an empty result; other columns are not read, and ``drop_near_copies``
passes them through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from starloom.llm.components import connected_components
from starloom.llm.part_keys import key_lists, part_keys
from starloom.llm.skew import BROADCAST_ROWS, split_join
from starloom.llm.store import stored
from starloom.llm.text_bytes import Block, blocks, lowered, mix

PERMUTATIONS = 96
BAND_FUNCTIONS = 3  # functions a band; each gives two values
HUB_ROUNDS = 2
CHUNK = 1024  # members of a bucket that a task compares with as many others
SMALL = 40  # shingles of a set that also has certain keys
SIGMAS = 5.0  # allowance of the signature-bit filter, in deviations

_GOLD = np.uint64(0x9E3779B97F4A7C15)
SIGNATURE = "doc_id long, n long, fp1 long, fp2 long, bands array<long>, bits array<long>"


def shingle_sets(block: Block, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct shingle, sorted by row, then hash."""
    block = lowered(block)
    starts, ends, row = block.words
    hashes = block.hashes(starts, ends)
    counts = block.count(row)
    total = len(hashes)
    run = hashes[: max(total - words + 1, 0)].copy()
    for k in range(1, words):
        run = mix(run * _GOLD + hashes[k : k + len(run)])
    whole = row[words - 1 :] == row[: len(run)] if len(run) else np.zeros(0, bool)
    rows, keys = row[: len(run)][whole], run[whole]
    # texts with fewer words than a shingle: the whole sequence
    short = np.flatnonzero((counts > 0) & (counts < words))
    if len(short):
        first = np.searchsorted(row, short)
        seq = mix(hashes[first] + counts[short].astype(np.uint64) * _GOLD)
        for k in range(1, words - 1):
            more = counts[short] > k
            seq[more] = mix(seq[more] * _GOLD + hashes[first[more] + k])
        rows, keys = np.concatenate([rows, short]), np.concatenate([keys, seq])
    order = np.lexsort((keys, rows))
    rows, keys = rows[order], keys[order]
    if len(rows):
        fresh = np.concatenate(([True], (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])))
        rows, keys = rows[fresh], keys[fresh]
    return rows, keys


def fingerprints(rows: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and two order-free 64-bit sums of each text."""
    size = np.bincount(rows, minlength=n).astype(np.int64)
    filled = np.flatnonzero(size)
    out = [np.zeros(n, dtype=np.uint64) for _ in range(2)]
    if len(filled):
        at = np.concatenate(([0], np.cumsum(size[filled])[:-1]))
        out[0][filled] = np.add.reduceat(mix(keys), at)
        out[1][filled] = np.add.reduceat(mix(keys ^ _GOLD), at)
    return size, out[0].view(np.int64), out[1].view(np.int64)


def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(96)
    factors = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return factors, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def min_max_signature(rows: np.ndarray, keys: np.ndarray, count: int = PERMUTATIONS) -> np.ndarray:
    """(texts with a set) x (2 * count): minimum and maximum of each function."""
    at = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
    out = np.empty((len(at), 2 * count), dtype=np.uint64)
    mixed = mix(keys)
    for k, (a, b) in enumerate(zip(*_functions(count), strict=True)):
        value = (mixed ^ b) * a
        value ^= value >> np.uint64(32)
        out[:, 2 * k] = np.minimum.reduceat(value, at)
        out[:, 2 * k + 1] = np.maximum.reduceat(value, at)
    return out


def _band_keys(signature: np.ndarray, functions: int) -> np.ndarray:
    width = 2 * functions
    bands = signature.shape[1] // width
    out = np.empty((len(signature), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(signature), b + 1, dtype=np.uint64)
        for c in range(b * width, (b + 1) * width):
            key = mix(key * _GOLD + signature[:, c])
        out[:, b] = key
    return out.view(np.int64)


def _bits(signature: np.ndarray) -> np.ndarray:
    """Two bits of each value, packed in longs."""
    two = (mix(signature + _GOLD) & np.uint64(3)).astype(np.uint8)
    raw = np.unpackbits(two[:, :, None], axis=2, bitorder="little")[:, :, :2].reshape(len(signature), -1)
    return np.ascontiguousarray(np.packbits(raw, axis=1)).view(np.int64)


def _lists(values: np.ndarray, filled: np.ndarray, n: int) -> pa.Array:
    """Rows of a matrix as lists; texts that are not ``filled`` get none."""
    lengths = np.zeros(n, dtype=np.int32)
    lengths[filled] = values.shape[1]
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def _all_keys(rows: np.ndarray, keys: np.ndarray, size: np.ndarray, signature: np.ndarray, percent: int) -> pa.Array:
    """Band keys of every set, and the certain keys of small ones."""
    filled = np.flatnonzero(size)
    bands = _band_keys(signature, BAND_FUNCTIONS)
    small = np.where(size <= SMALL, size, 0)
    few = small[rows] > 0
    some, parts = part_keys(rows[few], keys[few], small, percent)
    both = np.concatenate([np.repeat(filled, bands.shape[1]), some])
    return key_lists(both, np.concatenate([bands.reshape(-1).view(np.uint64), parts]), len(size))


def signatures(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, fp1, fp2, bands, bits) of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows, keys = shingle_sets(block, words)
                size, fp1, fp2 = fingerprints(rows, keys, block.rows)
                filled = np.flatnonzero(size)
                signature = min_max_signature(rows, keys) if len(filled) else np.zeros((0, 2 * PERMUTATIONS), np.uint64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(block.first, block.rows),
                        *(pa.array(x) for x in (size, fp1, fp2)),
                        _all_keys(rows, keys, size, signature, percent),
                        _lists(_bits(signature), filled, block.rows),
                    ],
                    names=["doc_id", "n", "fp1", "fp2", "bands", "bits"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SIGNATURE)


def with_sets(rows: DataFrame, words: int, keep: list[str], sets: bool = True) -> DataFrame:
    """Columns ``keep`` of ``rows`` with the fingerprint (f_n, f_1, f_2) and,
    if ``sets``, the shingles of its column ``text``."""
    at, text_at = [rows.columns.index(c) for c in keep], rows.columns.index("text")
    schema = rows.select(*keep).schema.add("f_n", "long").add("f_1", "long").add("f_2", "long")
    if sets:
        schema = schema.add("shingles", ArrayType(LongType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(text_at)):
                found, keys = shingle_sets(block, words)
                size, fp1, fp2 = fingerprints(found, keys, block.rows)
                columns = [batch.column(i).slice(block.first, block.rows) for i in at]
                columns += [pa.array(x) for x in (size, fp1, fp2)]
                if sets:
                    offsets = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys.view(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(run, schema)


def _bit_limit(percent: int) -> int:
    """Differing bits that a pair at the threshold exceeds with the
    probability of ``SIGMAS`` deviations."""
    values, p = 2 * PERMUTATIONS, 1 - percent / 100
    return int(np.ceil(values * p + SIGMAS * np.sqrt(values * (1.5 * p - p * p))))


def _may_link(percent: int, longs: int) -> Column:
    """Whether sizes and signature bits of a pair allow a link."""
    unlike = [F.bit_count(F.col("bits_a")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(longs)]
    small, large = F.least("n_a", "n_b"), F.greatest("n_a", "n_b")
    return (100 * small >= percent * large) & (sum(unlike[1:], unlike[0]) <= _bit_limit(percent))


class _Search:
    """State of the link search over classes of equal sets."""

    def __init__(self, docs: DataFrame, words: int, percent: int, broadcast_rows: int) -> None:
        self.percent, self.broadcast_rows = percent, broadcast_rows
        signed = signatures(docs, words, percent).withColumn("rid", F.monotonically_increasing_id())
        self.signed = stored(signed, "dedup-signatures")
        filled = self.signed.where("n > 0")
        # partial aggregates: a class that a third of the rows share is cheap
        classes = filled.groupBy("n", "fp1", "fp2").agg(
            F.min("rid").alias("cid"), F.min("doc_id").alias("min_doc"), F.count("*").alias("rows")
        )
        self.classes = stored(classes, "dedup-classes")
        reps = filled.join(self.classes.select("cid"), F.col("rid") == F.col("cid"))
        self.reps = stored(reps.select("cid", "doc_id", "n", "fp1", "fp2", "bands", "bits"), "dedup-reps")
        self.longs = 2 * PERMUTATIONS * 2 // 64
        keys = self.reps.select("cid", F.explode("bands").alias("key"))
        buckets = keys.groupBy("key").agg(
            F.min(F.struct(F.xxhash64("cid").alias("h"), "cid")).alias("hub"), F.count("*").alias("m")
        )
        buckets = stored(buckets.where("m > 1").select("key", F.col("hub.cid").alias("hub"), "m"), "dedup-buckets")
        self.members = stored(self._by_key(keys, buckets), "dedup-members")
        self.sets = stored(self._candidate_sets(docs, words), "dedup-sets")
        self.checked: DataFrame | None = None
        self.labels: DataFrame | None = None  # (node, component) of the linked classes

    def _by_key(self, rows: DataFrame, buckets: DataFrame) -> DataFrame:
        """``rows`` with the columns of ``buckets`` (a row a key, ``m`` members)."""
        return split_join(rows, buckets, "key", "m", self.broadcast_rows)

    def _candidate_sets(self, docs: DataFrame, words: int) -> DataFrame:
        """(cid, shingles) of the classes that share a key with another."""
        need = self.reps.join(self.members.select("cid").distinct(), "cid", "left_semi")
        need = need.select("cid", F.col("doc_id").alias("at_doc"), "n", "fp1", "fp2")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        found = texts.join(need.where("at_doc IS NOT NULL"), F.col("doc_id") == F.col("at_doc"))
        found = with_sets(found, words, ["cid", "n", "fp1", "fp2"])
        same = (F.col("f_n") == F.col("n")) & (F.col("f_1") == F.col("fp1")) & (F.col("f_2") == F.col("fp2"))
        found = found.where(same).select("cid", "shingles")
        # classes of rows without id: by their fingerprint
        bare = with_sets(texts.where("doc_id IS NULL"), words, ["doc_id"]).drop("doc_id")
        bare = bare.dropDuplicates(["f_n", "f_1", "f_2"]).join(need.where("at_doc IS NULL"), same)
        return found.unionByName(bare.select("cid", "shingles")).dropDuplicates(["cid"])

    def _attributes(self, side: str) -> DataFrame:
        return self.reps.select(
            F.col("cid").alias(side), F.col("n").alias(f"n_{side}"), F.col("bits").alias(f"bits_{side}")
        )

    def filtered(self, pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that may link, with their set sizes."""
        both = pairs.join(self._attributes("a"), "a").join(self._attributes("b"), "b")
        return both.where(_may_link(self.percent, self.longs)).select("a", "b", "n_a", "n_b")

    def check(self, pairs: DataFrame) -> None:
        """Compare the full sets of the pairs (a, b, n_a, n_b) not compared yet."""
        if self.checked is not None:
            pairs = pairs.join(self.checked.select("a", "b"), ["a", "b"], "left_anti")
        one = pairs.join(self.sets.select(F.col("cid").alias("b"), F.col("shingles").alias("s_b")), "b")
        two = one.join(self.sets.select(F.col("cid").alias("a"), F.col("shingles").alias("s_a")), "a")
        common = F.size(F.array_intersect("s_a", "s_b")).cast("long")
        linked = 100 * F.col("common") >= self.percent * (F.col("n_a") + F.col("n_b") - F.col("common"))
        done = two.select("a", "b", "n_a", "n_b", common.alias("common")).select("a", "b", linked.alias("linked"))
        done = stored(done, "dedup-checked")
        self.checked = done if self.checked is None else self.checked.union(done)
        self.merge(done)

    def merge(self, links: DataFrame) -> None:
        """Take new links (a, b, linked) into the components: only links
        between components that differ are edges of the next search."""
        links = links.where("linked").select(F.col("a").alias("src"), F.col("b").alias("dst"))
        if self.labels is None:
            self.labels = stored(connected_components(links), "dedup-components")
            return
        for end in ("src", "dst"):
            own = self.labels.select(F.col("node").alias(end), F.col("component").alias("_to"))
            links = links.join(own, end, "left").withColumn(end, F.coalesce("_to", end)).drop("_to")
        merged = stored(connected_components(links.select("src", "dst")), "dedup-merged")
        to = merged.select(F.col("node").alias("component"), F.col("component").alias("_to"))
        old = self.labels.join(to, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        single = merged.join(self.labels.select("node"), "node", "left_anti")
        self.labels = stored(old.union(single), "dedup-components")

    def check_twos(self, left: DataFrame) -> None:
        """Compare the pairs of buckets that hold two open members and whose
        pair the filter dropped."""
        twos = left.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("a"), F.max("cid").alias("b"))
        pairs = twos.where("m = 2").select("a", "b").distinct()
        size = self.reps.select("cid", "n")
        for side in "ab":
            pairs = pairs.join(size.withColumnsRenamed({"cid": side, "n": f"n_{side}"}), side)
        near = 100 * F.least("n_a", "n_b") >= self.percent * F.greatest("n_a", "n_b")
        self.check(pairs.where(near).select("a", "b", "n_a", "n_b"))

    def open_buckets(self) -> DataFrame:
        """Members (key, cid, comp, top) of the buckets that hold several
        components; ``top`` is the bucket's largest component.  The others
        need no further look."""
        parts = self.members.select("key", "cid").join(
            self.labels.select(F.col("node").alias("cid"), "component"), "cid", "left"
        )
        parts = stored(parts.select("key", "cid", F.coalesce("component", "cid").alias("comp")), "dedup-parts")
        sizes = parts.groupBy("key", "comp").agg(F.count("*").alias("m"))
        tops = sizes.groupBy("key").agg(
            F.max(F.struct("m", "comp")).alias("top"), F.count("*").alias("parts"), F.sum("m").alias("m")
        )
        tops = stored(tops.where("parts > 1").select("key", F.col("top.comp").alias("top"), "m"), "dedup-tops")
        self.members = stored(self._by_key(parts, tops), "dedup-open")
        return self.members

    def _rest_links(self, left: DataFrame) -> DataFrame:
        """Links (a, b, linked) between the components that share a bucket:
        every member outside a bucket's largest component against all members
        of other components.  Both sides are dealt in chunks of ``CHUNK``, a
        task holds one chunk of each, and only links leave it (one from a
        member to a component).  Buckets of two are done."""
        sizes = left.groupBy("key").agg(
            F.count("*").alias("m"), F.sum((F.col("comp") != F.col("top")).cast("int")).alias("u")
        )
        sizes = sizes.where("m > 2").select("key", "m", *(F.ceil(F.col(c) / CHUNK).cast("int").alias(f"{c}_parts") for c in "mu"))
        rows = self._by_key(left, stored(sizes, "dedup-sizes")).join(self.sets, "cid")
        spread = lambda n: F.pmod(F.xxhash64("cid"), F.col(n)).cast("int")
        cells = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        is_open = F.col("comp") != F.col("top")
        every = rows.select(
            "key", "cid", "comp", "shingles", F.lit(False).alias("open"),
            spread("m_parts").alias("j"), F.explode(cells("u_parts")).alias("i"),
        )
        opened = rows.where(is_open).select(
            "key", "cid", "comp", "shingles", F.lit(True).alias("open"),
            F.explode(cells("m_parts")).alias("j"), spread("u_parts").alias("i"),
        )
        percent = self.percent

        def links(group: pd.DataFrame) -> pd.DataFrame:
            found = []
            side = group["open"].to_numpy()
            if side.any() and not side.all():
                cid, comp = group["cid"].to_numpy(), group["comp"].to_numpy()
                sets = group["shingles"].to_numpy()
                size = np.array([len(x) for x in sets], dtype=np.int64)
                values, codes = np.unique(np.concatenate(sets), return_inverse=True)
                ends = np.cumsum(size)
                xs, ys = np.flatnonzero(side), np.flatnonzero(~side)
                y_codes = np.concatenate([codes[ends[y] - size[y] : ends[y]] for y in ys])
                y_starts = np.cumsum(size[ys]) - size[ys]
                for x in xs:
                    mine = np.zeros(len(values), dtype=np.int64)
                    mine[codes[ends[x] - size[x] : ends[x]]] = 1
                    common = np.add.reduceat(mine[y_codes], y_starts)
                    linked = 100 * common >= percent * (size[x] + size[ys] - common)
                    hits = ys[linked & (comp[ys] != comp[x])]
                    _, once = np.unique(comp[hits], return_index=True)
                    found += [(min(cid[x], cid[y]), max(cid[x], cid[y]), True) for y in hits[once]]
            return pd.DataFrame(found, columns=["a", "b", "linked"])

        both = every.union(opened)
        return both.groupBy("key", "i", "j").applyInPandas(links, "a long, b long, linked boolean").distinct()

    def run(self) -> DataFrame:
        """(cid, comp) of every class."""
        pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
        first = self.members.where("cid <> hub").select(*pair("cid", "hub")).distinct()
        self.check(self.filtered(first))
        for turn in range(HUB_ROUNDS):
            left = self.open_buckets()
            inside = F.when(F.col("comp") == F.col("top"), F.struct(F.xxhash64("cid", F.lit(turn)).alias("h"), "cid"))
            hubs = left.groupBy("key").agg(F.min(inside).alias("hub"), F.count("*").alias("m"))
            hubs = stored(hubs.select("key", F.col("hub.cid").alias("hub"), "m"), "dedup-hubs")
            again = self._by_key(left.where("comp <> top"), hubs).select(*pair("cid", "hub"))
            self.check(self.filtered(again.distinct()))
        self.check_twos(self.open_buckets())
        rest = self._rest_links(self.open_buckets())
        self.merge(stored(rest, "dedup-checked"))
        found = self.labels.select(F.col("node").alias("cid"), F.col("component").alias("comp"))
        return self.classes.join(found, "cid", "left").select("cid", F.coalesce("comp", "cid").alias("comp"))


def near_components(docs: DataFrame, words: int, percent: int, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept, fp1, fp2, comp) of every row of
    ``docs``; ``comp`` numbers the components (null for empty sets).  ``broadcast_rows``: rows of a key table that are broadcast whole."""
    search = _Search(docs, words, percent, broadcast_rows)
    comps = stored(search.run(), "dedup-classes")
    known = stored(search.classes.join(comps, "cid"), "dedup-known")
    least = known.groupBy("comp").agg(F.min("min_doc").alias("component_id"), F.count("*").alias("m"))
    known = split_join(known, stored(least, "dedup-least"), "comp", "m", broadcast_rows)
    key = F.struct("n", "fp1", "fp2")
    named = stored(known.select(key.alias("set"), "component_id", "comp", "rows"), "dedup-named")
    rows = search.signed.select("doc_id", "n", "fp1", "fp2", key.alias("set"))
    found = split_join(rows.where("n > 0"), named, "set", "rows", broadcast_rows // 10)
    empty = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    found = found.unionByName(empty, allowMissingColumns=True)
    return found.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "fp1",
        "fp2",
        "comp",
    )


def drop_near_copies(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """One row of ``docs`` for each component: that with its smallest doc_id.
    Of rows that repeat one doc_id in a component one stays; so does one row of
    each component that only rows without id have."""
    found = stored(near_components(docs, words, percent), "dedup-result")
    has_id = F.col("doc_id").isNotNull()
    times = found.where(has_id).groupBy(F.col("doc_id").alias("w_id")).agg(F.count("*").alias("times"))
    a_set = F.struct(F.col("n_shingles").alias("w_n"), F.col("fp1").alias("w_1"), F.col("fp2").alias("w_2"))
    kept = found.where("kept").select(F.col("doc_id").alias("w_id"), "comp", a_set.alias("w"))
    # of a component without any id the least set stays
    bare = kept.where("w_id IS NULL").groupBy("w_id", "comp").agg(F.min("w").alias("w"))
    kept = kept.where("w_id IS NOT NULL").unionByName(bare).select("w_id", "w.*").distinct()
    kept = stored(kept.join(times, "w_id", "left"), "dedup-kept")
    once = docs.join(kept.where("times = 1").select("w_id"), F.col("doc_id") == F.col("w_id"), "left_semi")
    # Repeated and missing ids: told apart by their sets.
    again = kept.where("times > 1 OR w_id IS NULL")
    ids = again.where("w_id IS NOT NULL").select("w_id").distinct()
    some = docs.join(ids, F.col("doc_id") == F.col("w_id"), "left_semi").union(docs.where(F.col("doc_id").isNull()))
    some = with_sets(some, words, some.columns, sets=False)
    same = (
        F.col("doc_id").eqNullSafe(F.col("w_id"))
        & (F.col("f_n") == F.col("w_n")) & (F.col("f_1") == F.col("w_1")) & (F.col("f_2") == F.col("w_2"))
    )
    some = some.join(again, same, "left_semi").dropDuplicates(["doc_id", "f_n", "f_1", "f_2"])
    return once.union(some.select(*[F.col(f"`{c}`") for c in docs.columns]))
