"""Jaccard join of n-gram sets through prefix trees, complete at any threshold.

A text's set is its distinct n-grams of lower-cased words, held as 64-bit
hashes.  Equal sets are one class, so copies cost one row each.

Which sets must meet in a tree is settled without comparing any: linked sets have
a key in common (``part_keys``), and nothing is left to chance.

Classes with a common key are joined to the key's least class (no pairs), and
the components of these edges are blocks: every link lies within a block.  A
block's sets go to one task, which puts them in a prefix tree and searches it
(``prefix_tree``).  A block of more than ``CELL_GRAMS`` n-grams is dealt in
chunks, and each two chunks meet in a task of their own; only links leave a task.

Edge cases: a text with fewer words than an n-gram has the whole sequence as its
one n-gram; a null or empty text, or one of blanks, has an empty set, links with
nothing and keeps its own id; a row with a null doc_id takes part, its
component's id is the smallest non-null one; a long text is read whole; repeated
rows are in one class; similarities equal to the threshold link; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.components import connected_components
from starloom.llm.minhash_dedup import fingerprints, shingle_sets, with_sets
from starloom.llm.part_keys import key_lists, part_keys
from starloom.llm.prefix_tree import linked
from starloom.llm.skew import BROADCAST_ROWS, split_join
from starloom.llm.store import stored
from starloom.llm.text_bytes import blocks

#: n-grams that a task's tree holds, but for single larger sets
CELL_GRAMS = 1_000_000


def keyed_sets(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, n, fp1, fp2, keys) of every whole text."""
    schema = "doc_id long, n long, fp1 long, fp2 long, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                rows, keys = shingle_sets(block, words)
                size, fp1, fp2 = fingerprints(rows, keys, block.rows)
                lists = key_lists(*part_keys(rows, keys, size, percent), block.rows)
                ids = batch.column(0).slice(block.first, block.rows)
                yield pa.RecordBatch.from_arrays(
                    [ids, *(pa.array(x) for x in (size, fp1, fp2)), lists], names=["doc_id", "n", "fp1", "fp2", "keys"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def _blocks(keys: DataFrame, broadcast_rows: int) -> DataFrame:
    """(cid, block) of the classes that share a key (cid, key) with another."""
    buckets = keys.groupBy("key").agg(F.min("cid").alias("hub"), F.count("*").alias("m")).where("m > 1")
    buckets = stored(buckets, "ngram-buckets")
    edges = split_join(keys, buckets, "key", "m", broadcast_rows).where("cid <> hub")
    edges = edges.select(F.col("cid").alias("src"), F.col("hub").alias("dst"))
    return connected_components(edges).select(F.col("node").alias("cid"), F.col("component").alias("block"))


def _sets(docs: DataFrame, need: DataFrame, words: int) -> DataFrame:
    """(cid, block, n, shingles) of the classes ``need`` (cid, doc_id, row,
    n, fp1, fp2, block): their sets, cut once more from one of their texts."""
    need = need.withColumnRenamed("doc_id", "at_doc")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with_id = texts.join(need.where("at_doc IS NOT NULL"), F.col("doc_id") == F.col("at_doc"))
    same = (F.col("f_n") == F.col("n")) & (F.col("f_1") == F.col("fp1")) & (F.col("f_2") == F.col("fp2"))
    found = with_sets(with_id, words, ["cid", "block", "n", "fp1", "fp2"]).where(same)
    # classes that only rows without id have: by their fingerprint
    bare = with_sets(texts.where("doc_id IS NULL"), words, ["doc_id"]).drop("doc_id")
    bare = bare.dropDuplicates(["f_n", "f_1", "f_2"]).join(need.where("at_doc IS NULL"), same)
    columns = ["cid", "block", "n", "shingles"]
    return found.select(columns).unionByName(bare.select(columns)).dropDuplicates(["cid"])


def _links(sets: DataFrame, percent: int, cell_grams: int) -> DataFrame:
    """Links (src, dst) of the sets (cid, block, n, shingles), found in trees."""
    sizes = sets.groupBy("block").agg(F.ceil(F.sum("n") / F.lit(cell_grams)).cast("int").alias("chunks"), F.count("*").alias("m"))
    rows = split_join(sets, stored(sizes, "ngram-sizes"), "block", "m")
    chunk = F.pmod(F.xxhash64("cid"), F.col("chunks")).cast("int")
    rows = rows.withColumn("chunk", chunk).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    # a chunk alone and with each other one; of several, the pairs do for it alone too
    rows = rows.where("chunks = 1 OR chunk <> other")
    cells = rows.select("block", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "cid", "shingles")
    cells = cells.repartition("block", "i", "j").sortWithinPartitions("block", "i", "j", "cid")

    def search(cids: np.ndarray, lists: list[pa.Array], ends: np.ndarray) -> pa.RecordBatch:
        """Links within each run of equal cells; ``ends``: the runs' ends."""
        src, dst, lo = [], [], 0
        for hi in ends.tolist():
            if hi - lo > 1:
                sets = [x.values.to_numpy() for x in lists[lo:hi]]
                offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
                found = np.array(linked(np.concatenate(sets), offsets, percent), dtype=np.int64).reshape(-1, 2) + lo
                src.append(cids[found[:, 0]])
                dst.append(cids[found[:, 1]])
            lo = hi
        none = [np.zeros(0, np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(src or none)), pa.array(np.concatenate(dst or none))], names=["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cells: list[tuple] = []
        held_cids: list[int] = []
        held: list[pa.Array] = []
        for batch in batches:
            own = list(zip(*(batch.column(c).to_pylist() for c in ("block", "i", "j")), strict=True))
            held_cells += own
            held_cids += batch.column("cid").to_pylist()
            held += list(batch.column("shingles"))
            last = held_cells[-1] if held_cells else None
            whole = len(held_cells)
            while whole and held_cells[whole - 1] == last:
                whole -= 1
            if whole:  # all cells but the last are complete
                yield search(np.array(held_cids[:whole]), held[:whole], _run_ends(held_cells[:whole]))
                held_cells, held_cids, held = held_cells[whole:], held_cids[whole:], held[whole:]
        if held_cells:
            yield search(np.array(held_cids), held, _run_ends(held_cells))

    return cells.mapInArrow(run, "src long, dst long")


def _run_ends(cells: list[tuple]) -> np.ndarray:
    return np.array([i + 1 for i in range(len(cells)) if i + 1 == len(cells) or cells[i + 1] != cells[i]])


def jaccard_components(
    docs: DataFrame, words: int, percent: int, cell_grams: int = CELL_GRAMS, broadcast_rows: int = BROADCAST_ROWS
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``: components
    of the documents whose sets of ``words``-grams have a Jaccard similarity of
    ``percent`` or more."""
    signed = stored(keyed_sets(docs, words, percent).withColumn("rid", F.monotonically_increasing_id()), "ngram-sets")
    filled = signed.where("n > 0")
    classes = filled.groupBy("n", "fp1", "fp2").agg(
        F.min("rid").alias("cid"), F.min("doc_id").alias("min_doc"), F.count("*").alias("rows")
    )
    classes = stored(classes, "ngram-classes")
    ids = classes.select(F.col("cid").alias("rid"), "cid")
    reps = filled.join(ids, "rid")
    # keys are read again from the sets where they are used, not written anew
    dealt = stored(_blocks(reps.select("cid", F.explode("keys").alias("key")), broadcast_rows), "ngram-blocks")
    need = reps.select("cid", "doc_id", "n", "fp1", "fp2").join(dealt, "cid")
    sets = stored(_sets(docs, need, words), "ngram-grams")
    comps = connected_components(_links(sets, percent, cell_grams)).withColumnsRenamed({"node": "cid", "component": "comp"})
    known = classes.join(comps, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    known = stored(known, "ngram-known")
    least = known.groupBy("comp").agg(F.min("min_doc").alias("component_id"), F.count("*").alias("m"))
    known = split_join(known, stored(least, "ngram-least"), "comp", "m", broadcast_rows)
    key = F.struct("n", "fp1", "fp2")
    named = stored(known.select(key.alias("set"), "component_id", "rows"), "ngram-named")
    rows = signed.select("doc_id", "n", key.alias("set"))
    found = split_join(rows.where("n > 0"), named, "set", "rows", broadcast_rows // 10)
    empty = rows.where("n = 0").withColumn("component_id", F.col("doc_id"))
    return found.unionByName(empty).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
