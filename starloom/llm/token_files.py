"""Token files: ORC with run-length encoded ids, row indexes and Bloom filters.

Documents are range-partitioned and sorted by doc_id, encoded, and written by
Spark's ORC writer (integer run-length encoding is ORC's own).  Row indexes
hold each stride's smallest and largest doc_id, Bloom filters its ids, so a
lookup prunes files, stripes and strides from metadata, and stripes are read
in parallel.  A file holds one range, and its part number is its place, so
the position of a document in the whole token stream is the sum of the files
before it plus its place in its own file, which is stored with it.

Edge cases: a null text is empty and has only the end id; rows of one doc_id
are ordered by a hash of their text, equal rows in any order (their positions
differ); a null doc_id comes first; a very long text is one row; an empty
table gives files without rows; columns other than doc_id and text are not
written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.library_tokens import library_table, vocabulary

SLICE = 512  # rows encoded at a time, which bounds a worker's memory
STRIDE = 1000  # rows between entries of the row index
SCHEMA = "doc_id long, place long, n_tokens long, tokens array<int>"


def with_end(values: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Ids and offsets with ``end_id`` after each text."""
    if end_id is None:
        return values, offsets
    return np.insert(values, offsets[1:], end_id), offsets + np.arange(len(offsets))


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int | None) -> DataFrame:
    """(doc_id, place, n_tokens, tokens) in the order of the rows; ``place``
    counts the ids before the document in its partition."""
    vocab = vocabulary(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = library_table(vocab.value)
        place = 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                values, offsets = with_end(*table.encode_array(batch.column(1)), end_id)
                tokens = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), pa.array(values.view("<i4")))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(place + offsets[:-1]), pa.array(np.diff(offsets)), tokens],
                    names=["doc_id", "place", "n_tokens", "tokens"],
                )
                place += int(offsets[-1])

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(
        run, SCHEMA
    )


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = None) -> None:
    """Write ``docs`` (doc_id, text) to ``path`` in ascending doc_id order."""
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    laid = docs.select("doc_id", "text").repartitionByRange(*order).sortWithinPartitions(*order)
    (
        encoded(laid, tokenizer_path, end_id)
        .write.option("compression", "zstd")
        .option("orc.row.index.stride", STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", 0.01)
        .orc(path)
    )


def _rows_and_bases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows with their file's part number, and the ids before each part."""
    rows = spark.read.schema(SCHEMA).orc(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("int")
    rows = rows.withColumn("part", part)
    sums = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return rows, sums.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, tokens): every document with its position in
    the whole stream, from the files."""
    rows, base = _rows_and_bases(spark, path)
    return rows.join(base, "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "tokens"
    )


def lookup(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Rows of some documents; the filter reaches the ORC reader, which skips
    files, stripes and strides by statistics and Bloom filters."""
    return spark.read.schema(SCHEMA).orc(path).where(F.col("doc_id").isin(doc_ids))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the stored ids.  The ids are
    reduced to their checksum where they are read, before any join."""
    rows, base = _rows_and_bases(spark, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("tokens")
            values = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
            at = (np.asarray(lists.offsets) * 4).tolist()
            crc = [zlib.crc32(values[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "place", "n_tokens", "part")), pa.array(crc, type=pa.int64())],
                names=["doc_id", "place", "n_tokens", "part", "ids_crc32"],
            )

    digests = rows.select("doc_id", "place", "n_tokens", "part", "tokens").mapInArrow(
        run, "doc_id long, place long, n_tokens long, part int, ids_crc32 long"
    )
    return digests.join(base, "part").select(
        "doc_id", (F.col("base") + F.col("place")).alias("start"), "n_tokens", "ids_crc32"
    )
