"""DataFrame front of the rank-array BPE (see ``bpe``)."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.bpe import encoder
from starloom.llm.library_tokens import vocabulary
from starloom.llm.token_files import SLICE


def _by_slices(docs: DataFrame, tokenizer_path: str, schema: str, columns) -> DataFrame:
    vocab = vocabulary(docs.sparkSession, tokenizer_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocab.value)
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                found = columns(bpe, batch.column(1))
                yield pa.RecordBatch.from_arrays([batch.column(0), *found.values()], names=["doc_id", *found])

    return docs.mapInArrow(run, schema)


def encode_texts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids): ids of every whole text as little-endian 32-bit integers."""

    def columns(bpe, texts) -> dict:
        return {"ids": pa.array(bpe.encode_array(texts), type=pa.binary())}

    return _by_slices(docs.select("doc_id", "text"), tokenizer_path, f"doc_id {dict(docs.dtypes)['doc_id']}, ids binary", columns)


def decode_ids(rows: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def columns(bpe, ids) -> dict:
        return {"text": pa.array([bpe.decode(x or b"") for x in ids.to_pylist()], type=pa.string())}

    return _by_slices(rows.select("doc_id", "ids"), tokenizer_path, f"doc_id {dict(rows.dtypes)['doc_id']}, text string", columns)


def round_trip_digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): every text encoded, and
    its ids decoded again, in one pass."""

    def columns(bpe, texts) -> dict:
        ids = bpe.encode_array(texts)
        return {
            "n_tokens": pa.array([len(x) // 4 for x in ids], type=pa.int64()),
            "ids_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            "decoded_sha256": pa.array([hashlib.sha256(bpe.decode(x).encode()).hexdigest() for x in ids]),
        }

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _by_slices(rows, tokenizer_path, schema, columns)
