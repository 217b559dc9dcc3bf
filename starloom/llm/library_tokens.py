"""Ids of whole texts by the tokenizers library, inside Spark tasks.

The vocabulary file is read once on the driver and sent as a broadcast (its
size is that of the file, a few megabytes), so executors need no such file.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

import numpy as np
from pyspark.sql import SparkSession

from starloom.llm.chunks import ChunkTable

#: parts encoded as one string; long strings were measured slower
JOINED = 128

_tables: dict[tuple, ChunkTable] = {}


def vocabulary(spark: SparkSession, path: str):
    """The tokenizer file's text as a broadcast."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))


def library_table(text: str) -> ChunkTable:
    """The worker's chunk table for a tokenizer file's text."""
    key = (len(text), hash(text))
    if key not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        spec = json.loads(text)
        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        blanks = "Split" not in json.dumps(spec.get("pre_tokenizer"))

        def one_by_one(parts: list[str]) -> list[bytes]:
            found = tokenizer.encode_batch_fast(parts, add_special_tokens=False)
            return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

        # A mark that is a token of its own wherever it stands: many parts are
        # encoded in one call and told apart by its id.
        mark = "\n" if blanks else "0"
        mark_ids = tokenizer.encode(mark, add_special_tokens=False).ids

        def many(parts: list[str]) -> list[bytes]:
            if len(mark_ids) != 1:
                return one_by_one(parts)
            out: list[bytes] = [b""] * len(parts)
            plain = [i for i, p in enumerate(parts) if mark not in p and p.strip()]
            other = sorted(set(range(len(parts))).difference(plain))
            for at in range(0, len(plain), JOINED):
                some = plain[at : at + JOINED]
                joined = mark.join([parts[i] for i in some])
                ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
                marks = np.flatnonzero(ids == mark_ids[0])
                if len(marks) != len(some) - 1:
                    other += some
                    continue
                raw = ids.tobytes()
                starts = np.concatenate(([0], marks + 1)) * 4
                ends = np.append(marks, len(ids)) * 4
                for i, s, e in zip(some, starts.tolist(), ends.tolist(), strict=True):
                    out[i] = raw[s:e]
            for i, ids in zip(other, one_by_one([parts[i] for i in other]), strict=True):
                out[i] = ids
            return out

        def whole(one: str) -> bytes:
            return np.array(tokenizer.encode(one, add_special_tokens=False).ids, dtype="<u4").tobytes()

        specials = [t["content"] for t in spec.get("added_tokens", [])]
        _tables[key] = ChunkTable(many, whole, blanks, specials)
    return _tables[key]
