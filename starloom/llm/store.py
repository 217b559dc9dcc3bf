"""Shared-folder helpers: intermediate tables and file outputs.

Every intermediate is a Parquet table in the folder that
``spark.checkpoint.dir`` names, which driver and executors share, so a lost
executor never loses lineage-free data.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from starloom.session import ensure_checkpoint_dir


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below the session's checkpoint folder (not created)."""
    base = re.sub(r"^file:/+", "file:///", str(ensure_checkpoint_dir(spark)))
    if base.startswith("/"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of that table."""
    path = shared_folder(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, most: int) -> Iterator[None]:
    """Jobs run meanwhile hand rows to Python workers in Arrow batches that are
    closed at ``most`` bytes: a worker and its executor each hold whole batches."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def reach_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That serves local runs and machines with the same layout; elsewhere the
    package is installed or passed with ``--py-files``."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
