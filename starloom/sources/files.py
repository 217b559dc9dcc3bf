"""Sources and sinks."""

from __future__ import annotations

import os
import re
import urllib.parse
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from starloom.session import stage

# Separators after which a shared file-name prefix is cut.
PREFIX_SEPARATORS = (" - ", " – ", "_", " ")
TABLE_EXTENSIONS = (".csv", ".txt", ".parquet")


def common_prefix(names: Sequence[str]) -> str:
    """Text that all file names start with, up to its last separator if it
    has one.  One file (or none) has no prefix."""
    if len(names) < 2:
        return ""
    shared = os.path.commonprefix(list(names))
    ends = [m.end() for sep in PREFIX_SEPARATORS for m in re.finditer(re.escape(sep), shared)]
    return shared[: max(ends, default=len(shared))]


def table_names(files: Sequence[str]) -> dict[str, str]:
    """File name -> table name (base name minus the shared prefix)."""
    prefix = common_prefix(list(files))
    out = {}
    for f in files:
        base = os.path.splitext(os.path.basename(f))[0]
        out[f] = (base.replace(prefix, "", 1) if prefix else base).strip()
    return out


def _literal(path: str) -> str:
    """A path as a reader takes it, where some letters would be a pattern."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any store that Spark reads: its files, and the
    folders that hold files; hidden ones (``_``, ``.``) are left out.  It is
    the listing that a reader plans with, no task runs."""
    try:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(_literal(path)).inputFiles()
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"source folder not found: {path}") from e
        raise
    scheme = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:/*")
    folder = "/" + scheme.sub("", path).strip("/") + "/"
    plain = ("/" + scheme.sub("", urllib.parse.unquote(f)) for f in found)
    return sorted({f.split(folder, 1)[1].split("/", 1)[0] for f in plain if folder in f})


def _has_long_rows(spark: SparkSession, path: str) -> bool:
    """Whether a quoted cell of a CSV file goes on in the next line, that is,
    whether some line holds an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"')))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """A CSV table as raw text (header row, UTF-8, comma, doubled quotes).

    ``multi_line``: whether cells may hold line ends, so that a file is read as
    a whole by one task.  By default that is measured by a scan of the lines;
    files without such cells are split.  (Spark reads files as a whole by
    patterns, so their names must not hold ``[``, ``{``, ``*`` or ``?``.)"""
    path = _literal(path)
    if multi_line is None:
        multi_line = _has_long_rows(spark, path)
    reader = spark.read.option("header", True).option("inferSchema", False).option("multiLine", multi_line)
    return reader.option("encoding", "UTF-8").option("escape", '"').csv(path)


def load_folder(
    spark: SparkSession,
    path: str,
    extensions: Iterable[str] = TABLE_EXTENSIONS,
    multi_line: bool | None = None,
) -> dict[str, DataFrame]:
    """Every ``.csv``/``.txt``/``.parquet`` file of a folder becomes a table.

    The folder may lie in any store that Spark reads.  CSV is read raw
    (:func:`read_csv`, all values strings); :func:`~starloom.operators.typed.typed_model`
    gives its columns types.  Raises ``FileNotFoundError`` for a missing folder.
    """
    exts = tuple(e.lower() for e in extensions)
    # plain files, or folders of part files that Spark itself wrote (name.csv/)
    files = [f for f in list_folder(spark, path) if f.lower().endswith(exts)]
    names = table_names(files)
    root = path.rstrip("/")
    return {
        names[f]: spark.read.parquet(_literal(f"{root}/{f}"))
        if f.lower().endswith(".parquet")
        else read_csv(spark, f"{root}/{f}", multi_line)
        for f in files
    }


def load_tables(spark: SparkSession, sf_dir: str, names: Sequence[str]) -> dict[str, DataFrame]:
    """Load ``<sf_dir>/<name>.parquet`` for each name (the driver tables)."""
    return {n: spark.read.parquet(os.path.join(sf_dir, f"{n}.parquet")) for n in names}


def sample_load(df: DataFrame, n: int = 1) -> DataFrame:
    """``FIRST n``: a cheap structural load of n rows."""
    return df.limit(n)


def qualify(df: DataFrame, table: str) -> DataFrame:
    """``QUALIFY *``: prefix every column with ``<table>.``."""
    return df.withColumnsRenamed({c: f"{table}.{c}" for c in df.columns})


def unqualify(df: DataFrame, table: str) -> DataFrame:
    """Undo :func:`qualify`."""
    p = f"{table}."
    return df.withColumnsRenamed({c: c[len(p):] for c in df.columns if c.startswith(p)})


def resident(df: DataFrame) -> DataFrame:
    """Load from a table already in the model, which is written once for
    all that read it (unlike cached rows it outlives a lost executor)."""
    return stage(df, "resident")


def inline_table(spark: SparkSession, rows: Sequence[Sequence], schema: StructType | str) -> DataFrame:
    """Literal rows."""
    return spark.createDataFrame(list(rows), schema)


def distinct_load(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``LOAD DISTINCT cols``."""
    return df.select(*cols).distinct()


def save_model(
    model: dict[str, DataFrame],
    path: str,
    partition_by: dict[str, Sequence[str]] | None = None,
) -> dict[str, str]:
    """Write every table of the model as parquet under ``path/<table>``,
    replacing what was there.  Returns table -> written path."""
    out = {}
    for name, df in model.items():
        target = os.path.join(path, name.replace("%", "").replace("/", "_"))
        w = df.write.mode("overwrite")
        cols = (partition_by or {}).get(name)
        if cols:
            w = w.partitionBy(*cols)
        w.parquet(target)
        out[name] = target
    return out


def read_model(spark: SparkSession, saved: dict[str, str]) -> dict[str, DataFrame]:
    """Read back what :func:`save_model` wrote."""
    return {n: spark.read.parquet(p) for n, p in saved.items()}
