"""Sources and sinks: folders of CSV/parquet files, literal tables, model persistence."""

from starloom.sources.files import (
    common_prefix,
    distinct_load,
    inline_table,
    list_folder,
    load_folder,
    load_tables,
    qualify,
    read_csv,
    read_model,
    resident,
    sample_load,
    save_model,
    table_names,
    unqualify,
)
from starloom.sources.versions import ModelStore

__all__ = [
    "ModelStore",
    "common_prefix",
    "distinct_load",
    "inline_table",
    "list_folder",
    "load_folder",
    "load_tables",
    "qualify",
    "read_csv",
    "read_model",
    "resident",
    "sample_load",
    "save_model",
    "table_names",
    "unqualify",
]
