"""Declared schemas of the stored tables, and a check of required columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

FILES = T.StructType.fromDDL("id BIGINT, path STRING, language STRING, hash STRING, chars BIGINT, project STRING, indexed_at TIMESTAMP")
SYMBOLS = T.StructType.fromDDL(
    "id BIGINT, file_id BIGINT, parent_id BIGINT, merged_into BIGINT, kind STRING, native_kind STRING, name STRING, qualified_name STRING, namespace STRING, signature STRING, "
    "doc STRING, start_line INT, end_line INT, exported BOOLEAN, is_partial BOOLEAN, chars BIGINT, value_type STRING"
)
IMPORTS = T.StructType.fromDDL(
    "id BIGINT, file_id BIGINT, kind STRING, spec STRING, names ARRAY<STRUCT<name: STRING, alias: STRING>>, alias STRING, is_global BOOLEAN, line INT, "
    "resolved_file_id BIGINT, resolved_namespace STRING, resolved_symbol_id BIGINT"
)
EDGES = T.StructType.fromDDL("id BIGINT, file_id BIGINT, from_symbol_id BIGINT, type STRING, name STRING, qualifier STRING, receiver_type STRING, instantiates BOOLEAN, line INT, to_symbol_id BIGINT")
PARTS = T.StructType.fromDDL("symbol_id BIGINT, file_id BIGINT, start_line INT, end_line INT")
USAGE = T.StructType.fromDDL("t STRING, client STRING, clientVersion STRING, event STRING, tools BOOLEAN, reason STRING, tool STRING, args STRING, ms BIGINT, chars BIGINT, error STRING")


def require(df: DataFrame, *columns: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
