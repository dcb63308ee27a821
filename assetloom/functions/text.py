"""Text decoding."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.StringType())
def lenient_utf8(content: pa.Array) -> pa.Array:
    """UTF-8 text of binary content without undecodable bytes.

    The built-in decoders raise on bad bytes or replace them, so this one is an Arrow function.
    """
    return pa.array([None if b is None else b.decode("utf-8", "ignore") for b in content.to_pylist()], pa.string())


def decode_lenient(content: Column) -> Column:
    """UTF-8 text of binary content: undecodable bytes are dropped, CR LF and CR become LF."""
    return F.regexp_replace(lenient_utf8(content), r"\r\n?", "\n")


def sql_literal(value: str) -> str:
    """A literal for SQL."""
    return "'" + value.replace("'", "''") + "'"
