"""What the operators share: intermediate tables, spill files, row identity, Arrow helpers.

Intermediate tables are Parquet in the folder that the cluster names in ``spark.checkpoint.dir``,
so a lost executor never takes the only copy of a result along, and a re-run of a task reads the
same rows.  ``released`` deletes those made inside it.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import delete, released, scratch, written

__all__ = ["ASCII_SPACE", "batch", "col", "delete", "dropped", "each_text", "fresh", "raw", "reachable", "released", "row_hash", "scratch", "spill_folder", "squeeze", "texts", "written"]

#: Runs of these six characters separate words wherever a contract says ``[\\x20\\x09-\\x0D]+``;
#: they are also what ``bytes.split()`` splits at.
ASCII_SPACE = b" \t\n\r\x0b\x0c"


def reachable(spark: SparkSession) -> SparkSession:
    """The session, its Python workers told where this package lies.

    Workers on a cluster need the package installed or shipped; those that share the driver's files
    then find it even if the driver only extended its own ``sys.path``.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
    return spark


def dropped(df: DataFrame) -> None:
    """Delete a table that ``written`` made and that nothing is read from any more."""
    if files := df.inputFiles():
        delete(df.sparkSession, files[0].rsplit("/", 1)[0])


def spill_folder() -> str | None:
    """A local directory of Spark's for a task's spill files; the system's where Spark names none."""
    named = [d for d in os.environ.get("SPARK_LOCAL_DIRS", "").split(",") if os.path.isdir(d)]
    return named[os.getpid() % len(named)] if named else None


def _holds_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, T.StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, (T.MapType, T.VariantType))


def row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of all columns of a row. Maps and variants, which have no hash of their own, count as their JSON text."""
    return F.xxhash64(*[F.to_json(F.struct(col(f.name))) if _holds_map(f.dataType) else col(f.name) for f in df.schema])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have (Spark compares names without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(array: pa.Array) -> list[str]:
    """Strings of an Arrow column; null is the empty text, undecodable bytes become U+FFFD."""
    try:
        return [t or "" for t in array.to_pylist()]
    except UnicodeDecodeError:
        return [(b or b"").decode("utf-8", "replace") for b in raw(array)]


def raw(array: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of an Arrow column; null is empty."""
    if pa.types.is_string(array.type):
        array = array.cast(pa.binary())
    elif pa.types.is_large_string(array.type):
        array = array.cast(pa.large_binary())
    return [b or b"" for b in array.to_pylist()]


def each_text(batches: Iterable[pa.Array], rows: int = 256) -> Iterator[str]:
    """The strings of Arrow columns, decoded a few rows at a time."""
    for a in batches:
        for at in range(0, len(a), rows):
            yield from texts(a.slice(at, rows))


def squeeze(text: bytes) -> bytes:
    """Replace each run of ASCII white space by one space; a run at an end stays as one space."""
    words = text.split()
    if not words:
        return b" " if text else b""
    out = b" ".join(words)
    if text[0] in ASCII_SPACE:
        out = b" " + out
    return out + b" " if text[-1] in ASCII_SPACE else out


def batch(schema: pa.Schema, columns: Iterable) -> pa.RecordBatch:
    """A record batch of ``schema`` from one sequence or array per column."""
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)
