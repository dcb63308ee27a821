"""The cluster's shared folder, intermediate tables, versioned tables, and the session settings the engine relies on."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .schemas import MIGRATIONS, TABLES

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.variable.substitute": "false", "spark.sql.adaptive.enabled": "true"}

_own: list[str] = []
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def configure(spark: SparkSession) -> SparkSession:
    """Set what results depend on: UTC, and no substitution of ``${...}`` inside SQL text."""
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    return spark


# ---- intermediate tables -----------------------------------------------------------------------


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one on this machine only where none is named and the master is local."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="assetloom-"))
    return "file://" + _own[0]


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; ``released`` deletes what was made inside it."""
    path = f"{shared_folder(spark)}/assetloom/{tag}-{uuid.uuid4().hex}"
    made = _made.get()
    if made is not None:
        made.append(path)
    return path


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts lineage, fixes the rows.

    The result's columns can be pruned and its filters pushed down, unlike those of a checkpoint.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables made inside are deleted at the end; whatever is to outlive them must be stored by then.

    Each use has a list of its own, so nested and parallel ones don't take each other's tables.
    """
    made: list[str] = []
    before = _made.set(made)
    try:
        yield
    finally:
        _made.reset(before)
        for path in made:
            delete(spark, path)


# ---- files -------------------------------------------------------------------------------------


def _at(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _at(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _at(spark, path)
    fs.delete(p, True)


def names(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder, sorted; none if it isn't there."""
    fs, p = _at(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def put(spark: SparkSession, path: str, head: str = "", parts: str | None = None, cut: int = 0, tail: str = "", replace: bool = True) -> None:
    """Make a file of a head, the part files of the folder ``parts`` in order without their last ``cut`` bytes, and a tail.

    Bytes go from stream to stream.  The file is made beside its place and renamed, so it appears
    whole; without ``replace`` one that is there already is an error.
    """
    fs, target = _at(spark, path)
    _, fresh = _at(spark, f"{path}.new-{uuid.uuid4().hex}")
    out = fs.create(fresh, False)
    try:
        out.write(bytearray(head.encode()))
        if parts is not None:
            source, folder = _at(spark, parts)
            files = sorted((s for s in source.listStatus(folder) if s.getPath().getName().startswith("part-")), key=lambda s: s.getPath().getName())
            left = sum(s.getLen() for s in files) - cut
            for s in files:
                take, left = min(s.getLen(), max(left, 0)), left - s.getLen()
                if take:
                    stream = source.open(s.getPath())
                    try:
                        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, take)
                    finally:
                        stream.close()
        out.write(bytearray(tail.encode()))
    finally:
        out.close()
    if replace and fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(fresh, target):
        fs.delete(fresh, True)
        raise OSError(f"could not put a file at {path}")


def text_of(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _at(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


# ---- tables in versions ------------------------------------------------------------------------


def _versions(spark: SparkSession, folder: str) -> list[str]:
    return [n for n in names(spark, f"{folder}/_versions") if n.endswith(".json")]


def current(spark: SparkSession, folder: str) -> dict[str, str]:
    """The tables of the newest version: name -> path."""
    found = _versions(spark, folder)
    return json.loads(text_of(spark, f"{folder}/_versions/{found[-1]}")) if found else {}


def stage(df: DataFrame, folder: str, name: str) -> str:
    """Write a table's next state beside the current one; it counts only from ``publish`` on."""
    path = f"{folder}/{name}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def publish(spark: SparkSession, folder: str, tables: dict[str, str]) -> None:
    """Make a version in which ``tables`` are at these paths and all others stay where they are.

    A version is one small file, put in place by one rename: readers see all of it or nothing, and
    a crash before it changes nothing.  Of two writers that start from the same version the second
    fails, and may try again.
    """
    found = _versions(spark, folder)
    number = int(found[-1].removesuffix(".json")) + 1 if found else 1
    put(spark, f"{folder}/_versions/{number:012d}.json", json.dumps(current(spark, folder) | tables, indent=1), replace=False)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete all but the newest ``keep`` versions and the table states only they refer to; how many states went."""
    found = _versions(spark, folder)
    old, new = found[: -max(keep, 1)], found[-max(keep, 1) :]
    paths = lambda versions: {p for v in versions for p in json.loads(text_of(spark, f"{folder}/_versions/{v}")).values()}
    gone = paths(old) - paths(new)
    for v in old:
        delete(spark, f"{folder}/_versions/{v}")
    for path in gone:
        delete(spark, path)
    return len(gone)


def read_or_empty(spark: SparkSession, path: str | None, schema: StructType, form: str = "parquet") -> DataFrame:
    """The table at ``path``; an empty one of that schema if there is none."""
    if path is None or not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).format(form).load(path)


def open_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the newest version; empty if it isn't there yet."""
    return read_or_empty(spark, current(spark, folder).get(name), TABLES[name])


def open_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of the newest version by name; those not there are empty."""
    at = current(spark, folder)
    return {name: read_or_empty(spark, at.get(name), schema) for name, schema in TABLES.items()}


def swap(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Replace one table by ``df``, which may read the old state, in a version of its own."""
    spark = df.sparkSession
    publish(spark, folder, {name: stage(df, folder, name)})
    return open_table(spark, folder, name)


def migrate(spark: SparkSession, folder: str) -> tuple[str, ...]:
    """Bring a folder of tables up to the newest set; what was applied now.

    All missing tables, empty, and the record of what was applied come in one version.
    """
    record = open_table(spark, folder, "schema_migrations")
    done = {r.version for r in record.collect()}  # as many rows as there are migrations
    applied = tuple(v for v, _ in MIGRATIONS if v not in done)
    if applied:
        at = current(spark, folder)
        missing = [t for v, tables in MIGRATIONS if v in applied for t in tables if t not in at]
        made = {t: stage(spark.createDataFrame([], TABLES[t]), folder, t) for t in missing}
        now = spark.createDataFrame([(v,) for v in applied], "version string").withColumn("applied_at", F.current_timestamp())
        made["schema_migrations"] = stage(record.unionByName(now).coalesce(1), folder, "schema_migrations")
        publish(spark, folder, made)
    return applied
