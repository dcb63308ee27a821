"""Exact dedup by Grace hashing: partition, spill, and compare complete content in a table.

Two rounds.  In the first each input task removes the copies within its own split, so however hot
a text is, at most one of its rows leaves a task.  Those leading rows are written once to the
shared folder; in the second they are dealt by content hash and every bucket is resolved the same
way across splits.  Either round keeps distinct contents in an open-addressing table; when they
outgrow ``budget_bytes`` the table and the rest of its input go to spill files by further bits of
the hash, and each file is resolved in turn, as often as needed.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import shutil
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import batch, col, spill_folder, squeeze, written

#: Distinct contents held in memory by a task before it spills.
BUDGET_BYTES = 64 << 20
FANOUT = 16
MAX_DEPTH = 12


class Table:
    """Open addressing with linear probing.  A slot leads to an entry: hash, content, value.

    Two records meet only if hash and complete content are equal.
    """

    def __init__(self) -> None:
        self.slots, self.mask, self.entries, self.size = [-1] * 1024, 1023, [], 0

    def merge(self, h: int, content: bytes, value, merge: Callable) -> None:
        slots, mask, entries = self.slots, self.mask, self.entries
        at = h & mask
        while (i := slots[at]) >= 0:
            entry = entries[i]
            if entry[0] == h and entry[1] == content:
                entry[2] = merge(entry[2], value)
                return
            at = (at + 1) & mask
        slots[at] = len(entries)
        entries.append([h, content, value])
        self.size += 2 * len(content) + 400
        if len(entries) * 2 > mask:
            self._grow()

    def _grow(self) -> None:
        self.mask = self.mask * 2 + 1
        self.slots = slots = [-1] * (self.mask + 1)
        for i, (h, _, _) in enumerate(self.entries):
            at = h & self.mask
            while slots[at] >= 0:
                at = (at + 1) & self.mask
            slots[at] = i


def grace(records: Iterator[tuple[int, bytes, object]], merge: Callable, budget: int = BUDGET_BYTES, depth: int = 0) -> Iterator[list]:
    """Entries [hash, content, merged value], one for each distinct content of ``records``.

    A bucket is split only while it holds several contents, so one endless content can't recurse.
    """
    table, files, folder = Table(), None, None
    shift = 64 - 4 * (depth + 1)
    try:
        for h, content, value in records:
            if files is None:
                table.merge(h, content, value, merge)
                if table.size > budget and len(table.entries) > 1 and depth < MAX_DEPTH:
                    folder = tempfile.mkdtemp(prefix="grace-", dir=spill_folder())
                    files = [open(os.path.join(folder, str(i)), "w+b") for i in range(FANOUT)]
                    for entry in table.entries:
                        pickle.dump(tuple(entry), files[entry[0] >> shift & 15], -1)
                    table = Table()
            else:
                pickle.dump((h, content, value), files[h >> shift & 15], -1)
        if files is None:
            yield from table.entries
            return
        for i, f in enumerate(files):
            f.seek(0)
            yield from grace(_unpickled(f), merge, budget, depth + 1)
            f.close()
            os.unlink(os.path.join(folder, str(i)))
    finally:
        for f in files or ():
            f.close()
        if folder:
            shutil.rmtree(folder, ignore_errors=True)


def _unpickled(f) -> Iterator:
    while True:
        try:
            yield pickle.load(f)
        except EOFError:
            return


def _order(key) -> tuple:
    """Order of keys: smallest first, null last."""
    return (key is None, key if key is not None else 0)


def exact_dedup(df: DataFrame, key: str = "doc_id", text: str = "text", budget_bytes: int = BUDGET_BYTES, normalise: Callable[[bytes], bytes] = squeeze) -> tuple[DataFrame, DataFrame]:
    """(flags, kept rows) of ``df``.  Texts are equal if ``normalise`` gives the same bytes.

    flags has one row for each row of ``df``: key, keep_id, group_size, kept, text_sha256.  Of
    equal texts the row with the smallest key stays; null keys come last, and of rows that share
    the smallest key just one stays.  keep_id is null only where every key of the group is null.
    Null text is the empty text.  Rows need not be unique, and columns of any name pass through to
    the kept rows.  An empty table gives empty results.
    """
    leaders = _leaders(df, key, text, budget_bytes, normalise)
    groups = _groups(leaders, df.columns.index(text), budget_bytes, normalise)
    members = leaders.select("rep", "lead", "key")
    won = F.col("lead") & (F.col("winner") == F.col("rep"))
    flags = members.join(groups, "rep").select("key", "keep_id", "group_size", won.alias("kept"), "text_sha256")
    winners = groups.filter("winner = rep").select("rep")
    rows = leaders.filter("lead").join(winners, "rep", "left_semi")
    return flags, rows.select(*[F.col(f"row.c{i}").cast(df.schema[c].dataType).alias(c) for i, c in enumerate(df.columns)])


def _leaders(df: DataFrame, key: str, text: str, budget: int, normalise: Callable) -> DataFrame:
    """Round one, written to the shared folder: rep (unique for each content of a task), lead, key, members, hash, row.

    Each row of ``df`` gives a row; only the leading one of a content carries its input row along.
    """
    plain = df.select(*[(col(c).cast("binary") if t == "string" else col(c)).alias(f"c{i}") for i, (c, t) in enumerate(df.dtypes)])
    k, t = df.columns.index(key), df.columns.index(text)
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("lead", T.BooleanType()), T.StructField("key", df.schema[key].dataType), T.StructField("members", T.LongType()), T.StructField("hash", T.LongType()), T.StructField("row", plain.schema)])
    out = to_arrow_schema(schema)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    content = normalise(row[t] or b"")
                    yield xxhash.xxh64_intdigest(content), content, (row[k], [], row)

        def merge(old: tuple, new: tuple) -> tuple:
            if _order(new[0]) < _order(old[0]):
                old, new = new, old
            old[1].append(new[0])
            old[1].extend(new[1])
            return old

        rep, held, rows = TaskContext.get().partitionId() << 33, 0, []
        for h, content, (own, others, row) in grace(records(), merge, budget):
            signed = h - (1 << 64) if h >> 63 else h
            rows.append((rep, True, own, 1 + len(others), signed, row))
            rows += [(rep, False, other, 0, signed, None) for other in others]
            rep, held = rep + 1, held + len(content)
            if held > (8 << 20) or len(rows) > 20_000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        *columns, packed = zip(*rows, strict=True)
        nested = out.field("row").type
        fields = [pa.array([None if r is None else r[i] for r in packed], f.type) for i, f in enumerate(nested)]
        none = pa.array([r is None for r in packed], pa.bool_())
        return batch(out, [*columns, pa.StructArray.from_arrays(fields, fields=list(nested), mask=none)])

    return written(plain.mapInArrow(resolve, schema), "dedup-leaders")


def _groups(leaders: DataFrame, text: int, budget: int, normalise: Callable) -> DataFrame:
    """Round two: for each leading row its group's winner (a rep), keep_id, group_size, text_sha256."""
    key = leaders.schema["key"].dataType
    schema = T.StructType([T.StructField("rep", T.LongType()), T.StructField("winner", T.LongType()), T.StructField("keep_id", key), T.StructField("group_size", T.LongType()), T.StructField("text_sha256", T.StringType())])
    out = to_arrow_schema(schema)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for b in batches:
                for rep, own, members, h, body in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    yield h & (1 << 64) - 1, normalise(body or b""), (_order(own), rep, members, [rep])

        def merge(old: tuple, new: tuple) -> tuple:
            first = min(old[:2], new[:2])
            old[3].extend(new[3])
            return (*first, old[2] + new[2], old[3])

        rows: list[tuple] = []
        for _, content, (best, winner, size, reps) in grace(records(), merge, budget):
            digest = hashlib.sha256(content).hexdigest()
            rows += [(rep, winner, None if best[0] else best[1], size, digest) for rep in reps]
            if len(rows) > 20_000:
                yield batch(out, zip(*rows, strict=True))
                rows = []
        if rows:
            yield batch(out, zip(*rows, strict=True))

    leading = leaders.filter("lead").select("rep", "key", "members", "hash", F.col(f"row.c{text}").alias("text"))
    return leading.repartition("hash").mapInArrow(resolve, schema)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with the row that stays for its text."""
    flags, _ = exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return flags.withColumnRenamed("key", "doc_id")


QUERIES = {"op2_exact_dedup": op2_exact_dedup}

ORACLE_SQL = {
    "op2_exact_dedup": r"""
        SELECT doc_id, keep_id, group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
        FROM (SELECT doc_id, t, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size
              FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents))
    """,
}
