"""Best-fit packing by the sum-of-squares rule (Csirik et al., 2006).

Documents become token pieces of at most ``capacity`` tokens; a piece goes where the sum of the
squared numbers of open sequences per residual gap becomes smallest.  Every task packs what it has
tokenized.  Sequences that end up with a gap above ``slack`` are opened again, and their pieces,
written to the shared folder, are packed once more in larger pools of ``pool`` pieces, so what a
task leaves half full meets the leftovers of others.  Only piece lengths and positions move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .shared import batch, col, each_text, written
from .wordcode import default_path, library_words

CAPACITY = 2048
#: Gap up to which a sequence packed by the first round is final.
SLACK = 0
#: Pieces that a task of the last round packs together.
POOL = 16_000


class SumOfSquares:
    """Open sequences by gap.  ``place`` gives (sequence, offset) for a piece of some length."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.made = capacity, 0
        self.count = np.zeros(capacity + 1, np.int64)  # open sequences with this gap
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        count, capacity = self.count, self.capacity
        if length == capacity:
            self.made += 1
            return self.made - 1, 0
        # Half of what the sum of squares changes by, if gap g becomes g - length: count[g - length] - count[g] + 1;
        # a full sequence no longer counts, and a new one costs count[capacity - length] + 1/2.
        change = count[:-length] - count[length:] + 1.0
        change[0] = 0.5 - count[length]
        change[count[length:] == 0] = np.inf
        change[-1] = count[capacity - length] + 0.5
        g = int(change.argmin()) + length
        if g == capacity:
            sequence, self.made = self.made, self.made + 1
        else:
            sequence = self.open[g].pop()
            count[g] -= 1
        if g > length:
            self.open[g - length].append(sequence)
            count[g - length] += 1
        return sequence, capacity - g


def pack(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece and the gap of each sequence.  Long pieces are placed first."""
    rule, n = SumOfSquares(capacity), len(lengths)
    sequence, offset = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in np.argsort(-np.asarray(lengths, np.int64), kind="stable").tolist():
        sequence[i], offset[i] = rule.place(lengths[i])
    filled = np.bincount(sequence, weights=lengths, minlength=rule.made).astype(np.int64) if n else np.zeros(0, np.int64)
    return sequence, offset, capacity - filled


def pack_documents(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = 0, slack: int = SLACK, pool: int = POOL) -> DataFrame:
    """One row per piece: key, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids by the tokenizers library followed by ``end_id``; only those longer than
    ``capacity`` are cut.  Null and empty texts are the one token ``end_id``.  Rows need not be
    unique and keys may be null or of any type: each row is packed.  An empty table gives no row.
    """
    path = path or default_path()
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), *[T.StructField(n, t) for n, t in (("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("sequence_id", T.LongType()), ("offset", T.LongType()), ("final", T.BooleanType()))]])
    out = to_arrow_schema(schema)
    end = end_id.to_bytes(4, "little")

    def placed(columns: list[list], base: int, closed: int) -> pa.RecordBatch:
        sequence, offset, gaps = pack(columns[3], capacity)
        return batch(out, [*columns, base + sequence, offset, gaps[sequence] <= closed])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, columns = library_words(path), [[], [], [], [], []]
        for b in batches:
            for k, ids in zip(b.column(0).to_pylist(), words.encode(each_text([b.column(1)])), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for c, x in zip(columns, (k, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(x)
        if columns[0]:
            yield placed(columns, TaskContext.get().partitionId() << 32, slack)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns[:5]), strict=True)]
        if rows:
            rows.sort(key=lambda r: (r[0] is None, 0 if r[0] is None else r[0], r[1:]))
            yield placed([list(c) for c in zip(*rows, strict=True)], 1 << 62 | TaskContext.get().partitionId() << 32, capacity)

    packed = written(df.select(col(key), col(text)).mapInArrow(first, schema), "packing")
    again = packed.filter("not final")
    pools = max(1, -(-again.count() // pool))
    done = packed.filter("final").unionByName(again.repartition(pools).mapInArrow(last, schema))
    return done.drop("final").withColumnRenamed("key", key)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` as pieces in sequences of at most 2048 tokens."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op1_packing": op1_packing}

ORACLE_SQL: dict[str, str] = {}
