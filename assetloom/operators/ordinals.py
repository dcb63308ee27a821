"""Dense positions without a sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written

#: ``monotonically_increasing_id`` counts a partition's rows in these low bits, from 0.
_ROW_BITS = 33


def arrival(path: str = "_metadata.file_path", at: str = "_metadata.file_block_start", when: str | None = None) -> Column:
    """Where a row of a file source stands: (time of the file, if asked for,) file, block, row.

    To be selected right above the scan.  Spark packs files into tasks by size, so ids alone don't
    give the order of files; within a block they do give the order of rows.
    """
    time = [F.col(when).alias("time")] if when else []
    return F.struct(*time, F.col(path).alias("file"), F.col(at).alias("block"), F.monotonically_increasing_id().alias("row"))


def dense(df: DataFrame, ordinal: str | tuple[str, ...] = "ordinal", out: str = "position", start: int = 0) -> DataFrame:
    """``df`` with a position from ``start`` on, in the order of the columns ``ordinal``, which tell all rows apart.

    Rows are dealt by ranges of the ordinal, sorted within, and written once with their place in
    their range; the ranges' counts, one number each, give what comes before.
    """
    by = (ordinal,) if isinstance(ordinal, str) else ordinal
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    placed = written(placed, "ordinals")
    part = F.shiftright("_at", _ROW_BITS)
    before: list[int] = []
    total = start
    for p, n in sorted(map(tuple, placed.groupBy(part.alias("p")).count().collect())):  # one row a range
        before += [0] * (p + 1 - len(before))
        before[p], total = total, total + n
    first = F.element_at(F.lit(before) if before else F.array(F.lit(0)), part.cast("int") + 1)
    return placed.withColumn(out, first.cast("long") + F.col("_at").bitwiseAND((1 << _ROW_BITS) - 1)).drop("_at")


def first_seen(df: DataFrame, key: str = "url", ordinal: str = "ordinal") -> DataFrame:
    """(position, key): each distinct key at its first place, positions dense from 0.

    The first place is a min-aggregation: it combines before the shuffle, so a key on many rows costs no more.
    """
    firsts = df.groupBy(key).agg(F.min(ordinal).alias("ordinal"))
    return dense(firsts, "ordinal").select("position", key)
