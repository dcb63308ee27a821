"""Sharding along a Hilbert curve.  DataFrame functions only.

Each metadata dimension is quantised to ``2**bits`` steps at its own quantiles, the cell's place on
the curve is the sort key, and the sorted rows are cut into runs of equal row counts.  Rows near on
the curve agree in all dimensions, so each run's files have narrow ranges in each and a filter on
any of them skips files.

Positions are counted without a global sort in one task: quantiles of the sort key cut the order
into segments, exact counts of the segments (as many as there are shuffle partitions) give each
segment's first position, and rows are numbered within their segment.  The quantiles decide only
how even the segments are, never the result.  The key ends in a hash, so the rows of one cell,
however many, fall into many segments.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import col, written

#: Low bits of the sort key: of a hash of the row's values, and of one that tells repeated rows apart.
_VALUE_BITS, _ROW_BITS = 32, 16
#: Segments a shuffle partition numbers, and the most there are.
_SEGMENTS, _MOST_SEGMENTS = 4, 4096


def hilbert_index(df: DataFrame, axes: list[str], bits: int, out: str) -> DataFrame:
    """``df`` with the curve index of its cell (columns ``axes``, each from 0 to 2**bits - 1) as column ``out``.

    Skilling's transform (2004), one projection a step.
    """
    n = len(axes)
    x = [f"{out}_{i}" for i in range(n)]
    df = df.select("*", *[F.col(a).cast("long").alias(b) for a, b in zip(axes, x, strict=True)])
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            first, own = F.col(x[0]), F.col(x[i])
            high = own.bitwiseAND(1 << b) != 0
            swap = first.bitwiseXOR(own).bitwiseAND(low)
            new_first = F.when(high, first.bitwiseXOR(F.lit(low))).otherwise(first.bitwiseXOR(swap))
            df = df.withColumns({x[0]: new_first} if i == 0 else {x[0]: new_first, x[i]: F.when(high, own).otherwise(own.bitwiseXOR(swap))})
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    flip = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        flip = flip.bitwiseXOR(F.when(F.col(x[-1]).bitwiseAND(1 << b) != 0, F.lit((1 << b) - 1)).otherwise(F.lit(0)).cast("long"))
    df = df.withColumn(f"{out}_t", flip)
    index = F.lit(0).cast("long")
    for b in range(bits):
        for i in range(n):
            bit = F.shiftright(F.col(x[i]).bitwiseXOR(F.col(f"{out}_t")), b).bitwiseAND(1)
            index = index.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - i))
    return df.withColumn(out, index).drop(*x, f"{out}_t")


def text_steps(df: DataFrame, dimensions: list[str], steps: int) -> dict[str, list[tuple[str, int]]]:
    """For each string column its cuts: (least value, step) of each step that a value has, whole values compared.

    A value's step is the share of rows with a smaller value, out of ``steps``.  Values are counted
    first, so a hot one is one row from then on; they are put in order by ranges, and the ranges' counts
    (as many as there are shuffle partitions) give what comes before each.  Nulls have no step.
    """
    values = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("d"), F.col(c).alias("value")) for i, c in enumerate(dimensions)])).alias("x")).select("x.*").filter("value IS NOT NULL")
    counted = values.groupBy("d", "value").agg(F.count("*").alias("n"))
    ranged = written(counted.repartitionByRange("d", "value").withColumn("part", F.spark_partition_id()), "hilbert-ranges")
    total, before = [0] * len(dimensions), [[] for _ in dimensions]
    for d, part, n in sorted(map(tuple, ranged.groupBy("d", "part").agg(F.sum("n")).collect())):
        before[d] += [total[d]] * (part + 1 - len(before[d]))
        total[d] += n
    own = lambda lists: F.element_at(F.array(*[F.array(*[F.lit(x).cast("long") for x in ns or [0]]) for ns in lists]), F.col("d") + 1)
    inside = F.coalesce(F.sum("n").over(W.partitionBy("d", "part").orderBy("value").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    place = F.element_at(own(before), F.col("part") + 1) + inside
    stepped = ranged.withColumn("place", place).withColumn("all", F.element_at(own([[n] for n in total]), 1)).withColumn("step", F.expr(f"({steps} * place) div all"))
    cuts: dict[str, list[tuple[str, int]]] = {}
    for d, step, value in sorted(map(tuple, stepped.groupBy("d", "step").agg(F.min("value")).collect())):  # as many as there are steps
        cuts.setdefault(dimensions[d], []).append((value, step))
    return cuts


def cells(df: DataFrame, texts: dict[str, str], numbers: dict[str, Column], bits: int) -> tuple[DataFrame, list[str]]:
    """``df`` with each dimension (name -> string column, name -> number; null lowest) as its step from 0 to 2**bits - 1, at quantiles over all rows; their names.

    A value that spans several quantiles skips their steps, so few values still use the whole axis.
    A dimension without any value is left out: it tells no rows apart, and the optimizer would
    fold its constant steps through the whole curve.
    """
    steps = 1 << bits
    cuts = [i / steps for i in range(1, steps)]
    by_text = text_steps(df, list(texts.values()), steps) if texts else {}
    found = df.agg(*[F.percentile_approx(c, cuts, 1000).alias(n) for n, c in numbers.items()]).first() if numbers else {}
    there = [n for n, c in texts.items() if c in by_text] + [n for n in numbers if found[n]]
    for name in there:
        step = F.lit(0)
        if name in texts:
            least = 0
            for value, at in by_text[texts[name]]:
                step = step + F.when(F.col(texts[name]) >= F.lit(value), F.lit(at - least)).otherwise(F.lit(0))
                least = at
        else:
            for cut, n in sorted(Counter(found[name] or ()).items()):
                step = step + F.when(numbers[name] > F.lit(cut), F.lit(n)).otherwise(F.lit(0))
        df = df.withColumn(name, step)
    return df, there


def _passed(value: Column, cuts: list[int]) -> Column:
    """How many of the sorted ``cuts`` are below ``value``: first among every 64th, then within one run."""
    if not cuts:
        return F.lit(0)
    runs = [cuts[i : i + 64] for i in range(0, len(cuts), 64)]
    below = lambda a: F.size(F.filter(a, lambda x: x < value))
    longs = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    run = below(longs([r[0] for r in runs]))
    inside = below(F.element_at(F.array(*[longs(r) for r in runs]), F.greatest(run, F.lit(1))))
    return F.greatest(run - 1, F.lit(0)) * 64 + inside


def hilbert_shards(df: DataFrame, key: str = "doc_id", text: str = "text", dimensions: tuple[str, ...] = ("lang", "source"), shards: int = 16, bits: int = 5) -> DataFrame:
    """(key, size, text_crc32, shard, slot, curve) for each row of ``df``.

    Dimensions are the named columns, compared as whole strings, and the text's size.  Shards are runs
    of the curve with row counts at most one apart; slot counts the rows of a shard from 0 along the
    curve.  size: the text's UTF-8 bytes plus 1; a null text counts as empty, its text_crc32 is 0 like
    that of no bytes.  Null dimensions are lowest, and a null key is a value like others.  Rows
    need not be unique: rows that agree in all of these may take each other's place.  Very long
    texts are read whole, and other columns, whatever their names, play no part.  An empty table
    gives no row.
    """
    if (len(dimensions) + 1) * bits + _VALUE_BITS + _ROW_BITS > 63:
        raise ValueError("too many dimensions or bits for a sort key of 63 bits")
    body = F.coalesce(col(text).cast("binary"), F.lit(b""))
    slim = df.select(col(key).alias("key"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), F.monotonically_increasing_id().alias("row"), *[col(d).cast("string").alias(f"d{i}") for i, d in enumerate(dimensions)])
    slim = written(slim, "hilbert")
    placed, axes = cells(slim, {f"a{i}": f"d{i}" for i in range(len(dimensions))}, {f"a{len(dimensions)}": F.col("size")}, bits)
    placed = hilbert_index(placed, axes, bits, "curve") if axes else placed.withColumn("curve", F.lit(0).cast("long"))
    value = F.shiftrightunsigned(F.xxhash64("key", "text_crc32", "size"), 64 - _VALUE_BITS)
    row = F.shiftrightunsigned(F.xxhash64("row"), 64 - _ROW_BITS)
    order = F.shiftleft("curve", _VALUE_BITS + _ROW_BITS).bitwiseOR(F.shiftleft(value, _ROW_BITS)).bitwiseOR(row)
    placed = placed.select("key", "size", "text_crc32", "row", "curve", order.alias("order"))
    n = min(_MOST_SEGMENTS, _SEGMENTS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = placed.agg(F.percentile_approx("order", [i / n for i in range(1, n)], 2 * n)).first()[0]
    placed = placed.withColumn("segment", _passed(F.col("order"), sorted(set(cuts or ()))))
    starts, total = {}, 0
    for segment, count in sorted(map(tuple, placed.groupBy("segment").count().collect())):  # n rows at most
        starts[segment], total = total, total + count
    start = F.element_at(F.array(*[F.lit(starts.get(i, 0)).cast("long") for i in range(max(starts, default=0) + 1)]), F.col("segment") + 1)
    within = W.partitionBy("segment").orderBy("order", "key", "text_crc32", "size", "row")
    placed = placed.withColumn("place", F.row_number().over(within).cast("long") - 1 + start)
    placed = placed.withColumn("shard", F.expr(f"place * {shards} div {max(total, 1)}"))
    first = F.expr(f"(shard * {max(total, 1)} + {shards - 1}) div {shards}")
    return placed.select(F.col("key").alias(key), "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("place") - first).alias("slot"), "curve")


def op9_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in 16 shards along the curve over language, source and size."""
    found = hilbert_shards(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source"))
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


QUERIES = {"op9_hilbert": op9_hilbert}

ORACLE_SQL: dict[str, str] = {}
