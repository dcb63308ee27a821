"""Exact top-k by inner product: a ball tree per shard, searched by branch and bound.

Candidates are dealt into shards, and each shard's tree is built once and written.  Queries visit
the shards in waves: in the first each query one shard, chosen by its hash, then 3 more, 12 more,
and so on, so that every shard has work in every wave.  Within a tree nodes come in the order of
their upper bound ``q . centre + |q| * radius``, until that falls below the current kth score; the
kth score over all shards so far is what a query starts the next wave with.

Results are exact.  Components are whole numbers in doubles.  Where their products fit a double
the scores are computed there; else the doubles only choose the rows that may be among the best,
with room for their error, and Python's integers give the scores.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import batch, col, dropped, written

LEAF = 128
#: Rows of a shard at least, shards up to which that holds, and components of a shard at most: beyond, shards grow, as each costs a copy of the queries.
SHARD_ROWS, SHARDS, SHARD_VALUES = 8_192, 64, 1 << 22
#: Shards that a query has visited grow by this factor from wave to wave.
WAVE = 4
#: Whole numbers up to here are exact in a double.
_EXACT = float(1 << 53)
#: Powers of two from which vectors are scaled down, so that squares stay finite.
_LARGE = 400
#: Scores that no long holds: the column holds the long next to them, and these bytes, the score plus an offset, tell them apart.
_LEAST, _MOST, _OFFSET, _BYTES = -(1 << 63), (1 << 63) - 1, 1 << 2160, 272
_SCORE = "score long, beyond binary"


def _scaled(vectors: np.ndarray) -> tuple[np.ndarray, int, float]:
    """The vectors over a power of two, that power, and the largest component as it was."""
    top = float(np.abs(vectors).max()) if vectors.size else 0.0
    shift = max(0, math.frexp(top)[1] - _LARGE)
    return (np.ldexp(vectors, -shift) if shift else vectors), shift, top


class BallTree:
    """Nodes over rows of whole-number vectors: centre, radius, children or a range of rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        whole, (scaled, self.shift, self.top) = vectors, _scaled(vectors)
        order = np.arange(len(ids))
        centres, radii, spans, children = [], [], [], []
        waiting = [(0, len(ids), -1, 0)]
        while waiting:
            lo, hi, parent, side = waiting.pop()
            part = scaled[order[lo:hi]]
            centre = part.mean(axis=0)
            radius = float(np.sqrt(((part - centre) ** 2).sum(axis=1).max()))
            me = len(centres)
            centres.append(centre)
            radii.append(radius)
            spans.append((lo, hi))
            children.append([-1, -1])
            if parent >= 0:
                children[parent][side] = me
            if hi - lo > leaf and radius > 0:
                far = part[int(((part - centre) ** 2).sum(axis=1).argmax())]
                other = part[int(((part - far) ** 2).sum(axis=1).argmax())]
                half = (hi - lo) // 2
                cut = np.argpartition(part @ (other - far), half)
                order[lo:hi] = order[lo:hi][cut]
                waiting += [(lo, lo + half, me, 0), (lo + half, hi, me, 1)]
        self.ids, self.vectors = ids[order], scaled[order]
        self.whole = whole[order] if self.shift else self.vectors
        self.centres, self.radii, self.spans, self.children = np.array(centres), np.array(radii), spans, children
        self.reach = float(np.sqrt((self.vectors**2).sum(axis=1).max()))

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """(score, id) of the ``k`` best rows whose id isn't ``own`` and whose score may reach ``floor``."""
        q, shift, top = _scaled(query)
        shift += self.shift
        length = float(np.sqrt(q @ q))
        exact = not shift and self.top * top * len(query) < _EXACT
        # Rounding takes far less than this off a product of the two lengths.
        room = 1e-9 * (length * self.reach + 1)
        bounds = self.centres @ q + length * self.radii + room
        below = 0.0 if exact else room
        low = -math.inf if floor is None else floor / (1 << shift) - below
        best: list[tuple[int, int]] = []  # a heap of (score, -id), worst first
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < low:
                break
            left, right = self.children[node]
            if left >= 0:
                for child in (left, right):
                    if bounds[child] >= low:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            lo, hi = self.spans[node]
            scores = self.vectors[lo:hi] @ q
            near = np.flatnonzero(scores >= low)
            if exact and len(near) > 4 * k:  # a leaf of equal vectors can be large; its own row may be among the best
                near = near[np.lexsort((self.ids[lo + near], -scores[near]))[: k + int(np.count_nonzero(self.ids[lo + near] == own))]]
            for i in near.tolist():
                if (other := int(self.ids[lo + i])) != own:
                    score = int(scores[i]) if exact else sum(int(a) * int(b) for a, b in zip(self.whole[lo + i].tolist(), query.tolist(), strict=True))
                    item = (score, -other)
                    if len(best) < k:
                        heapq.heappush(best, item)
                    elif item > best[0]:
                        heapq.heapreplace(best, item)
            if len(best) == k:
                low = max(low, best[0][0] / (1 << shift) - below)
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def quantised(vector: Column) -> Column:
    """floor(256 * x) of each component as a double, which holds it exactly; null for a vector that is null or holds null or a non-finite component.

    Doubles beyond 7e305 times 256 are no longer finite; such vectors are null, too.
    """
    whole = lambda y: F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)
    scaled = F.transform(vector, lambda x: F.lit(256.0) * x.cast("double"))
    sound = vector.isNotNull() & F.forall(scaled, lambda y: y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")))
    return F.when(sound, F.transform(scaled, whole))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), dim)


def _stored(score: int) -> tuple[int, bytes | None]:
    """The columns score and beyond."""
    if _LEAST < score < _MOST:
        return score, None
    return (_MOST if score > 0 else _LEAST), (score + _OFFSET).to_bytes(_BYTES, "big")


def top_k(df: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "v", k: int = 5, shard_rows: int | None = None) -> DataFrame:
    """(query_id, rank, key, score): for each row of ``queries`` the ``k`` rows of ``df`` with the highest inner product.

    Both have ``key`` (long) and ``vector`` (array of whole numbers that doubles hold
    exactly, of any size).  Rows with the query's key are its own and no candidates; ties go to the smaller key.
    Rows with a null key or vector, or an empty one, take no part, vectors of different lengths aren't
    compared, and rows need not be unique: repeated candidates are each a result, and repeated
    queries are answered once for each distinct vector.  Ranks are by the exact score; a score that
    no long holds is shown as the largest or smallest long.  Other columns, whatever their names, play
    no part.  An empty table gives no row.
    """
    sound = lambda d: d.select(col(key).alias("id"), col(vector).cast("array<double>").alias("v")).filter("id IS NOT NULL AND size(v) > 0").withColumn("dim", F.size("v"))
    asked = sound(queries).distinct().withColumn("qid", F.xxhash64("id", "v"))
    rows = sound(df)
    # A row for each length of vector, so how many shards there are is joined to the rows.
    size = F.lit(shard_rows) if shard_rows else F.greatest(F.lit(64), F.least(F.greatest(F.lit(SHARD_ROWS), F.ceil(F.col("n") / SHARDS)), F.floor(F.lit(SHARD_VALUES) / F.col("dim"))))
    lengths = written(rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.ceil(F.col("n") / size).cast("int").alias("shards")), "lengths")
    most, total = lengths.agg(F.coalesce(F.max("shards"), F.lit(0)), F.coalesce(F.sum("shards"), F.lit(0))).first()
    # Repeated rows would share a hash of their values, so their place in the input decides.
    dealt = rows.withColumn("place", F.xxhash64(F.monotonically_increasing_id())).join(lengths, "dim").select("dim", F.pmod("place", "shards").cast("int").alias("shard"), "id", "v")
    trees = written(_trees(dealt, max(total, 1)), "trees")
    asked = written(asked.join(lengths, "dim"), "asked")
    best = df.sparkSession.createDataFrame([], f"qid long, query_id long, id long, {_SCORE}, rank int")
    low, high = 0, 1
    while low < most:
        floors = best.filter(F.col("rank") == k).select("qid", F.col("query_id").alias("id"), "score", "beyond")
        now = asked.filter(F.col("shards") > low).join(floors, ["qid", "id"], "left")
        now = now.withColumn("visit", F.explode(F.sequence(F.lit(low), F.least(F.lit(high), F.col("shards")) - 1)))
        now = now.select("dim", F.pmod(F.pmod("qid", "shards") + F.col("visit"), "shards").cast("int").alias("shard"), "qid", "id", "v", "score", "beyond")
        found = best.drop("rank").unionByName(_searched(trees, now, k, total))
        order = W.partitionBy("qid", "query_id").orderBy(F.desc("score"), F.desc("beyond"), "id")
        before, best = best, written(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "top-k")
        dropped(before)
        low, high = high, high * WAVE
    return best.select("query_id", "rank", F.col("id").alias(key), "score")


def _trees(rows: DataFrame, shards: int) -> DataFrame:
    """(dim, shard, tree): each shard's tree."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        tree = BallTree(table["id"].combine_chunks().to_numpy(zero_copy_only=False), _matrix(table["v"].combine_chunks(), dim))
        return pa.table([pa.array([dim], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([pickle.dumps(tree, -1)], pa.binary())], names=["dim", "shard", "tree"])

    return rows.repartition(shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, tree binary")


def _searched(trees: DataFrame, asked: DataFrame, k: int, shards: int) -> DataFrame:
    """Each row of ``asked`` (with its shard and the kth score so far) answered from that shard: qid, query_id, id, score, beyond.

    A shard's tree comes first and its queries stream past it, however many.
    """
    fields = pa.schema([("qid", pa.int64()), ("query_id", pa.int64()), ("id", pa.int64()), ("score", pa.int64()), ("beyond", pa.binary())])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, at = None, None
        for b in batches:
            out: list[tuple] = []
            for dim, shard, data, qid, own, v, score, beyond in zip(*(c.to_pylist() if n != 5 else c for n, c in enumerate(b.columns)), strict=True):
                if data is not None:
                    tree, at = pickle.loads(data), (dim, shard)
                elif at == (dim, shard):
                    floor = int.from_bytes(beyond, "big") - _OFFSET if beyond is not None else score
                    out += [(qid, own, other, *_stored(s)) for s, other in tree.search(np.asarray(v.values, np.float64), own, k, floor)]
            if out:
                yield batch(fields, zip(*out, strict=True))

    both = asked.withColumn("tree", F.lit(None).cast("binary")).unionByName(trees, allowMissingColumns=True)
    both = both.select("dim", "shard", "tree", "qid", "id", "v", "score", "beyond")
    return both.repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", F.col("tree").isNull()).mapInArrow(answer, f"qid long, query_id long, id long, {_SCORE}")


def op8_balltree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all ``embeddings`` for every row whose vec_id is divisible by 50."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", quantised(F.col("embedding")).alias("v"))
    return top_k(rows, rows.filter("vec_id % 50 = 0"))


QUERIES = {"op8_balltree": op8_balltree}

ORACLE_SQL = {
    "op8_balltree": f"""
        WITH good AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score
            FROM good q JOIN good c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
        )
        SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, CAST(greatest(least(score, {_MOST}::HUGEINT), {_LEAST}::HUGEINT) AS BIGINT) AS score FROM ranked WHERE r <= 5
    """,
}
