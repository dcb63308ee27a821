"""SimHash near-dedup by an inverted index over byte positions with count filtering.

A fingerprint is eight bytes.  Fingerprints that differ in at most ``d`` bits differ in at most
``d`` bytes, so they share at least ``m = 8 - d`` bytes in place: the guaranteed minimum.  Postings
of single bytes would each hold a 256th of the corpus, so the index has postings of ``m - 1`` bytes
in place instead: of all choices of positions the fewest of which every choice of ``m`` holds one
(for d = 4 the 20 triples of Turan's system), so two that share ``m`` bytes meet.  In a posting the
shared positional bytes of each pair are tallied, pairs that reach the minimum are kept, and their
bit distance is verified.

A posting too large for one task is handed on: its pairs share a further byte, so it is dealt again
by each of the other positions, and where that doesn't do by nibbles, of which they share four of
eight.  Two such steps leave 65,536 different fingerprints at most, whatever the corpus.

Equal fingerprints are one node, and a posting gives a spanning forest of its links rather than
all its pairs: the classes are the same, and a group of n copies costs n - 1 edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import Forest, components
from .shared import col, fresh, raw, row_hash, written

#: Nodes of a task's forest before it is handed on.
FOREST_NODES = 500_000
#: Fingerprints of a posting that a task compares; larger ones are dealt again.
POSTING = 8_192


def simhash(text: bytes, words: int = 4, seed: int = 42) -> int:
    """The fingerprint of a whole text, unsigned: bit set if it is in over half the shingles' hashes."""
    tokens = text.lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps + 1).tolist()]
    ends = [*gaps[words - 1 :].tolist(), len(joined)]
    digest, total, counts = xxhash.xxh64_intdigest, len(ends), np.zeros(64, np.int64)
    for at in range(0, total, 65_536):
        hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts[at : at + 65_536], ends[at : at + 65_536], strict=False)], "<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total, bitorder="little").tobytes(), "little")


def fingerprints(text: Column, words: int = 4) -> Column:
    """The signed 64-bit fingerprint of a string column; null counts as empty (fingerprint 0)."""

    @F.arrow_udf(T.LongType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array(np.array([simhash(t, words) for t in raw(a)], np.uint64).view(np.int64))

    return of(text.cast("binary"))


def covering(n: int, m: int) -> list[tuple[int, ...]]:
    """Choices of ``m - 1`` of ``n`` places, few of them, such that every choice of ``m`` holds one.

    Turan's system for m = 4: three classes, and the triples within one or with two places of one and
    one of the next.  Else all choices.
    """
    if m != 4:
        return list(combinations(range(n), m - 1))
    size = -(-n // 3)
    of = [i // size for i in range(n)]

    def chosen(places: tuple[int, ...]) -> bool:
        held = sorted(of[p] for p in places)
        return len(set(held)) == 1 or any(held.count(c) == 2 and held.count((c + 1) % 3) == 1 for c in range(3))

    return [p for p in combinations(range(n), 3) if chosen(p)]


def _mask(places: tuple[int, ...], width: int) -> int:
    return sum((1 << width) - 1 << width * p for p in places)


def masks(bits: int) -> list[int]:
    """The index: the bits of a fingerprint that each kind of posting goes by."""
    return [_mask(c, 8) for c in covering(8, 8 - bits)] if bits < 7 else list(narrower(0, bits))


@cache
def narrower(mask: int, bits: int) -> tuple[int, ...]:
    """The kinds of postings that a posting of this kind is dealt into when it is too large; none if it can't be.

    Pairs within ``bits`` that agree in ``mask`` agree in one of these.  Up to the guaranteed minimum
    of bytes: one more byte.  Then, as at most ``bits`` of the other nibbles differ, the choices
    of nibbles that every set of the rest holds, and one more nibble.
    """
    free = [p for p in range(8) if not mask >> 8 * p & 255]
    if len(free) == bits + 1:
        return tuple(mask | 255 << 8 * p for p in free)
    nibbles = [p for p in range(16) if not mask >> 4 * p & 15]
    least = len(nibbles) - bits  # nibbles that are shared besides
    if len(nibbles) == 2 * bits and least > 1:
        return tuple(mask | sum(15 << 4 * nibbles[i] for i in c) for c in covering(len(nibbles), least))
    if least == 1 and len(nibbles) > 1:
        return tuple(mask | 15 << 4 * p for p in nibbles)
    return ()


def links(prints: DataFrame, bits: int = 4, posting: int = POSTING) -> DataFrame:
    """Edges (u, v) between distinct fingerprints of ``prints`` (fp) that connect whatever is linked within ``bits``.

    A task holds ``posting`` fingerprints of a posting; what is larger is written and dealt again.
    """
    if not 0 <= bits <= 7:
        raise ValueError("bits must be from 0 to 7: beyond, no byte need be shared")
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    kinds = F.array(*[F.lit(signed(m)).cast("long") for m in masks(bits)])
    waiting, edges = prints.select(F.explode(kinds).alias("mask"), "fp"), None
    while waiting is not None:
        found = written(_met(waiting, bits, posting), "simhash-links")
        own = found.filter("mask IS NULL").select("u", "v")
        edges = own if edges is None else edges.unionByName(own)
        rest = found.filter("mask IS NOT NULL")
        waiting = None if rest.isEmpty() else rest.select("mask", F.col("u").alias("fp")).distinct()
    return edges


def _met(postings: DataFrame, bits: int, posting: int) -> DataFrame:
    """(u, v, mask): the edges that postings give; where mask isn't null, u is to be posted anew under it."""
    key = F.col("fp").bitwiseAND(F.col("mask"))
    dealt = postings.select("mask", key.alias("key"), "fp").repartition("mask", "key").sortWithinPartitions("mask", "key")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("mask", pa.int64())])

    def rows(u: np.ndarray, v: np.ndarray | None, mask: np.ndarray | None) -> pa.RecordBatch:
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), none if v is None else pa.array(v, pa.int64()), none if mask is None else pa.array(mask, pa.int64())], schema=schema)

    def handed_on(mask: int, prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        for kind in narrower(mask & (1 << 64) - 1, bits):
            yield rows(prints, None, np.full(len(prints), kind, np.uint64).view(np.int64))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, rest, large = Forest(), None, None  # large: the posting that is being handed on
        for b in batches:
            now = np.stack([b.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)])
            if large is not None:
                n = int(((now[0] == large[0]) & (now[1] == large[1])).sum())
                yield from handed_on(large[0], now[2, :n])
                now = now[:, n:]
                large = large if not now.shape[1] else None
            if rest is not None:
                now = np.concatenate([rest, now], axis=1)
            if not now.shape[1]:
                continue
            change = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            bounds = np.concatenate([[0], change, [now.shape[1]]])
            last = int(bounds[-2])  # the last posting may go on in the next batch
            for s in _verify(now[2], bounds[:-1], bits, forest, posting, now[0]):
                yield from handed_on(int(now[0, bounds[s]]), now[2, bounds[s] : bounds[s + 1]])
            rest = now[:, last:]
            if rest.shape[1] > posting and narrower(int(rest[0, 0]) & (1 << 64) - 1, bits):
                large = (int(rest[0, 0]), int(rest[1, 0]))
                yield from handed_on(large[0], rest[2])
                rest = None
            if len(forest.parent) > FOREST_NODES:
                yield rows(*forest.edges(), None)
                forest = Forest()
        if rest is not None and rest.shape[1]:
            _verify(rest[2], np.array([0, rest.shape[1]]), bits, forest, rest.shape[1], rest[0])
        yield rows(*forest.edges(), None)

    return dealt.mapInArrow(meet, "u long, v long, mask long")


def linked(prints: np.ndarray, other: np.ndarray | np.uint64, bits: int) -> np.ndarray:
    """Whether pairs of fingerprints are within ``bits``: those that share fewer bytes in place than guaranteed are left out by the tally, the rest are verified."""
    differ = prints ^ other
    low = differ | differ >> np.uint64(4)
    low |= low >> np.uint64(2)
    low |= low >> np.uint64(1)
    shared = 8 - np.bitwise_count(low & np.uint64(0x0101010101010101))
    near = shared >= 8 - bits
    near[near] = np.bitwise_count(differ[near]) <= bits
    return near


def _verify(prints: np.ndarray, bounds: np.ndarray, bits: int, forest: Forest, posting: int, masks: np.ndarray) -> list[int]:
    """Link what is within ``bits`` in each posting ``prints[bounds[i]:bounds[i + 1]]``; the postings that are too large for that and can be dealt again."""
    sizes = np.diff(bounds)
    starts, prints = bounds[:-1], prints.view(np.uint64)
    two = starts[sizes == 2]
    near = linked(prints[two], prints[two + 1], bits)
    for x, y in zip(prints[two][near].view(np.int64).tolist(), prints[two + 1][near].view(np.int64).tolist(), strict=True):
        forest.link(x, y)
    large = []
    for i in np.flatnonzero(sizes > 2).tolist():
        s, n = int(starts[i]), int(sizes[i])
        if n > posting and narrower(int(masks[s]) & (1 << 64) - 1, bits):
            large.append(i)
        else:
            _span(prints[s : s + n], bits, forest)
    return large


def _span(prints: np.ndarray, bits: int, forest: Forest) -> None:
    """Grow trees over one posting: each found member looks only among those not yet found. Repeats of a fingerprint are found with it."""
    left = prints
    while len(left) > 1:
        found, left = [left[0]], left[1:]
        while found and len(left):
            at = found.pop()
            near = linked(left, at, bits)
            if near.any():
                for x in left[near]:
                    if x != at:
                        forest.link(int(at.view(np.int64)), int(x.view(np.int64)))
                        found.append(x)
                left = left[~near]


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """(key, fp, row_hash, component, component_id) for each row of ``df``.

    Rows link if their fingerprints differ in at most ``bits`` bits; component: the smallest
    fingerprint reachable, component_id: the smallest key there (null only where all are null).
    Null text is the empty text; texts without a word have fingerprint 0 and link like others.
    Very long texts are read whole.  Rows need not be unique; row_hash tells rows of one key apart, by
    all columns, of whatever type and name.  An empty table gives no row.
    """
    slim = df.select(col(key).alias("key"), fingerprints(col(text), words).alias("fp"), row_hash(df).alias("row_hash"))
    slim = written(slim, "simhash")
    classes = slim.groupBy("fp").agg(F.min("key").alias("low"))
    roots = components(links(classes.select("fp"), bits))
    rooted = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "low", F.coalesce("root", "fp").alias("component"))
    # Written, so that the join has an exchange of its own on both sides and a large component can be split.
    lows = written(rooted.groupBy("component").agg(F.min("low").alias("component_id")), "simhash-lows")
    labels = rooted.join(lows, "component").select("fp", "component", "component_id")
    return slim.join(labels, "fp")


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component one row of the smallest key stays.

    Null keys come last.  Rows that agree in every column count as one.  Odd rows: see ``near_duplicates``.
    """
    return keep_heads(df, key, near_duplicates(df, key, text, words, bits))


def keep_heads(df: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Of each component of ``found`` (key, row_hash, component), which labels the rows of ``df``, one row of the smallest key."""
    found = written(found, "simhash-found")
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row_hash"))
    heads = found.groupBy("component").agg(first.alias("h")).select("h.key", "h.row_hash")
    copies = found.groupBy("key", "row_hash").count()
    heads = heads.alias("h").join(copies.alias("c"), F.col("h.key").eqNullSafe(F.col("c.key")) & (F.col("h.row_hash") == F.col("c.row_hash")))
    heads = written(heads.select(F.col("h.key").alias("k"), F.col("h.row_hash").alias("r"), "count"), "simhash-heads")
    r, k, h, n, i = (fresh(df, x) for x in ("_r", "_k", "_h", "_n", "_i"))
    heads = heads.select(F.col("k").alias(k), F.col("r").alias(h), F.col("count").alias(n))
    hashed = df.withColumn(r, row_hash(df))

    def of(which: Column) -> DataFrame:
        return hashed.join(heads.filter(which), (F.col(r) == F.col(h)) & col(key).eqNullSafe(F.col(k)))

    single = of(F.col(n) == 1).select(*[col(c) for c in df.columns])
    if heads.filter(F.col(n) > 1).isEmpty():
        return single
    # Rows that agree in every column: any one of them. A row number, as maps can't be compared.
    several = of(F.col(n) > 1).withColumn(i, F.row_number().over(W.partitionBy(h, k).orderBy(F.lit(0))))
    return single.unionByName(several.filter(F.col(i) == 1).select(*[col(c) for c in df.columns]))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of ``documents`` with its fingerprint and the class it belongs to."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op10_simhash": op10_simhash}

ORACLE_SQL: dict[str, str] = {}
