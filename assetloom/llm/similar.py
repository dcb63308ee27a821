"""SimHash near-dedup at a similarity: the byte-position index, widened by MinHash keys, each pair verified on the texts.

The similarity of two texts is the Jaccard index of their sets of five-word shingles.  Pairs are
proposed in two ways.  The index of ``simhash.links`` tallies the bytes that two fingerprints of
these sets share and proposes those within a few bits.  That is sure for the closest only: at a
similarity of 0.8 fingerprints differ in about 10 of 64 bits, and beyond 7 no byte need be shared.
So a text is also posted under ``BANDS`` keys of ``ROWS`` minima of a hash over its set, each of
which two sets share with a probability of their similarity: two of 0.8 share no key with
probability (1 - 0.8 ** 6) ** 48, 5 in ten million; more similar ones miss each other more rarely.

Proposals only propose.  Texts that are connected by them form a group, and the pairs of a group
are compared on their full sets; those that reach the similarity are links.  Texts with equal sets
are one node.

A large group is cut into blocks, and each pair of blocks is a piece of work of its own, so no group
needs one task.  Beyond ``PAIRED`` blocks, whose pairs would be too many, each block is first compared
within itself, then the heads of the classes so found, in blocks again, as long as that halves them.
What is left is compared by pairs of blocks: classes larger than a block have blocks of their own,
which need no comparison with each other, and the other texts share blocks.  So a group of n copies
of one text costs n / 256 blocks, and the pairs of blocks are only those between classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import Forest, components
from .shared import col, fresh, raw, row_hash, written
from .simhash import FOREST_NODES, keep_heads, links

BANDS, ROWS = 48, 6
#: Members of a block, and members from which minima are compared before sets.
BLOCK, FEW = 256, 16
#: Blocks of a group up to which all their pairs are dealt at once.
PAIRED = 16
#: Pairs whose share of equal minima is this far below the similarity are not compared: over six standard deviations.
MARGIN = 0.15
#: Binary logarithm of the bits of the filter that keeps texts without a partner out of the shuffle.
_BITS = 23
#: Bytes of text hashed at once, and the length up to which a word is hashed by a polynomial; modulo 2**64 these are weak for long strings.
_AT_ONCE, _SHORT = 1 << 16, 256

_rng = np.random.default_rng(42)
_FACTORS, _TERMS = (_rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1) for _ in range(2))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93
_POWERS, _INVERSES = (np.multiply.accumulate(np.array([1] + [x] * (_AT_ONCE + _SHORT), np.uint64)) for x in (_BASE, pow(_BASE, -1, 1 << 64)))


def _mixed(x: np.ndarray) -> np.ndarray:
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
    return x ^ (x >> np.uint64(33))


def _words(tokens: list[bytes]) -> np.ndarray:
    """The hash of each word: differences of one running sum of bytes times powers, so no word is looked at alone."""
    lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if tokens else lengths
    data = np.frombuffer(b" ".join(tokens), np.uint8)
    out = np.empty(len(tokens), np.uint64)
    short = np.flatnonzero(lengths <= _SHORT)
    for i in np.flatnonzero(lengths > _SHORT).tolist():
        out[i] = xxhash.xxh64_intdigest(tokens[i])
    begins, ends = starts[short], starts[short] + lengths[short]
    at = 0
    while at < len(short):
        low = int(begins[at])
        to = int(np.searchsorted(begins, low + _AT_ONCE))
        part = data[low : int(ends[to - 1])]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(part)], out=sums[1:])
        b, e = begins[at:to] - low, ends[at:to] - low
        out[short[at:to]] = (sums[e] - sums[b]) * _INVERSES[b]
        at = to
    return out


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a whole text's shingles; a text of fewer words is one shingle."""
    tokens = text.lower().split()
    hashes = _words(tokens)
    total = max(len(tokens) - words + 1, 1)
    found = np.full(total, min(len(tokens), words), np.uint64)
    for i in range(min(len(tokens), words)):
        found = found * _STEP + hashes[i : i + total]
    return np.unique(_mixed(found))


def minima(shingle: np.ndarray) -> np.ndarray:
    """Of each of the hash functions the minimum over a set, in 32 bits, which vector instructions multiply."""
    found = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    half = (shingle >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(half), 256):
        hashes = half[at : at + 256, None] * _FACTORS
        hashes += _TERMS
        np.minimum(found, hashes.min(axis=0), out=found)
    return found


def majority(shingle: np.ndarray) -> int:
    """The SimHash fingerprint of a set, unsigned: bit set if it is in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingle), 65_536):
        part = shingle[at : at + 65_536].astype("<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingle), bitorder="little").tobytes(), "little")


def sketch(text: Column, words: int = 5) -> Column:
    """An array for a string column: the hash of its set of shingles, the set's fingerprint, then its keys."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            out = np.empty((len(a), BANDS + 2), np.uint64)
            low = np.empty((len(a), BANDS, ROWS), np.uint64)
            for i, t in enumerate(raw(a)):
                own = shingles(t, words)
                out[i, 0] = xxhash.xxh64_intdigest(own.tobytes())
                out[i, 1] = majority(own)
                low[i] = minima(own).reshape(BANDS, ROWS)
            key = np.tile(np.arange(BANDS, dtype=np.uint64), (len(a), 1))
            for part in range(ROWS):
                key = _mixed(key * _STEP + low[:, :, part])
            out[:, 2:] = key
            offsets = pa.array(np.arange(len(a) + 1, dtype=np.int32) * np.int32(BANDS + 2))
            yield pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1).view(np.int64)))

    return of(text.cast("binary"))


def among(hashes: DataFrame, row: Column) -> Column:
    """Whether a row hash may be one of ``hashes`` (row_hash): a filter of fixed size, which never refuses one that is."""
    place = F.col("row_hash").bitwiseAND((1 << _BITS) - 1)
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr("shiftleft(1L, cast(row_hash & 63 as int))").alias("bit"))
    bits = np.zeros(1 << _BITS - 6, np.int64)
    for word, found in words.groupBy("word").agg(F.bit_or("bit")).collect():  # 2**17 rows at most
        bits[word] = found

    @F.arrow_udf(T.BooleanType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            at = a.to_numpy(zero_copy_only=False) & ((1 << _BITS) - 1)
            yield pa.array((bits[at >> 6] >> (at & 63) & 1).astype(bool))

    return of(row)


def _edges(forest: Forest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x) for x in forest.edges()], ["u", "v"])


def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(band, fp, up) from (fp, bands): a posting for each band, up null; of a batch's nodes with one band all but the first are edges to it instead.

    So a band that many nodes have sends one posting a batch to the task that meets it.
    """
    for b in batches:
        if b.num_rows:
            bands = np.asarray(b.column(1).flatten(), np.int64)
            nodes = np.repeat(np.asarray(b.column(0), np.int64), BANDS)
            _, first, group = np.unique(bands, return_index=True, return_inverse=True)
            heads = first[group]
            again = heads != np.arange(len(bands))
            # An edge needs no meeting, so it goes anywhere: by its node.
            yield pa.RecordBatch.from_arrays([pa.array(np.where(again, nodes, bands)), pa.array(nodes), pa.array(nodes[heads], mask=~again)], ["band", "fp", "up"])


def proposed(nodes: DataFrame) -> DataFrame:
    """Edges (u, v) that connect the nodes (fp) of each key in common (bands) of ``nodes``."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, band, node = Forest(), None, None
        for b in batches:
            bands, nodes, ups = (np.asarray(b.column(i).fill_null(0), np.int64) for i in range(3))
            edge = np.asarray(b.column(2).is_valid())
            for x, y in zip(nodes[edge].tolist(), ups[edge].tolist(), strict=True):
                forest.link(x, y)
            bands, nodes = bands[~edge], nodes[~edge]
            if len(bands):
                if bands[0] == band:
                    forest.link(node, int(nodes[0]))
                for i in np.flatnonzero(bands[1:] == bands[:-1]).tolist():
                    forest.link(int(nodes[i]), int(nodes[i + 1]))
                band, node = bands[-1], int(nodes[-1])
            if len(forest.parent) > FOREST_NODES:
                yield _edges(forest)
                forest = Forest()
        yield _edges(forest)

    postings = nodes.select("fp", "bands").mapInArrow(_posted, "band long, fp long, up long")
    return postings.repartition("band").sortWithinPartitions("band").mapInArrow(meet, "u long, v long")


def compare(left: dict[int, np.ndarray], right: dict[int, np.ndarray] | None, similarity: float, forest: Forest) -> None:
    """Link the nodes of two blocks (or of one: ``right`` None), given with their sets, that reach the similarity."""
    others = left if right is None else right
    if not others:
        return
    nodes, sets = list(others), list(others.values())
    sizes = np.array([len(s) for s in sets])
    many = len(left) + len(others) > 2 * FEW
    low = lambda s: minima(s).astype(np.uint8)
    signs = np.array([low(s) for s in sets]) if many else None
    for n, (x, own) in enumerate(left.items()):
        may = np.minimum(sizes, len(own)) >= similarity * np.maximum(sizes, len(own)) - 1e-6
        if right is None:
            may[: n + 1] = False
        if many:
            at = np.flatnonzero(may)
            may[at] = (signs[at] == (signs[n] if right is None else low(own))).mean(axis=1) >= similarity - MARGIN
        for i in np.flatnonzero(may).tolist():
            if forest.find(x) == forest.find(nodes[i]):
                continue
            both = len(np.intersect1d(own, sets[i], assume_unique=True))
            if both / (len(own) + len(sets[i]) - both) >= similarity:
                forest.link(x, nodes[i])


def verified(dealt: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (u, v) between nodes of a group that reach the similarity and connect all that do.

    ``dealt``: (root, one, two, side, fp, text), a row for each pair of blocks (one, two) that a node is in; side tells its block.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, at, blocks = Forest(), None, ({}, {})
        for b in batches:
            places = zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)
            for (root, one, two, side, fp), text in zip(places, raw(b.column(5)), strict=True):
                if (root, one, two) != at:
                    if at:
                        compare(blocks[0], blocks[1] if at[1] != at[2] else None, similarity, forest)
                    at, blocks = (root, one, two), ({}, {})
                    if len(forest.parent) > FOREST_NODES:
                        yield _edges(forest)
                        forest = Forest()
                if fp not in blocks[side]:
                    blocks[side][fp] = shingles(text, words)
        if at:
            compare(blocks[0], blocks[1] if at[1] != at[2] else None, similarity, forest)
        yield _edges(forest)

    keys = ["root", "one", "two"]
    return dealt.select(*keys, "side", "fp", "text").repartition(*keys).sortWithinPartitions(*keys).mapInArrow(work, "u long, v long")


def _within(texts: DataFrame) -> DataFrame:
    """``texts`` (root, blocks, fp, text) dealt so that each block of a group is compared within itself."""
    own = F.pmod("fp", "blocks")
    return texts.select("root", own.alias("one"), own.alias("two"), F.lit(0).alias("side"), "fp", "text")


def _pairs(texts: DataFrame) -> DataFrame:
    """``texts`` (root, blocks, fp, text) dealt by all pairs of blocks of a group, a block with itself included."""
    own, other = F.pmod("fp", "blocks"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    both = texts.select("root", "fp", "text", own.alias("own"), other.alias("other"))
    return both.select("root", F.least("own", "other").alias("one"), F.greatest("own", "other").alias("two"), (F.col("own") > F.col("other")).cast("int").alias("side"), "fp", "text")


def _between(texts: DataFrame, labels: DataFrame) -> DataFrame:
    """``texts`` (root, fp, text) of groups dealt by pairs of blocks, but for those within one class of ``labels`` (fp, class).

    A unit is a class of more than ``BLOCK`` nodes, or what else the group has (unit 0, shared).
    """
    labels = labels.select("root", "fp", "class")
    sizes = labels.groupBy("root", "class").count().filter(F.col("count") > BLOCK).select("root", "class", F.lit(True).alias("own"))
    of = labels.join(sizes, ["root", "class"], "left").select("root", "fp", (~F.coalesce("own", F.lit(False))).alias("shared"), F.when(F.col("own"), F.col("class")).otherwise(F.lit(0)).alias("unit"))
    of = written(of, "similar-units")
    units = of.groupBy("root", "shared", "unit").count().select("root", "shared", "unit", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    units = written(units, "similar-unit-sizes")
    a, b = units.alias("a"), units.alias("b")
    place = lambda t: F.struct(f"{t}.shared", f"{t}.unit")
    met = a.join(b, "root").filter((place("a") < place("b")) | (F.col("a.shared") & F.col("b.shared")))
    met = written(met.select("root", *[F.col(f"{t}.{c}").alias(f"{c}_{t}") for t in "ab" for c in ("shared", "unit", "blocks")]), "similar-unit-pairs")
    placed = texts.select("fp", "text").join(of, "fp").withColumnsRenamed({"shared": "s", "unit": "c"})
    block = lambda t, n: F.struct(F.col(f"shared_{t}").alias("shared"), F.col(f"unit_{t}").alias("unit"), n.alias("n"))
    out = None
    for mine, other, side in (("a", "b", 0), ("b", "a", 1)):
        here = placed.join(met.withColumnRenamed("root", "r"), (F.col("root") == F.col("r")) & (F.col("s") == F.col(f"shared_{mine}")) & (F.col("c") == F.col(f"unit_{mine}")))
        here = here.withColumn("n", F.pmod("fp", f"blocks_{mine}")).withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"blocks_{other}") - 1)))
        # A unit's blocks meet each other once, and each itself once.
        alike = F.col("shared_a") & F.col("shared_b")
        here = here.filter(~alike | (F.col("n") <= F.col("m") if side == 0 else F.col("n") > F.col("m")))
        one, two = (("n", "m") if side == 0 else ("m", "n"))
        here = here.select("root", block("a", F.col(one)).alias("one"), block("b", F.col(two)).alias("two"), F.lit(side).alias("side"), "fp", "text")
        out = here if out is None else out.unionByName(here)
    return out


def _classes(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(root, fp, class) for each of ``members`` (root, fp): the smallest node that ``edges`` connect it with."""
    roots = components(edges).withColumnRenamed("root", "class")
    return written(members.join(roots, F.col("fp") == F.col("node"), "left").select("root", "fp", F.coalesce("class", "fp").alias("class")), "similar-classes")


def large_groups(members: DataFrame, texts: DataFrame, words: int, similarity: float) -> DataFrame:
    """Edges (u, v) that connect what reaches the similarity in groups of many blocks: ``members`` (root, fp), with ``texts`` (root, blocks, fp, text)."""
    edges = written(verified(_within(texts), words, similarity), "similar-edges")
    labels, before = _classes(members, edges), members.count()
    while True:
        sizes = labels.filter("class = fp").groupBy("root").count()
        sizes = written(sizes.select(F.col("root").alias("r"), F.col("count").alias("n"), F.ceil(F.col("count") / BLOCK).alias("b")), "similar-heads")
        now = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        if sizes.filter("n > 1").isEmpty():
            return edges  # every group is one class
        if 2 * now > before:
            return edges.unionByName(written(verified(_between(texts, labels), words, similarity), "similar-edges"))
        heads = labels.filter("class = fp").select("fp").join(texts.select("root", "fp", "text"), "fp")
        heads = heads.join(sizes, F.col("root") == F.col("r")).select("root", F.col("b").alias("blocks"), "fp", "text")
        edges = edges.unionByName(written(verified(_within(heads), words, similarity), "similar-edges"))
        labels, before = _classes(members, edges), now


def indexed(nodes: DataFrame, bits: int) -> DataFrame:
    """Edges (u, v) between nodes (fp) whose fingerprints (sim) the byte-position index links, and a tree over nodes of one fingerprint."""
    first = written(nodes.groupBy("sim").agg(F.min("fp").alias("first")), "similar-sims")
    same = nodes.select("fp", "sim").join(first, "sim").filter("fp <> first").select(F.col("fp").alias("u"), F.col("first").alias("v"))
    near = links(first.select(F.col("sim").alias("fp")), bits)
    for end in ("u", "v"):
        near = near.join(first.select(F.col("sim").alias(end), F.col("first").alias(f"_{end}")), end)
    return same.unionByName(near.select(F.col("_u").alias("u"), F.col("_v").alias("v")))


def similar(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 4) -> DataFrame:
    """(key, row_hash, component) for each row of ``df``; rows link if their similarity is at least ``similarity``.

    bits: the distance up to which the byte-position index proposes.  Null text is the empty text,
    and texts without a word are similar to each other only.  Rows need not be unique, and very long
    texts are read whole.  An empty table gives no row.
    """
    if not 0.8 <= similarity <= 1:
        raise ValueError("the number of keys is meant for similarities from 0.8")
    row = row_hash(df)
    slim = df.select(col(key).alias("key"), row.alias("row_hash"), sketch(col(text), words).alias("s"))
    slim = written(slim.select("key", "row_hash", F.col("s")[0].alias("fp"), F.col("s")[1].alias("sim"), F.slice("s", 3, BANDS).alias("bands")), "similar")
    nodes = slim.groupBy("fp").agg(F.min(F.struct("key", "row_hash", "sim", "bands")).alias("h"))
    nodes = written(nodes.select("fp", "h.*"), "similar-nodes")
    rough = components(proposed(nodes).unionByName(indexed(nodes, bits)))
    members = written(rough.unionByName(rough.select(F.col("root").alias("node"), "root").distinct()), "similar-members")
    large = written(members.groupBy("root").count().filter(F.col("count") > BLOCK).select("root", F.ceil(F.col("count") / BLOCK).alias("blocks")), "similar-large")
    members = members.join(large, "root", "left").select(F.col("node").alias("fp"), "root", F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"))
    members = written(members.join(nodes.select("fp", "key", "row_hash"), "fp"), "similar-rows")
    h, k = (fresh(df, x) for x in ("_h", "_k"))
    whole = df.select(col(key).alias("key"), row.alias("row_hash"), col(text).cast("binary").alias("text"))

    def texts(which: DataFrame) -> DataFrame:
        rows = which.withColumnsRenamed({"row_hash": h, "key": k})
        held = whole.filter(among(which, F.col("row_hash")))
        return held.join(rows, (F.col("row_hash") == F.col(h)) & F.col("key").eqNullSafe(F.col(k))).select("root", "blocks", "fp", "text")

    edges = verified(_pairs(texts(members.filter(F.col("blocks") <= PAIRED))), words, similarity)
    if not large.filter(F.col("blocks") > PAIRED).isEmpty():
        most = members.filter(F.col("blocks") > PAIRED)
        edges = edges.unionByName(large_groups(most.select("root", "fp"), written(texts(most), "similar-texts"), words, similarity))
    roots = components(edges)
    labels = written(nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("component")), "similar-labels")
    return slim.select("key", "row_hash", "fp").join(labels, "fp").select("key", "row_hash", "component")


def keep_dissimilar(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, similarity: float = 0.8, bits: int = 4) -> DataFrame:
    """The rows of ``df`` without similar ones: of each component one row of the smallest key stays, as ``simhash.keep_one`` does.

    Columns come through as they were, of whatever type and name; null keys come last, and rows that
    agree in every column count as one.  Null, empty and very long texts: see ``similar``.
    """
    return keep_heads(df, key, similar(df, key, text, words, similarity, bits))
