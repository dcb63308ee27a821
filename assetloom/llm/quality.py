"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each whole text becomes a short vector of statistics (lengths, shares of character kinds, word and
line repetition), transformed to be roughly normal.  Each class has a mean and a covariance, the
covariance shrunk towards the pooled variances; a score is the difference of the two log densities
(Mahalanobis distances by Cholesky factors that are computed once and sent with the task).  The
class moments are sums over all labelled rows, added up on the executors; the driver sees a fixed
number of sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import col, fresh, raw, written

#: Least share of the pooled variances in a class covariance, and what is added to each variance.
#: A class of n rows has a share of p / (n + p) at least, p being the number of statistics: few rows say little about p * p covariances.
SHRINKAGE, RIDGE = 0.05, 1e-4
#: Log-density differences are divided by this, the number of statistics, before the logistic function: they aren't independent normals, so plain densities are overconfident.
TEMPERATURE = 17.0
#: Scores from here on are label 1.
THRESHOLD = 0.3

_KINDS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!#$%&*+/<=>@[\\]^_`{|}~", b" \t", b"\n\r", bytes(range(0xC0, 0x100))]
_MEMBER = np.array([[float(b in kind) for kind in _KINDS] for b in range(256)])

FEATURES = ("log_chars", "log_words", "log_mean_word", "spread_word", "log_longest_word", "short_words", "upper", "digits", "punctuation", "symbols", "blanks", "line_breaks", "non_ascii", "distinct_words", "log_words_a_stop", "distinct_lines", "entropy")


def statistics(text: bytes) -> list[float]:
    """The transformed statistics of one whole text, all finite; those of the empty text are a fixed vector."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lower, upper, digits, marks, symbols, blanks, breaks, high = (counts @ _MEMBER).tolist()
    chars = float(counts[:0x80].sum() + counts[0xC0:].sum())
    words = text.split()
    n = len(words)
    sizes = np.fromiter(map(len, words), np.float64, n) if n else np.zeros(1)
    letters = lower + upper + high
    shares = counts[counts > 0] / max(1, len(text))
    lines = text.split(b"\n")
    root = lambda x, of: math.sqrt(x / of) if of else 0.0
    return [
        math.log1p(chars),
        math.log1p(n),
        math.log1p(float(sizes.mean())),
        math.log1p(float(sizes.std())),
        math.log1p(float(sizes.max())),
        float((sizes <= 3).mean()),
        root(upper, letters),
        root(digits, chars),
        root(marks, chars),
        root(symbols, chars),
        root(blanks, chars),
        root(breaks, chars),
        root(high, letters),
        len(set(words)) / n if n else 0.0,
        math.log1p(n / (1 + int(counts[0x2E]))),
        len(set(lines)) / len(lines),
        float(-(shares * np.log(shares)).sum()) if len(text) else 0.0,
    ]


def features(text: Column) -> Column:
    """Array of the statistics of a string column's whole texts; null counts as empty."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in batches:
            yield pa.array([statistics(t) for t in raw(a)], pa.list_(pa.float64()))

    return of(text.cast("binary"))


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors and log constants of classes 0 and 1."""

    means: tuple[np.ndarray, np.ndarray]
    factors: tuple[np.ndarray, np.ndarray]
    constants: tuple[float, float]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Scores from 0 to 1 of rows of statistics; higher: class 1 is likelier."""
        logs = [k - 0.5 * (((x - m) @ f.T) ** 2).sum(axis=1) for m, f, k in zip(self.means, self.factors, self.constants, strict=True)]
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / TEMPERATURE, -500, 500)))

    def score(self, vector: Column) -> Column:
        """The score of a column of statistics."""

        @F.arrow_udf(T.DoubleType())
        def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for a in batches:
                x = np.asarray(a.flatten(), np.float64).reshape(-1, len(FEATURES))
                yield pa.array(self.scores(x))

        return of(vector)


def discriminant(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant:
    """From each class's count, sum and sum of outer products.

    A class without rows takes the pooled moments, so without any labels every score is 1/2.
    """
    p = len(FEATURES)
    none = (0.0, np.zeros(p), np.zeros((p, p)))
    classes = [moments.get(c, none) for c in (0, 1)]
    n, s, q = (sum(m[i] for m in classes) for i in range(3))
    mean = s / max(n, 1)
    pooled = q / max(n, 1) - np.outer(mean, mean) if n else np.eye(p)
    out = []
    for count, total, outer in classes:
        m = total / count if count else mean
        own = outer / count - np.outer(m, m) if count else pooled
        share = max(shrinkage, p / (count + p))
        covariance = (1 - share) * own + share * np.diag(np.diag(pooled)) + ridge * np.eye(p)
        lower = np.linalg.cholesky(covariance)
        out.append((m, np.linalg.inv(lower), math.log((count + 1) / (n + 2)) - float(np.log(np.diag(lower)).sum())))
    means, factors, constants = zip(*out, strict=True)
    return Discriminant(means, factors, constants)


def fit(vectors: DataFrame, labels: DataFrame, key: str, label: str, learn: Column) -> Discriminant:
    """Learn from rows of ``vectors`` (key, x) that ``learn`` admits and ``labels`` (key, label) marks 0 or 1.

    Null keys and labels teach nothing; repeated labels count as often as they stand.
    """
    p = len(FEATURES)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((p + 1, p + 1)) for c in (0, 1)}
        for b in batches:
            y = np.asarray(b.column(0), np.int64)
            x = np.asarray(b.column(1).flatten(), np.float64).reshape(-1, p)
            one = np.concatenate([np.ones((len(x), 1)), x], axis=1)
            for c in sums:
                sums[c] += one[y == c].T @ one[y == c]
        for c, m in sums.items():
            if m[0, 0]:
                yield pa.RecordBatch.from_arrays([pa.array([c] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())], ["y", "i", "v"])

    marked = labels.filter(col(label).isin(0, 1)).select(col(key).alias("k"), col(label).cast("int").alias("y"))
    known = vectors.filter(learn).join(marked, F.col("key") == F.col("k")).select("y", "x")
    moments = {}
    for row in known.mapInArrow(add, "y int, i int, v double").groupBy("y", "i").agg(F.sum("v").alias("v")).collect():
        moments.setdefault(row.y, np.zeros(((p + 1) ** 2)))[row.i] = row.v
    square = {c: m.reshape(p + 1, p + 1) for c, m in moments.items()}
    return discriminant({c: (m[0, 0], m[0, 1:], m[1:, 1:]) for c, m in square.items()})


def in_training(key: Column) -> Column:
    """Rows to learn from: crc32 of the key's text mod 5 isn't 0. Null keys aren't."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 != 0, F.lit(False))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """(key, held_out, score, predicted) for each row of ``docs``, its whole text scored.

    Only the text is ever an input; null counts as empty, and both have the fixed statistics of the
    empty text.  held_out: rows that take no part in learning (null keys too).  Rows need not be
    unique, very long texts are read whole, and other columns, whatever their names, play no part.
    An empty table gives no row; without labels all scores are 1/2.
    """
    vectors = written(docs.select(col(key).alias("key"), features(col(text)).alias("x")), "quality")
    model = fit(vectors, labels, key, label, in_training(F.col("key")))
    scored = vectors.select("key", (~in_training(F.col("key"))).alias("held_out"), model.score(F.col("x")).alias("score"))
    return scored.select(F.col("key").alias(key), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, columns as they were, whatever their names.

    The statistics are computed once and written with the rows; learning and scoring read them from
    there.  Null and empty texts are scored by the fixed vector of the empty text; rows need not be
    unique and keys may be null; very long texts are read whole; without labels every score is 1/2
    and every row stays; an empty table gives no row.
    """
    x = fresh(docs, "x")
    rows = written(docs.withColumn(x, features(col(text))), "quality")
    model = fit(rows.select(col(key).alias("key"), col(x).alias("x")), labels, key, label, in_training(F.col("key")))
    return rows.filter(model.score(col(x)) >= THRESHOLD).drop(x)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every ``documents`` row as ``labels.quality`` marks it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))


QUERIES = {"op6_quality": op6_quality}

ORACLE_SQL: dict[str, str] = {}
