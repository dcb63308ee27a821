"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import attribution, balltree, bpe, exact_dedup, hilbert, licences, packing, quality, simhash, warc
from .shared import reachable

_MODULES = (packing, exact_dedup, warc, attribution, licences, quality, bpe, balltree, hilbert, simhash)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for module in _MODULES:
        found |= module.QUERIES
    return {name: (lambda spark, sf_dir, query=query: query(reachable(spark), sf_dir)) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for module in _MODULES:
        found |= module.ORACLE_SQL
    return found
