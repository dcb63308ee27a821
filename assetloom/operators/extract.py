"""The analyzers: five column expressions over a text, one pass over the assets, no shuffle.

Each list analyzer gives the sorted distinct matches of an asset; the technology analyzer gives
one row for each technology whose tokens occur, in a fixed order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns
from ..functions.text import decode_lenient
from ..storage import written

_ITEM = "struct<value: string, kind: string, evidence: string>"


@dataclass(frozen=True)
class Analyzer:
    """An id, the report it feeds, the asset types it takes, and its findings as a column expression.

    ``find`` maps the text to an array of struct (value, kind, evidence).  ``finish``, if any, maps
    all findings of the analyzer to more findings: an aggregate over the scan.
    """

    id: str
    report: str
    find: Callable[[Column], Column]
    types: tuple[str, ...] = ("javascript",)
    finish: Callable[[DataFrame], DataFrame] | None = None


def _item(value: Column, kind: str | None = None, evidence: str | None = None) -> Column:
    return F.struct(value.alias("value"), F.lit(kind).cast("string").alias("kind"), F.lit(evidence).cast("string").alias("evidence"))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """Sorted distinct matches."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))))


def _listed(pattern: str, group: int, kind: str | None, sign: str | None) -> Callable[[Column], Column]:
    """A list analyzer.  sign: a substring that every match of a case-sensitive pattern holds, tested first."""

    def find(text: Column) -> Column:
        found = F.transform(matches(text, pattern, group), lambda v: _item(v, kind))
        return found if sign is None else F.when(text.contains(sign), found).otherwise(F.array().cast(f"array<{_ITEM}>"))

    return find


def _technologies(text: Column) -> Column:
    """Patterns are tried only where a token's letters occur in the folded text, which is bound once.

    Folding takes the four letters outside ASCII that the patterns' case-insensitivity takes for
    i, s and k as these, so it hides no match.
    """

    def hits(folded: Column) -> Column:
        found = []
        for name, tokens in patterns.TECHNOLOGIES.items():
            near = reduce(lambda a, b: a | b, [folded.contains(t.lower()) for t in tokens])
            found.append(F.when(near & text.rlike(patterns.technology(tokens)), _item(F.lit(name), None, "signature match")))
        return F.filter(F.array(*found), lambda h: h.isNotNull())

    folded = F.lower(F.translate(text, "\u0130\u0131\u017f\u212a", "iisk"))
    return F.flatten(F.transform(F.array(folded), hits))


#: In order of id, which is the order of execution.
ANALYZERS = (
    Analyzer("endpoints", "endpoints", _listed(patterns.ENDPOINTS, 0, "api", None)),
    Analyzer("frameworks", "frameworks", _technologies),
    Analyzer("imports", "imports", _listed(patterns.IMPORTS, 1, None, None)),
    Analyzer("urls", "urls", _listed(patterns.URLS, 0, "url", "//")),
    Analyzer("websocket", "websocket", _listed(patterns.WEBSOCKETS, 0, "websocket", None)),
)


def registry(analyzers: Iterable[Analyzer]) -> dict[str, Analyzer]:
    """Analyzers by id, in order of id; an empty or repeated id is an error."""
    found: dict[str, Analyzer] = {}
    for a in analyzers:
        if not a.id or a.id in found:
            raise ValueError(f"empty or repeated analyzer id: {a.id!r}")
        found[a.id] = a
    return dict(sorted(found.items()))


def eligible(assets: DataFrame) -> DataFrame:
    """Downloaded scripts with a body; all others are left out without a word."""
    return assets.filter("type = 'javascript' AND status = 'downloaded' AND local_path IS NOT NULL")


def findings(assets: DataFrame, analyzers: Iterable[Analyzer] = ANALYZERS, url: str = "asset_url", text: str = "source", kind: str = "type") -> DataFrame:
    """(asset_url, ordinal, report, position, value, kind, evidence) of every asset, ``assets`` having an ordinal.

    One projection and one generate: the text is read once whatever the number of analyzers.
    Assets whose type an analyzer doesn't take, and null texts, give it nothing.
    """
    chosen = list(registry(analyzers).values())
    typed = kind in assets.columns
    per = []
    for a in chosen:
        found = F.coalesce(a.find(F.col(text)), F.array().cast(f"array<{_ITEM}>"))
        if typed:
            found = F.when(F.col(kind).isin(*a.types), found).otherwise(F.array().cast(f"array<{_ITEM}>"))
        per.append(F.transform(found, _numbered(a.report)))
    out = assets.select(F.col(url).alias("asset_url"), "ordinal", F.inline(F.flatten(F.array(*per))))
    for a in chosen:
        if a.finish is not None:
            out = out.unionByName(a.finish(out.filter(F.col("report") == a.report)), allowMissingColumns=True)
    return out


def _numbered(report: str) -> Callable[[Column, Column], Column]:
    return lambda x, i: F.struct(F.lit(report).alias("report"), i.alias("position"), x["value"].alias("value"), x["kind"].alias("kind"), x["evidence"].alias("evidence"))


def reader_errors(manifest: DataFrame, bodies: DataFrame, url: str = "url") -> DataFrame:
    """(asset_url, analyzer, message) of eligible assets without a body."""
    missing = eligible(manifest).join(bodies.select("local_path"), "local_path", "left_anti")
    return missing.select(F.col(url).alias("asset_url"), F.lit("reader").alias("analyzer"), F.concat(F.lit("No such file: "), F.col("local_path")).alias("message"))


def with_bodies(manifest: DataFrame, bodies: DataFrame, url: str = "url") -> DataFrame:
    """Eligible assets with their text, ready for ``findings``.

    The filter comes before the join, and bodies that are bytes (content) are decoded after it, so
    only files that an asset names are.
    """
    text = F.col("source") if "source" in bodies.columns else decode_lenient(F.col("content")).alias("source")
    return eligible(manifest).join(bodies, "local_path").select("ordinal", F.col(url).alias("asset_url"), "type", text)


def python_findings(assets: DataFrame, name: str, analyze: Callable[[str, str], Iterable[tuple[str, str, str]]]) -> tuple[DataFrame, DataFrame]:
    """(findings, errors) of an analyzer written in Python: (url, text) -> (report, value, kind or evidence).

    An exception becomes an error row of that asset; what the analyzer had given before stays.  The
    analyzer runs once: what it gives is written and then split.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for url, ordinal, text in zip(batch["asset_url"], batch["ordinal"], batch["source"], strict=True):
                n = 0
                try:
                    for report, value, kind in analyze(url, text or ""):
                        rows.append((url, ordinal, report, n, value, kind, None))
                        n += 1
                except Exception as e:  # noqa: BLE001  an analyzer mustn't end the scan
                    rows.append((url, ordinal, "errors", n, name, str(e), None))
            yield pd.DataFrame(rows, columns=["asset_url", "ordinal", "report", "position", "value", "kind", "evidence"])

    out = assets.select("asset_url", "ordinal", "source").mapInPandas(run, "asset_url string, ordinal bigint, report string, position int, value string, kind string, evidence string")
    out = written(out, "python-findings")
    errors = out.filter("report = 'errors'").select("asset_url", F.col("value").alias("analyzer"), F.col("kind").alias("message"))
    return out.filter("report <> 'errors'"), errors
