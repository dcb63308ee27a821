"""Read-only SQL over views of the tables.

Only one SELECT (or WITH, VALUES, TABLE, FROM) is taken.  Spark's own parser decides: the plan
that it makes of the text must hold no command.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import lenient_utf8
from ..sources.sinks import json_lines
from ..storage import configure, exists

#: The driver's tables.
DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def register(spark: SparkSession, sf_dir: str, tables: tuple[str, ...] = DRIVER_TABLES) -> None:
    """Each Parquet table of a folder as a temporary view."""
    for t in tables:
        if exists(spark, f"{sf_dir}/{t}.parquet"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)


def register_frames(tables: dict[str, DataFrame]) -> None:
    """DataFrames as temporary views by name."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def glob_to_regex(pattern: str) -> str:
    """A GLOB pattern (* ? [..] [^..]) as a regular expression for rlike."""
    out, i = "^", 0
    while i < len(pattern):
        c = pattern[i]
        end = pattern.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out += "(?s:.*)"
        elif c == "?":
            out += "(?s:.)"
        elif end > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out += f"[{body}]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out + "$"


#: Nodes of a parsed query. Whatever else a plan holds (commands, scripts, procedures) is refused.
_READS = frozenset(
    "Aggregate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation PipeOperator Pivot Project RepartitionByExpression Sample Sort SubqueryAlias Tail Union Unpivot UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedRelation "
    "UnresolvedSubqueryColumnAliases UnresolvedTableValuedFunction UnresolvedTVFAliases UnresolvedWith Window WithWindowDefinition CTERelationDef".split()
)
#: Functions that run code of the caller's choice.
_CALLS = re.compile(r"(?i)\b(?:try_)?(?:reflect|java_method)\s*\(")


#: What GLOB may not be looked for in, and GLOB with its pattern.
_GLOB = re.compile(r"""(?is)'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|\bGLOB\s+'((?:[^'\\]|\\.|'')*)'""")


def with_glob(text: str) -> str:
    """``text`` with each ``GLOB 'pattern'`` as RLIKE, which Spark knows; strings, names and comments stay."""

    def change(found: re.Match) -> str:
        if found[1] is None:
            return found[0]
        pattern = glob_to_regex(found[1].replace("''", "'"))
        return "RLIKE '" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"

    return _GLOB.sub(change, text)


def functions(spark: SparkSession) -> None:
    """Register the engine's own functions for SQL: ``lenient_text`` takes bytes to text as bodies are decoded."""
    spark.udf.register("lenient_text", lenient_utf8)


def query(spark: SparkSession, text: str) -> DataFrame:
    """The rows of one read-only statement; any other is a ValueError and does nothing. GLOB and ``lenient_text`` are known."""
    configure(spark)
    functions(spark)
    text = with_glob(text)
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if _CALLS.search(text) or not _reads_only(plan):
        raise ValueError("only a SELECT is allowed")
    return spark.sql(text)


def _reads_only(plan) -> bool:
    """Whether a parsed plan, its named queries and its subqueries are nothing but queries."""
    if plan.getClass().getSimpleName() not in _READS:
        return False
    below = [plan.children(), plan.subqueries()]
    if plan.getClass().getSimpleName() == "UnresolvedWith":
        below.append(plan.innerChildren())
    return all(_reads_only(c.apply(i)) for c in below for i in range(c.size()))


def query_lines(spark: SparkSession, text: str) -> DataFrame:
    """The rows as JSON objects, one a line."""
    return json_lines(query(spark, text))
