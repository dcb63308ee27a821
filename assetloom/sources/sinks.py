"""Sinks: URL lists, manifests, reports, summaries and query results."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import REPORTS
from ..storage import delete, publish, put


def sorted_urls(urls: DataFrame) -> DataFrame:
    """Distinct URLs in code-point order."""
    return urls.select("url").distinct().orderBy("url")


#: Each report's fields: of a finding (value, kind, evidence).
_FIELDS = {
    "urls": {"url": "value", "kind": "kind"},
    "endpoints": {"endpoint": "value", "kind": "kind"},
    "websocket": {"url": "value", "kind": "kind"},
    "imports": {"module": "value"},
    "frameworks": {"technology": "value", "evidence": "evidence"},
    "errors": {"analyzer": "kind", "message": "value"},
}


def _checked(findings: DataFrame) -> DataFrame:
    """``findings``; a report nobody knows is an error where the frame is read."""
    known = F.when(F.col("report").isin(*REPORTS), F.col("report")).otherwise(F.raise_error(F.concat(F.lit("Unknown report: "), F.coalesce("report", F.lit("null")))))
    return findings.withColumn("report", known)


def _shaped(name: str) -> list[Column]:
    return [F.col("asset_url"), *[F.col(value).alias(field) for field, value in _FIELDS[name].items()]]


def by_report(findings: DataFrame, errors: DataFrame | None = None) -> dict[str, DataFrame]:
    """One DataFrame for each report, with its fields."""
    checked = _checked(findings)
    out = {name: checked.filter(F.col("report") == name).select(*_shaped(name)) for name in REPORTS if name != "errors"}
    out["errors"] = errors if errors is not None else findings.sparkSession.createDataFrame([], REPORTS["errors"])
    return out


def write_reports(findings: DataFrame, errors: DataFrame | None, folder: str) -> dict[str, str]:
    """All reports as JSON lines under ``folder``, published together; the path of each.

    One job: the bodies are read and searched once, and each task writes a file for each report.
    Findings stay in the order they come in, so they are given in the order of their assets.
    """
    spark = findings.sparkSession
    rows = _checked(findings).select("report", "asset_url", "value", "kind", "evidence")
    if errors is not None:
        rows = rows.unionByName(errors.select(F.lit("errors").alias("report"), "asset_url", F.col("message").alias("value"), F.col("analyzer").alias("kind"), F.lit(None).cast("string").alias("evidence")))
    line = F.lit(None).cast("string")
    for name in REPORTS:
        line = F.when(F.col("report") == name, F.to_json(F.struct(*_shaped(name)), {"ignoreNullFields": "false"})).otherwise(line)
    path = f"{folder}/{uuid.uuid4().hex}"
    rows.select("report", line.alias("value")).write.partitionBy("report").text(path)
    paths = {name: f"{path}/report={name}" for name in REPORTS}
    publish(spark, folder, paths)
    return paths


def write_json_array(df: DataFrame, path: str, order: str | None = None) -> None:
    """All rows as one JSON array in one file, in order of a column that isn't written itself.

    Spark's tasks write the objects; the file system puts their files together, stream to stream.
    """
    spark, parts = df.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    rows = df.orderBy(order).drop(order) if order else df
    json_lines(rows).write.option("lineSep", ",\n").text(parts)
    put(spark, path, "[\n", parts, cut=2, tail="\n]\n")
    delete(spark, parts)


def write_csv(df: DataFrame, path: str) -> None:
    """All rows, in their order, as one CSV file: a header, rows ended by CR LF, nulls empty, quotes only where needed."""
    spark, parts = df.sparkSession, f"{path}.parts-{uuid.uuid4().hex}"
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    fields = [F.when(t.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(t) for t in text]
    df.select(F.concat_ws(",", *fields)).write.option("lineSep", "\r\n").text(parts)
    put(spark, path, ",".join(df.columns) + "\r\n", parts)
    delete(spark, parts)


def json_lines(df: DataFrame) -> DataFrame:
    """One JSON object a row, nulls kept; of columns with one name the first stays."""
    seen: set[str] = set()
    names = [f"_{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names)
    kept: list[Column] = []
    for old, new in zip(df.columns, names, strict=True):
        if old not in seen:
            seen.add(old)
            kept.append(F.col(new).alias(old))
    return plain.select(F.to_json(F.struct(*kept), {"ignoreNullFields": "false"}).alias("value"))


ASSET_COLUMNS = ["url", "local_path", "asset_type", "sha256", "size_bytes", "mime_type", "status", "discovered_at"]


def assets_csv(assets: DataFrame) -> DataFrame:
    """The inventory in order of id, ready for a CSV writer."""
    return assets.orderBy("id").select(*ASSET_COLUMNS)


def summary_json(summary: dict) -> str:
    return json.dumps(summary, indent=2) + "\n"


def summary_markdown(summary: dict) -> str:
    """Four figures and a line for each asset type, by name."""
    head = ["# Asset summary", "", f"- Total assets: {summary['total_assets']}", f"- JavaScript assets: {summary['javascript_count']}", f"- Endpoints: {summary['endpoint_count']}", f"- Technologies: {summary['technology_count']}", "", "## File statistics", ""]
    return "\n".join([*head, *(f"- {name}: {n}" for name, n in sorted(summary["file_statistics"].items()))]) + "\n"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text as a file."""
    put(spark, path, text)
