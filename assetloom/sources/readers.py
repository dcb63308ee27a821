"""Sources: seed lists, URL lists, manifests, asset bodies and report files.

Fetching from the network is outside the engine: what a crawler found is a table or list of URLs,
and what a downloader fetched is a manifest beside a folder of bodies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..functions.patterns import LINE_BREAK
from ..functions.text import decode_lenient
from ..functions.urls import is_web, strip
from ..operators.ordinals import arrival
from ..schemas import MANIFEST, REPORTS
from ..storage import current, exists, read_or_empty


def seeds(spark: SparkSession, source: str, is_file: bool = True) -> DataFrame:
    """Seed URLs (url). Of a file, the lines that start with http:// or https://, without a final CR, repeats kept; else the argument as it is."""
    if not is_file:
        return spark.createDataFrame([(source,)], "url string")
    found = spark.read.text(source).filter(F.col("value").rlike("^https?://"))
    return found.select(F.regexp_replace("value", "\r$", "").alias("url"))


def url_lines(texts: DataFrame, text: str = "value", place: str = "path") -> DataFrame:
    """(ordinal, url): the lines of whole texts, each stripped. Lines end at any Unicode line break.

    The ordinal is a struct of the text's ``place`` (a file's path) and the line's number: several
    files follow one another by path, whatever their sizes.
    """
    lines = texts.select(F.col(place).alias("place"), F.posexplode(F.split(F.col(text), LINE_BREAK, -1)).alias("line", "value"))
    return lines.select(F.struct("place", "line").alias("ordinal"), strip(F.col("value")).alias("url"))


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """The web URLs of a list file (or folder of them), in order of path and line; bytes that aren't UTF-8 are dropped."""
    files = spark.read.format("binaryFile").load(path).select("path", decode_lenient(F.col("content")).alias("value"))
    return url_lines(files).filter(is_web(F.col("url")))


def line_count(spark: SparkSession, path: str) -> DataFrame:
    """One row (n): the line feeds of a crawl's list, as it is logged after a crawl."""
    return spark.read.text(path, wholetext=True).agg(F.coalesce(F.sum(F.length("value") - F.length(F.replace(F.col("value"), F.lit("\n")))), F.lit(0)).cast("long").alias("n"))


def parse_manifest(texts: DataFrame, text: str = "value", schema: StructType = MANIFEST, place: str | None = None) -> DataFrame:
    """(ordinal, fields of ``schema``): the entries of manifests, each a whole text that is a JSON array of objects.

    An empty text, another root, a broken or cut-off array, an entry that isn't an object, and an
    entry without a URL raise an error.  Nothing of such a manifest is published.  The ordinal is a
    struct of the manifest's ``place`` (null for a single one) and the entry's number in it.
    """
    body = strip(F.col(text))
    parsed = F.from_json(body, ArrayType(schema), {"mode": "FAILFAST"})
    checked = (
        F.when(body == "", F.raise_error(F.lit("the manifest holds nothing")))
        .when(~body.startswith("["), F.raise_error(F.lit("a manifest is a JSON array")))
        .otherwise(parsed)
    )
    where = F.lit(None).cast("string") if place is None else F.col(place)
    entries = texts.select(where.alias("place"), F.posexplode(checked).alias("entry_number", "entry"))
    url = F.when(F.col("entry").isNull(), F.raise_error(F.lit("a manifest entry is no object"))).when(F.col("entry.url").isNull(), F.raise_error(F.lit("a manifest entry has no url"))).otherwise(F.col("entry.url"))
    rest = [F.col(f"entry.{f.name}").alias(f.name) for f in schema if f.name != "url"]
    return entries.select(F.struct("place", "entry_number").alias("ordinal"), url.alias("url"), *rest)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest file (or folder of them) at ``path``, in order of path and entry."""
    texts = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_manifest(texts, place="path")


def read_manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of one JSON object a line, in order of file and line: the form that can be split and streamed."""
    return spark.read.schema(MANIFEST).json(path).select(arrival().alias("ordinal"), *[F.col(c) for c in MANIFEST.names])


def as_assets(manifest: DataFrame) -> DataFrame:
    """Manifest entries with their defaults: type other, status discovered, an empty local_path null."""
    path: Column = F.when(F.length("local_path") > 0, F.col("local_path"))
    return manifest.withColumns({"type": F.coalesce("type", F.lit("other")), "status": F.coalesce("status", F.lit("discovered")), "local_path": path})


def bodies(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(local_path, content) of every file under ``path``, still bytes: only those an asset names get decoded. local_path is as Spark names it."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select(F.regexp_replace("path", "^file:(//)?", "").alias("local_path"), "content")


def report(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """(ordinal, fields) of a report as it was last published under ``folder``, in its order; empty where there is none."""
    path = current(spark, folder).get(name)
    rows = read_or_empty(spark, path, REPORTS[name], "json")
    # A table that isn't there has no files to tell the order from, and no rows to order.
    there = path is not None and exists(spark, path)
    at = arrival() if there else F.struct(F.lit("").alias("file"), F.lit(0).cast("long").alias("block"), F.lit(0).cast("long").alias("row"))
    return rows.select(at.alias("ordinal"), *REPORTS[name].names)
