"""Command line: classify, extract, ingest, report and query, each stage over files of the one before."""

from __future__ import annotations

import argparse
import logging
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.urls import classify
from . import config
from .operators import extract, ingest, summary
from .operators.ordinals import first_seen
from .plans.adhoc import query_lines, register_frames
from .schemas import TABLES
from .sources import readers, sinks
from .storage import configure, exists, migrate, open_tables, publish, released, stage, vacuum, written

LOG = logging.getLogger("assetloom")


def log_to_stderr(verbose: bool = False) -> None:
    logging.Formatter.converter = time.gmtime
    logging.basicConfig(level=logging.DEBUG if verbose else logging.INFO, format="%(asctime)sZ [%(levelname)s] %(message)s", datefmt="%Y-%m-%dT%H:%M:%S")


def run_classify(spark: SparkSession, urls: str, output: str) -> DataFrame:
    """The URL list's distinct web URLs with their class, as assets.json, one JSON array, and as JSON lines that can be split."""
    seen = written(first_seen(readers.url_list(spark, urls)).select("position", "url", classify(F.col("url")).alias("type")), "manifest")
    manifest = seen.orderBy("position").drop("position")
    manifest.write.mode("overwrite").json(f"{output}/manifest")
    sinks.write_json_array(seen, f"{output}/assets.json", "position")
    return seen


def run_extract(spark: SparkSession, manifest: DataFrame, bodies: str, output: str) -> int:
    """Write all reports; the number of recoverable errors."""
    entries, texts = readers.as_assets(manifest), readers.bodies(spark, bodies)
    # Written first: dealing by ranges looks at its input twice, and bodies are searched once.
    found = written(extract.findings(extract.with_bodies(entries, texts)), "findings")
    found = found.repartitionByRange("ordinal", "position").sortWithinPartitions("ordinal", "position")
    errors = extract.reader_errors(entries, texts.select("local_path"))
    sinks.write_reports(found, errors, f"{output}/reports")
    return readers.report(spark, f"{output}/reports", "errors").count()


def run_ingest(spark: SparkSession, manifest: DataFrame, output: str) -> dict[str, DataFrame]:
    """Merge the manifest and its reports into the inventory: all its tables change in one version or none does."""
    folder = f"{output}/tables"
    migrate(spark, folder)
    reports = {n: readers.report(spark, f"{output}/reports", n) for n in ("urls", "websocket", "endpoints", "frameworks")}
    staged: dict[str, str] = {}

    def save(name: str, df: DataFrame) -> DataFrame:
        staged[name] = stage(df, folder, name)
        return spark.read.schema(TABLES[name]).parquet(staged[name])

    ingest.ingest(open_tables(spark, folder), readers.as_assets(manifest), reports, save=save)
    publish(spark, folder, staged)
    vacuum(spark, folder)
    return open_tables(spark, folder)


def run_report(spark: SparkSession, output: str) -> dict:
    """Writes summary.json, summary.md and assets.csv beside the reports; the summary."""
    t = open_tables(spark, f"{output}/tables")
    found = summary.summary(t["assets"], t["endpoints"], t["technologies"])
    sinks.write_text(spark, f"{output}/reports/summary.json", sinks.summary_json(found))
    sinks.write_text(spark, f"{output}/reports/summary.md", sinks.summary_markdown(found))
    sinks.write_csv(sinks.assets_csv(t["assets"]), f"{output}/reports/assets.csv")
    return found


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array if the path ends in .json, else JSON lines."""
    return readers.read_manifest(spark, path) if path.endswith(".json") else readers.read_manifest_lines(spark, path)


def settings(spark: SparkSession, path: str | None) -> config.Config:
    """The configuration file's settings, the defaults without one; ``threads`` becomes the number of shuffle partitions."""
    found = config.load(path) if path else config.Config()
    if path:
        spark.conf.set("spark.sql.shuffle.partitions", str(found.threads))
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="assetloom", description=__doc__)
    parser.add_argument("--output", help="folder of the scan's reports and tables; by default the folder of the configuration's database path")
    parser.add_argument("--config", help="YAML file of settings")
    parser.add_argument("--verbose", action="store_true")
    sub = parser.add_subparsers(dest="command", required=True)
    sub.add_parser("classify").add_argument("urls")
    e = sub.add_parser("extract")
    e.add_argument("manifest")
    e.add_argument("bodies")
    sub.add_parser("ingest").add_argument("manifest")
    sub.add_parser("report")
    sub.add_parser("query").add_argument("sql")
    args = parser.parse_args(argv)
    log_to_stderr(args.verbose)
    spark = configure(SparkSession.builder.appName("assetloom").getOrCreate())
    try:
        found = settings(spark, args.config)
    except (OSError, ValueError) as problem:
        parser.error(str(problem))
    output = args.output or (found.database_path.rsplit("/", 1)[0] if args.config else None)
    if not output:
        parser.error("--output or --config must say where the scan's folder is")
    if args.command in ("extract", "ingest") and not exists(spark, args.manifest):
        parser.error(f"no manifest at {args.manifest}")
    with released(spark):
        if args.command == "classify":
            if exists(spark, args.urls):
                LOG.info("%d lines in the list", readers.line_count(spark, args.urls).first().n)
            LOG.info("%d assets in the manifest", run_classify(spark, args.urls, output).count())
        elif args.command == "extract":
            LOG.info("extracted, with %d recoverable errors", run_extract(spark, _manifest(spark, args.manifest), args.bodies, output))
        elif args.command == "ingest":
            run_ingest(spark, _manifest(spark, args.manifest), output)
        elif args.command == "report":
            LOG.info("%d assets in the summary", run_report(spark, output)["total_assets"])
        else:
            register_frames(open_tables(spark, f"{output}/tables"))
            register_frames({f"report_{n}": readers.report(spark, f"{output}/reports", n) for n in ("imports", "errors")})  # not ingested
            for row in query_lines(spark, args.sql).toLocalIterator():
                sys.stdout.write(row.value + "\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
