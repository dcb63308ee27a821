"""Queries of sources, sinks, reports, plugins and scans: each writes files of the synthetic assets and reads them back, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions.text import decode_lenient
from ..functions.urls import classify
from ..operators import extract, graph, ingest, plugins, summary
from ..operators.ordinals import arrival, dense, first_seen
from ..schemas import REPORTS
from ..sources import readers, sinks, synthetic
from ..storage import open_table, scratch
from . import adhoc, web

# ---- sources -----------------------------------------------------------------------------------

#: Lines of a seed file, in Spark and DuckDB alike; \r is put in by chr.
_SEED = "CASE page_id % 6 WHEN 0 THEN concat('ftp://h/', CAST(page_id AS STRING)) WHEN 1 THEN concat(' ', url) WHEN 2 THEN concat(url, chr(13)) WHEN 3 THEN '' ELSE url END"


def seed_file(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "seeds")
    spark.read.parquet(f"{d}/pages.parquet").selectExpr(f"{_SEED} AS value").write.text(path)
    return readers.seeds(spark, path)


def seed_single(spark, d):
    return readers.seeds(spark, "https://seed.example.test/start", is_file=False)


def _lists(spark, d) -> str:
    """Three lists under one folder, the second by far the largest, so sizes and paths give different orders."""
    path = scratch(spark, "lists")
    listed = synthetic.assets(spark, d).select("ordinal", "listed_url")
    for n, which in enumerate(("ordinal % 5 = 0", "ordinal % 5 <> 1", "ordinal % 5 = 1")):
        listed.filter(which).orderBy(F.desc("ordinal") if n == 2 else "ordinal").select(F.concat(F.lit("  "), "listed_url").alias("value")).write.text(f"{path}/{n}")
    return path


def url_list(spark, d):
    return first_seen(readers.url_list(spark, f"{_lists(spark, d)}/*"))


def crawl_count(spark, d):
    return readers.line_count(spark, f"{_lists(spark, d)}/*")


def _entries(spark, d) -> DataFrame:
    """Entries of a manifest, some without type, status or path, with an empty path, all with a field nobody knows."""
    n = F.col("ordinal")
    fields = {
        "url": F.col("asset_url"),
        "type": F.when(n % 4 != 0, F.col("type")),
        "status": F.when(n % 3 != 0, F.col("status")),
        "local_path": F.when(n % 5 == 0, "").when(n % 5 == 1, F.col("local_path")),
        "size_bytes": F.when(n % 2 == 0, n),
        "nobody": F.lit("knows"),
    }
    m = synthetic.assets(spark, d)
    m = m.withColumns({"type": classify(F.col("asset_url")), "local_path": F.concat(F.lit("bodies/"), n.cast("string"))})
    return m.select("ordinal", *[c.alias(k) for k, c in fields.items()])


_ENTRY_SQL = "CASE WHEN ordinal % 4 <> 0 THEN type ELSE 'other' END AS type, CASE WHEN ordinal % 3 <> 0 THEN status ELSE 'discovered' END AS status, CASE WHEN ordinal % 5 = 1 THEN 'bodies/' || ordinal END AS local_path, CASE WHEN ordinal % 2 = 0 THEN ordinal END AS size_bytes"


def _read_back(manifest: DataFrame) -> DataFrame:
    return dense(readers.as_assets(manifest)).select("position", "url", "type", "status", "local_path", "size_bytes")


def manifest_array(spark, d):
    """Written as one JSON array and read from it."""
    path = f"{scratch(spark, 'manifest')}/assets.json"
    sinks.write_json_array(_entries(spark, d), path, "ordinal")
    return _read_back(readers.read_manifest(spark, path))


def manifest_lines(spark, d):
    """Written as JSON lines in order, by many tasks, and read from their files."""
    path = scratch(spark, "manifest-lines")
    _entries(spark, d).orderBy("ordinal").drop("ordinal").write.json(path)
    return _read_back(readers.read_manifest_lines(spark, path))


def lenient_text(spark, d):
    """Bodies with bytes that aren't UTF-8 and with each kind of line end."""
    body = F.concat(F.coalesce(F.col("html"), F.lit("")).cast("binary"), F.unhex(F.lit("61FF0D0A62C30D63E282")))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(decode_lenient(body), 256).alias("sha256"))


# ---- sinks and reports -------------------------------------------------------------------------


def _published(spark, d) -> str:
    """All reports of a scan, a fifth of the bodies missing."""
    m = web.manifest(spark, d)
    there = m.filter("ordinal % 5 <> 0").select("local_path", "source")
    found = extract.findings(extract.with_bodies(m.drop("source"), there, "asset_url"))
    folder = scratch(spark, "reports")
    sinks.write_reports(found, extract.reader_errors(m, there, "asset_url"), folder)
    return folder


def reports_published(spark, d):
    folder = _published(spark, d)
    parts = [readers.report(spark, folder, n).select(F.lit(n).alias("report"), "asset_url", F.to_json(F.struct(*schema.names), {"ignoreNullFields": "false"}).alias("line")) for n, schema in REPORTS.items()]
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def imports_view(spark, d):
    """Ad-hoc SQL over reports that aren't ingested."""
    folder = _published(spark, d)
    adhoc.register_frames({f"report_{n}": readers.report(spark, folder, n) for n in ("imports", "errors")})
    return adhoc.query(spark, "SELECT module, count(*) AS n, (SELECT count(*) FROM report_errors) AS errors FROM report_imports GROUP BY module")


def sorted_url_list(spark, d):
    path = scratch(spark, "sorted")
    sinks.sorted_urls(synthetic.assets(spark, d).select(F.col("listed_url").alias("url"))).write.text(path)
    lines = spark.read.text(path).select(arrival().alias("ordinal"), F.col("value").alias("url"))
    return dense(lines).select("position", "url")


def _lines(spark, path: str, separator: str) -> DataFrame:
    return dense(spark.read.option("lineSep", separator).text(path).select(arrival().alias("ordinal"), F.col("value").alias("line"))).select("position", "line")


def csv_lines(spark, d):
    path = f"{scratch(spark, 'csv')}/assets.csv"
    sinks.write_csv(sinks.assets_csv(web.ingested(spark, d, ())["assets"]), path)
    return _lines(spark, path, "\r\n")


def _figures(spark, d) -> dict[str, DataFrame]:
    return web.ingested(spark, d, ("endpoints", "technologies"))


def summary_map(spark, d):
    t = _figures(spark, d)
    return summary.figures(t["assets"], t["endpoints"], t["technologies"]).select(F.explode("file_statistics").alias("asset_type", "n"))


def summary_markdown(spark, d):
    t, path = _figures(spark, d), f"{scratch(spark, 'summary')}/summary.md"
    sinks.write_text(spark, path, sinks.summary_markdown(summary.summary(t["assets"], t["endpoints"], t["technologies"])))
    return _lines(spark, path, "\n")


def query_json_lines(spark, d):
    adhoc.register(spark, d, ("nation",))
    return adhoc.query_lines(spark, "SELECT n_nationkey, n_name, CAST(NULL AS STRING) AS nothing FROM nation")


# ---- analyzers and plugins ---------------------------------------------------------------------


def _measured(url: str, text: str):
    """An analyzer in Python: the text's length, then a failure where there is no socket."""
    yield "urls", str(len(text)), "length"
    if "wss://" not in text:
        raise ValueError("no socket")


def python_analyzer(spark, d):
    found, errors = extract.python_findings(web.scripts(spark, d), "measured", _measured)
    return found.select("asset_url", F.col("value").alias("result")).unionByName(errors.select("asset_url", F.concat("analyzer", F.lit(": "), "message").alias("result")))


def analyzer_finish(spark, d):
    """An analyzer that adds a row for the whole scan when all assets have been read."""
    totals = lambda f: f.groupBy("value").agg(F.count("*").cast("string").alias("n")).select(F.lit("scan").alias("asset_url"), F.lit("imports").alias("report"), F.concat("value", F.lit(" "), "n").alias("value"))
    own = next(a for a in extract.ANALYZERS if a.id == "imports")
    return extract.findings(web.scripts(spark, d), [extract.Analyzer(own.id, own.report, own.find, own.types, totals)]).select("asset_url", "value")


class _Endpoints(plugins.Plugin):
    """Endpoints and the assets that reach them, as nodes and edges."""

    id, version = "endpoints", "1"

    def run(self, assets: DataFrame, context: plugins.Context) -> plugins.Result:
        found = extract.findings(assets, [a for a in extract.ANALYZERS if a.id == "endpoints"])
        asset = F.sha2(F.col("asset_url"), 256)
        ends = graph.model(found.select(F.sha2(F.concat("asset_url", F.lit(" "), "value"), 256).alias("id"), "value", asset.alias("asset_id")), "Endpoint")
        scripts = graph.model(assets.select(F.sha2("asset_url", 256).alias("id"), F.col("asset_url").alias("url")), "JavaScriptAsset")
        records = [graph.observations(df, kind, context.scan_id, F.lit(0).cast("long")) for df, kind in ((ends, "Endpoint"), (scripts, "JavaScriptAsset"))]
        sides = [r.select("natural_key", "id", "attributes_json") for r in records]
        target = sides[0].select(F.col("natural_key").alias("target_key"), F.get_json_object("attributes_json", "$.asset_id").alias("asset_id"))
        source = sides[1].select(F.col("natural_key").alias("source_key"), F.col("id").alias("asset_id"))
        pairs = target.join(source, "asset_id").select(F.lit(context.scan_id).alias("scan_id"), F.lit("JavaScriptAsset").alias("source_type"), "source_key", F.lit("reaches").alias("relationship"), F.lit("Endpoint").alias("target_type"), "target_key", F.lit(None).cast("string").alias("evidence"))
        return plugins.Result(records, [pairs], ["found by pattern"])


class _Late(plugins.Plugin):
    """Fails only when its rows are computed."""

    id = "late"

    def run(self, assets: DataFrame, context: plugins.Context) -> plugins.Result:
        return plugins.Result([assets.select(F.raise_error(F.lit("late")).alias("id"))])


class _After(plugins.Plugin):
    id, dependencies = "after", ("late",)

    def run(self, assets: DataFrame, context: plugins.Context) -> plugins.Result:
        return plugins.Result()


class _Strict(plugins.Plugin):
    id, schema = "strict", {"type": "object", "required": ["depth"], "properties": {"depth": {"type": "integer", "minimum": 1}}}

    def run(self, assets: DataFrame, context: plugins.Context) -> plugins.Result:
        return plugins.Result()


def _plugin_tables(spark, d) -> str:
    folder = scratch(spark, "plugins")
    context = plugins.Context("scan-1", {"strict": {"depth": 0}})
    plugins.run_and_store(plugins.Registry([_After(), _Late(), _Strict(), _Endpoints()]), web.scripts(spark, d), context, folder)
    return folder


def plugin_runs(spark, d):
    return open_table(spark, _plugin_tables(spark, d), "plugin_runs").select("id", "scan_id", "plugin_id", "status", "warning_count")


def plugin_edges(spark, d):
    folder = _plugin_tables(spark, d)
    ids = open_table(spark, folder, "graph_nodes").groupBy("node_type").agg(F.count("*").alias("nodes"))
    edges = open_table(spark, folder, "graph_edges").agg(F.count("*").alias("edges"), F.countDistinct("source_id").alias("sources"))
    return ids.join(edges)


# ---- scans and the graph -----------------------------------------------------------------------


def scans_registered(spark, d):
    """Two scans of regions, the second overlapping the first: the first registration stays."""
    r = spark.read.parquet(f"{d}/region.parquet").select(F.col("r_name").alias("id"), "r_regionkey")
    first = r.filter("r_regionkey < 3").select("id", F.lit("first").alias("target"))
    return graph.register_scan(first, r.filter("r_regionkey > 1").select("id", F.lit("second").alias("target")))


def graph_conflicts(spark, d):
    """Ids that several natural keys share, here because every seventh endpoint takes its asset's id."""
    found = web._endpoints(spark, d).withColumn("id", F.when(F.length("value") % 7 == 0, F.col("asset_id")).otherwise(F.col("id")))
    return graph.conflicts(graph.observations(graph.model(found, "Endpoint"), "Endpoint", "scan-1", F.lit(0).cast("long")))


def cascade_urls(spark, d):
    """The addresses that stay when every asset with an odd id is deleted."""
    t = web.ingested(spark, d, ("urls",))
    left = ingest.cascade({"assets": t["assets"].filter("id % 2 = 0"), "urls": t["urls"]})
    names = left["assets"].select(F.col("id").alias("asset_id"), F.col("url").alias("asset_url"))
    return left["urls"].join(names, "asset_id").select("asset_url", "url", "kind")


QUERIES = {f.__name__: f for f in (
    seed_file, seed_single, url_list, crawl_count, manifest_array, manifest_lines, lenient_text, reports_published, imports_view, sorted_url_list, csv_lines, summary_map, summary_markdown, query_json_lines,
    python_analyzer, analyzer_finish, plugin_runs, plugin_edges, scans_registered, graph_conflicts, cascade_urls,
)}

_MANIFEST_SQL = f"{web._BASE} SELECT row_number() OVER (ORDER BY ordinal) - 1 AS position, asset_url AS url, {_ENTRY_SQL} FROM assets"
_THERE = f"{web._ELIGIBLE} AND ordinal % 5 <> 0"
_REPORT_LINES = {"endpoints": (P.RE2_ENDPOINTS, 1, "{'endpoint': value, 'kind': 'api'}"), "imports": (P.RE2_IMPORTS, 1, "{'module': value}"), "urls": (P.RE2_URLS, 0, "{'url': value, 'kind': 'url'}"), "websocket": (P.RE2_WEBSOCKETS, 0, "{'url': value, 'kind': 'websocket'}")}


def _line_sql(report: str) -> str:
    pattern, group, line = _REPORT_LINES[report]
    whole = line.replace("{", "{'asset_url': asset_url, ", 1)
    return f"SELECT '{report}' AS report, asset_url, CAST(to_json({whole}) AS VARCHAR) AS line FROM ({web._report_sql(pattern, group)} AND ordinal % 5 <> 0)"


_TECHNOLOGY_LINES = f"SELECT 'frameworks' AS report, asset_url, CAST(to_json({{'asset_url': asset_url, 'technology': technology, 'evidence': 'signature match'}}) AS VARCHAR) AS line FROM (SELECT t.* FROM ({web._TECH_SQL}) t JOIN assets a USING (asset_url) WHERE ordinal % 5 <> 0)"
_ERROR_LINES = f"SELECT 'errors' AS report, asset_url, CAST(to_json({{'asset_url': asset_url, 'analyzer': 'reader', 'message': 'No such file: ' || local_path}}) AS VARCHAR) AS line FROM assets WHERE {web._ELIGIBLE} AND ordinal % 5 = 0"
_CSV_FIELDS = "concat_ws(',', asset_url, CASE WHEN ordinal % 2 = 0 THEN local_path ELSE '' END, type, sha256(source), CAST(octet_length(encode(source)) AS VARCHAR), '', last_status, CASE discovered_s WHEN 0 THEN '1970-01-01 00:00:00' ELSE '1970-01-02 00:00:00' END)"

ORACLE_SQL: dict[str, str] = {
    "seed_file": f"SELECT regexp_replace(value, '\\r$', '') AS url FROM (SELECT {_SEED.replace('STRING', 'VARCHAR')} AS value FROM pages) WHERE starts_with(value, 'http://') OR starts_with(value, 'https://')",
    "seed_single": "SELECT 'https://seed.example.test/start' AS url",
    "url_list": f"""WITH {synthetic.SQL}, listed AS (SELECT listed_url, 0 AS place, ordinal AS line FROM assets_src WHERE ordinal % 5 = 0 UNION ALL SELECT listed_url, 1, ordinal FROM assets_src WHERE ordinal % 5 <> 1
        UNION ALL SELECT listed_url, 2, -ordinal FROM assets_src WHERE ordinal % 5 = 1), firsts AS (SELECT listed_url, min(place) AS place, arg_min(line, (place, line)) AS line FROM listed GROUP BY listed_url)
        SELECT row_number() OVER (ORDER BY place, line) - 1 AS position, listed_url AS url FROM firsts""",
    "crawl_count": "SELECT CAST(sum(CASE WHEN page_id % 5 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS n FROM pages",
    "manifest_array": _MANIFEST_SQL,
    "manifest_lines": _MANIFEST_SQL,
    "lenient_text": "SELECT page_id, sha256(replace(replace(coalesce(html, '') || 'a' || chr(13) || chr(10) || 'b' || chr(13) || 'c', chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS sha256 FROM pages",
    "reports_published": f"{web._BASE} " + " UNION ALL ".join([*map(_line_sql, _REPORT_LINES), _TECHNOLOGY_LINES, _ERROR_LINES]),
    "imports_view": f"{web._BASE} SELECT value AS module, count(*) AS n, (SELECT count(*) FROM assets WHERE {web._ELIGIBLE} AND ordinal % 5 = 0) AS errors FROM ({web._report_sql(P.RE2_IMPORTS, 1)} AND ordinal % 5 <> 0) GROUP BY value",
    "sorted_url_list": f"WITH {synthetic.SQL} SELECT row_number() OVER (ORDER BY url) - 1 AS position, url FROM (SELECT DISTINCT listed_url AS url FROM assets_src)",
    "csv_lines": f"{web._UPSERT_SQL} SELECT CAST(0 AS BIGINT) AS position, 'url,local_path,asset_type,sha256,size_bytes,mime_type,status,discovered_at' AS line UNION ALL SELECT id, {_CSV_FIELDS} FROM inventory",
    "summary_map": f"{web._BASE} SELECT type AS asset_type, count(*) AS n FROM assets GROUP BY type",
    "summary_markdown": f"""{web._BASE}, types AS (SELECT type, count(*) AS n FROM assets GROUP BY type), lines AS (SELECT 0 AS position, '# Asset summary' AS line UNION ALL SELECT 1, '' UNION ALL SELECT 2, '- Total assets: ' || (SELECT count(*) FROM assets)
        UNION ALL SELECT 3, '- JavaScript assets: ' || (SELECT count(*) FROM assets WHERE type = 'javascript') UNION ALL SELECT 4, '- Endpoints: ' || (SELECT count(*) FROM ({web._report_sql(P.RE2_ENDPOINTS, 1)}))
        UNION ALL SELECT 5, '- Technologies: ' || (SELECT count(DISTINCT technology) FROM ({web._TECH_SQL})) UNION ALL SELECT 6, '' UNION ALL SELECT 7, '## File statistics' UNION ALL SELECT 8, ''
        UNION ALL SELECT 8 + row_number() OVER (ORDER BY type), '- ' || type || ': ' || n FROM types) SELECT CAST(position AS BIGINT) AS position, line FROM lines""",
    "query_json_lines": "SELECT CAST(to_json({'n_nationkey': n_nationkey, 'n_name': n_name, 'nothing': NULL}) AS VARCHAR) AS value FROM nation",
    "python_analyzer": f"{web._BASE} SELECT asset_url, CAST(length(source) AS VARCHAR) AS result FROM assets WHERE {web._ELIGIBLE} UNION ALL SELECT asset_url, 'measured: no socket' FROM assets WHERE {web._ELIGIBLE} AND NOT contains(source, 'wss://')",
    "analyzer_finish": f"{web._BASE}, i AS ({web._report_sql(P.RE2_IMPORTS, 1)}) SELECT asset_url, value FROM i UNION ALL SELECT 'scan', value || ' ' || count(*) FROM i GROUP BY value",
    "plugin_runs": "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'scan-1', 'late', 'failed', CAST(0 AS BIGINT)), (2, 'scan-1', 'after', 'skipped', 0), (3, 'scan-1', 'strict', 'failed', 0), (4, 'scan-1', 'endpoints', 'completed', 1)) AS v(id, scan_id, plugin_id, status, warning_count)",
    "plugin_edges": f"{web._BASE}, e AS ({web._ENDPOINT_ROWS}) SELECT node_type, nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(DISTINCT asset_url) FROM e) AS sources FROM (SELECT 'Endpoint' AS node_type, (SELECT count(*) FROM e) AS nodes UNION ALL SELECT 'JavaScriptAsset', (SELECT count(*) FROM assets WHERE {web._ELIGIBLE}))",
    "scans_registered": "SELECT r_name AS id, CASE WHEN r_regionkey < 3 THEN 'first' ELSE 'second' END AS target FROM region",
    "graph_conflicts": f"{web._BASE}, e AS ({web._ENDPOINT_ROWS}) SELECT id, count(*) AS n FROM (SELECT CASE WHEN length(value) % 7 = 0 THEN asset_id ELSE id END AS id FROM e) GROUP BY id HAVING count(*) > 1",
    "cascade_urls": f"{web._UPSERT_SQL}, f AS (SELECT asset_url, value AS url, 'url' AS kind FROM ({web._report_sql(P.RE2_URLS, 0)}) UNION ALL SELECT asset_url, value, 'websocket' FROM ({web._report_sql(P.RE2_WEBSOCKETS, 0)})) SELECT f.asset_url, f.url, f.kind FROM f JOIN inventory i USING (asset_url) WHERE i.id % 2 = 0",
}
