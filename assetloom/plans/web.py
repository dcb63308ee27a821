"""Queries of the asset operators over the synthetic assets, each with the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import urls as U
from ..functions.text import sql_literal
from ..operators import extract, graph, ingest, plugins, summary
from ..operators.ordinals import first_seen
from ..sources import synthetic
from ..sources.readers import as_assets
from ..storage import scratch

Query = Callable[[SparkSession, str], DataFrame]

# ---- the same rules as SQL text ---------------------------------------------------------------

_PATH = "lower(regexp_replace({url}, '(?s)[?#].*$', ''))"


def _classify_sql(url: str) -> str:
    p = _PATH.format(url=url)
    name = f"regexp_extract({p}, '[^/]*$')"
    return f"""CASE WHEN {p} LIKE '%.js' OR {p} LIKE '%.mjs' THEN 'javascript' WHEN {p} LIKE '%.map' THEN 'source_map' WHEN {p} LIKE '%.wasm' THEN 'webassembly'
 WHEN {name} IN ('manifest.json', 'manifest.webmanifest') OR {p} LIKE '%.webmanifest' THEN 'manifest'
 WHEN regexp_matches({p}, {sql_literal(P.WORKER)}) THEN 'worker' WHEN {p} LIKE '%.json' THEN 'configuration' ELSE 'other' END"""


_NAME = "regexp_replace(coalesce(list_filter(string_split(regexp_extract({url}, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '' AND x <> '.')[-1], 'asset'), '[^A-Za-z0-9._-]', '_', 'g')"
_FILE = "lpad(CAST(ordinal AS VARCHAR), 6, '0') || '_' || substr(" + _NAME.format(url="asset_url") + ", 1, 120)"

#: Assets with their class, file name and body, and the manifest of a scan.
_BASE = f"WITH {synthetic.SQL}, assets AS (SELECT *, {_classify_sql('asset_url')} AS type, {_FILE} AS local_path FROM assets_src)"
_ELIGIBLE = "type = 'javascript' AND status = 'downloaded'"


def _matches_sql(pattern: str, group: int) -> str:
    return f"{_BASE} SELECT asset_url, unnest(list_distinct(regexp_extract_all(source, {sql_literal(pattern)}, {group}))) AS value FROM assets WHERE {_ELIGIBLE}"


# ---- inputs ------------------------------------------------------------------------------------


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic assets as a manifest: ordinal, asset_url, type, status, header, local_path, source."""
    a = synthetic.assets(spark, sf_dir)
    url = F.col("asset_url")
    return as_assets(a.withColumns({"type": U.classify(url), "local_path": U.file_name(F.col("ordinal"), url)}))


def scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.eligible(manifest(spark, sf_dir))


def _findings(report: str, *fields: str) -> Query:
    analyzer = [a for a in extract.ANALYZERS if a.report == report]
    return lambda spark, d: extract.findings(scripts(spark, d), analyzer).selectExpr("asset_url", *fields)


# ---- queries -----------------------------------------------------------------------------------


def classify_assets(spark, d):
    return manifest(spark, d).select("asset_url", "type")


def classify_counts(spark, d):
    return manifest(spark, d).groupBy("type").agg(F.count("*").alias("n"))


def candidate_filter(spark, d):
    url = F.concat(F.col("listed_url"), F.lit("  "))
    padded = synthetic.assets(spark, d).select("ordinal", F.when(F.col("ordinal") % 2 == 0, F.col("listed_url")).otherwise(url).alias("url"))
    return padded.filter(U.is_candidate(F.col("url"))).select("ordinal", U.strip(F.col("url")).alias("url"))


def dedup_first_seen(spark, d):
    a = synthetic.assets(spark, d).select("ordinal", F.col("listed_url").alias("url"))
    twice = a.unionByName(a.select((F.col("ordinal") + 1_000_000_000).alias("ordinal"), "url"))
    return first_seen(twice.filter(U.is_web(F.col("url"))))


def eligible_assets(spark, d):
    return scripts(spark, d).select("ordinal", "asset_url")


def safe_names(spark, d):
    return manifest(spark, d).select("asset_url", F.col("local_path").alias("name"))


def integrity(spark, d):
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.sha2(body, 256).alias("sha256"), F.octet_length(body).cast("bigint").alias("size_bytes"))


def mime_guess(spark, d):
    m = manifest(spark, d)
    return m.select("asset_url", U.media_type(F.col("header"), F.col("local_path")).alias("mime_type"))


def page_links(spark, d):
    found = F.array_distinct(F.regexp_extract_all("html", F.lit('(?i)href="([^"]*)"'), F.lit(1)))
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(found).alias("link"))


def error_rows(spark, d):
    m = manifest(spark, d)
    there = m.filter("ordinal % 5 <> 0").select("local_path")
    return extract.reader_errors(m, there, "asset_url").select("asset_url", "analyzer", "message")


def finding_counts(spark, d):
    return extract.findings(scripts(spark, d)).groupBy("report").agg(F.count("*").alias("n"), F.countDistinct("asset_url").alias("assets"))


_EMPTY_TABLES = {n: ddl for n, ddl in {
    "assets": "id bigint, url string, local_path string, asset_type string, sha256 string, size_bytes bigint, mime_type string, status string, discovered_at timestamp",
    "urls": "id bigint, asset_id bigint, url string, kind string",
    "endpoints": "id bigint, asset_id bigint, endpoint string, method string, kind string",
    "technologies": "id bigint, asset_id bigint, name string, evidence string",
}.items()}


def _entries(spark, d, which: str, status) -> DataFrame:
    """The manifest of a scan of part of the assets."""
    m = manifest(spark, d).filter(which)
    return m.select("ordinal", F.col("asset_url").alias("url"), "type", F.when(F.col("ordinal") % 2 == 0, F.col("local_path")).alias("local_path"), F.sha2("source", 256).alias("sha256"), F.octet_length("source").cast("bigint").alias("size_bytes"), F.lit(None).cast("string").alias("mime_type"), status.alias("status"))


def _reports(spark, d, which: str) -> dict[str, DataFrame]:
    """The reports of a scan of part of the assets."""
    m = manifest(spark, d).filter(which)
    found = extract.findings(extract.eligible(m)).withColumn("ordinal", F.struct("ordinal", "position"))
    # As in a scan, findings are stored once and read by report.
    f = ingest.snapshots(scratch(spark, "reports"))("findings", found)
    own = lambda name, field, *more: f.filter(F.col("report") == name).select("asset_url", F.col("value").alias(field), *more, "ordinal")
    return {"urls": own("urls", "url", "kind"), "websocket": own("websocket", "url", "kind"), "endpoints": own("endpoints", "endpoint", "kind"), "frameworks": own("frameworks", "technology", "evidence")}


def ingested(spark, d, needed: tuple[str, ...]) -> dict[str, DataFrame]:
    """The inventory and the ``needed`` tables after two scans: two thirds of the assets, then two thirds of them again with another status.

    Each ingest is a snapshot in the shared folder, as the engine keeps them; only what a query needs is stored.
    """
    tables = {n: spark.createDataFrame([], ddl) for n, ddl in _EMPTY_TABLES.items()}
    for day, (which, status) in enumerate((("ordinal % 3 <> 1", F.col("status")), ("ordinal % 3 <> 0", F.lit("rescanned")))):
        keep, now = ingest.snapshots(scratch(spark, "ingest")), F.timestamp_seconds(F.lit(86_400 * day))
        entries = _entries(spark, d, which, status)
        if needed:
            tables = ingest.ingest(tables, entries, _reports(spark, d, which), now, keep, needed)
        else:
            tables = tables | {"assets": keep("assets", ingest.upsert_assets(tables["assets"], entries, now))}
    return tables


def upsert_assets(spark, d):
    both = ingested(spark, d, ())["assets"]
    return both.select("id", "url", "local_path", "asset_type", "sha256", "size_bytes", "mime_type", "status", F.unix_seconds("discovered_at").alias("discovered_s"))


_UPSERT_SQL = f"""{_BASE}, first AS (SELECT row_number() OVER (ORDER BY ordinal) AS id, * FROM assets WHERE ordinal % 3 <> 1),
 second AS (SELECT (SELECT count(*) FROM first) + row_number() OVER (ORDER BY ordinal) AS id, * FROM assets WHERE ordinal % 3 = 1),
 inventory AS (SELECT *, 0 AS discovered_s, CASE WHEN ordinal % 3 = 0 THEN status ELSE 'rescanned' END AS last_status FROM first
  UNION ALL SELECT *, 86400, 'rescanned' FROM second)"""


def ingest_urls(spark, d):
    t = ingested(spark, d, ("urls",))
    return t["urls"].join(t["assets"].select(F.col("id").alias("asset_id"), F.col("url").alias("asset_url")), "asset_id").select("asset_url", "url", "kind")


def _report_sql(pattern: str, group: int) -> str:
    return f"SELECT asset_url, unnest(list_distinct(regexp_extract_all(source, {sql_literal(pattern)}, {group}))) AS value FROM assets WHERE {_ELIGIBLE}"


_TECH_SQL = " UNION ALL ".join(f"SELECT asset_url, {sql_literal(n)} AS technology FROM assets WHERE {_ELIGIBLE} AND regexp_matches(source, {sql_literal(P.re2_technology(t))})" for n, t in P.TECHNOLOGIES.items())


def summary_figures(spark, d):
    t = ingested(spark, d, ("endpoints", "technologies"))
    return summary.figures(t["assets"], t["endpoints"], t["technologies"]).select("total_assets", "javascript_count", "endpoint_count", "technology_count")


def summary_types(spark, d):
    return summary.by_type(ingested(spark, d, ())["assets"])


def report_csv_order(spark, d):
    a = ingested(spark, d, ())["assets"]
    return a.select("id", "url", "asset_type", "status").orderBy("id")


# ---- graph -------------------------------------------------------------------------------------


def _endpoints(spark, d) -> DataFrame:
    found = extract.findings(scripts(spark, d), [a for a in extract.ANALYZERS if a.id == "endpoints"])
    asset = F.sha2(F.col("asset_url"), 256)
    return found.select(F.sha2(F.concat("asset_url", F.lit(" "), "value"), 256).alias("id"), "value", asset.alias("asset_id"), "ordinal", "position")


def _observed(spark, d) -> DataFrame:
    found = _endpoints(spark, d)
    ends = graph.model(found, "Endpoint")
    first = graph.observations(ends, "Endpoint", "scan-1", F.lit(1).cast("long"))
    again = graph.observations(ends.withColumn("id", F.concat(F.lit("later-"), "id")), "Endpoint", "scan-1", F.lit(2).cast("long"))
    assets = graph.model(scripts(spark, d).select(F.sha2("asset_url", 256).alias("id"), F.col("asset_url").alias("url")), "JavaScriptAsset")
    return first.unionByName(again).unionByName(graph.observations(assets, "JavaScriptAsset", "scan-1", F.lit(0).cast("long")))


def graph_nodes(spark, d):
    nodes = graph.store(_observed(spark, d))
    return nodes.select("id", "scan_id", "node_type", F.sha2("natural_key", 256).alias("key_hash"), F.get_json_object("attributes_json", "$.id").alias("latest_id"))


_ENDPOINT_ROWS = f"SELECT asset_url, value, sha256(asset_url || ' ' || value) AS id, sha256(asset_url) AS asset_id FROM ({_report_sql(P.RE2_ENDPOINTS, 1)})"
_ENDPOINT_KEY = "sha256(to_json({'asset_id': asset_id, 'confidence': 0, 'method': NULL, 'protocol': 'http', 'value': value}))"
_ASSET_KEY = "sha256(to_json({'asset_type': 'javascript', 'content_type': NULL, 'etag': NULL, 'language': 'javascript', 'last_modified': NULL, 'local_path': NULL, 'sha256': NULL, 'size_bytes': NULL, 'source_map_url': NULL, 'url': asset_url}))"


def graph_edges(spark, d):
    nodes = graph.store(_observed(spark, d))
    sides = nodes.filter("node_type = 'Endpoint'").select(F.col("natural_key").alias("target_key"), F.get_json_object("natural_key", "$.asset_id").alias("asset_id"))
    assets = nodes.filter("node_type = 'JavaScriptAsset'").select(F.col("natural_key").alias("source_key"), F.col("id").alias("asset_id"))
    pairs = sides.join(assets, "asset_id").select(F.lit("scan-1").alias("scan_id"), F.lit("JavaScriptAsset").alias("source_type"), "source_key", F.lit("reaches").alias("relationship"), F.lit("Endpoint").alias("target_type"), "target_key", F.lit(None).cast("string").alias("evidence"))
    return graph.relate(nodes, pairs.unionByName(pairs))


def _territory(spark, d) -> DataFrame:
    """Regions to nations, nations to customers, customers to orders: all of them."""
    levels = (("nation", "r", "n_regionkey", "n", "n_nationkey", "has nation"), ("customer", "n", "c_nationkey", "c", "c_custkey", "has customer"), ("orders", "c", "o_custkey", "o", "o_orderkey", "has order"))
    edges = [spark.read.parquet(f"{d}/{table}.parquet").selectExpr("'a' AS scan_id", f"concat('{s}', {source}) AS source_id", f"'{name}' AS relationship", f"concat('{t}', {target}) AS target_id", f"'{table}' AS evidence") for table, s, source, t, target, name in levels]
    return edges[0].union(edges[1]).union(edges[2])


_TERRITORY_SQL = """edges AS (SELECT 'r' || n_regionkey AS source_id, 'has nation' AS relationship, 'n' || n_nationkey AS target_id, 'nation' AS evidence FROM nation
 UNION ALL SELECT 'n' || c_nationkey, 'has customer', 'c' || c_custkey, 'customer' FROM customer UNION ALL SELECT 'c' || o_custkey, 'has order', 'o' || o_orderkey, 'orders' FROM orders)"""
_CYCLE = [("a", "b"), ("a", "d"), ("b", "c"), ("d", "c"), ("c", "a")]


def _walk_sql(edges: str, start: str, depth: int) -> str:
    return f"""WITH RECURSIVE {edges}, walk AS (SELECT source_id, relationship, target_id, evidence, 1 AS depth FROM edges WHERE source_id = '{start}'
 UNION ALL SELECT e.source_id, e.relationship, e.target_id, e.evidence, w.depth + 1 FROM edges e JOIN walk w ON e.source_id = w.target_id WHERE w.depth < {depth})
 SELECT source_id, relationship, target_id, evidence, CAST(depth AS VARCHAR) AS depth FROM walk"""


def _traverse(depth: int) -> Query:
    return lambda spark, d: graph.traverse(_territory(spark, d), "a", "r1", depth)


def graph_traverse_cycle(spark, d):
    edges = spark.createDataFrame([("a", s, "to", t, "") for s, t in _CYCLE], "scan_id string, source_id string, relationship string, target_id string, evidence string")
    return graph.traverse(edges, "a", "a", 4)


_CYCLE_SQL = "edges AS (SELECT source_id, 'to' AS relationship, target_id, '' AS evidence FROM (VALUES " + ", ".join(f"('{s}', '{t}')" for s, t in _CYCLE) + ") AS v(source_id, target_id))"

_PLUGINS = [("report", ["graph", "secrets"]), ("graph", ["extract"]), ("secrets", ["extract"]), ("extract", ["classify"]), ("classify", [])]


def plugin_order(spark, d):
    frame = spark.createDataFrame(_PLUGINS, "id string, dependencies array<string>")
    return plugins.order_levels(frame)


_PLUGIN_SQL = "WITH RECURSIVE p(id, needs) AS (VALUES " + ", ".join(f"('{i}', {n or '[]::VARCHAR[]'})" for i, n in _PLUGINS) + """), chain AS (SELECT id, 0 AS level FROM p WHERE len(needs) = 0
 UNION ALL SELECT p.id, c.level + 1 FROM p JOIN chain c ON list_contains(p.needs, c.id)) SELECT id, CAST(max(level) AS INTEGER) AS level FROM chain GROUP BY id"""


def scan_diff(spark, d):
    """New beside the reference operators: what changed between two scans, by a full outer join."""
    old = _entries(spark, d, "ordinal % 3 <> 1", F.col("status")).select("url", F.col("status").alias("old"))
    new = _entries(spark, d, "ordinal % 3 <> 0", F.lit("rescanned")).select("url", F.col("status").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed").otherwise("same")
    return old.join(new, "url", "full").select("url", change.alias("change"))


QUERIES: dict[str, Query] = {
    "classify_assets": classify_assets,
    "classify_counts": classify_counts,
    "candidate_filter": candidate_filter,
    "dedup_first_seen": dedup_first_seen,
    "eligible_assets": eligible_assets,
    "safe_names": safe_names,
    "integrity": integrity,
    "mime_guess": mime_guess,
    "extract_endpoints": _findings("endpoints", "value AS endpoint", "kind"),
    "extract_imports": _findings("imports", "value AS module"),
    "extract_urls": _findings("urls", "value AS url", "kind"),
    "extract_websockets": _findings("websocket", "value AS url", "kind"),
    "detect_frameworks": _findings("frameworks", "value AS technology", "evidence"),
    "finding_counts": finding_counts,
    "page_links": page_links,
    "error_rows": error_rows,
    "upsert_assets": upsert_assets,
    "ingest_urls": ingest_urls,
    "summary_figures": summary_figures,
    "summary_types": summary_types,
    "report_csv_order": report_csv_order,
    "graph_nodes": graph_nodes,
    "graph_edges": graph_edges,
    "graph_traverse_d1": _traverse(1),
    "graph_traverse_d3": _traverse(3),
    "graph_traverse_cycle": graph_traverse_cycle,
    "plugin_order": plugin_order,
    "scan_diff": scan_diff,
}

_ALL_FINDINGS = f"""f AS (SELECT 'endpoints' AS report, asset_url, value FROM ({_report_sql(P.RE2_ENDPOINTS, 1)}) UNION ALL SELECT 'imports', asset_url, value FROM ({_report_sql(P.RE2_IMPORTS, 1)})
 UNION ALL SELECT 'urls', asset_url, value FROM ({_report_sql(P.RE2_URLS, 0)}) UNION ALL SELECT 'websocket', asset_url, value FROM ({_report_sql(P.RE2_WEBSOCKETS, 0)}) UNION ALL SELECT 'frameworks', asset_url, technology FROM ({_TECH_SQL}))"""

ORACLE_SQL: dict[str, str] = {
    "classify_assets": f"{_BASE} SELECT asset_url, type FROM assets",
    "classify_counts": f"{_BASE} SELECT type, count(*) AS n FROM assets GROUP BY type",
    "candidate_filter": f"WITH {synthetic.SQL}, c AS (SELECT ordinal, CASE WHEN ordinal % 2 = 0 THEN listed_url ELSE listed_url || '  ' END AS url FROM assets_src) SELECT ordinal, trim(url) AS url FROM c WHERE regexp_matches(url, {sql_literal(P.CANDIDATE)})",
    "dedup_first_seen": f"WITH {synthetic.SQL} SELECT row_number() OVER (ORDER BY o) - 1 AS position, url FROM (SELECT listed_url AS url, min(ordinal) AS o FROM assets_src WHERE starts_with(listed_url, 'http://') OR starts_with(listed_url, 'https://') GROUP BY 1)",
    "eligible_assets": f"{_BASE} SELECT ordinal, asset_url FROM assets WHERE {_ELIGIBLE}",
    "safe_names": f"{_BASE} SELECT asset_url, local_path AS name FROM assets",
    "integrity": "SELECT page_id, sha256(coalesce(html, '')) AS sha256, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS size_bytes FROM pages",
    "mime_guess": f"{_BASE} SELECT asset_url, coalesce(nullif(split_part(header, ';', 1), ''), CASE lower(regexp_extract(local_path, '\\.([A-Za-z0-9]+)$', 1)) {' '.join(f'WHEN {sql_literal(k)} THEN {sql_literal(v)}' for k, v in U.MEDIA_TYPES.items())} END) AS mime_type FROM assets",
    "extract_endpoints": f"SELECT asset_url, value AS endpoint, 'api' AS kind FROM ({_matches_sql(P.RE2_ENDPOINTS, 1)})",
    "extract_imports": f"SELECT asset_url, value AS module FROM ({_matches_sql(P.RE2_IMPORTS, 1)})",
    "extract_urls": f"SELECT asset_url, value AS url, 'url' AS kind FROM ({_matches_sql(P.RE2_URLS, 0)})",
    "extract_websockets": f"SELECT asset_url, value AS url, 'websocket' AS kind FROM ({_matches_sql(P.RE2_WEBSOCKETS, 0)})",
    "detect_frameworks": f"{_BASE} SELECT asset_url, technology, 'signature match' AS evidence FROM ({_TECH_SQL})",
    "finding_counts": f"{_BASE}, {_ALL_FINDINGS} SELECT report, count(*) AS n, count(DISTINCT asset_url) AS assets FROM f GROUP BY report",
    "page_links": "SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '(?i)href=\"([^\"]*)\"', 1))) AS link FROM pages",
    "error_rows": f"{_BASE} SELECT asset_url, 'reader' AS analyzer, 'No such file: ' || local_path AS message FROM assets WHERE {_ELIGIBLE} AND ordinal % 5 = 0",
    "upsert_assets": f"{_UPSERT_SQL} SELECT id, asset_url AS url, CASE WHEN ordinal % 2 = 0 THEN local_path END AS local_path, type AS asset_type, sha256(source) AS sha256, CAST(octet_length(encode(source)) AS BIGINT) AS size_bytes, CAST(NULL AS VARCHAR) AS mime_type, last_status AS status, CAST(discovered_s AS BIGINT) AS discovered_s FROM inventory",
    "ingest_urls": f"{_BASE} SELECT asset_url, value AS url, 'url' AS kind FROM ({_report_sql(P.RE2_URLS, 0)}) UNION ALL SELECT asset_url, value, 'websocket' FROM ({_report_sql(P.RE2_WEBSOCKETS, 0)})",
    "summary_figures": f"{_BASE} SELECT (SELECT count(*) FROM assets) AS total_assets, (SELECT count(*) FROM assets WHERE type = 'javascript') AS javascript_count, (SELECT count(*) FROM ({_report_sql(P.RE2_ENDPOINTS, 1)})) AS endpoint_count, (SELECT count(DISTINCT technology) FROM ({_TECH_SQL})) AS technology_count",
    "summary_types": f"{_BASE} SELECT type AS asset_type, count(*) AS n FROM assets GROUP BY type",
    "report_csv_order": f"{_UPSERT_SQL} SELECT id, asset_url AS url, type AS asset_type, last_status AS status FROM inventory",
    "graph_nodes": f"{_BASE}, e AS ({_ENDPOINT_ROWS}) SELECT id, 'scan-1' AS scan_id, 'Endpoint' AS node_type, {_ENDPOINT_KEY} AS key_hash, 'later-' || id AS latest_id FROM e UNION ALL SELECT sha256(asset_url), 'scan-1', 'JavaScriptAsset', {_ASSET_KEY}, sha256(asset_url) FROM assets WHERE {_ELIGIBLE}",
    "graph_edges": f"{_BASE}, e AS ({_ENDPOINT_ROWS}) SELECT 'scan-1' AS scan_id, asset_id AS source_id, 'reaches' AS relationship, id AS target_id, '' AS evidence FROM e",
    "graph_traverse_d1": _walk_sql(_TERRITORY_SQL, "r1", 1),
    "graph_traverse_d3": _walk_sql(_TERRITORY_SQL, "r1", 3),
    "graph_traverse_cycle": _walk_sql(_CYCLE_SQL, "a", 4),
    "plugin_order": _PLUGIN_SQL,
    "scan_diff": f"{_BASE} SELECT asset_url AS url, CASE ordinal % 3 WHEN 0 THEN 'removed' WHEN 1 THEN 'added' ELSE 'changed' END AS change FROM assets",
}
