"""Schemas of the pipeline's tables and of the domain models. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T
from pyspark.sql.types import StructType

_TYPES = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType())}


def _schema(fields: str) -> StructType:
    """From ``name type, ...``, without a running session."""
    return StructType([T.StructField(name, _TYPES[kind]) for name, kind in (f.split() for f in fields.split(", "))])


MANIFEST = _schema("url string, type string, local_path string, sha256 string, size_bytes bigint, mime_type string, status string, error string")
FINDING = _schema("asset_url string, report string, value string, kind string, evidence string, ordinal bigint")

#: Reports and their fields, in order.
REPORTS = {
    "urls": _schema("asset_url string, url string, kind string"),
    "endpoints": _schema("asset_url string, endpoint string, kind string"),
    "websocket": _schema("asset_url string, url string, kind string"),
    "imports": _schema("asset_url string, module string"),
    "frameworks": _schema("asset_url string, technology string, evidence string"),
    "errors": _schema("asset_url string, analyzer string, message string"),
}

#: Inventory tables.
TABLES = {
    "assets": _schema("id bigint, url string, local_path string, asset_type string, sha256 string, size_bytes bigint, mime_type string, status string, discovered_at timestamp"),
    "urls": _schema("id bigint, asset_id bigint, url string, kind string"),
    "endpoints": _schema("id bigint, asset_id bigint, endpoint string, method string, kind string"),
    "technologies": _schema("id bigint, asset_id bigint, name string, evidence string"),
    "findings": _schema("id bigint, asset_id bigint, finding_type string, severity string, value string, created_at timestamp"),
    "scan_runs": _schema("id string, target string, configuration_hash string, status string, started_at timestamp, finished_at timestamp"),
    "scan_assets": _schema("scan_id string, asset_id bigint"),
    "graph_nodes": _schema("id string, scan_id string, node_type string, natural_key string, attributes_json string"),
    "graph_edges": _schema("scan_id string, source_id string, relationship string, target_id string, evidence string"),
    "plugin_runs": _schema("id bigint, scan_id string, plugin_id string, plugin_version string, status string, started_at timestamp, finished_at timestamp, warning_count bigint"),
    "schema_migrations": _schema("version string, applied_at timestamp"),
}

#: Versions of the table set, append-only: each adds tables and none changes one.
MIGRATIONS = (
    ("0001_inventory", ("assets", "urls", "endpoints", "technologies", "findings")),
    ("0002_platform", ("scan_runs", "scan_assets", "graph_nodes", "graph_edges", "plugin_runs")),
)

#: Classes of assets.
ASSET_TYPES = ("javascript", "source_map", "webassembly", "configuration", "manifest", "worker", "other")

_ASSET = "id string, url string, asset_type string, sha256 string, local_path string, content_type string, size_bytes bigint, etag string, last_modified string"

#: Domain models, by the name that graph nodes carry as their type.
MODELS = {
    "ScanRun": _schema("id string, started_at timestamp, target string, configuration_hash string, status string"),
    "Asset": _schema(_ASSET),
    "JavaScriptAsset": _schema(_ASSET + ", language string, source_map_url string"),
    "SourceMap": _schema(_ASSET + ", compiled_asset_id string, original_sources array<string>"),
    "Endpoint": _schema("id string, value string, protocol string, method string, asset_id string, confidence int"),
    "GraphQLOperation": _schema("id string, name string, operation_type string, endpoint_id string, asset_id string"),
    "Dependency": _schema("id string, name string, version string, source string, asset_id string"),
    "Framework": _schema("id string, name string, version string, evidence string, asset_id string"),
    "RuntimeRequest": _schema("id string, url string, method string, initiator string, status_code int, duration_ms double, asset_id string"),
    "StorageEntry": _schema("id string, storage_type string, key string, value_hash string, origin string"),
    "ServiceWorker": _schema("id string, scope string, script_url string, asset_id string"),
    "Chunk": _schema("id string, name string, bundle string, asset_id string, lazy boolean"),
    "Import": _schema("id string, specifier string, kind string, asset_id string, resolved_asset_id string"),
    "SecretFinding": _schema("id string, category string, fingerprint string, asset_id string, confidence int, severity string, evidence string"),
    "Technology": _schema("id string, name string, version string, evidence string, asset_id string"),
    "Manifest": _schema("id string, name string, start_url string, asset_id string"),
}

#: What a model's field is where it isn't given.
DEFAULTS = {
    "ScanRun": {"target": "", "configuration_hash": "", "status": "running"},
    "Asset": {"url": "", "asset_type": "other"},
    "JavaScriptAsset": {"url": "", "asset_type": "javascript", "language": "javascript"},
    "SourceMap": {"url": "", "asset_type": "source_map"},
    "Endpoint": {"value": "", "protocol": "http", "confidence": 0},
    "GraphQLOperation": {"name": "", "operation_type": "query"},
    "Dependency": {"name": "", "source": "bundle"},
    "Framework": {"name": "", "evidence": ""},
    "RuntimeRequest": {"url": "", "method": "GET"},
    "StorageEntry": {"storage_type": "localStorage", "key": "", "origin": ""},
    "ServiceWorker": {"scope": "", "script_url": ""},
    "Chunk": {"name": "", "bundle": "", "lazy": False},
    "Import": {"specifier": "", "kind": "static"},
    "SecretFinding": {"category": "unknown", "fingerprint": "", "confidence": 0, "severity": "info", "evidence": ""},
    "Technology": {"name": "", "evidence": ""},
    "Manifest": {"name": ""},
}
