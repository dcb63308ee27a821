"""Assets made from the ``pages`` table by expressions that Spark and DuckDB read alike.

The driver's pages hold no script text; a snippet that depends on the page id alone is added, so
that every analyzer finds something and something to leave alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '/$', '')"
_SUFFIX = """CASE page_id % 12 WHEN 0 THEN '/a.js' WHEN 1 THEN '/A.MJS' WHEN 2 THEN '/a.js.map' WHEN 3 THEN '/a.wasm'
 WHEN 4 THEN '/manifest.json' WHEN 5 THEN '/site.webmanifest' WHEN 6 THEN '/sw/worker/' WHEN 7 THEN '/cfg.json'
 WHEN 8 THEN '/service-worker.js' WHEN 9 THEN '/worker.json' WHEN 10 THEN '/a b.js?v=1#x' ELSE '/workers/x' END"""
_SNIPPET = """concat(
 CASE page_id % 4 WHEN 0 THEN 'import React, {useState} from "react"; import "./side.css";' WHEN 1 THEN 'const a = require("axios"); reimport "late";'
  WHEN 2 THEN 'import * as V from "vue"; createApp();' ELSE 'import("lazy"); require( "spaced"); export * from "other"' END, chr(10),
 'fetch("/api/v', CAST(page_id % 5 AS STRING), '/users/', '$', '{id}?q=1"); x="/GraphQL"; y=/rest/', CAST(page_id % 7 AS STRING), ' /apiary a/v1 //v2/no', chr(10),
 CASE page_id % 3 WHEN 0 THEN 'ws("wss://socket.example.test/live"); ' WHEN 1 THEN 'WS://Plain.example.test:8080/a ' ELSE '' END,
 'https://api.example.test/v1/items/', CAST(page_id % 11 AS STRING), ' //comment HTTPS://UP.example.test', chr(10),
 CASE page_id % 10 WHEN 0 THEN 'NgModule' WHEN 1 THEN 'x@angular/core' WHEN 2 THEN '"@angular/core"' WHEN 3 THEN '__NEXT_DATA__' WHEN 4 THEN 'nuxt.js'
  WHEN 5 THEN 'svelte/internal' WHEN 6 THEN 'x=__webpack_require__(1)' WHEN 7 THEN 'x/@vite/client' WHEN 8 THEN 'rollupPlugin' ELSE 'import.meta.hot' END)"""

#: name -> expression over ``pages``
COLUMNS = {
    "ordinal": "page_id",
    "asset_url": f"concat({_BASE}, '/p', CAST(page_id AS STRING), {_SUFFIX})",
    "listed_url": f"concat({_BASE}, {_SUFFIX})",
    "status": "CASE WHEN page_id % 11 = 0 THEN 'failed' ELSE 'downloaded' END",
    "header": "CASE page_id % 3 WHEN 0 THEN 'text/javascript; charset=utf-8' WHEN 1 THEN '' END",
    "source": f"concat(coalesce(html, ''), chr(10), {_SNIPPET})",
}

#: The same as a DuckDB common table expression.
SQL = "assets_src AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in COLUMNS.items()) + " FROM pages)"


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, asset_url, listed_url, status, header, source); asset_url is unique, listed_url isn't."""
    return spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr(*[f"{e} AS {n}" for n, e in COLUMNS.items()])
