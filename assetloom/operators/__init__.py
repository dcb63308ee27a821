"""DataFrame operators: dedup, extraction, ingest, reports, graph, plugins."""
