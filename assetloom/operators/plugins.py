"""Plugins: metadata, dependency order, and a small runner.

A plugin maps a DataFrame of assets to DataFrames of records and edges; the graph of plugins is
tiny and ordered on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import TABLES
from ..storage import open_table, publish, stage, written
from .graph import relate, store


@dataclass(frozen=True)
class Context:
    """What a run knows: the scan's id and the configuration."""

    scan_id: str
    configuration: Mapping[str, Any] = field(default_factory=dict)


@dataclass(frozen=True)
class Result:
    """Node observations, edges by natural key, and warnings."""

    records: Sequence[DataFrame] = ()
    relationships: Sequence[DataFrame] = ()
    warnings: Sequence[str] = ()


class Plugin:
    """Subclasses give an id, a version and ``run``."""

    id: str = ""
    version: str = "0"
    dependencies: tuple[str, ...] = ()
    asset_types: tuple[str, ...] = ("javascript",)
    schema: Mapping[str, Any] = {"type": "object", "additionalProperties": False}

    def initialize(self, context: Context) -> None:
        """Acquire what the run needs."""

    def run(self, assets: DataFrame, context: Context) -> Result:
        raise NotImplementedError

    def cleanup(self, context: Context) -> None:
        """Release it, even after another plugin failed."""


class Registry:
    """Plugins by id, in order of registration."""

    def __init__(self, plugins: Iterable[Plugin] = ()) -> None:
        self.plugins: dict[str, Plugin] = {}
        for p in plugins:
            self.register(p)

    def register(self, plugin: Plugin) -> None:
        if not plugin.id:
            raise ValueError("a plugin needs an id")
        if plugin.id in self.plugins:
            raise ValueError(f"there is a plugin {plugin.id!r} already")
        self.plugins[plugin.id] = plugin

    def get(self, name: str) -> Plugin:
        if name not in self.plugins:
            raise KeyError(f"no plugin {name!r}")
        return self.plugins[name]

    def ordered(self, requested: Iterable[str] | None = None) -> list[Plugin]:
        """The requested plugins (all by default) with what they depend on, dependencies first.

        Otherwise in the order asked for.  An explicit stack holds the path, so long chains don't
        overflow; meeting a plugin of the path again is a cycle.
        """
        done: dict[str, Plugin] = {}
        for start in list(self.plugins) if requested is None else requested:
            path: dict[str, list[str]] = {}
            waiting = [start]
            while waiting:
                name = waiting[-1]
                if name in done:
                    waiting.pop()
                    continue
                if name not in path:
                    path[name] = list(self.get(name).dependencies)
                needed = path[name]
                while needed and needed[0] in done:
                    needed.pop(0)
                if not needed:
                    done[name] = self.plugins[name]
                    del path[name]
                    waiting.pop()
                elif needed[0] in path:
                    raise ValueError(f"plugins depend on each other: {needed[0]}")
                else:
                    waiting.append(needed[0])
        return list(done.values())


_KINDS = {"object": Mapping, "array": (list, tuple), "string": str, "integer": int, "number": (int, float), "boolean": bool, "null": type(None)}


def check(value: Any, schema: Mapping[str, Any], where: str = "configuration") -> None:
    """Check a configuration against the part of JSON Schema that plugins declare theirs in; a ValueError says what doesn't fit.

    type, enum, minimum, maximum, required, properties, additionalProperties and items count.
    """
    kind = schema.get("type")
    if kind is not None:
        kinds = [kind] if isinstance(kind, str) else list(kind)
        if unknown := [k for k in kinds if k not in _KINDS]:
            raise ValueError(f"{where}: the schema names an unknown type {unknown[0]!r}")
        fits = any(isinstance(value, _KINDS[k]) and (k == "boolean" or not isinstance(value, bool)) for k in kinds)
        if not fits:
            raise ValueError(f"{where} must be of type {' or '.join(kinds)}")
    if "enum" in schema and value not in schema["enum"]:
        raise ValueError(f"{where} must be one of {schema['enum']}")
    for bound, holds in (("minimum", lambda v, b: v >= b), ("maximum", lambda v, b: v <= b)):
        if bound in schema and isinstance(value, (int, float)) and not holds(value, schema[bound]):
            raise ValueError(f"{where} has a {bound} of {schema[bound]}")
    if isinstance(value, Mapping):
        known = schema.get("properties", {})
        if lacking := [n for n in schema.get("required", ()) if n not in value]:
            raise ValueError(f"{where} lacks {lacking[0]!r}")
        more = schema.get("additionalProperties", True)
        for name, item in value.items():
            inner = known.get(name, more)
            if inner is False:
                raise ValueError(f"{where} doesn't know {name!r}")
            if isinstance(inner, Mapping):
                check(item, inner, f"{where}.{name}")
    elif isinstance(value, (list, tuple)) and "items" in schema:
        for i, item in enumerate(value):
            check(item, schema["items"], f"{where}[{i}]")


@dataclass(frozen=True)
class Run:
    """A row of plugin_runs: status is completed, failed or skipped."""

    plugin_id: str
    plugin_version: str
    status: str
    started_at: datetime
    finished_at: datetime
    warning_count: int = 0
    message: str = ""


def _stored(result: Result) -> Result:
    """The result with its frames computed and written, so that what they raise is raised here."""
    return Result([written(r, "plugin-records") for r in result.records], [written(r, "plugin-edges") for r in result.relationships], result.warnings)


def run(registry: Registry, assets: DataFrame, context: Context, requested: Iterable[str] | None = None, keep: Callable[[Plugin, Result], Any] | None = None) -> tuple[dict[str, Result], list[Run]]:
    """Results by plugin id, computed and written, and a Run of each plugin.

    A plugin's part of the configuration (under its id) is checked against its schema first.  A
    plugin that fails, there, in its code or while its frames are computed or kept, is recorded as
    failed, and what depends on it as skipped; every plugin that was initialized is cleaned up.
    ``keep`` gets each result once it is written.
    """
    results: dict[str, Result] = {}
    runs: list[Run] = []
    now = lambda: datetime.now(timezone.utc).replace(tzinfo=None)
    for plugin in registry.ordered(requested):
        began, started = now(), False
        if any(d not in results for d in plugin.dependencies):
            runs.append(Run(plugin.id, plugin.version, "skipped", began, now()))
            continue
        try:
            check(context.configuration.get(plugin.id, {}), plugin.schema, plugin.id)
            started = True
            plugin.initialize(context)
            result = _stored(plugin.run(assets.filter(F.col("type").isin(*plugin.asset_types)), context))
            if keep is not None:
                keep(plugin, result)
            results[plugin.id] = result
            runs.append(Run(plugin.id, plugin.version, "completed", began, now(), len(result.warnings)))
        except Exception as e:  # noqa: BLE001  one plugin mustn't end the others
            runs.append(Run(plugin.id, plugin.version, "failed", began, now(), message=str(e)))
        finally:
            if started:
                plugin.cleanup(context)
    return results, runs


def run_rows(spark: SparkSession, runs: Sequence[Run], scan_id: str, first_id: int = 1) -> DataFrame:
    """The rows of plugin_runs."""
    rows = [(first_id + i, scan_id, r.plugin_id, r.plugin_version, r.status, r.started_at, r.finished_at, r.warning_count) for i, r in enumerate(runs)]
    return spark.createDataFrame(rows, TABLES["plugin_runs"])


def run_and_store(registry: Registry, assets: DataFrame, context: Context, folder: str, requested: Iterable[str] | None = None) -> list[Run]:
    """Run plugins over assets and store what they find in the tables under ``folder``, in one version.

    Records are node observations, relationships are pairs by natural key as ``graph.relate`` takes
    them.  The graph is stored plugin by plugin, so a plugin whose records or edges break a key fails
    alone and leaves nothing.
    """
    spark = assets.sparkSession
    state = {n: open_table(spark, folder, n) for n in ("graph_nodes", "graph_edges")}

    def keep(plugin: Plugin, result: Result) -> None:
        nodes, edges = state["graph_nodes"], state["graph_edges"]
        if result.records:
            seen = result.records[0]
            for more in result.records[1:]:
                seen = seen.unionByName(more)
            nodes = written(store(seen, nodes), "plugin-nodes")
        for pairs in result.relationships:
            edges = relate(nodes, pairs, edges)
        if result.relationships:
            edges = written(edges, "plugin-graph")
        state.update(graph_nodes=nodes, graph_edges=edges)

    _, runs = run(registry, assets, context, requested, keep)
    past = open_table(spark, folder, "plugin_runs")
    first = (past.agg(F.max("id")).first()[0] or 0) + 1
    state["plugin_runs"] = past.unionByName(run_rows(spark, runs, context.scan_id, first))
    publish(spark, folder, {n: stage(df.select(*TABLES[n].names), folder, n) for n, df in state.items()})
    return runs


def order_levels(plugins: DataFrame) -> DataFrame:
    """(id, level) for a table of plugins (id, dependencies): the longest chain below each; a cycle or an unknown plugin is an error.

    The table is a registry's metadata, a row for each plugin that is installed, so it is put in
    order on the driver.
    """
    needs = {r.id: list(r.dependencies or ()) for r in plugins.select("id", "dependencies").collect()}

    class Known(Plugin):
        def __init__(self, name: str) -> None:
            self.id, self.dependencies = name, tuple(needs[name])

    levels: dict[str, int] = {}
    for plugin in Registry(map(Known, needs)).ordered():
        levels[plugin.id] = max((levels[d] + 1 for d in plugin.dependencies), default=0)
    return plugins.sparkSession.createDataFrame(list(levels.items()), "id string, level int")
