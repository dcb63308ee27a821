"""The knowledge graph: nodes by natural key, edges with evidence, bounded traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import DEFAULTS, MODELS
from ..storage import written

NODE = "id string, scan_id string, node_type string, natural_key string, attributes_json string"


def model(df: DataFrame, kind: str) -> DataFrame:
    """``df`` completed to the fields of a domain model: absent ones take their default or null."""
    shape: StructType = MODELS[kind]
    default = DEFAULTS[kind]
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(default.get(f.name))).cast(f.dataType).alias(f.name) for f in shape])


def natural_key(fields: list[str]) -> Column:
    """Canonical JSON of all attributes but the id, nulls kept: any change of an attribute is another node."""
    return F.to_json(F.struct(*sorted(f for f in fields if f != "id")), {"ignoreNullFields": "false"})


def observations(models: DataFrame, kind: str, scan_id: str, sequence: Column) -> DataFrame:
    """Models as node observations: sequence says in which order they were stored."""
    fields = models.columns
    return models.select(F.col("id").cast("string").alias("id"), F.lit(scan_id).alias("scan_id"), F.lit(kind).alias("node_type"), natural_key(fields).alias("natural_key"), F.to_json(F.struct(*sorted(fields)), {"ignoreNullFields": "false"}).alias("attributes_json"), sequence.alias("sequence"))


def conflicts(observed: DataFrame) -> DataFrame:
    """(id, n) of ids that would be stored under ``n`` > 1 natural keys: what ``store`` raises an error for."""
    keys = observed.groupBy("scan_id", "node_type", "natural_key").agg(F.min_by("id", "sequence").alias("id"))
    return keys.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")


def store(observed: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Nodes after storing: per (scan, type, natural key) the first id stays, the attributes are the latest.

    An id that two keys share breaks the primary key: reading the result raises an error.
    """
    rows = observed
    if existing is not None:
        rows = rows.unionByName(existing.withColumn("sequence", F.lit(-1).cast("long")))
    keys = ["scan_id", "node_type", "natural_key"]
    nodes = rows.groupBy(*keys).agg(F.min_by("id", "sequence").alias("id"), F.max_by("attributes_json", "sequence").alias("attributes_json"))
    owners = nodes.groupBy("id").agg(F.count("*").alias("n"))
    checked = nodes.join(owners, "id")
    unique = F.when(F.col("n") == 1, F.col("id")).otherwise(F.raise_error(F.concat(F.lit("Model id under several keys: "), F.col("id"))))
    return checked.select(unique.alias("id"), *keys, "attributes_json")


def relate(nodes: DataFrame, pairs: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges after relating: ``pairs`` has scan_id, source_type, source_key, relationship, target_type, target_key and evidence.

    Ends are looked up by natural key; an end that isn't stored raises an error.  Equal edges are one.
    """
    found = pairs.withColumn("evidence", F.coalesce("evidence", F.lit("")))
    for end in ("source", "target"):
        look = nodes.select(F.col("scan_id").alias("_s"), F.col("node_type").alias("_t"), F.col("natural_key").alias("_k"), F.col("id").alias(f"_{end}"))
        found = found.join(look, (F.col("scan_id") == F.col("_s")) & (F.col(f"{end}_type") == F.col("_t")) & (F.col(f"{end}_key") == F.col("_k")), "left").drop("_s", "_t", "_k")
        known = F.when(F.col(f"_{end}").isNotNull(), F.col(f"_{end}")).otherwise(F.raise_error(F.lit("an end of the edge is not stored")))
        found = found.withColumn(f"{end}_id", known)
    edges = found.select("scan_id", "source_id", "relationship", "target_id", "evidence")
    return (edges if existing is None else existing.unionByName(edges)).distinct()


#: Repeats of an edge that one row is spread into at once.
_SPREAD = 100_000


def traverse(edges: DataFrame, scan_id: str, source_id: str, max_depth: int = 1) -> DataFrame:
    """(source_id, relationship, target_id, evidence, depth), all strings: outbound edges up to a depth.

    Every path counts: diamonds and cycles repeat edges.  A level carries each edge once, with its
    number of paths (a stored edge is one row); only the result repeats it.  Levels are written, so each is computed once and
    the next joins what is there.
    """
    if max_depth < 1:
        raise ValueError("max_depth counts from 1")
    fields = ["source_id", "relationship", "target_id", "evidence"]
    own = edges.filter(F.col("scan_id") == scan_id).select(*fields)
    level = own.filter(F.col("source_id") == source_id).withColumn("_paths", F.lit(1).cast("long"))
    if max_depth > 1:
        level = written(level, "graph-level")
    out = level.withColumn("depth", F.lit("1"))
    for depth in range(2, max_depth + 1):
        ends = level.groupBy(F.col("target_id").alias("source_id")).agg(F.sum("_paths").alias("_paths"))
        level = written(own.join(ends, "source_id").select(*fields, "_paths"), "graph-level")
        out = out.unionByName(level.withColumn("depth", F.lit(str(depth))))
    # Edges of many paths are spread in two steps, so that no array grows with the number of paths.
    some = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_paths - 1) div {_SPREAD}"))).alias("_block")
    blocks = out.select(*fields, "depth", "_paths", some)
    each = F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.lit(_SPREAD).cast("long"), F.col("_paths") - F.col("_block") * _SPREAD)))
    return blocks.select(*fields, "depth", each.alias("_")).drop("_")


def register_scan(scans: DataFrame, scan: DataFrame) -> DataFrame:
    """Scan runs with a new one, unless its id is there."""
    return scans.unionByName(scan.join(scans.select("id"), "id", "left_anti"), allowMissingColumns=True)


def save_edges(edges: DataFrame, path: str) -> None:
    """Edges by scan, sorted by their source within a file: a traversal reads one scan's folder and skips row groups by source."""
    edges.repartition("scan_id", "source_id").sortWithinPartitions("scan_id", "source_id").write.partitionBy("scan_id").mode("append").parquet(path)
