"""The streaming ingest as a query: its inventory equals that of one batch of all the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MANIFEST
from ..storage import open_table, scratch
from ..streaming import manifests
from . import web

#: Overlapping drops that together hold every row; each is larger than the one before, so sizes alone would order them wrongly.
_DROPS = ("ordinal % 3 = 0", "ordinal % 3 <> 2", "ordinal % 2 = 0 OR ordinal % 3 = 2")


def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three overlapping drops of the synthetic manifest, merged as one batch after all have landed."""
    folder, now = scratch(spark, "stream"), F.timestamp_seconds(F.lit(0))
    rows = web.manifest(spark, sf_dir).select("ordinal", F.col("asset_url").alias("url"), "type", "local_path", "status", *[F.lit(None).cast(f.dataType).alias(f.name) for f in MANIFEST if f.name in ("sha256", "size_bytes", "mime_type", "error")])
    for n, which in enumerate(_DROPS):
        drop = rows.filter(which).withColumn("status", F.lit(f"drop {n}")).withColumn("error", F.repeat(F.lit("-"), F.lit(40 * n)))
        drop.select(*MANIFEST.names).write.json(f"{folder}/drops/{n}")
    manifests.follow(manifests.drops(spark, f"{folder}/drops"), f"{folder}/tables", f"{folder}/checkpoint", now, once=True).awaitTermination()
    return open_table(spark, f"{folder}/tables", "assets").select("url", "asset_type", "local_path", "status")


QUERIES = {"stream_equals_batch": stream_equals_batch}

ORACLE_SQL = {
    "stream_equals_batch": f"{web._BASE} SELECT asset_url AS url, type AS asset_type, local_path, CASE WHEN ordinal % 2 = 0 OR ordinal % 3 = 2 THEN 'drop 2' ELSE 'drop 1' END AS status FROM assets"
}
