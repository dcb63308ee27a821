"""Manifests that arrive in drops: a file stream of JSON lines, merged batch by batch.

State is keyed by URL in the snapshot itself, so no watermark is needed; a batch that is delivered
again changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import upsert_assets
from ..schemas import MANIFEST
from ..sources.readers import as_assets
from ..storage import open_table, released, swap

_PLACE = ("time", "file", "block")


def drops(spark: SparkSession, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """The stream of manifest entries that land as JSON lines under ``folder``, each with the time, path and block of its file."""
    reader = spark.readStream.schema(MANIFEST).option("recursiveFileLookup", "true")
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    place = F.struct(F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    return reader.json(folder).select("*", place.alias("place"))


def merge_into(folder: str, now: Column | None = None):
    """A foreachBatch function: upserts each batch into the inventory of the tables in ``folder``.

    Of a URL's entries in a batch the last wins: the one in the newest file (of files of one time the
    last by path), in its last line.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        at = F.struct(*[F.col(f"place.{c}").alias(c) for c in _PLACE], F.monotonically_increasing_id().alias("row"))
        entries = as_assets(batch.withColumn("ordinal", at).drop("place"))
        with released(batch.sparkSession):
            swap(upsert_assets(open_table(batch.sparkSession, folder, "assets"), entries, now), folder, "assets")

    return merge


def follow(stream: DataFrame, folder: str, checkpoint: str, now: Column | None = None, once: bool = False) -> StreamingQuery:
    """Start merging; ``once`` stops when what is there has been merged."""
    writer = stream.writeStream.foreachBatch(merge_into(folder, now)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
