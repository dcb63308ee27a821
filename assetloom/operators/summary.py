"""Figures over the inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_type(assets: DataFrame) -> DataFrame:
    return assets.groupBy("asset_type").agg(F.count("*").alias("n"))


def figures(assets: DataFrame, endpoints: DataFrame, technologies: DataFrame) -> DataFrame:
    """One row: total_assets, javascript_count, endpoint_count (rows), technology_count (distinct names), file_statistics."""
    types = by_type(assets).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_assets"), F.coalesce(F.sum(F.when(F.col("asset_type") == "javascript", F.col("n"))), F.lit(0)).alias("javascript_count"), F.map_from_entries(F.collect_list(F.struct("asset_type", "n"))).alias("file_statistics"))
    paths = endpoints.agg(F.count("*")).scalar()
    names = technologies.agg(F.countDistinct("name")).scalar()
    return types.select("total_assets", "javascript_count", paths.alias("endpoint_count"), names.alias("technology_count"), "file_statistics")


def summary(assets: DataFrame, endpoints: DataFrame, technologies: DataFrame) -> dict:
    """The figures as a dict for the JSON and Markdown reports."""
    return figures(assets, endpoints, technologies).first().asDict(recursive=True)
