"""Keyed ingest into snapshots: upsert, id lookup, insert-or-ignore.

Parquet has no MERGE; an ingest is a join of the old snapshot with the reduced batch, written as
the new snapshot.  Ordinals may be numbers or structs: any column that orders the batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import written
from .ordinals import dense

_UPDATED = ["local_path", "asset_type", "sha256", "size_bytes", "mime_type", "status"]


def next_id(existing: DataFrame) -> int:
    return (existing.agg(F.max("id")).first()[0] or 0) + 1


def with_ids(new: DataFrame, existing: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """``new`` with ids after those of ``existing``, in order of ``ordinal``."""
    return dense(new, ordinal, "id", next_id(existing))


def last_of(batch: DataFrame, key: str = "url", ordinal: str = "ordinal") -> DataFrame:
    """Of the rows of a key in the batch, the last; ``first_ordinal`` is where the key came first."""
    rest = [c for c in batch.columns if c != key]
    reduced = batch.groupBy(key).agg(F.max_by(F.struct(*rest), ordinal).alias("r"), F.min(ordinal).alias("first_ordinal"))
    return reduced.select(key, "r.*", "first_ordinal")


def upsert_assets(existing: DataFrame, batch: DataFrame, now: Column | None = None) -> DataFrame:
    """The inventory after a manifest: ``batch`` has ordinal, url, type and the downloader's columns.

    A known URL keeps id and discovered_at and takes every other value from the batch, nulls too;
    of a URL's entries the last wins.  New URLs get the next ids in manifest order.  The two sides
    meet in one full outer join, written once: the rows with and without an id are read from it.
    """
    now = now if now is not None else F.current_timestamp()
    incoming = last_of(batch.select("ordinal", "url", F.col("type").alias("asset_type"), "local_path", "sha256", "size_bytes", "mime_type", F.coalesce("status", F.lit("discovered")).alias("status")))
    hit = F.col("first_ordinal").isNotNull()
    old = existing.select("id", "url", "discovered_at", F.struct(*_UPDATED).alias("old"))
    new = incoming.select("url", F.struct(*_UPDATED).alias("new"), "first_ordinal")
    both = old.join(new, "url", "full").select("id", "url", F.when(hit, F.col("new")).otherwise(F.col("old")).alias("r"), "discovered_at", "first_ordinal")
    both = written(both, "upsert")
    kept, added = both.filter("id IS NOT NULL"), both.filter("id IS NULL").drop("id")
    added = with_ids(added, both, "first_ordinal").withColumn("discovered_at", now)
    columns = ["id", "url", *[F.col(f"r.{c}").alias(c) for c in _UPDATED], "discovered_at"]
    return kept.select(*columns).unionByName(added.select(*columns))


def manifest_ids(assets: DataFrame, manifest: DataFrame) -> DataFrame:
    """(asset_url, asset_id) of the URLs in this manifest; other assets aren't looked up."""
    return assets.join(manifest.select("url").distinct(), "url", "left_semi").select(F.col("url").alias("asset_url"), F.col("id").alias("asset_id"))


def insert_or_ignore(existing: DataFrame, batch: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """``existing`` and the rows of ``batch`` whose keys it doesn't have; of equal keys in the batch the first. Rows with a null key are left out."""
    complete = batch.dropna(subset=keys)
    rest = [c for c in batch.columns if c not in (*keys, ordinal)]
    firsts = complete.groupBy(*keys).agg(F.min_by(F.struct(F.lit(0).alias("_"), *rest), ordinal).alias("r"), F.min(ordinal).alias("ordinal")).select(*keys, *[f"r.{c}" for c in rest], "ordinal")
    new = with_ids(firsts.join(existing.select(*keys), keys, "left_anti"), existing)
    columns = existing.columns
    return existing.unionByName(new.select(*[F.col(c) if c in new.columns else F.lit(None).cast(existing.schema[c].dataType).alias(c) for c in columns]))


#: The tables that findings go to, in the order they are stored.
FED = ("urls", "endpoints", "technologies")


def ingest(tables: dict[str, DataFrame], manifest: DataFrame, reports: dict[str, DataFrame], now: Column | None = None, save: Callable[[str, DataFrame], DataFrame] | None = None, fed: tuple[str, ...] = FED) -> dict[str, DataFrame]:
    """All tables after one scan.  Reports have an ordinal for their order; findings of URLs that the manifest doesn't have are dropped.

    ``save`` stores a table under its name and gives it back, as ``snapshots`` does; the inventory
    is stored first, so the look-ups of the other tables read it instead of joining it anew.  Only
    the tables ``fed`` names take findings.
    """
    save = save or (lambda _, df: df)
    assets = save("assets", upsert_assets(tables["assets"], manifest, now))
    ids = manifest_ids(assets, manifest)
    own = lambda name: reports[name].join(ids, "asset_url")
    # Plain addresses come before sockets, as their report is read first.
    at = lambda n: F.struct(F.lit(n).alias("report"), "ordinal").alias("ordinal")

    def urls() -> tuple[DataFrame, list[str]]:
        plain = own("urls").select("asset_id", "url", F.coalesce("kind", F.lit("url")).alias("kind"), at(0))
        sockets = own("websocket").select("asset_id", "url", F.coalesce("kind", F.lit("websocket")).alias("kind"), at(1))
        return plain.unionByName(sockets), ["asset_id", "url", "kind"]

    def endpoints() -> tuple[DataFrame, list[str]]:
        return own("endpoints").select("asset_id", "endpoint", F.coalesce("kind", F.lit("api")).alias("kind"), "ordinal"), ["asset_id", "endpoint", "kind"]

    def technologies() -> tuple[DataFrame, list[str]]:
        return own("frameworks").select("asset_id", F.col("technology").alias("name"), "evidence", "ordinal"), ["asset_id", "name"]

    found = {"assets": assets}
    for name, rows in (("urls", urls), ("endpoints", endpoints), ("technologies", technologies)):
        if name in fed:
            found[name] = save(name, insert_or_ignore(tables[name], *rows()))
    return tables | found


def snapshots(folder: str) -> Callable[[str, DataFrame], DataFrame]:
    """A ``save`` that writes each table as Parquet under ``folder``, a new one for each ingest."""

    def save(name: str, df: DataFrame) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{folder}/{name}")

    return save


def cascade(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Rows whose asset is gone are dropped from the tables that refer to it."""
    ids = tables["assets"].select(F.col("id").alias("asset_id"))
    return {n: t.join(ids, "asset_id", "left_semi").select(*t.columns) if "asset_id" in t.columns else t for n, t in tables.items()}
