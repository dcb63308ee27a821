"""URL predicates and projections as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .patterns import CANDIDATE, JAVA_SPACE, WORKER

#: Media types guessed from a file's extension.
MEDIA_TYPES = {"js": "text/javascript", "mjs": "text/javascript", "wasm": "application/wasm", "json": "application/json", "webmanifest": "application/manifest+json"}


def is_web(url: Column) -> Column:
    """Whether the URL starts with http:// or https://, in lower case."""
    return url.startswith("http://") | url.startswith("https://")


def is_candidate(url: Column) -> Column:
    """Whether a crawled URL may be an asset worth keeping."""
    return url.rlike(CANDIDATE)


def strip(text: Column) -> Column:
    """The text without Unicode white space at its ends."""
    return F.regexp_replace(text, f"^[{JAVA_SPACE}]+|[{JAVA_SPACE}]+$", "")


def asset_path(url: Column) -> Column:
    """The URL up to its query or fragment, lower-cased; scheme and host stay."""
    return F.lower(F.regexp_replace(url, r"(?s)[?#].*$", ""))


def classify(url: Column) -> Column:
    """The asset class of a URL; the first rule that holds decides."""
    path = asset_path(url)
    name = F.substring_index(path, "/", -1)
    return (
        F.when(path.endswith(".js") | path.endswith(".mjs"), "javascript")
        .when(path.endswith(".map"), "source_map")
        .when(path.endswith(".wasm"), "webassembly")
        .when(name.isin("manifest.json", "manifest.webmanifest") | path.endswith(".webmanifest"), "manifest")
        .when(path.rlike(WORKER), "worker")
        .when(path.endswith(".json"), "configuration")
        .otherwise("other")
    )


def file_name(ordinal: Column, url: Column) -> Column:
    """A safe local name: six-digit position, then the last path part with odd characters replaced."""
    path = F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1)
    last = F.try_element_at(F.filter(F.split(path, "/"), lambda x: ~x.isin("", ".")), F.lit(-1))
    safe = F.substring(F.regexp_replace(F.coalesce(last, F.lit("asset")), r"[^A-Za-z0-9._-]", "_"), 1, 120)
    number = ordinal.cast("string")
    return F.concat(F.when(F.length(number) < 6, F.lpad(number, 6, "0")).otherwise(number), F.lit("_"), safe)


def media_type(header: Column, name: Column) -> Column:
    """The Content-Type header before its first semicolon, else a guess by the name's extension, else null."""
    guess = F.try_element_at(F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair]), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)))
    return F.coalesce(F.nullif(F.split_part(header, F.lit(";"), F.lit(1)), F.lit("")), guess)
