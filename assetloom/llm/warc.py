"""WARC archives with revisit records, and a globally ordered capture index by loser-tree merging.

Writing: each row is one record.  Of equal payloads of some length the one with the largest key is
stored; the others are revisit records without a payload that name it.  Archives are written by
Spark's text sink: a record ends with CR LF CR LF, which is the sink's line separator, and a row is
a record's header and payload, so the files are plain WARC/1.1 by the commit protocol of any store.

Reading: archives are read whole, file by file, and cut by Content-Length, so payloads may hold
anything.  Files are bounded in rows and bytes: records are written by classes of size, and the
larger a class, the fewer of its records share a file.  Each file gives a locally sorted run of captures:
URL key, timestamp, file, offset.  The runs are dealt by ranges of URL key and timestamp, and each
task merges the parts of the runs it gets by a loser tree, from spill files where they are many.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
import urllib.parse
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import batch, col, scratch, spill_folder, written

#: Payloads from this size on are stored once.
REVISIT_BYTES = 1000
#: Records and payload bytes of a file at most; a single record may be larger.
ROWS_PER_FILE, FILE_BYTES = 1000, 64 << 20
#: A class of sizes ends at so many times the end of the one before.
_CLASS = 16
#: Captures a merging task holds before it spills its runs.
HELD_CAPTURES = 200_000
#: Made-up times of capture stay below this second.
_LAST_SECOND = 100 * 365 * 86_400
END = "\r\n\r\n"


def _revisits(df: DataFrame, key: str, payload: str, least: int) -> DataFrame:
    """Adds _digest, _bytes and _of: the key of the response that holds the payload, null for responses.

    Only payloads of at least the minimum size that occur more than once are looked up.  That table
    is written first, so its size is known when the join is planned: where it is small Spark
    broadcasts it and no payload is shuffled; else payloads are dealt by digest.  Smaller payloads
    match nothing and are dealt by a key of their own, so equal ones don't meet in one task.
    """
    body = F.coalesce(col(payload).cast("binary"), F.lit(b""))
    hashed = df.withColumns({"_digest": F.sha1(body), "_bytes": F.octet_length(body).cast("long")})
    groups = hashed.filter(F.col("_bytes") >= least).groupBy("_digest", "_bytes").agg(F.max(col(key)).alias("_holder"), F.count("*").alias("_n"))
    stored = written(groups.filter("_n > 1").select(F.concat("_digest", F.lit(" "), F.col("_bytes")).alias("_look"), "_holder"), "stored")
    alone = F.concat(F.lit("-"), F.xxhash64(F.monotonically_increasing_id()).cast("string"))
    look = F.when(F.col("_bytes") >= least, F.concat("_digest", F.lit(" "), F.col("_bytes"))).otherwise(alone)
    joined = hashed.withColumn("_look", look).join(stored, "_look", "left")
    return joined.withColumn("_of", F.when(~col(key).eqNullSafe(F.col("_holder")), F.col("_holder"))).drop("_holder", "_look")


def timestamp(at: Column) -> Column:
    """A time as WARC writes it, in UTC whatever the session's zone: from the seconds since 1970, by arithmetic."""
    seconds = F.unix_seconds(at)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86_400).cast("int"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    rest = F.pmod(seconds, F.lit(86_400))
    return F.concat(day.cast("string"), F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def write_archives(df: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None, least: int = REVISIT_BYTES, rows_per_file: int = ROWS_PER_FILE, file_bytes: int = FILE_BYTES) -> None:
    """Write a record for each row of ``df`` into archives under ``path``.

    captured: the time of capture; by default, for tables without one, the epoch plus ``key``
    seconds, counted anew from each century's worth of them so that no key is out of range.
    Null payloads are empty, a null URL is left out, a null key is written as ``null``; of rows
    that share the largest key of equal payloads each is a response.  Line breaks in a URL are
    written as %0D and %0A.  A file has at most ``rows_per_file`` records, and ``file_bytes`` of
    payload unless a single record is larger.  Other columns, whatever their names, play no part.
    """
    slim = df.select(col(key).alias("key"), col(url).alias("url"), col(payload).alias("body"), (captured if captured is not None else F.timestamp_seconds(F.pmod(F.coalesce(col(key), F.lit(0)), F.lit(_LAST_SECOND)))).alias("at"))
    name = lambda c: F.concat(F.lit("<urn:capture:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    revisit = F.col("_of").isNotNull()
    line = lambda label, value: F.concat(F.lit(label + ": "), value, F.lit("\r\n"))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name(F.col("key"))),
        line("WARC-Date", timestamp(F.col("at"))),
        # A URL can't hold a line break in a header; it is escaped as in a URL.
        F.coalesce(line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")), F.lit("")),
        F.when(revisit, F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"), line("WARC-Refers-To", name(F.col("_of"))))).otherwise(""),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("_digest"))),
        line("WARC-Payload-Length", F.col("_bytes").cast("string")),
        F.lit("Content-Type: text/html; charset=utf-8\r\n"),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("_bytes").cast("string"))),
        F.lit("\r\n"),
    )
    record = F.concat(head, F.when(revisit, "").otherwise(F.coalesce("body", F.lit(""))))
    # Sizes up to the first bound fit by the number of rows alone; each further class has a file for fewer.
    bounds = [max(file_bytes // rows_per_file, 1)]
    while bounds[-1] < file_bytes:
        bounds.append(min(bounds[-1] * _CLASS, file_bytes))
    size = F.coalesce(F.octet_length(F.col("body").cast("binary")), F.lit(0))
    kind = F.lit(0)
    for bound in bounds:
        kind = kind + (size > bound).cast("int")
    there = {r.n for r in slim.select(kind.alias("n")).distinct().collect()}  # a handful of classes
    for n in sorted(there | {0}):
        own = _revisits(slim.filter(kind == n), "key", "body", least).select(record.alias("value"))  # equal payloads are of one class
        most = rows_per_file if n == 0 else max(1, file_bytes // bounds[n]) if n < len(bounds) else 1
        own.write.mode("append").option("lineSep", END).option("maxRecordsPerFile", most).text(path)


def url_key(url: str) -> str:
    """The URL with its host's labels reversed, so captures of a site sort together (SURT form)."""
    try:
        parts = urllib.parse.urlsplit(url.strip())
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.strip().lower()
    if not host:
        return url.strip().lower()
    query = "&".join(sorted(parts.query.split("&"))) if parts.query else ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "") + ")" + (parts.path or "/").lower() + (f"?{query.lower()}" if query else "")


def records(data: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers, block) of each record of an archive, cut by Content-Length."""
    at = 0
    while at < len(data):
        blank = data.find(b"\r\n\r\n", at)
        if blank < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:blank].decode("utf-8", "surrogateescape").split("\r\n")
        headers = {k.lower(): v.removeprefix(" ") for k, _, v in (x.partition(":") for x in lines[1:])}
        start = blank + 4
        end = start + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield at, end + 4 - at, headers, data[start:end]
        at = end + 4


_RUN = "run long, url_key string, captured string, key long, url string, file string, offset long, length long, type string, digest string, payload_bytes long, refers_to long"


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives under ``path`` as a capture, each file's in order of URL key and timestamp: a run.

    The payload of a response must have the digest and length its header names; else ValueError.
    """
    schema = spark.createDataFrame([], _RUN).schema
    fields = pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.string()) for f in schema])
    number = lambda s: None if s == "null" else int(s)
    named = lambda s: number(s.removeprefix("<urn:capture:").removesuffix(">"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file = b.column(0)[i].as_py()
                run, out = int.from_bytes(hashlib.blake2b(file.encode(), digest_size=7).digest(), "big"), []
                for offset, length, h, block in records(b.column(1)[i].as_py()):
                    digest, size = h["warc-payload-digest"].removeprefix("sha1:"), int(h["warc-payload-length"])
                    if h["warc-type"] == "response" and (hashlib.sha1(block).hexdigest(), len(block)) != (digest, size):
                        raise ValueError(f"{file}, byte {offset}: payload and digest differ")
                    url = h.get("warc-target-uri")
                    out.append((run, url_key(url or ""), h["warc-date"], named(h["warc-record-id"]), url, file, offset, length, h["warc-type"], digest, size, named(h["warc-refers-to"]) if "warc-refers-to" in h else None))
                out.sort(key=_place)
                if out:
                    yield batch(fields, zip(*out, strict=True))

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(parse, schema)


def _place(row: tuple) -> tuple:
    """Order of captures: URL key, timestamp, then key (null first), file and offset, so that ties have one order."""
    return (row[1], row[2], row[3] is not None, row[3] or 0, row[5], row[6])


class LoserTree:
    """Merges sorted runs: inner nodes keep the loser of their match, so the next winner costs one path."""

    def __init__(self, runs: list[Iterator[tuple]], place: Callable[[tuple], tuple]) -> None:
        self.runs, self.place = runs, place
        n = len(runs)
        self.heads = [next(r, None) for r in runs]
        self.keys = [None if h is None else place(h) for h in self.heads]
        self.losers = [-1] * max(1, n)
        winner = [0] * (2 * n)
        for i in range(n):
            winner[n + i] = i
        for node in range(n - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winner[1] if n > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None
        return (self.keys[a], a) <= (self.keys[b], b)

    def __iter__(self) -> Iterator[tuple]:
        n = len(self.runs)
        while n and (row := self.heads[self.winner]) is not None:
            yield row
            run = self.winner
            self.heads[run] = after = next(self.runs[run], None)
            self.keys[run] = None if after is None else self.place(after)
            node = (run + n) // 2
            while node >= 1 and n > 1:
                if self._before(self.losers[node], run):
                    self.losers[node], run = run, self.losers[node]
                node //= 2
            self.winner = run


def merged(rows: Iterable[tuple], held: int = HELD_CAPTURES) -> Iterator[tuple]:
    """All ``rows`` (their first field says the run) in order.  Runs stay in memory up to ``held`` rows, then in a spill file."""
    parts: dict[int, list[tuple]] = {}
    spilled: list[tuple[int, int]] = []
    n = 0
    with tempfile.TemporaryFile(dir=spill_folder()) as f:
        for row in rows:
            parts.setdefault(row[0], []).append(row)
            n += 1
            if n >= held:
                # What is held is one sorted run from now on: it goes out as the merge of its parts.
                start = f.tell()
                block: list[tuple] = []
                for r in LoserTree(_sorted(parts), _place):
                    block.append(r)
                    if len(block) == 500:
                        pickle.dump(block, f, -1)
                        block = []
                pickle.dump(block, f, -1)
                spilled.append((start, f.tell()))
                parts, n = {}, 0
        f.flush()
        yield from LoserTree([*_sorted(parts), *(_read(f, s, e) for s, e in spilled)], _place)


def _sorted(parts: dict[int, list[tuple]]) -> list[Iterator[tuple]]:
    """The parts as runs; a shuffle may deliver pieces of a run in any order, so each is put in order first."""
    return [iter(sorted(p, key=_place)) for p in parts.values()]


def _read(f, start: int, end: int) -> Iterator[tuple]:
    at = start
    while at < end:
        f.seek(at)
        block = pickle.load(f)
        at = f.tell()
        yield from block


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures in order of URL key and timestamp: sorted within partitions, partitions in order."""
    schema = runs.schema
    fields = pa.schema([(f.name, pa.int64() if f.dataType.typeName() == "long" else pa.string()) for f in schema])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[tuple] = []
        for row in merged(r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)):
            block.append(row)
            if len(block) == 10_000:
                yield batch(fields, zip(*block, strict=True))
                block = []
        if block:
            yield batch(fields, zip(*block, strict=True))

    return runs.repartitionByRange("url_key", "captured", "key", "file", "offset").mapInArrow(merge, schema)


def capture_index(pages: DataFrame, path: str | None = None, key: str = "page_id", url: str = "url", payload: str = "html", captured: Column | None = None) -> DataFrame:
    """Write ``pages`` as archives under ``path``, read them back, and merge their runs into one index.

    Odd rows: see ``write_archives``.  Rows need not be unique, each is a capture; an empty table gives none.
    """
    spark = pages.sparkSession
    path = path or scratch(spark, "warc")
    write_archives(pages, path, key, url, payload, captured)
    return merge_runs(written(read_captures(spark, path), "captures"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ``pages`` row as its capture in the archives' merged index."""
    index = capture_index(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"))
    return index.select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


QUERIES = {"op3_warc": op3_warc}

ORACLE_SQL = {
    "op3_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
             m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS holder FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> holder THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= {REVISIT_BYTES} AND page_id <> holder THEN holder END AS refers_to
        FROM m
    """,
}
