import csv
import json
import os

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from assetloom import __main__ as cli
from assetloom import config, schemas, storage
from assetloom.operators import extract, ingest, summary
from assetloom.operators.ordinals import dense, first_seen
from assetloom.sources import readers, sinks
from assetloom.streaming import manifests

BODY = "import React from 'react'; const a = require('axios');\nfetch('/api/users'); new WebSocket('wss://socket.example.test'); fetch('https://api.example.test/v1'); useState();"


def scan(tmp_path, items, bodies):
    for name, text in bodies.items():
        (tmp_path / "bodies").mkdir(exist_ok=True)
        (tmp_path / "bodies" / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    for item in items:
        if item.get("local_path"):
            item["local_path"] = str(tmp_path / "bodies" / item["local_path"])
    (tmp_path / "assets.json").write_text(json.dumps(items))
    return str(tmp_path / "assets.json")


URL = "https://app.example.test/app.js"


def extracted(spark, tmp_path, items, bodies):
    path = scan(tmp_path, items, bodies)
    errors = cli.run_extract(spark, readers.read_manifest(spark, path), str(tmp_path / "bodies"), str(tmp_path / "out"))
    return errors, {n: [tuple(r)[1:] for r in readers.report(spark, str(tmp_path / "out" / "reports"), n).orderBy("ordinal").collect()] for n in schemas.REPORTS}


def test_golden_scan(spark, tmp_path):
    item = {"url": URL, "type": "javascript", "status": "downloaded", "local_path": "app.js"}
    errors, got = extracted(spark, tmp_path, [item, {"url": "https://x/y", "type": "other", "status": "downloaded", "local_path": "app.js"}], {"app.js": BODY})
    assert errors == 0 and got["errors"] == []
    assert got["endpoints"] == [(URL, "/api/users", "api")]
    assert got["websocket"] == [(URL, "wss://socket.example.test", "websocket")]
    assert {r[1] for r in got["imports"]} == {"react", "axios"}
    assert got["frameworks"] == [(URL, "React", "signature match")]
    assert {r[1] for r in got["urls"]} == {"//socket.example.test", "https://api.example.test/v1"}


def test_missing_body_is_one_error_and_others_go_on(spark, tmp_path):
    items = [{"url": URL, "type": "javascript", "status": "downloaded", "local_path": "gone.js"}, {"url": URL + "2", "type": "javascript", "status": "downloaded", "local_path": "app.js"}]
    errors, got = extracted(spark, tmp_path, items, {"app.js": b"\xff/api/x"})
    assert errors == 1 and [(r[0], r[1]) for r in got["errors"]] == [(URL, "reader")]
    assert got["endpoints"] == [(URL + "2", "/api/x", "api")]


@pytest.mark.parametrize("text", ["", "  \n", "{}", '[{"url": "a"', '[1]', '[{"type": "x"}]'])
def test_bad_manifests_raise(spark, text):
    with pytest.raises((PySparkException, Py4JJavaError)):
        readers.parse_manifest(spark.createDataFrame([(text,)], "value string")).collect()


def test_manifest_defaults_and_order(spark):
    text = '[ {"url": "b", "local_path": ""}, {"url": "a", "type": "javascript", "status": "failed", "size_bytes": 3} ]'
    rows = readers.as_assets(readers.parse_manifest(spark.createDataFrame([(text,)], "value string"))).orderBy("ordinal").collect()
    assert [(r.url, r.type, r.status, r.local_path, r.size_bytes) for r in rows] == [("b", "other", "discovered", None, None), ("a", "javascript", "failed", None, 3)]
    assert readers.parse_manifest(spark.createDataFrame([("[]",)], "value string")).count() == 0


def test_seeds_and_url_lists(spark, tmp_path):
    (tmp_path / "seeds.txt").write_bytes(b"http://a\r\nftp://b\n http://c\nhttps://d\nhttp://a\r\n")
    assert [r.url for r in readers.seeds(spark, str(tmp_path / "seeds.txt")).collect()] == ["http://a", "https://d", "http://a"]
    assert [r.url for r in readers.seeds(spark, "not a url", is_file=False).collect()] == ["not a url"]
    (tmp_path / "urls.txt").write_bytes("http://a/1.js   http://b\x0bhttps://c\x85x\nHTTP://no\nhttp://a/1.js\n".encode() + b"http://\xffd\n")
    assert [r.url for r in readers.url_list(spark, str(tmp_path / "urls.txt")).orderBy("ordinal").collect()] == ["http://a/1.js", "http://b", "https://c", "http://a/1.js", "http://d"]


def test_files_follow_one_another_by_path_whatever_their_sizes(spark, tmp_path):
    (tmp_path / "lists").mkdir()
    (tmp_path / "lists" / "1.txt").write_text("http://a/1\nhttp://b/1\n")
    (tmp_path / "lists" / "2.txt").write_text("".join(f"http://x/{i}\n" for i in range(5000)) + "http://a/1\n")
    (tmp_path / "lists" / "3.txt").write_text("http://b/2\n")
    seen = first_seen(readers.url_list(spark, str(tmp_path / "lists"))).orderBy("position").collect()
    assert [r.url for r in seen[:3]] == ["http://a/1", "http://b/1", "http://x/0"] and seen[-1].url == "http://b/2" and [r.position for r in seen] == list(range(5003))
    assert readers.line_count(spark, str(tmp_path / "lists")).first().n == 5004
    for form, read in (("json", readers.read_manifest_lines), ("array", readers.read_manifest)):
        (tmp_path / form).mkdir()
        for name, size in (("a", 1), ("b", 3000), ("c", 2)):
            rows = [json.dumps({"url": f"{name}{i:04d}"}) for i in range(size)]
            (tmp_path / form / f"{name}.json").write_text("\n".join(rows) if form == "json" else "[" + ",".join(rows) + "]")
        urls = [r.url for r in read(spark, str(tmp_path / form)).orderBy("ordinal").collect()]
        assert urls == sorted(urls) and len(urls) == 3003


def test_the_newest_drop_of_a_batch_wins_whatever_its_size(spark, tmp_path):
    folder, drops = str(tmp_path / "tables"), tmp_path / "drops"
    drops.mkdir()

    def drop(name, time, rows):
        path = drops / name
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        os.utime(path, (time, time))

    pad = [{"url": f"pad{i}", "error": "x" * 200} for i in range(500)]
    drop("z", 1000, [{"url": "u", "status": "old"}, {"url": "v", "status": "old"}])
    drop("b", 2000, [*pad, {"url": "u", "status": "newer"}, {"url": "v", "status": "newer"}])
    drop("a", 3000, [{"url": "u", "status": "first line"}, {"url": "u", "status": "newest"}])
    manifests.follow(manifests.drops(spark, str(drops)), folder, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    rows = {r.url: (r.id, r.status) for r in storage.open_table(spark, folder, "assets").collect()}
    assert len(rows) == 502 and rows["u"] == (1, "newest") and rows["v"] == (2, "newer") and rows["pad0"] == (3, "discovered")
    drop("c", 4000, [{"url": "v", "status": "last"}])
    manifests.follow(manifests.drops(spark, str(drops)), folder, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert {r.url: r.status for r in storage.open_table(spark, folder, "assets").collect()}["v"] == "last"


def test_first_seen_and_dense_positions(spark):
    df = spark.createDataFrame([(5, "x"), (3 << 20, "y"), (9, "x"), (7 << 33, "z"), (4, "w")], "ordinal long, url string")
    assert sorted(map(tuple, first_seen(df).collect())) == [(0, "w"), (1, "x"), (2, "y"), (3, "z")]
    assert [r.position for r in dense(spark.range(3000).withColumnRenamed("id", "ordinal"), start=5).orderBy("ordinal").collect()] == list(range(5, 3005))


def tables(spark):
    return {n: spark.createDataFrame([], schemas.TABLES[n]) for n in ("assets", "urls", "endpoints", "technologies")}


def manifest(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, url string, type string, local_path string, sha256 string, size_bytes long, mime_type string, status string")


def reports(spark, urls=(), websocket=(), endpoints=(), frameworks=()):
    make = lambda rows, fields: spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ordinal long, asset_url string, " + fields)
    return {"urls": make(urls, "url string, kind string"), "websocket": make(websocket, "url string, kind string"), "endpoints": make(endpoints, "endpoint string, kind string"), "frameworks": make(frameworks, "technology string, evidence string")}


def test_upsert_matrix(spark):
    at = lambda s: F.timestamp_seconds(F.lit(s))
    first = ingest.upsert_assets(tables(spark)["assets"], manifest(spark, [("b", "other", "p", "h", 1, "m", "downloaded"), ("a", "other", None, None, None, None, None), ("b", "manifest", "q", "h2", 2, "m2", "failed")]), at(0))
    rows = {r.url: r for r in first.collect()}
    assert (rows["b"].id, rows["a"].id, rows["b"].asset_type, rows["a"].status) == (1, 2, "manifest", "discovered")
    second = ingest.upsert_assets(first, manifest(spark, [("c", "x", None, None, None, None, "s"), ("b", "javascript", None, None, None, None, "downloaded")]), at(100))
    rows = {r.url: r for r in second.collect()}
    assert (rows["b"].id, rows["b"].local_path, rows["b"].sha256, rows["b"].asset_type) == (1, None, None, "javascript")
    assert rows["b"].discovered_at == rows["a"].discovered_at != rows["c"].discovered_at and rows["c"].id == 3
    assert rows["a"].status == "discovered" and len(rows) == 3


def test_ingest_is_idempotent_keeps_stale_rows_and_drops_unknown_assets(spark, tmp_path):
    m = manifest(spark, [("a", "javascript", None, None, None, None, None), ("b", "other", None, None, None, None, None)])
    r = reports(spark, [("a", "u1", None), ("a", "u1", "url"), ("gone", "u2", "url"), ("b", None, "url")], [("a", "u1", None), ("a", "u1", "url")], [("a", "/api", None)], [("b", "Vue", "first"), ("b", "Vue", "second")])
    once = ingest.ingest(tables(spark), m, r, save=ingest.snapshots(str(tmp_path / "1")))
    twice = ingest.ingest(once, m.filter("url = 'b'"), r, save=ingest.snapshots(str(tmp_path / "2")))
    for t in (once, twice):
        assert sorted((x.asset_id, x.url, x.kind) for x in t["urls"].collect()) == [(1, "u1", "url"), (1, "u1", "websocket")]
        assert [(x.asset_id, x.endpoint, x.kind, x.method) for x in t["endpoints"].collect()] == [(1, "/api", "api", None)]
        assert [(x.asset_id, x.name, x.evidence) for x in t["technologies"].collect()] == [(2, "Vue", "first")]
    figures = summary.summary(twice["assets"], twice["endpoints"], twice["technologies"])
    assert figures == {"total_assets": 2, "javascript_count": 1, "endpoint_count": 1, "technology_count": 1, "file_statistics": {"javascript": 1, "other": 1}}
    assert sinks.summary_markdown(figures).endswith("- javascript: 1\n- other: 1\n")
    sinks.write_csv(sinks.assets_csv(twice["assets"]), f"file://{tmp_path}/a.csv")
    text = (tmp_path / "a.csv").read_bytes().decode()
    assert text.startswith("url,local_path,asset_type") and text.count("\r\n") == 3
    left = ingest.cascade(twice | {"assets": twice["assets"].filter("id = 2")})
    assert left["urls"].count() == 0 and left["technologies"].count() == 1


def test_summary_of_nothing(spark):
    t = tables(spark)
    assert summary.summary(t["assets"], t["endpoints"], t["technologies"]) == {"total_assets": 0, "javascript_count": 0, "endpoint_count": 0, "technology_count": 0, "file_statistics": {}}


def test_python_analyzers_keep_what_they_gave_before_failing(spark):
    def analyze(url, text):
        yield "urls", "one", "url"
        if "bad" in text:
            raise ValueError("no")

    df = spark.createDataFrame([("a", 0, "fine"), ("b", 1, "bad"), ("c", 2, None)], "asset_url string, ordinal long, source string")
    found, errors = extract.python_findings(df, "mine", analyze)
    assert sorted(r.asset_url for r in found.collect()) == ["a", "b", "c"]
    assert [tuple(r) for r in errors.collect()] == [("b", "mine", "no")]


def test_analyzer_registry_and_finish(spark):
    with pytest.raises(ValueError, match="empty or repeated"):
        extract.registry([extract.ANALYZERS[0], extract.ANALYZERS[0]])
    assert list(extract.registry(reversed(extract.ANALYZERS))) == ["endpoints", "frameworks", "imports", "urls", "websocket"]
    total = lambda f: f.agg(F.lit("all").alias("asset_url"), F.lit("urls").alias("report"), F.count("*").cast("string").alias("value"))
    own = extract.Analyzer("urls", "urls", extract.ANALYZERS[3].find, finish=total)
    df = spark.createDataFrame([("a", 0, "javascript", "//x //y"), ("b", 1, "other", "//z"), ("c", 2, "javascript", None)], "asset_url string, ordinal long, type string, source string")
    assert sorted((r.asset_url, r.value) for r in extract.findings(df, [own]).collect()) == [("a", "//x"), ("a", "//y"), ("all", "2")]


def test_unknown_reports_are_errors(spark):
    bad = spark.createDataFrame([("a", "odd", "v", None, None, 0)], schemas.FINDING.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "))
    with pytest.raises(PySparkException, match="Unknown report"):
        sinks.by_report(bad)["urls"].collect()


def test_json_outputs(spark, tmp_path):
    df = spark.sql("SELECT 1 AS a, NULL AS b, 2 AS a, 'é' AS c")
    assert [r.value for r in sinks.json_lines(df).collect()] == ['{"a":1,"b":null,"c":"é"}']
    rows = spark.createDataFrame([(i, f"é{i}" if i % 2 else None) for i in range(100)], "o int, v string").repartition(7)
    sinks.write_json_array(rows, f"file://{tmp_path}/a.json", "o")
    assert json.loads((tmp_path / "a.json").read_text()) == [{"v": f"é{i}" if i % 2 else None} for i in range(100)]
    sinks.write_json_array(rows.limit(0), f"file://{tmp_path}/a.json", "o")
    assert json.loads((tmp_path / "a.json").read_text()) == [] and [n for n in os.listdir(tmp_path) if not n.endswith(".crc")] == ["a.json"]


def test_csv_is_what_a_csv_reader_takes(spark, tmp_path):
    values = ["plain", None, "", "a,b", 'say "x"', "two\r\nlines", " blanks ", "é\\", "#x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v string").orderBy("id")
    sinks.write_csv(df, f"file://{tmp_path}/a.csv")
    with open(tmp_path / "a.csv", newline="", encoding="utf-8") as f:
        assert list(csv.reader(f)) == [["id", "v"], *[[str(i), v or ""] for i, v in enumerate(values)]]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "urls.txt").write_text("https://h/a.js\nhttps://h/b.json\nhttps://h/a.js\n")
    out = str(tmp_path / "o")
    assert cli.main(["--output", out, "classify", str(tmp_path / "urls.txt")]) == 0
    path = scan(tmp_path, [{"url": URL, "type": "javascript", "status": "downloaded", "local_path": "app.js"}], {"app.js": BODY})
    assert cli.main(["--output", out, "extract", path, str(tmp_path / "bodies")]) == 0
    for _ in range(2):
        assert cli.main(["--output", out, "ingest", path]) == 0
    assert cli.main(["--output", out, "report"]) == 0
    assert json.loads((tmp_path / "o" / "reports" / "summary.json").read_text())["total_assets"] == 1
    assert (tmp_path / "o" / "reports" / "summary.md").read_text().startswith("# Asset summary") and (tmp_path / "o" / "reports" / "assets.csv").read_text().count(URL) == 1
    assert [x["url"] for x in json.loads((tmp_path / "o" / "assets.json").read_text())] == ["https://h/a.js", "https://h/b.json"]
    capsys.readouterr()
    assert cli.main(["--output", out, "query", "SELECT url, asset_type, mime_type FROM assets"]) == 0
    assert json.loads(capsys.readouterr().out) == {"url": URL, "asset_type": "javascript", "mime_type": None}
    (tmp_path / "c.yaml").write_text(f"threads: 3\ndatabase:\n  path: {out}/recon.db\n")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert cli.main(["--config", str(tmp_path / "c.yaml"), "query", "SELECT count(*) AS n FROM assets"]) == 0
    assert json.loads(capsys.readouterr().out) == {"n": 1} and spark.conf.get("spark.sql.shuffle.partitions") == "3"
    spark.conf.set("spark.sql.shuffle.partitions", before)
    (tmp_path / "bad.yaml").write_text("threads: 0\n")
    for bad in (["--output", out, "ingest", str(tmp_path / "none.json")], ["--config", str(tmp_path / "bad.yaml"), "report"], ["report"]):
        with pytest.raises(SystemExit):
            cli.main(bad)


def test_migrations_are_applied_once_and_touch_nothing_that_is_there(spark, tmp_path):
    folder = str(tmp_path / "tables")
    storage.swap(spark.createDataFrame([(1, 2, "f", "info", "v", None)], schemas.TABLES["findings"]), folder, "findings")
    assert storage.migrate(spark, folder) == tuple(v for v, _ in schemas.MIGRATIONS) and storage.migrate(spark, folder) == ()
    tables = storage.open_tables(spark, folder)
    assert set(tables) == set(schemas.TABLES) and tables["findings"].count() == 1 and tables["graph_edges"].schema == schemas.TABLES["graph_edges"]
    assert sorted(r.version for r in tables["schema_migrations"].collect()) == [v for v, _ in schemas.MIGRATIONS]


def test_versions_change_whole_and_old_ones_can_go(spark, tmp_path):
    folder = str(tmp_path)
    storage.migrate(spark, folder)
    finding = lambda i: spark.createDataFrame([(i, 2, "f", "info", "v", None)], schemas.TABLES["findings"])
    storage.swap(finding(1), folder, "findings")
    both = storage.swap(storage.open_table(spark, folder, "findings").unionByName(finding(2)), folder, "findings")
    assert sorted(r.id for r in both.collect()) == [1, 2]
    before = storage.current(spark, folder)
    lost = storage.stage(finding(3), folder, "findings")  # a writer that ends before it publishes
    assert storage.current(spark, folder) == before and storage.open_table(spark, folder, "findings").count() == 2 and storage.exists(spark, lost)
    with pytest.raises(OSError):  # a writer that is late
        storage.put(spark, f"{folder}/_versions/{3:012d}.json", "{}", replace=False)
    assert storage.vacuum(spark, folder, 1) == 2 and storage.open_table(spark, folder, "findings").count() == 2
    assert storage.open_table(spark, folder, "assets").count() == 0 and storage.vacuum(spark, folder, 1) == 0


def test_intermediate_tables_are_deleted_by_who_made_them(spark):
    outer = storage.written(spark.range(3), "outer")
    with storage.released(spark):
        kept = storage.written(spark.range(4), "kept")
        with storage.released(spark):
            inner = storage.written(spark.range(5), "inner")
            assert inner.count() == 5
        assert kept.count() == 4 and not storage.exists(spark, inner.inputFiles()[0])
    assert outer.count() == 3 and not storage.exists(spark, kept.inputFiles()[0])


def test_configuration():
    assert config.parse(None) == config.Config()
    got = config.parse({"threads": 3, "crawler": {"depth": 2, "javascript": False}, "download": None, "database": {"path": "x"}})
    assert (got.threads, got.crawler.depth, got.crawler.javascript, got.download.timeout, got.database_path) == (3, 2, False, 15, "x")
    for bad, key in (({"threads": 0}, "threads"), ({"threads": True}, "threads"), ({"crawler": {"javascript": 1}}, "crawler.javascript"), ({"download": {"retries": -1}}, "download.retries"), ({"database": {"path": ""}}, "database.path"), ({"crawler": 5}, "crawler"), ([], "root")):
        with pytest.raises(ValueError, match=key):
            config.parse(bad)
