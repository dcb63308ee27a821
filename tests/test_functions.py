import random

import duckdb
import pytest
from pyspark.sql import functions as F

from assetloom.functions import patterns as P
from assetloom.functions import urls as U
from assetloom.functions.text import decode_lenient, sql_literal
from assetloom.plans.adhoc import glob_to_regex

CLASSES = [
    ("https://h.test/a.js?v=1#x", "javascript"),
    ("https://h.test/A.MJS", "javascript"),
    ("https://h.test/service-worker.js", "javascript"),
    ("https://x.js", "javascript"),
    ("https://h.test/a.js.map", "source_map"),
    ("https://h.test/a.wasm", "webassembly"),
    ("https://h.test/manifest.json", "manifest"),
    ("https://h.test/manifest.webmanifest#a?b", "manifest"),
    ("https://h.test/site.webmanifest", "manifest"),
    ("https://h.test/sw/worker/", "worker"),
    ("https://h.test/worker.json", "worker"),
    ("https://worker.h.test/x", "worker"),
    ("https://h.test/service-worker", "worker"),
    ("https://h.test/workers/x", "other"),
    ("https://h.test/cfg.json", "configuration"),
    ("https://h.test/x?y=a.js", "other"),
    ("https://h.test/", "other"),
    ("", "other"),
]


def test_classes(spark):
    df = spark.createDataFrame(CLASSES, "url string, want string")
    assert [r for r in df.withColumn("got", U.classify(F.col("url"))).collect() if r.got != r.want] == []


@pytest.mark.parametrize(
    ("url", "kept"),
    [("http://a/x.JS", True), ("http://a/x.js?q", True), ("http://a/x.jsx", False), ("http://a/worker?x", True), ("http://a/my_worker", True), ("http://a/manifest", True), ("http://a/manifest.json#f", True), ("http://a/manifesto", False), ("http://a/x.js  ", False), ("service-worker", True)],
)
def test_candidates(spark, url, kept):
    assert spark.createDataFrame([(url,)], "u string").select(U.is_candidate(F.col("u"))).first()[0] is kept


def test_file_names(spark):
    rows = [(0, "https://h/a/b.js?x", "000000_b.js"), (12, "https://h", "000012_asset"), (7, "https://h/a b/ü!.js#f", "000007___.js"), (1234567, "https://h/x/", "1234567_x"), (1, "https://h/./.", "000001_asset"), (2, "https://h/" + "a" * 200, "000002_" + "a" * 120)]
    df = spark.createDataFrame(rows, "n long, u string, want string")
    assert [r for r in df.withColumn("got", U.file_name(F.col("n"), F.col("u"))).collect() if r.got != r.want] == []


def test_media_types(spark):
    rows = [("text/html; charset=x", "a.js", "text/html"), ("", "a.js", "text/javascript"), (None, "a.MJS", "text/javascript"), (None, "a.map", None), (None, "a.webmanifest", "application/manifest+json"), ("; x", "a.json", "application/json"), ("a/b ;c", "x", "a/b ")]
    df = spark.createDataFrame(rows, "h string, n string, want string")
    assert [r for r in df.withColumn("got", U.media_type(F.col("h"), F.col("n"))).collect() if r.got != r.want] == []


def test_strip_and_lenient_decoding(spark):
    assert spark.createDataFrame([(" \x1c a b\xa0\n",)], "s string").select(U.strip(F.col("s"))).first()[0] == "a b"
    got = spark.createDataFrame([(bytearray(b"a\xff\r\nb\rc\xc3\xa9"),), (None,)], "b binary").select(decode_lenient(F.col("b")).alias("t")).collect()
    assert [r.t for r in got] == ["a\nb\ncé", None]


def find(spark, pattern, group, text):
    return spark.createDataFrame([(text,)], "t string").select(F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(pattern), F.lit(group))))).first()[0]


def test_list_patterns(spark):
    assert find(spark, P.URLS, 0, "wss://h/x https://a.b/c\" //comment HTTPS://U 'x//y'") == ["//U", "//comment", "//h/x", "//y", "https://a.b/c"]
    assert find(spark, P.WEBSOCKETS, 0, "WSS://a.b/c ws://x<y xws://z") == ["WSS://a.b/c", "ws://x", "ws://z"]
    assert find(spark, P.ENDPOINTS, 0, "/api/u /apiary a/api //v1 /V2beta /v /rest?x=${y} https://h/v1 é/v3 /GraphQL") == ["/GraphQL", "/V2beta", "/api/u", "/apiary", "/rest?x=${y}"]
    text = "import {a,\n b} from 'm1'; import \"m2\"; require('m3\"); import('no'); require( 'no'); export * from 'no'; reimport 'm4'"
    assert find(spark, P.IMPORTS, 1, text) == ["m1", "m2", "m3", "m4"]


TOKENS = [
    ("React", "x react y", True), ("React", "reactor", False), ("React", "ReactDOM", True), ("React", "uſeſtate", True), ("Vue", "revue", False), ("Vue", "évue", False), ("Angular", '"@angular/core"', False), ("Angular", "x@angular", True),
    ("Angular", "ngoninit", True), ("Next.js", "a/next/router/b", True), ("Nuxt", "nuxt.js", True), ("Nuxt", "nuxtx", False), ("Svelte", "svelte/internal", True), ("Webpack", "(__webpack_require__)", True), ("Webpack", "x__webpack_require__", False),
    ("Vite", "'/@vite/client'", False), ("Vite", "x/@vite/client", True), ("Vite", "importxmeta.hot", False), ("Rollup", "__commonJS=", True),
]


@pytest.mark.parametrize(("name", "text", "hit"), TOKENS)
def test_technologies(spark, name, text, hit):
    from assetloom.operators.extract import _technologies

    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(F.col("t").rlike(P.technology(P.TECHNOLOGIES[name]))).first()[0] is hit
    assert (name in [x.value for x in df.select(_technologies(F.col("t"))).first()[0]]) is hit


def test_large_texts_do_not_overflow_the_regex_stack(spark):
    text = "import a from 'x'; /api/v1 https://h.test/ wss://s " * 20_000
    df = spark.createDataFrame([(text,)], "t string")
    for p in (P.URLS, P.WEBSOCKETS, P.ENDPOINTS, P.IMPORTS):
        assert df.select(F.size(F.regexp_extract_all("t", F.lit(p), F.lit(0)))).first()[0] >= 20_000


def test_globs(spark):
    for glob, text, hit in (("a*c", "abbc", True), ("a?c", "abbc", False), ("[a-c]x", "bx", True), ("[^a]x", "ax", False), ("a.c", "abc", False), ("*", "a\nb", True), ("[x", "[x", True)):
        assert spark.createDataFrame([(text,)], "t string").select(F.col("t").rlike(glob_to_regex(glob))).first()[0] is hit


def test_spark_and_duckdb_patterns_agree_on_random_token_strings(spark):
    rng = random.Random(11)
    tokens = ["import ", "import{a} ", " from ", "require(", "require (", "'", '"', "`", "/", "//", "/api", "/v1", "/rest", "graphql", "ws://", "WSS://", "http:", "https://", "x", "é", "_", " ", "\n", "\xa0", "\u2003", "<", "\\", "@angular", "react", "Vue", "nuxt.js", "/@vite/client", "import.meta.hot", "(", ")", "${", "}", "?q=1", "next/dist", "1"]
    texts = ["".join(rng.choice(tokens) for _ in range(rng.randint(0, 25))) for _ in range(1500)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    all_of = lambda p, g: F.array_sort(F.array_distinct(F.regexp_extract_all("t", F.lit(p), F.lit(g))))
    java = {"urls": (P.URLS, 0), "ws": (P.WEBSOCKETS, 0), "ends": (P.ENDPOINTS, 0), "imports": (P.IMPORTS, 1)}
    got = df.select("i", *[all_of(*x).alias(n) for n, x in java.items()], *[F.col("t").rlike(P.technology(t)).alias(n) for n, t in P.TECHNOLOGIES.items()]).orderBy("i").collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE s (i INTEGER, t VARCHAR)")
    con.executemany("INSERT INTO s VALUES (?, ?)", [list(x) for x in enumerate(texts)])
    re2 = {"urls": (P.RE2_URLS, 0), "ws": (P.RE2_WEBSOCKETS, 0), "ends": (P.RE2_ENDPOINTS, 1), "imports": (P.RE2_IMPORTS, 1)}
    fields = [f"list_distinct(regexp_extract_all(t, {sql_literal(p)}, {g}))" for p, g in re2.values()] + [f"regexp_matches(t, {sql_literal(P.re2_technology(t))})" for t in P.TECHNOLOGIES.values()]
    want = con.sql(f"SELECT i, {', '.join(fields)} FROM s ORDER BY i").fetchall()
    for r, w in zip(got, want, strict=True):
        assert tuple(r) == tuple(sorted(x) if isinstance(x, list) else x for x in w), texts[r.i]
