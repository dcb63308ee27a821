import datetime
import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm import hilbert, licences, quality, warc
from assetloom.llm.balltree import BallTree, quantised, top_k
from assetloom.llm.shared import scratch

# ---- WARC ---------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, key string, body string, file string, _digest string"


def pages():
    rng = random.Random(2)
    big = "x" * 1500
    rows = [(i, f"https://www.h{i % 4}.test/p/{i % 3}?b=2&a={i % 2}#f", "<p>" + "y" * rng.randint(0, 3000)) for i in range(60)]
    rows += [(100 + i, "http://h1.test/same", big) for i in range(20)]
    rows += [(200, None, None), (201, "", ""), (202, "not a url", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\n\r\n" * 40), (203, "http://[bad", "\r\n\r\n"), (204, "http://a.test/\r\nX: y", "é" * 600)]
    rows += [(None, "http://null.test/", big), (119, "http://again.test/", big), (205, "http://dup.test", "z" * 1000), (205, "http://dup.test", "z" * 1000), (None, None, "only nulls " * 100), (None, None, "only nulls " * 100)]
    return [(*r, "k", "b", "f", "d") for r in rows]


def expected_records(rows):
    payload = [(r[0], (r[2] or "").encode()) for r in rows]
    top = {}
    for k, b in payload:
        if k is not None:
            top[b] = max(k, top.get(b, k))
    out = []
    for k, b in payload:
        holder = top.get(b) if len(b) >= 1000 else None
        revisit = holder is not None and holder != k
        out.append((str(k), len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", str(holder if revisit else None)))
    return sorted(out)


def test_archives_round_trip_on_odd_pages(spark):
    rows = pages()
    found = warc.capture_index(spark.createDataFrame(rows, PAGES).repartition(3)).collect()
    assert sorted((str(r.key), r.payload_bytes, r.digest, r.type, str(r.refers_to)) for r in found) == expected_records(rows)


def test_archives_are_plain_warc_files_and_offsets_point_at_records(spark, tmp_path):
    rows, path = pages(), f"file://{tmp_path}/w"
    index = warc.capture_index(spark.createDataFrame(rows, PAGES), path)
    bodies = Counter()
    for r in index.collect():
        with open(r.file.removeprefix("file:").replace("//", "/"), "rb") as f:
            f.seek(r.offset)
            data = f.read(r.length)
        ((at, length, headers, block),) = warc.records(data)
        assert at == 0 and length == r.length and headers["warc-type"] == r.type
        if r.type == "response":
            bodies[block] += 1
        assert r.url is None or "\r" not in r.url
    assert set(bodies) == {(r[2] or "").encode() for r in rows}


def test_index_is_globally_ordered(spark):
    index = warc.capture_index(spark.createDataFrame(pages(), PAGES).repartition(5))
    parts = index.withColumn("p", F.spark_partition_id()).collect()
    places = [(r.url_key, r.captured, r.key is not None, r.key or 0) for r in parts]
    assert places == sorted(places) and len({r.p for r in parts}) >= 1


def test_dates_are_utc_whatever_the_session_says(spark, tmp_path):
    rows = [(s, f"http://h.test/{s}", "x") for s in (0, 1, 86_399, 1_667_109_599, 1_667_113_200, 1_647_154_800, 3_000_000_000)]
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("America/New_York", "Europe/Berlin", "Asia/Kolkata", before):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = warc.capture_index(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
        finally:
            spark.conf.set("spark.sql.session.timeZone", before)
        utc = lambda s: datetime.datetime.fromtimestamp(s, datetime.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        assert {r.key: r.captured for r in found} == {s: utc(s) for s, _, _ in rows}


def test_files_are_bounded_in_bytes_and_rows(spark, tmp_path):
    sizes = [10] * 90 + [150] * 40 + [1500] * 8 + [3000] * 5 + [20_000] * 3
    rows = [(i, f" http://h.test/{i} ", chr(97 + i % 26) * n + str(i)) for i, n in enumerate(sizes)]
    path = f"file://{tmp_path}/w"
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path, rows_per_file=40, file_bytes=4000)
    files = [f for f in os.listdir(tmp_path / "w") if f.startswith("part-")]
    for f in files:
        held = list(warc.records((tmp_path / "w" / f).read_bytes()))
        assert len(held) <= 40 and (sum(len(b) for *_, b in held) <= 4000 or len(held) == 1)
    found = warc.read_captures(spark, path).collect()
    assert sorted((r.key, r.url, r.payload_bytes) for r in found) == [(k, u, len(b)) for k, u, b in rows]


def test_empty_pages(spark):
    assert warc.capture_index(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("held", [1, 7, 50, 10_000])
def test_merge_equals_sort(held):
    rng = random.Random(held)
    rows = [(rng.randrange(9), rng.choice("abc"), str(rng.randrange(5)), rng.choice([None, 1, 2]), "u", f"f{rng.randrange(3)}", n) for n in range(300)]
    assert list(warc.merged(iter(rows), held)) == sorted(rows, key=warc._place)


def test_loser_tree_of_any_number_of_runs():
    for n in (0, 1, 2, 3, 5, 8, 13):
        rng = random.Random(n)
        runs = [sorted((0, rng.choice("xyz"), "", i, "", "", j) for j in range(rng.randrange(6))) for i in range(n)]
        flat = sorted((r for run in runs for r in run), key=warc._place)
        assert list(warc.LoserTree([iter(sorted(r, key=warc._place)) for r in runs], warc._place)) == flat


def test_broken_archives_raise():
    good = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert len(list(warc.records(good * 3))) == 3
    for bad in (good[:-3], b"x" + good, good.replace(b": 2", b": 1")):
        with pytest.raises(ValueError):
            list(warc.records(bad))


def test_url_key():
    assert warc.url_key("HTTPS://www.Example.COM:443/A/b?z=1&a=2#f") == "com,example)/a/b?a=2&z=1"
    assert warc.url_key("http://x.test:8080") == "test,x:8080)/"


# ---- licences -----------------------------------------------------------------------------------


def recognised(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [tuple(r.r) for r in df.select("i", licences.recognise(F.col("t")).alias("r")).orderBy("i").collect()]


def brute_licences(text):
    """The same in plain Python, over lists."""
    plain, known, names, spdx = licences.normalised, licences.known(), licences.names(), licences.identifiers()

    def look(s):
        n = plain(s)
        under = re.match(licences._UNDER, n)
        return known.get(n) or (names.get(under[1]) if under else None) or known.get(re.sub(" [0-9]{1,2}$", "", n))

    bare = re.sub(r"(?m)^[ \t]*(?://+[!/]*|/\*+!?|\*+/)|(?://+|/\*+|\*+/)[ \t\r]*$", "", text or "")
    ids = []
    for s in re.split(r"[.!?]+[ \t\r\n]+|:[ \t\r]*\n|\n[ \t\r]*\n", bare):
        if found := look(s):
            ids.append(found)
            continue
        for line in s.split("\n"):
            head, mark, expression = line.lower().rpartition("spdx-license-identifier:")
            if mark:
                ids += [spdx[w] for w in re.findall(r"[a-z0-9.+-]+", expression) if w in spdx]
            elif found := look(line):
                ids.append(found)
    left, matched = list(ids), []
    for name, rule in licences.RULES:
        at = 0
        while at + len(rule) <= len(left):
            if left[at : at + len(rule)] == rule:
                left[at : at + len(rule)] = [None]
                matched.append(name)
            at += 1
    unmatched = []
    for x in filter(None, left):
        name = x[5:] if x[:5] in ("Name-", "Spdx-") else licences.SINGLE.get(x)
        if name:
            matched.append(name)
        else:
            unmatched.append(x)
    return ",".join(dict.fromkeys(matched)), ",".join(ids), ",".join(unmatched)


def sample(name):
    """A sentence that is known by this identifier."""
    if name in licences.SENTENCES:
        return licences.SENTENCES[name][-1]
    kind, licence = name.split("-", 1)
    return "Released under the " + licences.NAMES[licence][0] if kind == "Name" else f"SPDX-License-Identifier: {licence}"


def test_licences(spark):
    mit = ". ".join(licences.SENTENCES[i][0] for i in ("MitGrant", "MitNotice", "MitAsIs"))
    wrapped = mit.replace(", ", ",\n")
    texts = [None, "", "nothing here", "Some junk line\nReleased under the MIT License.\nmore", "LICENSED under the Apache   License, version 2.0", mit, wrapped, mit + "\n\n" + mit, "Licensed under CC BY 4.0. Licensed under CC BY-NC 4.0.", "All rights reserved.", "license " * 50_000]
    got = recognised(spark, texts)
    assert [g[0] for g in got] == ["", "", "", "MIT", "Apache-2.0", "MIT", "MIT", "MIT", "CC-BY-4.0,CC-BY-NC-4.0", "", ""]
    assert got[7][1].count("MitGrant") == 2 and got[7][2] == ""
    assert got[9][1:] == ("Rights", "Rights")
    assert got == [brute_licences(t) for t in texts]


def test_licences_in_comments(spark):
    mit = ". ".join(licences.SENTENCES[i][0] for i in ("MitGrant", "MitNotice", "MitAsIs")) + "."
    lines = mit.replace(", ", ",\n").split("\n")
    apache = ["Licensed under the Apache License, Version 2.0 (the \"License\");", "you may not use this file except in compliance with the License.", "You may obtain a copy of the License at", "", "    http://www.apache.org/licenses/LICENSE-2.0", ""]
    texts = ["// Licensed under the MIT License", "int x; /* a */\n/* Licensed under the MIT License. */\nint y;", "\n".join(f"  // {x}" for x in lines), "/*\n" + "\n".join(lines) + "\n*/", "\n".join(f"/* {x} */" for x in lines), "\r\n".join(f"// {x}" for x in apache), "\n".join(f"# {x}" for x in lines)]
    got = recognised(spark, texts)
    assert [g[0] for g in got] == ["MIT"] * 5 + ["Apache-2.0", "MIT"]
    assert got == [brute_licences(t) for t in texts]


def test_full_notices_and_spdx_expressions(spark):
    s = lambda *ids: ".\n".join(licences.SENTENCES[i][0] for i in ids) + ".\n"
    bsd = licences.SENTENCES["BsdGrant"][0] + ":\n1. " + licences.SENTENCES["BsdSource"][0] + ".\n2. " + licences.SENTENCES["BsdBinary"][0] + ".\n"
    texts = {
        s("IscGrant", "IscAsIs"): "ISC", s("ZeroGrant", "IscAsIs"): "0BSD", s("UnlicenseFree", "UnlicenseAnyone"): "Unlicense", s("Epl2Notice"): "EPL-2.0", s("Lgpl21Later", "GnuHope", "LgplSee"): "LGPL-2.1-or-later",
        "Copyright (c) 2020 X\n\n" + bsd: "BSD-2-Clause", bsd + "3. " + licences.SENTENCES["BsdEndorse"][1] + ".": "BSD-3-Clause", bsd.replace("1. ", "* ").replace("2. ", "* "): "BSD-2-Clause",
        "/* SPDX-License-Identifier: (MIT OR Apache-2.0) */\nint x;": "MIT,Apache-2.0", "# SPDX-License-Identifier: MPL-2.0": "MPL-2.0", "// SPDX-License-Identifier: GPL-2.0-only": "GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0": "GPL-2.0-or-later,Classpath-exception-2.0",
        "spdx-license-identifier: bsd-2-clause AND isc": "BSD-2-Clause,ISC", "SPDX-License-Identifier: LGPL-3.0": "LGPL-3.0-only", "SPDX-License-Identifier: Nobody-1.0": "", "This project is licensed under the terms of the GPLv3 license!": "GPL-3.0-only", "the code is also available under CC0": "CC0-1.0", "The code is also available under CC0 1.0": "CC0-1.0",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0-only", s("MplNotice") + licences.SENTENCES["MplCopy"][0]: "MPL-2.0", s("ZlibAsIs", "ZlibGrant"): "Zlib", "understand what is available": "",
    }
    got = recognised(spark, list(texts))
    assert [g[0] for g in got] == list(texts.values())
    assert got == [brute_licences(t) for t in texts]


def test_every_rule_fires(spark):
    rules = [*licences.RULES, *[(licence, [x]) for x, licence in licences.SINGLE.items()]]
    rules += [(x, [f"Name-{x}"]) for x in licences.NAMES] + [(x, [f"Spdx-{x}"]) for x in licences.SPDX]
    assert set(licences.SINGLE) <= set(licences.SENTENCES) and {i for _, r in licences.RULES for i in r if "-" not in i} <= set(licences.SENTENCES)
    texts = [".\n\n".join(sample(i) for i in rule) for _, rule in rules]
    got = recognised(spark, texts)
    for (name, rule), (found, sentences, unmatched), text in zip(rules, got, texts, strict=True):
        assert (found, sentences, unmatched) == (name, ",".join(rule), ""), text
        assert brute_licences(text) == (found, sentences, unmatched)
    for n, (_, rule) in enumerate(licences.RULES):  # no rule stands before one that holds it
        for _, earlier in licences.RULES[:n]:
            assert not any(rule[at : at + len(earlier)] == earlier for at in range(len(rule) - len(earlier) + 1))


def test_licences_against_brute_force_on_mixed_texts(spark):
    rng = random.Random(5)
    pool = [x for group in licences.SENTENCES.values() for x in group] + ["SPDX-License-Identifier: MIT", "Released under the MIT License", "junk words", "free software under way", ""]
    texts = ["".join(rng.choice(pool).replace(" ", rng.choice([" ", "\n", "  "]), rng.randint(0, 3)) + rng.choice([". ", ".\n", ":\n", "\n\n", "\n", " // \n", "!\r\n2. "]) for _ in range(rng.randint(1, 9))) for _ in range(300)]
    assert recognised(spark, texts) == [brute_licences(t) for t in texts]


def test_licences_of_odd_rows(odd, none):
    assert odd.select(licences.recognise(F.col("text"))).count() == odd.count()
    assert none.select(licences.recognise(F.col("text"))).count() == 0


# ---- quality ------------------------------------------------------------------------------------


def test_statistics_are_finite():
    for t in (b"", b" ", b"\n", b"a", "é".encode() * 1000, b"x" * 100_000, b"A! b@ 9\n" * 30, bytes(range(256))):
        s = quality.statistics(t)
        assert len(s) == len(quality.FEATURES) and all(map(math.isfinite, s))


def test_scores_are_the_log_density_difference():
    rng = np.random.default_rng(1)
    p = len(quality.FEATURES)
    data = {c: rng.normal(c, 1 + c, (200, p)) for c in (0, 1)}
    model = quality.discriminant({c: (float(len(x)), x.sum(0), x.T @ x) for c, x in data.items()})
    both = np.concatenate([data[0], data[1]])
    variances = np.diag(both.T @ both / len(both) - np.outer(both.mean(0), both.mean(0)))
    logs = []
    for c in (0, 1):
        m = data[c].mean(0)
        share = max(quality.SHRINKAGE, p / (len(data[c]) + p))
        s = (1 - share) * np.cov(data[c].T, bias=True) + share * np.diag(variances) + quality.RIDGE * np.eye(p)
        d = both - m
        logs.append(math.log(0.5) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d * np.linalg.solve(s, d.T).T).sum(1))
    assert np.allclose(model.scores(both), 1 / (1 + np.exp(-(logs[1] - logs[0]) / quality.TEMPERATURE)))


def test_quality_learns_without_held_out_rows_and_keeps_good_ones(spark):
    rng = random.Random(4)
    good = lambda: " ".join(rng.choice(["the", "river", "runs", "over", "stone", "and", "moss"]) for _ in range(rng.randint(40, 200))) + "."
    bad = lambda: " | ".join(rng.choice(["###", "$$$", "BUY", "99", "%%%"]) for _ in range(rng.randint(40, 200)))
    docs = spark.createDataFrame([(i, good() if i % 3 else bad()) for i in range(600)] + [(None, None), (700, ""), (5, good())], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(600)] + [(None, 1), (3, None)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.quality(docs, labels).collect()}
    assert quality.quality(docs, labels).count() == 603
    for i in range(600):
        assert rows[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= rows[i].score <= 1
        assert rows[i].predicted == int(rows[i].score >= 0.3) == int(i % 3 > 0)
    # Labels of held-out rows are never looked at.
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.quality(docs, turned).collect()}
    assert all(abs(again[i] - rows[i].score) < 1e-9 for i in range(600))
    kept = quality.keep_good(docs.withColumn("score", F.lit("s")), labels)
    assert kept.columns == ["doc_id", "text", "score"] and kept.filter("doc_id % 3 = 0 AND doc_id < 600").count() == 0


def test_quality_without_labels_or_rows(odd, none, spark):
    nothing = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.quality(odd, nothing).collect()} == {0.5}
    assert quality.quality(none, nothing).count() == 0 and quality.keep_good(odd, nothing).columns == odd.columns


# ---- search -------------------------------------------------------------------------------------


def brute_top(rows, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, v in good:
        if q % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), i) for i, w in good if i != q and len(w) == len(v))[:k]
            out[q] = [(n, i, -s) for n, (s, i) in enumerate(found, 1)]
    return out


def check_top(spark, rows, kind="float", **sizes):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").select("vec_id", quantised(F.col("embedding")).alias("v"), F.lit(1).alias("shard"), F.lit("x").alias("score"), F.lit(0).alias("qid"))
    got = defaultdict(list)
    for r in top_k(df, df.filter("vec_id % 50 = 0"), k=5, **sizes).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    clamped = lambda s: max(-(1 << 63), min((1 << 63) - 1, s))
    want = {q: [(n, i, clamped(s)) for n, i, s in v] for q, v in brute_top(rows, 5).items() if v}
    assert {q: sorted(v) for q, v in got.items()} == want
    return want


def test_top_k_is_exact_with_ties_nulls_and_many_shards(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(700)]
    hot = rows[3][1]
    rows += [(1000 + i, hot) for i in range(250)]
    rows += [(2000, None), (2001, [1.0, None] + [0.0] * 6), (2002, [float("nan")] * 8), (2003, [float("inf")] + [0.0] * 7), (None, hot), (2050, []), (2100, [1.0, 2.0]), (2101, [3.0, 1.0]), (2150, [0.0] * 8)]
    for shard_rows in (100, 20, None):
        check_top(spark, rows, shard_rows=shard_rows)


def test_top_k_is_exact_for_components_of_any_size(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(0, 1, 64) * 10.0 ** rng.uniform(-3, 9, 64)]) for i in range(400)]
    rows += [(1000 + i, [float(np.float32(x)) for x in rng.normal(0, 1, 64)]) for i in range(150)]  # small beside large, in every shard
    near = [float(np.float32(x)) for x in rng.normal(0, 1e7, 64)]
    rows += [(2000 + i, near[:63] + [near[63] + 2.0**-8 * i]) for i in range(20)]  # scores that differ in their last digits
    want = check_top(spark, rows, shard_rows=90)
    assert any(s == (1 << 63) - 1 for v in want.values() for _, _, s in v) and any(abs(s) < 1 << 50 for v in want.values() for _, _, s in v)
    huge = [(i, [float(x) for x in rng.normal(0, 1, 5) * 10.0 ** rng.uniform(-300, 300, 5)]) for i in range(200)]
    check_top(spark, huge, "double", shard_rows=64)


def test_top_k_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, v array<long>")
    assert top_k(df, df).count() == 0 and top_k(df, df).columns == ["query_id", "rank", "vec_id", "score"]


def test_ball_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(0)
    centres = rng.integers(-400, 400, (20, 6))
    data = (np.repeat(centres, 100, axis=0) + rng.integers(-5, 5, (2000, 6))).astype(float)
    tree = BallTree(np.arange(2000), data)
    for q in data[:10]:
        scores = data @ q
        want = sorted(((int(s), -i) for i, s in enumerate(scores)), reverse=True)[:5]
        assert tree.search(q, -1, 5, None) == [(s, -i) for s, i in want]
        assert tree.search(q, -1, 5, want[-1][0]) == [(s, -i) for s, i in want]


# ---- sharding -----------------------------------------------------------------------------------


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_curve_visits_each_cell_by_single_steps(spark, bits):
    n = 1 << bits
    df = spark.range(n**3).selectExpr(f"id % {n} AS a", f"id div {n} % {n} AS b", f"id div {n * n} AS c")
    rows = sorted(hilbert.hilbert_index(df, ["a", "b", "c"], bits, "h").collect(), key=lambda r: r.h)
    assert [r.h for r in rows] == list(range(n**3))
    assert {abs(x.a - y.a) + abs(x.b - y.b) + abs(x.c - y.c) for x, y in zip(rows, rows[1:], strict=False)} == {1}


def test_shards_are_runs_of_the_curve(odd, none):
    for shards in (16, 7, 200):
        rows = hilbert.hilbert_shards(odd, shards=shards).collect()
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in odd.collect())
        groups = defaultdict(list)
        for r in rows:
            groups[r.shard].append(r)
        counts = [len(groups[s]) for s in range(shards)]
        assert max(counts) - min(counts) <= 1 and set(groups) <= set(range(shards))
        assert all(sorted(x.slot for x in g) == list(range(len(g))) for g in groups.values())
        ordered = [r.curve for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
        assert ordered == sorted(ordered)
    assert hilbert.hilbert_shards(none).count() == 0


def curve_index(axes, bits):
    """Skilling's transform on plain integers."""
    x, n = list(axes), len(axes)
    q = 1 << bits - 1
    while q > 1:
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & q - 1
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << bits - 1
    while q > 1:
        if x[-1] & q:
            t ^= q - 1
        q >>= 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def test_the_whole_order_is_that_of_the_curve_over_quantiles(odd):
    rows, bits = odd.collect(), 5
    steps = []
    for values in ([r.lang for r in rows], [r.source for r in rows]):
        there = sorted(v.encode() for v in values if v is not None)
        steps.append([0 if v is None else (there.index(v.encode()) << bits) // len(there) for v in values])
    sizes = [len((r.text or "").encode()) + 1 for r in rows]
    cuts = [sorted(sizes)[-(-i * len(sizes) // (1 << bits)) - 1] for i in range(1, 1 << bits)]
    steps.append([sum(c < v for c in cuts) for v in sizes])
    want = Counter((str(r.doc_id), size, curve_index(at, bits)) for r, size, at in zip(rows, sizes, zip(*steps, strict=True), strict=True))
    found = hilbert.hilbert_shards(odd).collect()
    assert Counter((str(r.doc_id), r.size, r.curve) for r in found) == want
    ordered = sorted(found, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in found)
    n = len(found)
    assert [r.shard for r in ordered] == [place * 16 // n for place in range(n)]


def test_shard_files_have_narrow_ranges(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, "w" * rng.randint(1, 4000), rng.choice(["de", "en", "fr", "it"]), f"src{rng.randrange(20):02d}") for i in range(3000)], "doc_id long, text string, lang string, source string")
    rows = hilbert.hilbert_shards(docs).join(docs, "doc_id").collect()
    span = lambda f: sum(len({f(r) for r in rows if r.shard == s}) for s in range(16)) / 16
    assert span(lambda r: r.lang) < 3 and span(lambda r: r.source) < 14


def test_repeated_rows_are_numbered_once_each(spark):
    docs = spark.createDataFrame([(None, "same", "en", "s")] * 500 + [(i, f"t{i}", "en", "s") for i in range(100)], "doc_id long, text string, lang string, source string")
    rows = hilbert.hilbert_shards(docs).collect()
    assert len(rows) == 600 and len({(r.shard, r.slot) for r in rows}) == 600


def test_sources_with_a_long_common_prefix_are_told_apart(spark):
    rng = random.Random(1)
    source = lambda n: ("http" if n % 2 else "https") + "://corpus.example.test/common/crawl/part-" + f"{n:02d}"
    docs = spark.createDataFrame([(i, "w" * rng.randint(1, 4000), rng.choice(["de", "en", "fr", "it"]), source(rng.randrange(20))) for i in range(3000)], "doc_id long, text string, lang string, source string")
    rows = hilbert.hilbert_shards(docs).join(docs, "doc_id").collect()
    span = lambda f: sum(len({f(r) for r in rows if r.shard == s}) for s in range(16)) / 16
    assert span(lambda r: r.lang) < 3 and span(lambda r: r.source) < 14


def test_steps_of_strings_are_their_quantiles(spark):
    words = ["", "a", "aa", "ab", "b", "src1", "src10", "src2", "é", "zzzzzzzzzz", "z" * 9 + "y"]
    rng = random.Random(3)
    values = [rng.choice(words) for _ in range(500)] + ["hot"] * 400 + [None] * 50
    df = spark.createDataFrame([(v,) for v in values], "w string").repartition(5)
    found, there = hilbert.cells(df, {"a": "w"}, {}, 3)
    steps = {r.w: r.a for r in found.distinct().collect()}
    sound = sorted((v for v in values if v is not None), key=str.encode)
    assert there == ["a"] and steps.pop(None) == 0 and steps == {w: 8 * sound.index(w) // len(sound) for w in set(sound)}


def test_new_paths_are_below_the_shared_folder(spark):
    assert scratch(spark, "t") != scratch(spark, "t")
