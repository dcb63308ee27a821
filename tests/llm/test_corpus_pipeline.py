import os
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from assetloom.llm import catalogue, similar
from assetloom.llm.exact_dedup import exact_dedup
from assetloom.llm.simhash import near_duplicates
from assetloom.llm.wordcode import default_path, library

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_every_operator_is_registered():
    names = catalogue.queries()
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 11)} and len(names) == 10
    assert {*names, "pipeline"} <= set(__spark_entry__.queries()) and set(catalogue.oracle_sql()) <= set(names)


@needs_data
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = catalogue.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    found = con.sql(catalogue.oracle_sql()[name])
    at = [found.columns.index(c) for c in columns]
    assert len(found.columns) == len(columns)
    assert sorted(repr([r[c] for c in columns]) for r in df.collect()) == sorted(repr([r[i] for i in at]) for r in found.fetchall())


@needs_data
def test_the_other_queries_return_every_row(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").count()
    for name in ("op6_quality", "op7_bpe", "op9_hilbert", "op10_simhash"):
        df = catalogue.queries()[name](spark, DATA)
        assert df.select("doc_id").distinct().count() == df.count() == docs
    for name in ("op1_packing", "op4_section_tokens"):
        assert catalogue.queries()[name](spark, DATA).select("doc_id").distinct().count() == docs


@pytest.fixture
def folder(spark, odd, tmp_path):
    """Odd rows as documents; labels mark prose good and a few rows bad."""
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1) for i in range(25)] + [(i, 1) for i in range(100, 112)] + [(i, 0) for i in range(300, 312)]
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "simhash near-dedup", "best-fit packing"]
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, folder)
    assert good.columns == columns
    good.write.parquet(f"{folder}/good")
    good = spark.read.parquet(f"{folder}/good")
    rows = good.collect()
    assert 0 < len(rows) < docs.count() and {r.doc_id for r in rows} >= {i for i in range(25)}
    unique = stages[1](spark, good, folder)
    normal = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    first = {}
    for r in rows:
        first.setdefault(normal(r.text), []).append(r.doc_id)
    assert unique.columns == columns
    unique.write.parquet(f"{folder}/unique")
    unique = spark.read.parquet(f"{folder}/unique")
    assert sorted(str(r.doc_id) for r in unique.collect()) == sorted(str(min((d for d in v if d is not None), default=None)) for v in first.values())
    single = stages[2](spark, unique, folder)
    assert single.columns == columns
    single.write.parquet(f"{folder}/single")
    single = spark.read.parquet(f"{folder}/single")
    assert single.count() == near_duplicates(unique).select("component").distinct().count()
    pieces = stages[3](spark, single, folder).collect()
    tokens = sum(len(library(default_path()).encode(r.text or "", add_special_tokens=False).ids) + 1 for r in single.collect())
    assert sum(p.length for p in pieces) == tokens
    whole = corpus_pipeline.run(spark, folder).collect()
    key = lambda ps: sorted((str(p.doc_id), p.piece, p.start, p.length, p.ids_crc32) for p in ps)
    assert key(whole) == key(pieces)


def test_stages_take_columns_of_any_name_and_type(spark, odd, folder):
    docs = odd.withColumns({"m": F.create_map(F.lit("a"), F.col("n_chars")), "a.b": F.lit(1), "_x": F.lit("u"), "_k": F.lit(2)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, folder)
        assert kept.dtypes == docs.dtypes, name
        assert 0 < kept.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_stages_take_empty_documents(spark, none, folder):
    docs = none.select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0


def test_planted_copies_and_near_copies_go_and_clean_rows_stay(spark):
    rng = np.random.default_rng(0)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(500)]
    prose = [" ".join(rng.choice(words, 600)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(prose)]
    rows += [(100 + i, t.replace(" ", "\n", 5)) for i, t in enumerate(prose[:10])]
    rows += [(200 + i, t + " " + words[0]) for i, t in enumerate(prose[:10])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    flags, kept = exact_dedup(docs)
    assert {r.key for r in flags.filter("NOT kept").collect()} == {100 + i for i in range(10)}
    left = corpus_pipeline.near_stage(spark, kept, "")
    assert {r.doc_id for r in left.collect()} == set(range(30))


def brute_components(texts, words=5, similarity=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(max(len(w) - words + 1, 1))})
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if label[i] != label[j] and len(a & sets[j]) / len(a | sets[j]) >= similarity:
                label = [label[j] if x == label[i] else x for x in label]
    return label


@pytest.mark.parametrize(("block", "paired"), [(512, 16), (5, 16), (5, 1)])
def test_near_stage_links_at_five_word_similarity(spark, monkeypatch, block, paired):
    monkeypatch.setattr(similar, "BLOCK", block)
    monkeypatch.setattr(similar, "PAIRED", paired)
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    texts = []
    for changes in (0, 1, 2, 3, 4, 5, 6, 8, 12):  # 200 words: each change costs about five shingles of 196
        for _ in range(4):
            own = list(rng.choice(words, 200))
            texts.append(" ".join(own))
            for at in rng.choice(200, changes, replace=False):
                own[at] = "changed"
            texts.append(" ".join(own).upper())
    hub = list(rng.choice(words, 60))
    texts += [" ".join(hub[:k] + [f"w{k}"] + hub[k:]) for k in range(20)] + ["", None, "one two", "one two three", "b"]
    label = brute_components(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    left = corpus_pipeline.near_stage(spark, docs, "")
    assert sorted(r.doc_id for r in left.collect()) == sorted({c: i for i, c in reversed(list(enumerate(label)))}.values())
    assert 12 < len(texts) - len(set(label)) < 50


def test_large_groups_give_the_links_of_all_pairs(spark, monkeypatch):
    """Two classes larger than a block, a chain and single texts in one group; and no pair of blocks of one class is compared."""
    monkeypatch.setattr(similar, "BLOCK", 8)
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    texts = []
    for _ in range(2):
        own = list(rng.choice(words, 120))
        texts += [" ".join([*own[:at], f"x{at}", *own[at + 1 :]]) for at in range(0, 120, 3)]
    chain = list(rng.choice(words, 100))
    for at in range(0, 60, 4):
        chain[at] = f"y{at}"
        texts.append(" ".join(chain))
    texts += [" ".join(rng.choice(words, 50)) for _ in range(20)]
    label = brute_components(texts)
    node = [(i + 1) * 0x9E3779B97F4A7C15 % (1 << 63) for i in range(len(texts))]
    rows = spark.createDataFrame([(1, -(-len(texts) // 8), f, t.encode()) for f, t in zip(node, texts, strict=True)], "root long, blocks long, fp long, text binary")
    dealt = []
    between = similar._between

    def kept(*a):
        dealt.append(between(*a))
        return dealt[-1]

    monkeypatch.setattr(similar, "_between", kept)
    found = similar.components(similar.large_groups(rows.select("root", "fp"), rows, 5, 0.8))
    roots = {r.node: r.root for r in found.collect()}
    pairs = {(roots.get(f, f), c) for f, c in zip(node, label, strict=True)}
    assert len(pairs) == len({r for r, _ in pairs}) == len(set(label))
    assert sum(label.count(c) > 8 for c in set(label)) >= 2
    pieces = dealt[0].select("one", "two").distinct().collect()
    assert pieces and not [p for p in pieces if p.one.unit == p.two.unit and not p.one.shared and not p.two.shared]


def test_a_common_key_sends_one_posting_a_batch(spark):
    bands = np.arange(40 * similar.BANDS, dtype=np.int64).reshape(40, -1) + 1000
    bands[:30, 3] = 7
    rows = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(bands)], "fp long, bands array<long>").coalesce(1)
    posted = rows.mapInArrow(similar._posted, "band long, fp long, up long")
    assert posted.filter("band = 7 AND up IS NULL").count() == 1 and posted.filter("up IS NOT NULL").count() == 29
    linked = similar.components(similar.proposed(rows.repartition(4)))
    assert {(r.node, r.root) for r in linked.collect()} == {(i, 0) for i in range(1, 30)}
