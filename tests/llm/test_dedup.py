import hashlib
import itertools
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from assetloom.llm.components import Forest, components
from assetloom.llm.exact_dedup import exact_dedup, grace
from assetloom.llm.simhash import _span, covering, keep_one, linked, links, masks, narrower, near_duplicates, simhash
from assetloom.llm.shared import squeeze
from assetloom.llm.similar import keep_dissimilar


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_squeeze_is_the_contracts_replacement():
    for t in ("", " ", "\t\n", " a  b\x0b\x0c c ", "a", "é  x", "\x1ca \x1c"):
        assert squeeze(t.encode()).decode() == normal(t)


def check_flags(rows, flags):
    groups = defaultdict(list)
    for d, t in rows:
        groups[normal(t)].append(d)
    want = sorted((str(d), str(min((x for x in groups[normal(t)] if x is not None), default=None)), len(groups[normal(t)]), hashlib.sha256(normal(t).encode()).hexdigest()) for d, t in rows)
    got = sorted((str(r.key), str(r.keep_id), r.group_size, r.text_sha256) for r in flags)
    assert got == want
    kept = defaultdict(int)
    for r in flags:
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.key == r.keep_id
    assert set(kept.values()) == {1} if rows else not kept


def test_exact_dedup_on_odd_rows(odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for budget in (64 << 20, 3_000):  # in memory, and spilling again and again
        flags, kept = exact_dedup(odd, budget_bytes=budget)
        check_flags(rows, flags.collect())
        assert kept.columns == odd.columns and kept.schema == odd.schema
        assert sorted(normal(r.text) for r in kept.collect()) == sorted({normal(t) for _, t in rows})


def test_exact_dedup_of_nothing(none):
    flags, kept = exact_dedup(none)
    assert flags.count() == 0 and kept.count() == 0 and kept.columns == none.columns


def test_grace_compares_contents_not_hashes():
    # Every record has the same hash, and the budget is far too small: content alone decides, and recursion ends.
    records = [(42, f"content {i % 50}".encode(), 1) for i in range(500)]
    found = list(grace(iter(records), lambda a, b: a + b, budget=1_000))
    assert sorted(e[1] for e in found) == sorted({c for _, c, _ in records}) and {e[2] for e in found} == {10}


def test_grace_with_one_endless_content_stays_in_memory():
    found = list(grace(iter([(7, b"x" * 10_000, 1)] * 300), lambda a, b: a + b, budget=1_000))
    assert len(found) == 1 and found[0][2] == 300


def brute_classes(prints, bits):
    f = np.array(prints, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None, :]) <= bits
    label = list(range(len(f)))
    for _ in range(len(f)):
        new = [min(label[j] for j in np.flatnonzero(near[i])) for i in range(len(f))]
        if new == label:
            break
        label = new
    return label


def test_near_duplicates_on_odd_rows(odd):
    found = near_duplicates(odd).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted((str(d), simhash((t or "").encode())) for d, t in rows) == sorted((str(r.key), r.fp & (1 << 64) - 1) for r in found)
    prints = [r.fp & (1 << 64) - 1 for r in found]
    label = brute_classes(prints, 4)
    ids = defaultdict(list)
    for r, c in zip(found, label, strict=True):
        ids[c].append(r.key)
    for r, c in zip(found, label, strict=True):
        assert r.component_id == min((x for x in ids[c] if x is not None), default=None)


def test_simhash_is_the_majority_of_spark_hashes(spark):
    text = "The QUICK brown\tfox  jumps over the lazy dog the quick brown fox É"
    words = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)]
    hashes = [r[0] for r in spark.createDataFrame([(s,) for s in shingles], "s string").select(F.xxhash64("s")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash(text.encode()) == want
    assert simhash(b"") == simhash(b" \n") == 0 and simhash(b"One two") == simhash(b"one\ttwo")


def test_links_lose_none_within_the_distance(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = set(base.tolist())
    for b in base.tolist():
        for k in (1, 3, 4, 5):
            flips = rng.choice(64, k, replace=False)
            prints.add(b ^ int(sum(1 << int(i) for i in flips)))
    prints = sorted(prints)
    assert_same_classes(classes_of(spark, prints), brute_classes(prints, 4))


def classes_of(spark, prints, bits=4, **sizes):
    """The component of each of unsigned fingerprints, by the index."""
    signed = [int(p) - (1 << 64) if int(p) >> 63 else int(p) for p in prints]
    edges = links(spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3), bits, **sizes)
    root = {r.node: r.root for r in components(edges).collect()}
    return [root.get(s, s) for s in signed]


def assert_same_classes(got, want):
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_every_choice_of_places_holds_one_of_the_index():
    for n, m in ((8, 4), (8, 3), (8, 5), (10, 5), (6, 2)):
        chosen = covering(n, m)
        assert all(any(set(c) <= set(p) for c in chosen) for p in itertools.combinations(range(n), m))
    assert len(covering(8, 4)) == 20 == len(masks(4))


@pytest.mark.parametrize("bits", [1, 3, 4, 5, 6, 7])
def test_pairs_within_the_distance_meet_at_every_level(bits):
    rng = np.random.default_rng(bits)
    for _ in range(150):
        a = int(rng.integers(0, 1 << 63))
        b = a ^ sum(1 << int(i) for i in rng.choice(64, bits, replace=False))
        meeting = [m for m in masks(bits) if a & m == b & m]
        assert meeting
        for m in meeting:
            while below := narrower(m, bits):
                agreeing = [x for x in below if a & x == b & x]
                assert agreeing and all(x & m == m for x in below)
                m = agreeing[int(rng.integers(len(agreeing)))]
            assert m.bit_count() >= 48 or bits != 4


def test_tallies_count_bytes_in_place():
    rng = np.random.default_rng(2)
    a, b = rng.integers(0, 1 << 63, 4000, dtype=np.uint64), rng.integers(0, 1 << 63, 4000, dtype=np.uint64)
    b[:2000] = a[:2000]
    for i in range(2000):
        for at in rng.choice(64, i % 8, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(at)
    assert linked(a, b, 4).tolist() == [(int(x) ^ int(y)).bit_count() <= 4 for x, y in zip(a, b, strict=True)]


@pytest.mark.parametrize("posting", [3, 20, 8_192])
def test_postings_that_are_dealt_again_lose_no_link(spark, posting):
    rng = np.random.default_rng(11)
    prints = {int(x) for x in rng.integers(0, 1 << 63, 60, dtype=np.uint64)}
    for base in list(prints)[:4]:  # crowds around four fingerprints, whole bytes in common
        for _ in range(60):
            prints.add(base ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 9), replace=False)))
        for _ in range(60):
            prints.add(base ^ int(rng.integers(0, 1 << 20)) << 12)
    prints = sorted(prints)
    assert_same_classes(classes_of(spark, prints, posting=posting), brute_classes(prints, 4))


def test_a_posting_of_fifty_thousand_fingerprints(spark):
    rng = np.random.default_rng(12)
    base = 0x1234567890ABCDEF
    # All share three bytes, and the first twenty thousand four; the others are 40 random bits apart.
    low = rng.choice(1 << 32, 20_000, replace=False)
    crowd = {base & ~0xFFFFFFFF | int(x) for x in low} | {base & 0xFFFFFF | int(x) << 24 for x in rng.integers(0, 1 << 40, 30_000)}
    prints = np.array(sorted(crowd), np.uint64)
    assert len(prints) > 49_990
    forest = Forest()
    for i in range(len(prints) - 1):  # brute force
        for j in np.flatnonzero(np.bitwise_count(prints[i + 1 :] ^ prints[i]) <= 4):
            forest.link(int(prints[i].view(np.int64)), int(prints[i + 1 + j].view(np.int64)))
    want = [forest.find(int(p.view(np.int64))) for p in prints]
    assert 10 < len(set(want)) < len(prints) - 100
    assert_same_classes(classes_of(spark, prints), want)


def test_span_finds_each_component_of_a_posting():
    prints = np.array([0b0, 0b1111, 0b11111111, (1 << 40) - 1, 1 << 63], np.uint64)
    forest = Forest()
    _span(prints, 4, forest)
    assert forest.find(0) == forest.find(0b11111111) != forest.find((1 << 40) - 1)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(1, 120)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 5000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert all(found[i] == 1 for i in range(2, 121)) and all(found[1000 + i] == 1000 for i in range(1, 200)) and 5000 not in found
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_keep_one_keeps_a_row_of_each_class(odd, none):
    found = near_duplicates(odd).collect()
    kept = keep_one(odd)
    rows = kept.collect()
    assert kept.columns == odd.columns and len(rows) == len({r.component for r in found})
    first = {}
    for r in found:
        first.setdefault(r.component, []).append(r.key)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(min((k for k in v if k is not None), default=None)) for v in first.values())
    assert keep_one(none).count() == 0 and near_duplicates(none).count() == 0


def test_rows_with_maps_and_repeated_rows(spark):
    rows = [(i, "a b c d e f g h", {"k": i % 2}, [{"x": "y"}]) for i in (3, 1, 1, 2)] + [(9, "other words that link with nothing else here", {}, [])] * 2 + [(None, None, None, None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, m map<string, int>, n array<map<string, string>>")
    assert near_duplicates(df).count() == 8
    for kept in (keep_one(df), keep_dissimilar(df)):
        assert kept.schema == df.schema and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "9", "None"]
