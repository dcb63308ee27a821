import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assetloom.llm import attribution
from assetloom.llm.bpe import BacktrackingBPE, OffsetTable, backtracking, decoded, digests, encoded
from assetloom.llm.packing import SumOfSquares, pack, pack_documents
from assetloom.llm.wordcode import WordCoder, default_path, library, library_coder, library_words


def ids(data):
    return np.frombuffer(data, "<u4").tolist()


def want(text):
    return library(default_path()).encode(text, add_special_tokens=False).ids


HARD = ["", " ", "a<|endoftext|>b", "<|ENDOFTEXT|><|startoftext|>", "İΣΑΣ ǅ K ſ ﬁ", "é É ́", "x\x1cy z", "don't 'S DON'T I'LL", "½²٣ｆ 12 3", "!!! ## _ $$$'s", "日本語 😀", "thinging" * 40, "퟿", "<|", "a b\x85c"]


def test_both_coders_give_the_librarys_ids():
    bpe, words = backtracking(default_path())
    for coder in (words, library_words(default_path())):
        assert [ids(c) for c in coder.encode(HARD)] == [want(t) for t in HARD]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_backtracking_is_exact_on_any_text(text):
    bpe, words = backtracking(default_path())
    got = np.array(ids(next(iter(words.encode([text])))), np.int64)
    assert got.tolist() == want(text)
    assert bpe.decode(got).decode() == library(default_path()).decode(got.tolist(), skip_special_tokens=False)


def test_backtracking_is_exact_on_random_letters():
    rng, (bpe, words) = random.Random(1), backtracking(default_path())
    texts = [" ".join("".join(rng.choice("aehinorst") for _ in range(rng.randint(1, 30))) for _ in range(20)) for _ in range(300)]
    assert [ids(c) for c in words.encode(texts)] == [want(t) for t in texts]


def test_forgetting_words_changes_nothing(monkeypatch):
    import assetloom.llm.wordcode as module

    monkeypatch.setattr(module, "KEPT_WORDS", 5)
    monkeypatch.setattr(module, "KEPT_LENGTH", 3)
    monkeypatch.setattr(module, "TOGETHER", 10)
    coder = WordCoder(library_coder(default_path()))
    assert [ids(c) for c in coder.encode(HARD * 2)] == [want(t) for t in HARD * 2]


def test_offset_table_joins_like_python():
    strings = [b"a", b"", b"bcd", b"\xc3\xa9"]
    table = OffsetTable(strings)
    picked = [0, 2, 2, 1, 3, 0]
    assert table.join(np.array(picked), block=2) == b" ".join(strings[i] for i in picked)
    assert table.join(np.array([], np.int64)) == b""


def test_encode_and_decode_columns(odd, none):
    rows = odd.select("text", encoded(F.col("text")).alias("i"), decoded(encoded(F.col("text"))).alias("d"), digests(F.col("text")).alias("h")).collect()
    t = library(default_path())
    import hashlib

    for r in rows:
        expected = want(r.text or "")
        back = t.decode(expected, skip_special_tokens=False)
        assert r.i == expected and r.d == back
        assert (r.h.n_tokens, r.h.ids_sha256, r.h.decoded_sha256) == (len(expected), hashlib.sha256(" ".join(map(str, expected)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
    assert none.select(digests(F.col("text"))).count() == 0


def check_packing(rows, pieces, capacity):
    texts = defaultdict(list)
    for d, t in rows:
        texts[d].append(np.array([*want(t or ""), 0], "<u4"))
    expected = sorted((str(d), p, s, len(x[s : s + capacity]), zlib.crc32(x[s : s + capacity].tobytes())) for d, group in texts.items() for x in group for p, s in enumerate(range(0, len(x), capacity)))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in pieces) == expected
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r.length for r in pieces)
    return len(sequences), -(-total // capacity)


def test_packing_is_whole_and_tight(odd, none):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    for capacity, pool in ((2048, 16_000), (64, 20)):
        made, least = check_packing(rows, pack_documents(odd, capacity=capacity, pool=pool).collect(), capacity)
        assert made <= least * 1.05 + 3
    assert pack_documents(none).count() == 0


def test_keys_of_any_type_are_packed(spark):
    df = spark.createDataFrame([("", "one two"), (None, "three"), ("a", None), ("", ""), ("b", "four " * 3000)], "doc_id string, text string")
    pieces = pack_documents(df, slack=-1).collect()
    assert sorted(str(p.doc_id) for p in pieces if p.piece == 0) == ["", "", "None", "a", "b"]


def test_remembered_pairs_are_bounded(monkeypatch):
    import assetloom.llm.bpe as module

    own = BacktrackingBPE(default_path())
    words = [b"packing", b"tokenizers", b"unbelievable", b"xxyyzz"]
    before = own.code([w.decode() for w in words])
    monkeypatch.setattr(module, "KEPT_PAIRS", 2)
    own.compatible.clear()
    assert own.code([w.decode() for w in words]) == before and len(own.compatible) <= 2


def test_sum_of_squares_places_where_the_sum_is_smallest():
    rng, capacity = random.Random(5), 12
    rule, gaps = SumOfSquares(capacity), {}
    for _ in range(400):
        length = rng.randint(1, capacity)

        def total(change):
            count = defaultdict(int)
            for g in {**gaps, **change}.values():
                count[g] += g > 0
            return sum(n * n for n in count.values())

        ways = [total({s: g - length}) for s, g in gaps.items() if g >= length] + [total({-1: capacity - length})]
        sequence, offset = rule.place(length)
        before = gaps.get(sequence, capacity)
        assert offset == capacity - before and before >= length
        got = total({sequence: before - length})
        gaps[sequence] = before - length
        assert got == min(ways)


def test_packing_comes_close_to_the_bound():
    rng = np.random.default_rng(0)
    lengths = np.clip(rng.lognormal(5.5, 1.0, 4000).astype(int), 1, 2048).tolist()
    _, _, gaps = pack(lengths, 2048)
    assert len(gaps) <= -(-sum(lengths) // 2048) * 1.02 and gaps.min() >= 0


def brute_sections(text, rule):
    encoding, one_word, _ = attribution.encoder(attribution.default_path())
    data = text.encode()
    tokens = [encoding.decode_single_token_bytes(i) for i in attribution.encode(encoding, one_word, text)]
    assert b"".join(tokens) == data
    lines = data.split(b"\n")
    lines = [x + b"\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
    owner = [i for i, x in enumerate(lines) for _ in x]
    n, crossing, at = [0] * len(lines), [0] * len(lines), 0
    for t in tokens:
        held = owner[at : at + len(t)]
        home = held[0] if rule == "start" else max(sorted(set(held)), key=lambda s: (held.count(s), -s))
        n[home] += 1
        crossing[home] += len(set(held)) > 1
        at += len(t)
    return n, crossing


@pytest.mark.parametrize("rule", ["start", "most"])
def test_section_tokens_match_brute_force(spark, rule):
    texts = ["", "one", "a\n\nb\n", "\n\n\n", "x \n  \n y", "é\n日本\n", "end\n", "a  \n\n\n  b c\r\n\td"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    for r in df.select("t", attribution.section_tokens(F.col("t"), rule).alias("s")).collect():
        n, crossing = brute_sections(r.t, rule)
        assert [x.n_tokens for x in r.s] == n and [x.n_crossing for x in r.s] == crossing
        assert [x.section for x in r.s] == list(range(len(n))) and r.s[-1].end_byte == len(r.t.encode())


def test_long_blank_runs_are_coded_as_the_pattern_would():
    encoding, one_word, _ = attribution.encoder(attribution.default_path())
    for run in (2_500, 4_000):
        for text in ("a" + " " * run + "b", "\n" * run, " " * run + "\nx", "a" + "\t" * run, "a" + " " * run + "b" + "\n" * run + " c"):
            assert attribution.encode(encoding, one_word, text) == encoding.encode_ordinary(text)


def test_sections_of_odd_rows_add_up(odd, none):
    encoding, one_word, _ = attribution.encoder(attribution.default_path())
    for r in odd.select("text", attribution.section_tokens(F.col("text")).alias("s")).collect():
        assert sum(x.n_tokens for x in r.s) == len(attribution.encode(encoding, one_word, r.text or ""))
    assert none.select(attribution.section_tokens(F.col("text"))).count() == 0
