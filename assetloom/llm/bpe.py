"""BPE by backtracking: exact merges in linear time, and decoding by an offset table.

Encoding takes, at each place, the longest vocabulary entry that starts there (an Aho-Corasick
automaton finds them in one pass over a word) and keeps it only if the pair it forms with the
entry before is one that the merges would have left standing; else it tries the next shorter
entry, and goes back one entry where none is left.  Places from which no way leads on are marked,
so none is tried twice.  Pair compatibility doesn't depend on the text: the answers form a table,
filled as pairs turn up.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import each_text
from .wordcode import WordCoder, default_path, latin_words, library

#: Pairs whose compatibility a worker remembers.  Beyond, the table is filled anew: memory, not results, depends on this.
KEPT_PAIRS = 1_000_000


def byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies write for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}


class BacktrackingBPE:
    """Encoder and decoder of one word-end byte-level BPE file (merges in the order of ids).

    Inside, a word is a string of symbols: chr(byte), and chr(256 + byte) for its last byte.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        vocab, letter = model["vocab"], byte_letters()
        symbol = {c: chr(b) for b, c in letter.items()}
        ends = {c: chr(256 + b) for b, c in letter.items()}
        self.spelled = {i: self._symbols(t, symbol, ends) for t, i in vocab.items()}
        self.of = {s: i for i, s in self.spelled.items()}
        #: merge of a pair of ids -> id, and the pair an id was merged from
        self.merged: dict[tuple[int, int], int] = {}
        self.rank: dict[int, int] = {}
        self.pair: dict[int, tuple[int, int]] = {}
        for n, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.merged[x, y] = z
            self.pair[z], self.rank[z] = (x, y), n
        self.length = {i: len(s) for i, s in self.spelled.items()}
        self.shorter = {i: next((self.of[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.of), -1) for i, s in self.spelled.items()}
        self.automaton = ahocorasick.Automaton()
        for s, i in self.of.items():
            self.automaton.add_word(s, i)
        self.automaton.make_automaton()
        self.compatible: dict[tuple[int, int], bool] = {}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.normaliser, self.splitter = library(path).normalizer, library(path).pre_tokenizer
        self.byte_of = {c: b for b, c in letter.items()}
        names = {i: t for t, i in (vocab | self.special).items()}
        self.text_of = OffsetTable([names.get(i, "").encode() for i in range(max(names) + 1)])
        self.digits_of = OffsetTable([str(i).encode() for i in range(max(names) + 1)])

    def _symbols(self, token: str, symbol: dict[str, str], ends: dict[str, str]) -> str:
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return "".join([symbol[c] for c in body[:-1]]) + ends[body[-1]]
        return "".join([symbol[c] for c in token])

    def _stands(self, left: int, right: int) -> bool:
        """Whether the merges leave ``left`` and ``right`` side by side when they meet.

        Undoes the merges on both sides of the seam, latest first; the pair doesn't stand if at
        some point the two parts at the seam would have been merged before the parts were.
        """
        rank, pair, merged = self.rank, self.pair, self.merged
        late = len(rank) + 1
        own_left, own_right = rank.get(left, -1), rank.get(right, -1)
        while True:
            joined = merged.get((left, right))
            if joined is not None and rank[joined] < late:
                return False
            if own_left < 0 and own_right < 0:
                return True
            # Of equals the left merge comes first, so undo the right one first; while the right part
            # forms, a seam merge of its rank would have come before it, and not so for the left part.
            if own_left > own_right:
                late, left = own_left, pair[left][1]
                own_left = rank.get(left, -1)
            else:
                late, right = own_right + 1, pair[right][0]
                own_right = rank.get(right, -1)

    def word(self, word: str) -> list[int]:
        """Ids of one word, given in symbols."""
        n = len(word)
        whole = self.of.get(word)
        if whole is not None and (n == 1 or whole in self.pair):
            return [whole]
        longest = [-1] * n
        length = self.length
        for end, i in self.automaton.iter(word):
            at = end + 1 - length[i]
            if longest[at] < 0 or length[i] > length[longest[at]]:
                longest[at] = i
        shorter, compatible = self.shorter, self.compatible
        dead = bytearray(n + 1)
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            before = out[-1] if out else -1
            while token >= 0:
                end = at + length[token]
                if not dead[end]:
                    if before < 0:
                        break
                    ok = compatible.get((before, token))
                    if ok is None:
                        if len(compatible) >= KEPT_PAIRS:
                            compatible.clear()
                        ok = compatible[before, token] = self._stands(before, token)
                    if ok:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif before < 0:
                raise ValueError("the vocabulary doesn't spell this word")
            else:
                dead[at] = 1
                out.pop()
                at -= length[before]
                token = shorter[before]
        return out

    def code(self, pieces: list[str]) -> list[bytes]:
        """Ids of lower-case words or raw pieces without white space, as little-endian unsigned 32-bit bytes."""
        out = []
        for piece in pieces:
            words = latin_words(piece)
            out.append(b"".join([self._code(w.encode()) for w in words] if words else self._raw(piece)))
        return out

    def _raw(self, piece: str) -> Iterator[bytes]:
        """Ids of a piece that isn't Latin-1 or may hold special tokens.

        Normalised and split by the file's own normaliser and splitter, whose Unicode tables are older than Python's.
        """
        for i, run in enumerate(self.specials.split(piece) if self.specials else [piece]):
            if i % 2:
                yield self.special[run].to_bytes(4, "little")
            elif run:
                for word, _ in self.splitter.pre_tokenize_str(self.normaliser.normalize_str(run)):
                    yield self._code(bytes([self.byte_of[c] for c in word]))

    def _code(self, data: bytes) -> bytes:
        word = data[:-1].decode("latin-1") + chr(data[-1] + (256 if self.suffix else 0))
        return np.array(self.word(word), "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """The entries' own spellings with one space between, special tokens too."""
        return self.text_of.join(ids)


class OffsetTable:
    """Strings in one buffer, each with a space after it; ``join`` gathers by offsets, without a loop."""

    def __init__(self, strings: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join([s + b" " for s in strings]), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(s) + 1 for s in strings])]).astype(np.int64)
        self.lengths = np.diff(self.offsets)

    def join(self, ids: np.ndarray, block: int = 1 << 18) -> bytes:
        """The strings of ``ids`` with one space between."""
        out = []
        for at in range(0, len(ids), block):
            part = ids[at : at + block]
            n = self.lengths[part]
            ends = np.cumsum(n)
            out.append(self.data[np.arange(ends[-1]) + np.repeat(self.offsets[part] - (ends - n), n)].tobytes())
        return b"".join(out)[:-1]


@cache
def backtracking(path: str) -> tuple[BacktrackingBPE, WordCoder]:
    """A worker's encoder, shared by its tasks."""
    bpe = BacktrackingBPE(path)
    return bpe, WordCoder(bpe.code)


def encoded(text: Column, path: str | None = None) -> Column:
    """The ids (array of int) of each whole text as the tokenizers library gives them, without added special tokens.

    Null counts as empty.  Strings of special tokens in a text are special tokens, as for the library.
    """
    path = path or default_path()

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _, words = backtracking(path)
        for a in batches:
            yield _lists(list(words.encode(each_text([a]))))

    return of(text)


def decoded(ids: Column, path: str | None = None) -> Column:
    """The text of an array of ids as the library's ``decode(ids, skip_special_tokens=False)``; null ids give the empty text."""
    path = path or default_path()

    @F.arrow_udf(T.StringType())
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe, _ = backtracking(path)
        for a in batches:
            yield pa.array([bpe.decode(np.asarray(x, np.int64)).decode() if x else "" for x in a.to_pylist()], pa.string())

    return of(ids)


def _lists(coded: list[bytes]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(coded), "<i4")))


def digests(text: Column, path: str | None = None) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a round trip of each whole text; null counts as empty."""
    path = path or default_path()
    kind = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    @F.arrow_udf(kind)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe, words = backtracking(path)
        for a in batches:
            n, of_ids, of_text = [], [], []
            for coded in words.encode(each_text([a])):
                ids = np.frombuffer(coded, "<u4").astype(np.int64)
                n.append(len(ids))
                of_ids.append(hashlib.sha256(bpe.digits_of.join(ids)).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["n_tokens", "ids_sha256", "decoded_sha256"])

    return of(text)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded again, as digests."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")


QUERIES = {"op7_bpe": op7_bpe}

ORACLE_SQL: dict[str, str] = {}
