"""Texts to token ids through their words.

The tokenizer file's normaliser never looks across white space, and its splitter cuts a text into
words that are coded each on its own; so a text's ids are those of its words put together.  Words
repeat, so their ids are kept, as little-endian unsigned 32-bit bytes: the ids of a text are then
one join.  Texts of Latin-1 characters, which normalising only lower-cases, are cut here; of
others, the pieces between white space go to the tokenizer as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import numpy as np

#: The white space of the tokenizer's splitter (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_SPLIT = re.compile(f"[^{SPACE}]+")
#: Characters that str.split() splits at, though they are no white space here.
_EXTRA = "\x1c\x1d\x1e\x1f"
#: Words kept at most, and the longest kept.  Beyond, they are coded anew: memory, not results, depends on these.
KEPT_WORDS, KEPT_LENGTH = 800_000, 200
#: Characters of text that are coded together.
TOGETHER = 1_000_000
#: The file's pattern for lower-case Latin-1 text.
_LETTERS, _NUMBERS, _BLANKS = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", r"\t-\r \x85\xa0"
_WORDS = re.compile(f"[{_LETTERS}]+|'(?:[stmd]|re|ve|ll)|[{_NUMBERS}]|[^{_LETTERS}{_NUMBERS}{_BLANKS}]+")


def latin_words(text: str) -> list[str] | None:
    """The words of a text of Latin-1 characters; None for others and for what may hold a special token ("<|")."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return None
    return None if "<|" in text else _WORDS.findall(text.lower())


def words_of(text: str) -> list[str]:
    """The words of any text: lower-case, or as they stand where they aren't Latin-1."""
    words = latin_words(text)
    if words is None:
        pieces = text.split() if not any(c in text for c in _EXTRA) else _SPLIT.findall(text)
        words = [w for p in pieces for w in (latin_words(p) or [p])]
    return words


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@cache
def library(path: str):
    """The tokenizers library's own object, without truncation and padding."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def library_coder(path: str) -> Callable[[list[str]], list[bytes]]:
    """Codes words or raw pieces by the library, in few calls.

    Words of Latin-1 are one word to the library too, so many go as one text, and each ends with
    its first token that carries the end-of-word mark.  Other pieces are told apart by the library.
    """
    tokenizer = library(path)
    mark = tokenizer.model.end_of_word_suffix
    ends = np.array([bool(mark) and (tokenizer.id_to_token(i) or "").endswith(mark) for i in range(tokenizer.get_vocab_size())])

    def cut(ids: np.ndarray, at: list[int]) -> list[bytes]:
        return [ids[s:t].tobytes() for s, t in zip(at, at[1:], strict=False)]

    def apart(pieces: list[str]) -> list[bytes]:
        e = tokenizer.encode(pieces, is_pretokenized=True, add_special_tokens=False)
        ids, words = np.array(e.ids, "<u4"), np.array(e.word_ids, np.int64)
        return cut(ids, np.searchsorted(words, np.arange(len(pieces) + 1)).tolist())

    def together(words: list[str]) -> list[bytes]:
        texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
        ids = np.array([i for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False) for i in e.ids], "<u4")
        at = [0, *(np.flatnonzero(ends[ids]) + 1).tolist()]
        return cut(ids, at) if len(at) == len(words) + 1 else apart(words)

    def code(pieces: list[str]) -> list[bytes]:
        plain = [latin_words(p) == [p] for p in pieces] if mark else [False] * len(pieces)
        first = iter(together([p for p, x in zip(pieces, plain, strict=True) if x]))
        other = iter(apart([p for p, x in zip(pieces, plain, strict=True) if not x]))
        return [next(first if x else other) for x in plain]

    return code


class WordCoder:
    """``code`` maps lower-case words, or raw pieces that aren't Latin-1, to their ids' bytes."""

    def __init__(self, code: Callable[[list[str]], list[bytes]]) -> None:
        self.code, self.kept = code, {}

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each whole text, as little-endian unsigned 32-bit bytes."""
        held, size = [], 0
        for t in texts:
            held.append(words_of(t))
            size += len(t)
            if size > TOGETHER:
                yield from self._coded(held)
                held, size = [], 0
        yield from self._coded(held)

    def _coded(self, held: list[list[str]]) -> list[bytes]:
        kept = self.kept
        new = list({w for group in held for w in group if w not in kept})
        kept.update(zip(new, self.code(new), strict=True))
        of = kept.__getitem__
        out = [b"".join(map(of, group)) for group in held]
        if len(kept) > KEPT_WORDS:
            kept.clear()
        elif max(map(len, new), default=0) > KEPT_LENGTH:
            for w in new:
                if len(w) > KEPT_LENGTH:
                    del kept[w]
        return out


@cache
def library_words(path: str) -> WordCoder:
    """A worker's coder, shared by its tasks."""
    return WordCoder(library_coder(path))
