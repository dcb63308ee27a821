"""Token counts by section: encode once, map tokens to spans, join spans with sections.

A whole document is encoded once.  Byte-level tokens spell the text, so their lengths add up to
spans of it; the spans are joined with the sections' intervals by position, and a token that
crosses a boundary goes where the rule says: ``start`` to the section of its first byte, ``most``
to the one that holds most of its bytes (the earlier of equals).  Every token is counted in just
one section, so the sections' counts add up to the document's.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import texts

#: The library's splitter recurses on white space, so longer runs of it are coded as the one word they are.
LONG_BLANK = 2_000
#: Unicode White_Space, what the splitter's pattern takes for white space.
_BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RUN = re.compile(f"[{_BLANK}]{{{LONG_BLANK},}}")

SECTION = T.StructType([T.StructField(n, t) for n, t in (("section", T.IntegerType()), ("start_byte", T.LongType()), ("end_byte", T.LongType()), ("n_tokens", T.LongType()), ("n_crossing", T.LongType()))])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@cache
def encoder(path: str):
    """(encoding, the same for text that is one word, byte length of each token) of a file of ranks."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    lengths[list(ranks.values())] = [len(t) for t in ranks]
    make = lambda name, pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return make("sections", public_tokenizers.PATTERN), make("one-word", "(?s).+"), lengths


def encode(encoding, one_word, text: str) -> list[int]:
    """Ids of the whole text.  one_word: codes a text as a single word.

    In a run of white space the pattern leaves the last character for what follows, and takes the
    rest as one word; at the end of the text it takes the whole run.
    """
    out, at = [], 0
    for run in _RUN.finditer(text):
        out += encoding.encode_ordinary(text[at : run.start()])
        at = run.end() if run.end() == len(text) else run.end() - 1
        out += one_word.encode_ordinary(text[run.start() : at])
    return out + encoding.encode_ordinary(text[at:])


def lines(text: bytes) -> np.ndarray:
    """Ends of the sections of a text that are its lines, each with its line feed; an empty text is one section."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    return ends if len(ends) and ends[-1] == len(text) else np.append(ends, len(text))


def attribute(spans: np.ndarray, ends: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, crossing tokens) of each section.  spans: the tokens' end bytes; ends: the sections'.

    A crossing token counts as such in the section it goes to.
    """
    starts = np.concatenate([[0], spans[:-1]])
    first = np.searchsorted(ends, starts, "right")
    last = np.searchsorted(ends, spans - 1, "right")
    crossing = np.flatnonzero(first != last)
    home = first.copy()
    if rule == "most":
        begins = np.concatenate([[0], ends[:-1]])
        for i in crossing.tolist():
            held = range(int(first[i]), int(last[i]) + 1)
            home[i] = max(held, key=lambda s, i=i: (min(ends[s], spans[i]) - max(begins[s], starts[i]), -s))
    elif rule != "start":
        raise ValueError("rule must be 'start' or 'most'")
    n = len(ends)
    return np.bincount(home, minlength=n), np.bincount(home[crossing], minlength=n)


def section_tokens(text: Column, rule: str = "most", path: str | None = None) -> Column:
    """Array of structs (section, start_byte, end_byte, n_tokens, n_crossing), one for each line of the whole text.

    Null counts as empty: one section without tokens.  Bytes that aren't UTF-8 count as U+FFFD.  A very
    long text is held whole by its task, with its spans; nothing of it is left out.
    """
    path = path or default_path()

    @F.arrow_udf(T.ArrayType(SECTION))
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoding, one_word, lengths = encoder(path)
        for a in batches:
            offsets, columns = [0], [[] for _ in range(5)]
            for text in texts(a):
                ends = lines(text.encode())
                n, crossing = attribute(np.cumsum(lengths[encode(encoding, one_word, text)]), ends, rule) if text else (np.zeros(1, np.int64),) * 2
                for c, x in zip(columns, (np.arange(len(ends)), np.concatenate([[0], ends[:-1]]), ends, n, crossing), strict=True):
                    c.append(x)
                offsets.append(offsets[-1] + len(ends))
            flat = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
            rows = pa.StructArray.from_arrays([pa.array(flat[0].astype(np.int32)), *[pa.array(x.astype(np.int64)) for x in flat[1:]]], [f.name for f in SECTION])
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rows)

    return of(text)


def op4_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every line of every ``documents`` text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.inline(section_tokens(F.col("text"))))


QUERIES = {"op4_section_tokens": op4_section_tokens}

ORACLE_SQL: dict[str, str] = {}
