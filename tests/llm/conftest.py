import random

import pytest

#: Extra columns carry names that operators use inside.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, score double, row string, rep long, fp long, component long, count long, _r string, c0 string, piece int, final boolean, x string"


def odd_rows() -> list[tuple]:
    """Nulls everywhere, empty and blank texts, repeated rows, one id on two texts, copies, near copies, other scripts, one very long text."""
    rng = random.Random(7)
    words = [("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))) for _ in range(300)]
    prose = [" ".join(rng.choice(words) for _ in range(rng.randint(30, 200))) + ".\nNext line." for _ in range(25)]
    texts = [(i, t) for i, t in enumerate(prose)]
    texts += [(100 + i, prose[0].replace(" ", "  \t")) for i in range(12)]  # equal but for white space
    texts += [(200 + i, prose[1] + f" tail{i}") for i in range(6)]  # near copies
    texts += [(300, None), (301, ""), (302, " \n\t"), (303, " "), (304, "a"), (305, "A b C"), (None, prose[2]), (None, None), (None, "only here"), (None, "only here")]
    texts += [(306, "same id, first"), (306, "same id, second"), (307, "twice"), (307, "twice")]
    texts += [(308, "日本語のテキスト ÉCOLE Straße ǅ İ 😀 <|endoftext|> don't 'S ½²"), (309, "x\x1cy z w\x85v"), (310, "long " * 30_000 + "end"), (311, "q" * 50_000)]
    return [(d, t, None if n % 5 == 0 else "en", None if n % 7 == 0 else "hot", None if n % 3 == 0 else n, "k", 0.5, None, 1, 2, 3, 4, "r", "c", 5, True, "x") for n, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
