import random

import pytest

WORDS = "the quick brown fox jumps over a lazy dog while many small birds sing in tall green trees near calm water and old stone walls".split()


@pytest.fixture(scope="session")
def documents(spark):
    """A frame of documents from texts; further columns clash with names that operators use."""

    def make(texts, ids=None, **more):
        rows = [(i, t, "en", "src0", len(t or ""), "x", -1, 0.5) for i, t in zip(ids or range(len(texts)), texts, strict=True)]
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string, rank int, score double")

    return make


@pytest.fixture()
def rng():
    return random.Random(7)


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


ODD_TEXTS = [None, "", " ", "\n\n", "a", "a" * 50_000, "Ünï¢ødé 中文 😀 \u00a0\u2003 x", "same", "same", "'s 't're don't I'LL we'll  '''ve", "x\x00y\r\n\t z", "The end.  "]
