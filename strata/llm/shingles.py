"""Words, shingles and digests of texts, as the near-duplicate operators use them.

Words are stretches of bytes other than blanks, with A to Z lower-cased. Defined
results: null and empty texts have no words; fewer words than a shingle has are one
shingle; text that isn't UTF-8 has its wrong bytes replaced (:func:`strata.llm.bytebpe.text_of`).
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes.maketrans(bytes(range(0x41, 0x5B)), bytes(range(0x61, 0x7B)))


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """A 64-bit hash of each shingle of ``n`` words in order (fewer words: the whole sequence): the words' hashes, folded."""
    from xxhash import xxh64_intdigest

    hashes = np.array(list(map(xxh64_intdigest, words)), np.uint64)
    width = min(n, len(words))
    if not width:
        return hashes
    count = len(words) - width + 1
    out = np.full(count, width, np.uint64)
    for k in range(width):
        out = (out ^ hashes[k : k + count]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def shingle_set(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct shingles."""
    return np.unique(shingles(words, n))


def words_of(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


def class_of(words: list[bytes]) -> bytes:
    """Digest of a text's words in their order."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(words))


def row_digest(text_col: str = "text") -> Column:
    """Digest of a text as it stands: with its id it names a row."""
    return F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
