"""Packing against the rules: every id once, no gaps, little padding."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from strata.llm import bytebpe, packing
from tests.llm.conftest import ODD_TEXTS, prose

JSON = public_tokenizers.path("byte_bpe_50k.json")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=40), st.integers(1, 12))
def test_differencing_partitions(lengths, windows):
    out = packing.difference(lengths, windows)
    assert sorted(i for _, m in out for i in m) == list(range(len(lengths)))
    assert all(s == sum(lengths[i] for i in m) for s, m in out) and len(out) <= windows
    fitted = packing.windows_of(lengths, 64)
    assert all(s <= 64 for s, _ in fitted) and sorted(i for _, m in fitted for i in m) == list(range(len(lengths)))


def test_differencing_evens_out():
    assert sorted(s for s, _ in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]  # the textbook case
    assert [s for s, _ in packing.difference([4, 4, 2, 2], 2)] == [6, 6]
    assert len(packing.windows_of([40, 40, 40], 64)) == 3  # 2 would do by the sum, not by any split


def pieces(df):
    return [r.asDict() for r in df.collect()]


def test_every_id_once_and_gapless(documents, rng):
    texts = [*ODD_TEXTS, *(prose(rng, rng.randrange(1, 700)) for _ in range(150)), prose(rng, 4000)]
    got = pieces(packing.pack_documents(documents(texts), JSON, group=64))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in got:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    for i, raw in enumerate(bytebpe.codec(JSON).encode([t or "" for t in texts])):
        want = [*np.frombuffer(raw, "<u4").tolist(), 0]
        mine = sorted(by_doc[i], key=lambda p: p["start"])
        assert [x for p in mine for x in np.frombuffer(bytes(p["ids"]), "<u4").tolist()] == want
        assert all(p["doc_tokens"] == len(want) and p["length"] * 4 == len(p["ids"]) for p in mine)
        at = 0
        for p in mine:
            assert p["start"] == at
            at += p["length"]
    for mine in by_sequence.values():
        at = 0
        for p in sorted(mine, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 1024
    used = sum(p["length"] for p in got)
    assert used / (1024 * len(by_sequence)) > 0.85  # a task's last group is small here


def test_query_digest_and_edges(spark, documents):
    from pyspark.sql import functions as F

    got = packing.pack_documents(documents([None, "a b"], [5, 5]), JSON).withColumn("crc", F.crc32("ids")).collect()
    assert sorted((r.length, r.crc) for r in got)[0] == (1, zlib.crc32(b"\0\0\0\0"))
    assert packing.pack_documents(documents([]).where("false"), JSON).count() == 0
    assert packing.pack_documents(documents(["x"], [None]), JSON).first().doc_id is None


def test_padding_of_many_documents(documents, rng):
    got = pieces(packing.pack_documents(documents([prose(rng, rng.randrange(1, 300)) for _ in range(1200)]).coalesce(1), JSON))
    assert sum(p["length"] for p in got) / (1024 * len({p["sequence_id"] for p in got})) > 0.97
