"""MinHash near-duplicates against all pairs."""

import re

import numpy as np
import pytest

from strata.llm import minhash, queries
from tests.llm.conftest import ODD_TEXTS, prose


def set_of(text, n=2):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()


def expected(rows, percent=80):
    sets = {i: set_of(t) for i, t in rows}
    root = {i: i for i in sets}

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            x, y = sets[i], sets[j]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((of(i), of(j)))
                root[b] = a
    return {i: (len(sets[i]), of(i)) for i in ids}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def edited(rng, text, share):
    words = text.split(" ")
    for _ in range(max(1, int(share * len(words)))):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def test_against_all_pairs(spark, documents, rng):
    texts = [*ODD_TEXTS]
    for _ in range(25):
        base = prose(rng, rng.choice([1, 2, 3, 5, 6, 12, 40, 200]))
        texts += [base, *(edited(rng, base, rng.choice([0.01, 0.04, 0.05, 0.06, 0.1])) for _ in range(rng.randrange(6))), base.upper(), f"{base} and more of it", f"x {base}"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert result(minhash.similar_sets(documents(texts))) == expected(rows)
    assert result(minhash.similar_sets(documents(texts), block=2)) == expected(rows)


def test_a_hot_group_of_near_copies_in_a_chain(spark, documents, rng):
    """Texts drift: neighbours link, the ends don't, so centres don't reach all."""
    words = prose(rng, 60).split(" ")
    texts = []
    for k in range(150):
        words[rng.randrange(60)] = f"w{k}"
        texts.append(" ".join(words))
    texts += ["same thing over and over"] * 1500 + [""] * 500
    rows = list(enumerate(texts))
    small = dict(rows[:151])
    got = result(minhash.similar_sets(documents(texts), block=16))
    want = expected(list(small.items()))
    assert {i: got[i] for i in range(150)} == {i: want[i] for i in range(150)}
    assert {got[i] for i in range(150, 1650)} == {(4, 150)} and all(got[i] == (0, i) for i in range(1650, 2150))


def test_edges(spark, documents):
    assert result(minhash.similar_sets(documents([]))) == {}
    rows = minhash.similar_sets(documents(["a b c d e", "a b c d e", "a b c d e", "z", None], ids=[None, 5, 5, 9, 1])).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles, r.component_id) for r in rows) == [(False, 0, 4, None), (True, 1, 0, 1), (True, 5, 4, 5), (True, 5, 4, 5), (True, 9, 1, 9)]
    odd = spark.sql("select 1L doc_id, cast(x'4F6BFF2E' as string) text union all select 2L, 'fine'")
    assert result(minhash.similar_sets(odd)) == {1: (1, 1), 2: (1, 2)}
    long = "word " * 400_000
    assert result(minhash.similar_sets(documents([long, long + "end"], ids=[3, 4]))) == {3: (1, 3), 4: (2, 4)}


def test_half_bands_meet_as_stated():
    """Of sets at a similarity of 0.8 nearly all share two half bands."""
    masks, factors = minhash.constants(32)
    r = np.random.default_rng(1)
    met, equal = 0, 0.0
    for _ in range(1500):
        own = r.integers(0, 1 << 64, 450, np.uint64)
        x, y = (minhash.signature(own[s], masks, factors) for s in (slice(0, 425), slice(25 + 25, 450)))  # 375 of 450 shared
        equal += (x == y).mean()
        met += (minhash.half_bands(x, 2) == minhash.half_bands(y, 2)).sum() >= 2
    assert abs(equal / 1500 - 375 / 450) < 0.01 and met == 1500


@pytest.mark.parametrize("share", [0.3, 0.8])
def test_parities_never_leave_out_a_link(share):
    r = np.random.default_rng(2)
    for n in (1, 7, 60, 3000):
        own = r.integers(0, 1 << 64, n, np.uint64)
        other = np.concatenate([own[: int(n * share)], r.integers(0, 1 << 64, n - int(n * share), np.uint64)])
        apart = len(set(own.tolist()) ^ set(other.tolist()))
        assert np.bitwise_count(minhash.parity(own) ^ minhash.parity(other)).sum() <= apart


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    found = queries.queries()["op12_minhash"](spark, sf)
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert result(found) == expected(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found.collect())
