"""Periodic runs against trying all periods at all places."""

import hashlib
import re
import zlib

import numpy as np

from strata.llm import periods, queries
from tests.llm.conftest import ODD_TEXTS, prose


def plain_runs(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j - i + p >= max(least, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted(((s, n, p) for (s, n), p in out.items()), key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(w)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, length, p in runs for i in range(s + p, s + length)}
    s, length, p = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    lines, kept = "".join(f"{s},{n},{p}\n" for s, n, p in runs), " ".join(x for i, x in enumerate(w) if i not in gone)
    return len(runs), s, length, p, None if s is None else 1000 * length // p, sha(lines), sha(kept)


def repetitive(rng):
    return " ".join(part for _ in range(rng.randrange(1, 5)) for part in [prose(rng, rng.randrange(30)), " ".join([prose(rng, rng.randrange(1, 9))] * rng.randrange(1, 20))])


def test_runs_of_random_words_against_all_periods(rng):
    for _ in range(150):
        docs = [np.array([rng.randrange(k) for _ in range(rng.randrange(90))], np.int64) for k in rng.choices([1, 2, 3, 9], k=4)]
        for least in (4, 12):
            for d, found in zip(docs, periods.runs_of(docs, least), strict=True):
                assert [tuple(r) for r in found.tolist()] == plain_runs(d.tolist(), least)


def test_documents(spark, documents, rng):
    texts = [*ODD_TEXTS, "a " * 11, "a " * 12, *(repetitive(rng) for _ in range(80)), *(prose(rng, 60) for _ in range(80))]
    found = periods.digests(periods.periodic_runs(periods.damaged(documents(texts)), group=200)).collect()
    assert {r[0]: tuple(r[1:]) for r in found} == {i: expected(i, t) for i, t in enumerate(texts)}


def test_edges(spark, documents, rng):
    assert periods.periodic_runs(documents([])).count() == 0
    text = repetitive(rng)
    rows = periods.digests(periods.periodic_runs(documents([text, text, text], ids=[None, 4, 4]))).collect()
    assert len(rows) == 3 and len({tuple(r[1:]) for r in rows}) == 1
    assert expected(None, text) == tuple(rows[0][1:])
    odd = spark.sql("select 1L doc_id, cast(x'4F6BFF2E' as string) text")
    assert periods.periodic_runs(odd).first().collapsed == "Ok�."
    words = " ".join(map(str, range(150_000)))  # above a million characters, repeated whole
    row = periods.periodic_runs(documents([f"{words} {words}"])).first()
    assert [tuple(r) for r in row.runs] == [(0, 300_000, 150_000)] and row.collapsed == words


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = queries.queries()["op13_periodic_runs"](spark, sf)
    assert found.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {r[0]: tuple(r[1:]) for r in found.collect()} == {r.doc_id: expected(r.doc_id, r.text) for r in rows}
