"""Fingerprints, links and components against brute force."""

import re
from itertools import combinations

import xxhash

from strata.llm import minhash, simhash
from strata.llm.components import connected_components
from tests.llm.conftest import ODD_TEXTS, prose


def brute_fingerprint(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def edited(rng, text, n):
    words = text.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = "edit" + str(rng.randrange(1000))
    return " ".join(words)


def test_fingerprint(rng):
    for t in [*ODD_TEXTS, prose(rng, 30), prose(rng, 300)]:
        assert simhash.fingerprint(t) == brute_fingerprint(t)
    t = prose(rng, 50)
    assert simhash.fingerprint(t, chunk=7) == simhash.fingerprint(t)


def test_triples_guarantee_a_meeting():
    triples = [set(t) for t in simhash.position_triples()]
    assert len(triples) == 20 and all(any(t <= set(c) for t in triples) for c in combinations(range(8), 4))


def flipped(rng, fp, n):
    for b in rng.sample(range(64), n):
        fp ^= 1 << b
    return fp


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_links_lose_nothing_in_hot_lists(spark, rng):
    """A dense group whose lists are longer than a block, and strangers."""
    centre = rng.getrandbits(64)
    fps = {flipped(rng, centre, rng.randrange(0, 6)) for _ in range(120)} | {rng.getrandbits(64) for _ in range(60)} | {0, (1 << 64) - 1, 15}
    frame = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    want = components(sorted(map(signed, fps)), lambda a, b: ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4)
    for block in (8, 4096):  # the shorter block sends lists to the centres
        edges = simhash.links(frame, "fp", simhash.position_triples(), 4, 4, block)
        assert all(((r.a ^ r.b) & ((1 << 64) - 1)).bit_count() <= 4 for r in edges.collect())
        got = {r.node: r.root for r in connected_components(edges).collect()}
        assert {n: got.get(n, n) for n in want} == want


def test_query_against_brute_force(documents, rng):
    base = [prose(rng, 200) for _ in range(6)]
    texts = [*ODD_TEXTS, *base, *(edited(rng, b, n) for b in base for n in (0, 1, 1, 2, 3)), base[0].upper(), "  " + base[1]]
    got = simhash.near_duplicates(documents(texts), words=4, bits=4).collect()
    fps = [brute_fingerprint(t) for t in texts]
    want = components(range(len(texts)), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    assert {r.doc_id: (r.fp, r.component_id) for r in got} == {i: (signed(fps[i]), want[i]) for i in want}


def test_similar_documents_against_brute_force(documents, rng):
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(8)]
    texts = [*ODD_TEXTS, *base, *(edited(rng, b, n) for b in base for n in (0, 1, 2, 3, 5, 9)), base[0].upper() + "\n", prose(rng, 6000)]
    sets = [set(map(int, simhash.shingle_set(simhash.words_of(t), 5))) for t in texts]
    want = components(range(len(texts)), lambda a, b: sets[a] == sets[b] if not sets[a] | sets[b] else len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    for block in (4, 1024):
        got = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(texts), block=block).collect()}
        assert got == want


def test_edges_of_input(documents):
    assert simhash.near_duplicates(documents([])).count() == 0 and simhash.similar_documents(documents([])).count() == 0
    got = simhash.near_duplicates(documents(["a b", "a b", None], [None, 3, 3]))
    assert sorted((r.doc_id or -1, r.component_id) for r in got.collect()) == [(-1, 3), (3, 3), (3, 3)]
    assert simhash.similar_documents(documents(["a b", "a b"], [4, 4])).count() == 2


def test_a_hot_group_of_near_copies_needs_few_pairs(documents, rng, monkeypatch):
    """A third of all rows are near copies of one text: candidate pairs grow with the rows, not with their square."""
    base = prose(rng, 400)
    texts = [prose(rng, 60) for _ in range(400)] + [edited(rng, base, rng.randrange(1, 4)) for _ in range(200)]
    asked, real = [], minhash.linked_sets
    monkeypatch.setattr(minhash, "linked_sets", lambda pairs, sets, percent: asked.append(pairs.count()) or real(pairs, sets, percent))
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(texts)).collect()}
    assert {got[i] for i in range(400, 600)} == {400} and sum(asked) < 4 * len(texts)


def test_shingles_are_those_of_the_words(rng):
    words = [w.encode() for w in prose(rng, 50).split()]
    found = simhash.shingles(words, 5)
    assert len(found) == 46 == len(set(found.tolist())) and (simhash.shingles(words[3:8], 5) == found[3:4]).all()
    assert len(simhash.shingles(words[:3], 5)) == 1 and len(simhash.shingles([], 5)) == 0
    assert simhash.majority(found, 7) == simhash.majority(found)


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(100, 160)]
    hub = [(7, i) for i in range(500, 700)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(path + hub + [(3, 3)], "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {7: 7} | {i: 7 for i in range(500, 700)}


def test_similar_documents_finds_appended_cut_and_short_texts(documents, rng):
    texts = []
    for n in (12, 20, 25, 100, 200, 300, 400, 600):
        for _ in range(6):
            words = prose(rng, n).split()
            more = prose(rng, n // 8).split()
            texts += [" ".join(words), " ".join(words + more), " ".join(words[: n - n // 8]), " ".join(words[:-1] + ["other"])]
    common = prose(rng, 12)
    texts += [f"{common} {prose(rng, k)}" for k in (1, 2, 3, 4) for _ in range(20)]
    sets = [set(simhash.shingle_set(simhash.words_of(t), 5).tolist()) for t in texts]
    near = simhash._Sets(len(texts))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                near.join(i, j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(near.root(i), i)
    got = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(texts)).collect()}
    assert got == {i: least[near.root(i)] for i in range(len(texts))}


def test_text_that_is_not_utf8(spark):
    docs = spark.sql("select 1L doc_id, cast(x'4F6BFF2E' as string) text union all select 2L, 'ok\ufffd.'")
    rows = simhash.near_duplicates(docs).collect()
    assert len({r.fp for r in rows}) == 1 and {r.component_id for r in rows} == {1}
    assert {r.component_id for r in simhash.similar_documents(docs).collect()} == {1}
