"""URL filter, licence scan and shards against plain Python."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from strata.llm import licences, shards, urlfilter
from strata.llm.queries import URL_RULES
from tests.llm.conftest import ODD_TEXTS, prose

ODD_URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7x?q=/de/", "http://example.com/en/1", "x://notexample.com/en/1", "http://a.example.net/de/81#f", "http://net/de/1", "ftp://É.net/DE/", "http://b.org/es/", "http://a.b?c/d", "http://q.org#/es/", "http://c.net/fr/ü"]


def plain(url):
    if not url or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.split(r"[/?#]", rest)[0]
    path = re.split(r"[?#]", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


def models(urls):
    """Witten-Bell trigram models in plain Python: log ratio of each trigram of a URL, averaged."""
    def coded(u):
        s = "".join(c.lower() if "A" <= c <= "Z" else c for c in u or "")
        return "^^" + "".join("0" if c in "0123456789" else c if c in urlfilter.ALPHABET[2:] and c not in "*" else "*" for c in s) + "$"

    tri = {k: Counter(coded(u)[i : i + 3] for u in us for i in range(len(coded(u)) - 2)) for k, us in urls.items()}

    def p(k, g):
        t = tri[k]
        one, two = Counter(), Counter()
        for x, n in t.items():
            one[x[2]] += n
            two[x[1:]] += n
        lower = (one[g[2]] + 0.5) / (sum(one.values()) + 0.5 * urlfilter.SIZE)
        for counts, gram in ((two, g[1:]), (t, g)):
            n = sum(c for x, c in counts.items() if x[:-1] == gram[:-1])
            kinds = sum(1 for x, c in counts.items() if c and x[:-1] == gram[:-1])
            lower = (counts[gram] + kinds * lower) / (n + kinds) if n else lower
        return lower

    memo = {}

    def score(u):
        grams = [coded(u)[i : i + 3] for i in range(len(coded(u)) - 2)]
        for g in grams:
            if g not in memo:
                memo[g] = math.log(p("allow", g)) - math.log(p("block", g))
        return sum(memo[g] for g in grams) / len(grams)

    return score


def test_urls_against_plain_python(spark):
    urls = ODD_URLS + [f"http://h{i % 7}.example.{t}/{lang}/{i}" for i in range(40) for t in ("com", "net", "org") for lang in ("en", "de", "es", "fr")]
    pages = spark.createDataFrame([(i % 500, u, "h", "p", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, path string, rule string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, URL_RULES).collect())
    ruled = [plain(u) for u in urls]
    score = models({v: [u for u, r in zip(urls, ruled, strict=True) if r[3] == v] for v in ("allow", "block")})
    both = {v: [score(u) for u, r in zip(urls, ruled, strict=True) if r[3] == v] for v in ("allow", "block")}
    (good, gs), (bad, bs) = ((np.mean(both[v]), np.std(both[v])) for v in ("allow", "block"))
    threshold = bad + (good - bad) * bs / (gs + bs)
    want = sorted((i, h, p, r, v or ("allow" if score(u) >= threshold else "block")) for i, (u, (h, p, r, v)) in enumerate(zip(urls, ruled, strict=True)))
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert got == want


def test_url_edges(spark):
    schema = "page_id long, url string"
    assert urlfilter.judge(spark.createDataFrame([], schema), URL_RULES).count() == 0
    twice = urlfilter.judge(spark.createDataFrame([(1, "http://x.fr/"), (1, "http://x.fr/"), (None, None)], schema), URL_RULES).collect()
    assert [r.verdict for r in twice] == ["allow"] * 3
    assert "Python" not in urlfilter.judge(spark.createDataFrame([(1, "http://a.com/en/")], schema), URL_RULES)._jdf.queryExecution().toString()


APACHE, MIT = licences.TEMPLATES["Apache-2.0"], licences.TEMPLATES["MIT"]


def test_licences(spark, rng):
    files = [
        (1, "a/LICENSE", APACHE + "\nmore"), (2, "a/x.txt", prose(rng, 30)), (3, "a/b/c/y.txt", prose(rng, 30)), (4, "a/b/LICENSE", "Released under the  MIT license!\n"),
        (5, "a/b/z.txt", "own\n" + licences.TEMPLATES["GPL-3.0"]), (6, "d/e.txt", None), (7, None, ""), (8, "top.txt", "the work is good"), (9, "a/b/c/d/e.txt", "x"), (10, "ab/x.txt", "x"),
    ]
    df = spark.createDataFrame([(*f, "q", 1.0) for f in files], "doc_id long, path string, text string, dir string, cosine double")
    got = {r.doc_id: (r.licence, r.how, r.licence_dir) for r in licences.scan(df).collect()}
    assert got == {
        1: ("Apache-2.0", "header", None), 2: ("Apache-2.0", "inherited", "a"), 3: ("MIT", "inherited", "a/b"), 4: ("MIT", "header", None), 5: ("GPL-3.0", "header", None),
        6: (None, "none", None), 7: (None, "none", None), 8: (None, "none", None), 9: ("MIT", "inherited", "a/b"), 10: (None, "none", None),
    }
    assert licences.scan(df.where("false")).count() == 0
    assert licences.scan(df.unionByName(df)).count() == 20


def test_head_or_foot_makes_a_licence_file(spark):
    near = "Released now under the MIT License."
    files = [(1, "a/x", f"{near}\nthen\n{APACHE}"), (2, "a/b/y", "plain"), (3, "c/x", f"prose\n\n{MIT}\n\n"), (4, "c/d/y", "plain"), (5, "e/x", f"prose\n{MIT}\nprose"), (6, "e/y", "plain")]
    got = {r.doc_id: (r.licence, r.how) for r in licences.scan(spark.createDataFrame(files, "doc_id long, path string, text string")).collect()}
    assert got == {1: ("Apache-2.0", "header"), 2: ("MIT", "inherited"), 3: ("MIT", "header"), 4: ("MIT", "inherited"), 5: ("MIT", "header"), 6: (None, "none")}


def test_windows_forms_and_tags(spark, rng):
    header = 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance\nwith the License. You may obtain a copy of the License at'
    grant = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including"
    around = [prose(rng, 40) for _ in range(60)]
    texts = [
        (f"// x\n{header}\nmore", "Apache-2.0"), (f"{around[0]} Released under the MIT License. {around[1]}", "MIT"), ("# SPDX-License-Identifier: GPL-3.0-or-later\ncode", "GPL-3.0"),
        (f"MIT License\n\n{grant}", "MIT"), (f"{around[2]}\nReleased under\nthe MIT License.\n{around[3]}", "MIT"), ("SPDX-License-Identifier: Zlib", None), *((x, None) for x in around[4:]),
    ]
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, (t, _) in enumerate(texts)], "doc_id long, path string, text string")
    assert {r.doc_id: r.licence for r in licences.scan(df).collect()} == {i: want for i, (_, want) in enumerate(texts)}


def test_anchors_lose_no_line(rng):
    m = licences.Matcher(licences.TEMPLATES, {"the": 90, "license": 30, "under": 80, "work": 70, "is": 95, "this": 90}, 100, 0.6)
    words = sorted({t for x in licences.TEMPLATES.values() for t in licences.terms(x)}) + ["alpha", "beta"]
    for _ in range(3000):
        line = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))
        if m.best(line):
            assert any(a in line for a in m.anchors), line
    assert m.best(APACHE.upper())[0] == "Apache-2.0" and m.scan("x\n" + MIT)[2] == 1 and m.scan("") is None


@pytest.mark.parametrize("total", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(total):
    one, other = (shards.slots_of(np.arange(total), total, k) for k in (1, 2))
    assert sorted(one.tolist()) == list(range(total)) == sorted(other.tolist())
    assert total < 60 or (one != other).any() and (one != np.arange(total)).sum() > total // 2
    assert (shards.slots_of(np.arange(total)[total // 2 :], total, 1) == one[total // 2 :]).all()


def test_shards_hold_every_id_in_slot_order(spark, documents, rng, tmp_path):
    from strata.llm.bytebpe import codec

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    texts = [*ODD_TEXTS, *(prose(rng, rng.randrange(0, 200)) for _ in range(60))]
    docs = documents(texts).repartition(3, "doc_id").sortWithinPartitions("doc_id")
    at = f"file://{tmp_path}/out"
    index = sorted(shards.materialise(docs, vocabulary, at, length=64, per_shard=16).collect(), key=lambda r: r.slot)
    total = len(index)
    files = sorted((tmp_path / "out" / "shards").glob("part-*"))
    assert [r.slot for r in index] == list(range(total)) and [p.stat().st_size for p in files] == [16 * 129] * (total // 16) + [total % 16 * 129] * bool(total % 16)
    reader = shards.Shards(spark, at)
    read = reader.read(0, total)
    assert (reader.read(10, 20) == read[10:30]).all()
    for r in index:  # plain files at a fixed stride
        raw = files[r.shard].read_bytes()[r.byte_offset :][:128]
        assert raw == read[r.slot].tobytes() and zlib.crc32(raw) == r.tokens_crc32
    encoded = list(codec(vocabulary).encode([t or "" for t in texts]))
    # streams of tasks: put the sequences back into number order and cut at end ids
    back = np.argsort(shards.slots_of(np.arange(total), total, 2024))
    numbered = np.empty_like(read)
    numbered[back] = read
    layout = spark.read.json(f"{at}/layout").first()
    assert (layout.sequences, layout.stride, layout.dtype) == (total, 129, "<u2")
    real = [numbered[i][: index[int(np.flatnonzero(back == i)[0])].n_tokens] for i in range(total)]
    split = Counter(tuple(x) for x in " ".join(map(str, np.concatenate(real).tolist())).split("50256") for x in [tuple(x.split())])
    del split[()]
    assert split == Counter(tuple(map(str, np.frombuffer(e, "<u4").tolist())) for e in encoded if e)
    assert {d for r in index for d in r.doc_ids} == set(range(len(texts)))
    assert shards.materialise(docs.where("false"), vocabulary, f"file://{tmp_path}/none").count() == 0


def test_licences_against_plain_tf_idf(spark, rng):
    """Best form of every text by the cosine of every line and window, without anchors or bounds."""
    every = licences.forms({name: (x, *licences.FORMS[name]) for name, x in licences.TEMPLATES.items()})
    words = sorted({t for _, x in every for t in licences.terms(x)})
    texts = [None, "", *(x for _, x in every), *(" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(40))]
    texts += [f"{prose(rng, 9)}\n{x[: len(x) * 2 // 3]}\n{prose(rng, 9)} {x}" for _, x in every] + [prose(rng, 30) for _ in range(20)]
    held = [set(licences.terms(t or "")) for t in texts]
    idf = {t: math.log((len(texts) + 1) / (sum(t in h for h in held) + 1)) + 1 for t in words}
    unknown = math.log(len(texts) + 1) + 1

    def cosine(found, form):
        x, y = Counter(found), Counter(licences.terms(form))
        norm = lambda c: math.sqrt(sum((k * idf.get(t, unknown)) ** 2 for t, k in c.items())) or 1.0
        return sum(k * y[t] * idf[t] ** 2 for t, k in x.items() if t in y) / norm(x) / norm(y)

    want = {}
    for i, text in enumerate(texts):
        lines = [licences.terms(x) for x in (text or "").split("\n")]
        found, best = [t for x in lines for t in x], []
        for name, form in every:
            n = min(len(licences.terms(form)), len(found))
            best += [(cosine(x, form), name) for x in lines] + [(cosine(found[k : k + n], form), name) for k in range(len(found) - n + 1) if n]
        top = max((c for c, _ in best), default=0.0)
        want[i] = (round(top, 9), {name for c, name in best if c > top - 1e-9}) if top >= 0.6 else None
    df = spark.createDataFrame([(i, f"d{i}/x", t) for i, t in enumerate(texts)], "doc_id long, path string, text string")
    got = {r.doc_id: r for r in licences.scan(df).collect()}
    for i, w in want.items():
        assert (got[i].how == "none") if w is None else (round(got[i].cosine, 9) == w[0] and got[i].licence in w[1]), (i, texts[i], got[i], w)
    assert sum(w is not None for w in want.values()) >= 2 * len(every)


def test_forms_left_out_by_their_terms_lose_no_match(rng):
    every = {name: (x, *licences.FORMS[name]) for name, x in licences.TEMPLATES.items()}
    m = licences.Matcher(every, {"license": 40, "the": 90, "version": 30, "copy": 25}, 100, 0.6)
    every_form = [(name, v) for name, v, *_ in m.vectors]
    words = sorted({t for _, v in every_form for t in v}) + ["plain", "words"]
    matched = 0
    for _ in range(400):
        form = licences.terms(rng.choice(licences.forms(every))[1])
        found = [rng.choice(words) if rng.random() < 0.45 else t for t in form if rng.random() < 0.8] or ["plain"]
        want = {name for name, v in every_form if m._cosine(licences.Counter(found), v) >= 0.6}
        assert want <= {name for name, *_ in m.possible(set(found))}
        best = m.best(" ".join(found))
        assert bool(want) == bool(best) and (not best or best[0] in want)
        matched += bool(want)
    assert 50 < matched < 350
