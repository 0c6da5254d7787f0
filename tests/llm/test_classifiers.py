"""Toxicity and quality: held-out accuracy, edges, and that only allowed labels are read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strata.llm import quality, toxicity
from strata.llm.labelled import held_out
from tests.llm.conftest import ODD_TEXTS, prose

SF = "/root/testdata/sf0.1"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    good = int((y == 1).sum())
    return (rank[y == 1].sum() - good * (good + 1) / 2) / (good * (len(y) - good))


@pytest.mark.parametrize("name,label,least", [("op6_toxicity", "toxic", 0.9), ("op9_quality", "quality", 0.97)])
def test_held_out(spark, name, label, least):
    from strata.llm.queries import queries

    got = queries()[name](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").select("score", label, "predicted").toPandas()
    assert got.score.between(0, 1).all() and auc(got.score.to_numpy(), got[label].to_numpy()) > least
    assert (got.predicted == got[label]).mean() > 0.95


def test_toxicity_edges(spark, documents, rng):
    texts = [*ODD_TEXTS, *(prose(rng, 40) + (" you blarg" + "aeio"[i % 4] + " fool" if i % 2 else "") for i in range(300))]
    docs = documents(texts)
    truth = labels(spark, [(i, 1, int("blarg" in (t or ""))) for i, t in enumerate(texts)])
    scored = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, truth, F.lit(True), ["doc_id"]).collect()}
    assert len(scored) == len(texts) and all(0 <= s <= 1 for s in scored.values())
    assert min(scored[i] for i, t in enumerate(texts) if "blarg" in (t or "")) > 0.7 > 0.3 > max(scored[i] for i, t in enumerate(texts) if "blarg" not in (t or ""))
    assert toxicity.score_toxicity(docs, truth.where("false"), F.lit(True), ["doc_id"]).where("toxicity <> 0").count() == 0
    assert toxicity.score_toxicity(docs.where("false"), truth, F.lit(True), ["doc_id"]).count() == 0
    again = toxicity.score_toxicity(docs.unionByName(docs), truth, F.lit(True), docs.columns)
    assert again.columns == [*docs.columns, "toxicity"] and again.count() == 2 * len(texts)


def test_features_undo_obfuscation():
    lex = toxicity.Lexicon(frozenset({"moron"}), frozenset({"blarg"}))
    value = lambda t: dict(zip(toxicity.FEATURES, toxicity.features(t, lex), strict=True))
    assert "blargest" in lex and "moron" in lex and "morons" not in lex
    assert value("you MORON, you")["log_hits"] == np.log1p(1) and value("you moron")["near_second"] > 0
    for t in ("m0r0n", "m.o.r.o.n", "mor*on"):
        assert value(t)["log_hidden"] > 0, t
    assert value("") == dict.fromkeys(toxicity.FEATURES, 0.0)
    assert value("a nice day")["log_hits"] == value("a nice day")["log_hidden"] == 0


def test_labels_that_are_held_out_have_no_influence(spark, documents, rng):
    texts = [prose(rng, 30) + ("!!" * (i % 2)) for i in range(200)]
    docs, rows = documents(texts), [(i, i % 2, 0) for i in range(200)]
    other = labels(spark, rows).withColumn("quality", F.when(held_out(5, 0), 1 - F.col("quality")).otherwise(F.col("quality")))
    score = lambda t: {r.doc_id: r.score for r in quality.score_quality(docs, t, ~held_out(5, 0), ["doc_id"]).collect()}
    assert score(labels(spark, rows)) == score(other)


def test_quality_edges(spark, documents, rng):
    docs = documents(ODD_TEXTS + [prose(rng, 20) for _ in range(20)])
    truth = labels(spark, [(i, int(i % 3 > 0), 0) for i in range(30)])
    got = quality.score_quality(docs, truth, F.lit(True), ["doc_id"]).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.score_quality(docs, truth.where("false"), F.lit(True), ["doc_id"]).where("score <> 1").count() == 0
    assert quality.score_quality(docs.where("false"), truth, F.lit(True), ["doc_id"]).count() == 0


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(np.append(rng.integers(10, 200, 20), i % 2)).astype(np.int32) for i in range(300)]
    y = np.array([1 if i % 2 else -1 for i in range(300)])
    w, b = quality.fit(rows, y, 256)
    assert all((quality.margin(r, w, b) > 0) == (t > 0) for r, t in zip(rows, y, strict=True))
    a, c = quality.logistic(np.array([-2.0, -1, 1, 2]), np.array([-1, -1, 1, 1]))
    assert a > 0 and abs(c) < 1e-6


def test_kept_columns_may_have_any_name(spark, documents, rng):
    docs = documents([prose(rng, 20) + ("!" * (i % 2)) for i in range(60)])
    docs = docs.withColumns({c: F.lit(c) for c in ("features", "prediction", "probability", "raw", "toxicity", "label", "part", "score")})
    truth = labels(spark, [(i, i % 2, i % 2) for i in range(60)])
    for score in (toxicity.score_toxicity, quality.score_quality):
        got = score(docs, truth, F.lit(True), docs.columns, column="mine")
        assert got.columns == [*docs.columns, "mine"] and got.where("features = 'features' and score = 'score'").count() == 60


def test_quality_features_against_plain_python(rng):
    def plain(text, bits=16):
        slot = lambda gram: ((gram * 2654435761) & 0xFFFFFFFF) >> (32 - bits)
        raw, words, out = text.encode(), text.split(), set()
        for order in (1, 2, 3):
            for i in range(len(raw) - order + 1):
                gram = order
                for byte in raw[i : i + order]:
                    gram = (gram * 257 + byte) & 0xFFFFFFFF
                out.add(slot(gram))
        same = [a == b for a, b in zip(words, words[1:])]
        for order in range(1, 7):
            out |= {slot((1 << 28) + (1 << order) + sum(same[i + k] << k for k in range(order))) for i in range(len(same) - order + 1)}
        return sorted(out)

    for text in [t or "" for t in ODD_TEXTS[:5] + ODD_TEXTS[6:]] + [prose(rng, 60), "a a b b b c " * 9]:
        found = quality.slots(text, 16)
        assert found.tolist() == plain(text)
        assert quality.unpacked(quality.packed(found, 16), 16).tolist() == found.tolist()
    full = np.arange(0, 1 << 16, 3, dtype=np.int32)
    assert len(quality.packed(full, 16)) == 8192 and (quality.unpacked(quality.packed(full, 16), 16) == full).all()


def test_an_id_that_stands_often_is_one_row_of_the_sample(spark, documents):
    from strata.llm.labelled import training_sample

    docs = documents([f"text {i}" for i in range(500)], [7] * 490 + list(range(10, 20)))
    truth = labels(spark, [(i, i % 2, 0) for i in range(5, 20)] + [(7, 0, 1)])
    got = training_sample(docs, truth, "quality", F.lit(True), 12).collect()
    assert len(got) == len({r.doc_id for r in got}) <= 12
    assert all(r.text == "text 0" and r.label == 1.0 for r in got if r.doc_id == 7)


def plain_quality(sample, texts, bits=16):
    """Scores by the definition: class log-count ratios, the dual's optimum by many rounds on the whole matrix, Platt's curve by gradient steps."""
    slot = {t: quality.slots(t, bits) for t in {*texts, *(r.text for r in sample)}}
    fitted, check = [r for r in sample if r.part < 8], [r for r in sample if r.part >= 8]
    counts = {y: np.ones(1 << bits) for y in (0, 1)}
    for r in fitted:
        counts[int(r.label)][slot[r.text]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    x = np.zeros((len(fitted), 1 << bits))
    for i, r in enumerate(fitted):
        x[i, slot[r.text]] = ratio[slot[r.text]]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([1.0 if r.label else -1.0 for r in fitted])
    upper = np.array([len(y) / (2 * (y == v).sum()) for v in y])
    q = (x @ x.T + 1) * np.outer(y, y)  # the bias is a feature of one
    dual = np.zeros(len(y))
    for _ in range(3000):
        for i in range(len(y)):
            dual[i] = min(max(dual[i] - (q[i] @ dual - 1) / q[i, i], 0.0), upper[i])
    w, bias = (dual * y) @ x, float(dual @ y)

    def margin(t):
        v = ratio[slot[t]]
        return float(w[slot[t]] @ v / (np.linalg.norm(v) or 1.0) + bias)

    m, good = np.array([margin(r.text) for r in check]), np.array([r.label > 0 for r in check])
    target = np.where(good, (good.sum() + 1) / (good.sum() + 2), 1 / ((~good).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(200_000):
        g = 1 / (1 + np.exp(-(a * m + b))) - target
        a, b = a - 0.02 * (g * m).sum(), b - 0.02 * g.sum()
    return {t: 1 / (1 + np.exp(-(a * margin(t) + b))) for t in texts}


def test_whole_quality_query_against_its_definition(spark, documents, rng):
    from strata.llm.labelled import training_sample

    texts = [prose(rng, rng.randrange(20, 60)) if i % 3 else " ".join(rng.choice("zx qv jj".split()) for _ in range(40)) for i in range(200)]
    for i in rng.sample(range(200), 40):
        texts[i] += " " + " ".join(rng.choice(["zx", "fox", "tree"]) for _ in range(20))
    docs, truth = documents(texts), labels(spark, [(i, int(i % 3 > 0) if i % 11 else int(i % 3 == 0), 0) for i in range(200)])
    sample = training_sample(docs, truth, "quality", ~held_out(5, 0), 8_000).collect()
    want = plain_quality(sample, texts)
    got = {r.doc_id: r.score for r in quality.score_quality(docs, truth, ~held_out(5, 0), ["doc_id"]).collect()}
    assert max(abs(got[i] - want[t]) for i, t in enumerate(texts)) < 0.03


def plain_lexicon(rows, odds_least=20.0, surprise=24.0, size=500):
    """Words and stems of at most eight letters whose documents are toxic far more often than others."""
    import math
    import re

    toxic, clean, counts = sum(y for _, y in rows), sum(1 - y for _, y in rows), {}
    for text, y in rows:
        words = {w for w in re.split(r"[\W\d_]+", text.lower()) if w}
        for term in {w + "$" for w in words} | {w[:k] for w in words for k in range(4, 9) if k <= len(w)}:
            t, n = counts.get(term, (0, 0))
            counts[term] = (t + y, n + 1)
    kept = []
    for term, (t, n) in counts.items():
        c = n - t
        odds = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
        g2 = 2 * (t * math.log((t + 1e-9) / (n * toxic / (toxic + clean))) + c * math.log((c + 1e-9) / (n * clean / (toxic + clean))))
        if odds >= odds_least and g2 >= surprise:
            kept.append((-g2, len(term), term))
    terms = [t for _, _, t in sorted(kept)[:size]]
    stems = {t for t in terms if t[-1] != "$"}
    short = {s for s in stems if not any(s[:k] in stems for k in range(4, len(s)))}
    return {t[:-1] for t in terms if t[-1] == "$" and not any(t[:-1][:k] in short for k in range(4, 9))}, short


def tree_value(node, x):
    while node.subtreeDepth() > 0:
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


def test_whole_toxicity_query_against_its_definition(spark, documents, rng, monkeypatch):
    """Lexicon, trees and isotonic curve by their definitions, from the sample and the fitted trees' splits."""
    from strata.llm.labelled import training_sample

    bad = ["blargish", "snorfing", "gruntle"]
    texts = [" ".join([prose(rng, rng.randrange(10, 40))] + ([f"you {rng.choice(bad)} you {rng.choice(bad)}"] if i % 3 == 0 else [])) for i in range(240)]
    docs, truth = documents(texts), labels(spark, [(i, 0, int(i % 3 == 0) if i % 17 else int(i % 3 > 0)) for i in range(240)])
    sample = training_sample(docs, truth, "toxic", ~held_out(3, 1), 12_000)
    rows = sample.collect()
    models, fit = [], toxicity.fit
    monkeypatch.setattr(toxicity, "fit", lambda *a: models.append(fit(*a)) or models[-1])
    got = {r.doc_id: r.toxicity for r in toxicity.score_toxicity(docs, truth, ~held_out(3, 1), ["doc_id"]).collect()}
    (model,) = models
    words, stems = plain_lexicon([(r.text, int(r.label)) for r in rows if r.part < 7])
    assert words == set(model.lexicon.words) and stems == {s for found in model.lexicon.stems.values() for s in found} and words | stems

    trees = [(w, t._call_java("rootNode")) for w, t in zip(model.trees.treeWeights, model.trees.trees, strict=True)]

    def raw(text):
        x = toxicity.features(text, model.lexicon)
        # sums of the same leaves differ in their last digits by the order of adding
        return round(1 / (1 + np.exp(-2 * sum(w * tree_value(t, x) for w, t in trees))), 12)

    points = sorted((raw(r.text), r.label) for r in rows if r.part >= 7)
    blocks = []  # pools of neighbours that fall
    for x, y in points:
        if blocks and blocks[-1][2] == x:
            blocks[-1] = [blocks[-1][0] + y, blocks[-1][1] + 1, x, blocks[-1][3]]
        else:
            blocks.append([y, 1, x, x])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, to, _ = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, to, blocks[-1][3]]
    xs, ys = zip(*[p for s, n, to, since in blocks for p in ([(since, s / n), (to, s / n)] if since < to else [(to, s / n)])], strict=True)
    assert max(abs(got[i] - np.interp(raw(t), xs, ys)) for i, t in enumerate(texts)) < 1e-6
