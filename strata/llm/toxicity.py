"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression (operator 6).

Features of a whole text, none of which depends on anything but the text: the
density and number of lexicon words, of lexicon words that show only after
obfuscation is undone (digits and signs for letters, letters spaced out by
dots), their nearness to a second person, the shares of capitals, digits and
punctuation, exclamation runs, stretched letters and symbol-laden words. The
lexicon is learned from the labelled sample: words whose documents are toxic
far more often than the rest, and stems (word beginnings of 4 to 8 letters)
for languages that inflect. Trees and calibration come from Spark's MLlib, on
separate parts of the sample.

Defined results: null and empty texts are scored like any other (all features
zero); repeated rows get equal scores; without usable labels of both classes
every score is the share of toxic labels (0.0 without labels); a text of any
length is scored whole; extra columns are not read.
"""

from __future__ import annotations

import re
import string
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.bytebpe import text_of
from strata.llm.common import discard, named, written
from strata.llm.labelled import kept, text_in, training_sample, with_row

#: Words for a second person, in the four languages of the corpus.
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split())
#: What stands for letters in obfuscated words.
_PLAIN = str.maketrans("013457@$!", "oieastasi")
_EDGES = string.punctuation + "¡¿…“”„«»‘’"
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][.\-_*]){3,}[^\W\d_](?![^\W_])")
FEATURES = ["log_hits", "density", "log_hidden", "hidden_density", "near_second", "second_density", "capitals", "shouted", "digits", "punctuation", "exclaims", "stretched", "symbol_words", "log_words"]


class Lexicon:
    """Whole words, and stems that a word may begin with."""

    def __init__(self, words: frozenset[str], stems: frozenset[str] = frozenset()):
        self.words = words
        self.stems: dict[str, tuple[str, ...]] = {}
        for s in sorted(stems):
            self.stems[s[:4]] = (*self.stems.get(s[:4], ()), s)

    def __contains__(self, word: str) -> bool:
        return word in self.words or (found := self.stems.get(word[:4])) is not None and word.startswith(found)


def features(text: str, lexicon: Lexicon) -> list[float]:
    lower = text.lower()
    words = lower.split()
    n, chars = max(1, len(words)), max(1, len(text))
    hits = hidden = near = second = symbols = 0
    recent: deque[int] = deque(maxlen=1)  # place of the latest second person
    latest = None  # place of the latest lexicon word
    for i, raw in enumerate(words):
        word = raw if raw.isalpha() else raw.strip(_EDGES)
        found = word in lexicon
        if not found and not word.isalpha() and word:
            symbols += 1
            plain = word.translate(_PLAIN)
            if plain.replace(".", "").replace("-", "").replace("*", "").replace("_", "") in lexicon:
                hidden += 1
                found = True
        elif found:
            hits += 1
        if found:
            latest = i
            near += bool(recent) and i - recent[0] <= 6
        elif word in SECOND_PERSON:
            second += 1
            near += latest is not None and i - latest <= 6
            recent.append(i)
    letters = sum(map(lower.count, "!?"))
    upper = sum(1 for a in re.findall(r"[A-ZÀ-ÖØ-Þ]+", text) for _ in a)
    shouted = len(re.findall(r"\b[A-ZÀ-ÖØ-Þ]{3,}\b", text))
    digits = len(re.findall(r"\d", text))
    marks = len(re.findall(r"[^\w\s]", text))
    stretched = len(re.findall(r"([^\W\d_])\1\1", lower))
    spaced = sum(re.sub(r"[^\w]|_", "", x) in lexicon for x in _SPACED.findall(lower))
    hidden += spaced
    return [np.log1p(hits), 1000 * hits / n, np.log1p(hidden), 1000 * hidden / n, 1000 * near / n, 1000 * second / n, upper / chars, shouted / n, digits / chars, marks / chars, 1000 * letters / chars, 1000 * stretched / n, symbols / n, np.log1p(len(words))]


def with_features(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``_row`` with the ``keep`` columns, and a dense feature vector of each text. No shuffle."""
    source, schema = with_row(docs, keep, T.StructField("features", T.ArrayType(T.DoubleType())))

    def run(batches):
        for b in batches:
            values = np.array([features(t, lexicon) for t in map(text_of, text_in(b))], np.float64).reshape(-1, len(FEATURES))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, len(FEATURES)), pa.int32()), pa.array(values.ravel()))
            yield pa.record_batch([b.column("_row"), lists], names=["_row", "features"])

    return source.mapInArrow(run, schema).withColumn("features", array_to_vector("features"))


def learn_lexicon(sample: DataFrame, odds_least: float = 20.0, surprise: float = 24.0, size: int = 500) -> Lexicon:
    """Words and stems whose documents are toxic far more often than others: at most ``size``.

    Both the smoothed odds ratio and the log-likelihood ratio (G squared, which chance
    seldom lifts so high among a sample's words) have to be large. A stem that holds makes
    longer ones superfluous.
    """
    totals = sample.agg(F.sum("label").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = totals["t"] or 0.0, totals["n"] - (totals["t"] or 0.0)
    if not toxic or not clean:
        return Lexicon(frozenset())
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))
    terms = F.flatten(F.transform(words, lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), F.transform(F.filter(F.array(*map(F.lit, range(4, 9))), lambda k: k <= F.length(w)), lambda k: F.substring(w, F.lit(1), k)))))
    counts = sample.select("label", F.explode(F.array_distinct(terms)).alias("term")).where("term <> '$'").groupBy("term").agg(F.sum("label").alias("t"), F.count("*").alias("n"))
    t, c = F.col("t"), F.col("n") - F.col("t")
    odds = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
    g2 = 2 * (t * F.log((t + 1e-9) / (F.col("n") * toxic / (toxic + clean))) + c * F.log((c + 1e-9) / (F.col("n") * clean / (toxic + clean))))
    found = counts.where((odds >= odds_least) & (g2 >= surprise)).orderBy(F.desc(g2), F.length("term"), "term").limit(size).collect()
    whole = {r["term"][:-1] for r in found if r["term"].endswith("$")}
    stems = {r["term"] for r in found if not r["term"].endswith("$")}
    short = {s for s in stems if not any(s[:k] in stems for k in range(4, len(s)))}
    return Lexicon(frozenset(w for w in whole if not any(w[:k] in short for k in range(4, 9))), frozenset(short))


@dataclass(frozen=True)
class Model:
    """What a labelled sample gives: the lexicon, the trees over the features, and the curve from their probability to a score."""

    lexicon: Lexicon
    trees: GBTClassificationModel
    curve: IsotonicRegressionModel

    def score(self, featured: DataFrame) -> DataFrame:
        """``raw`` and ``toxicity`` of rows with ``features``."""
        raw = self.trees.transform(featured).withColumn("raw", vector_to_array("probability")[1])
        return self.curve.transform(raw)


def fit(sample: DataFrame, trees: int = 12, depth: int = 3) -> Model:
    """The model of a sample with ``label``, ``part`` and ``text``: lexicon and trees by parts 0 to 6, the curve by the rest."""
    lexicon = learn_lexicon(sample.where("part < 7"))
    data = with_features(sample, lexicon, ["label", "part"]).select("_row.label", "_row.part", "features").coalesce(6).cache()
    fitted_on = data.where("part < 7")
    if fitted_on.select("label").distinct().count() < 2:
        fitted_on = data
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, maxBins=64, seed=5).fit(fitted_on)
    rest = data.where("part >= 7")
    rest = rest if rest.select("label").distinct().count() == 2 else data
    rest = model.transform(rest).select("label", vector_to_array("probability")[1].alias("raw"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="toxicity").fit(rest)
    data.unpersist()
    return Model(lexicon, model, curve)


def score_toxicity(docs: DataFrame, labels: DataFrame, allowed: Column, keep: list[str], bound: int = 12_000, trees: int = 12, depth: int = 3, label: str = "toxic", column: str = "toxicity") -> DataFrame:
    """``keep`` columns and a calibrated toxicity of 0 to 1, named ``column``, for every document.

    ``bound`` is the greatest number of labelled documents that the lexicon, the trees
    and the calibration are fitted on.
    """
    sample = written(training_sample(docs, labels, label, allowed, bound).repartition(6, "doc_id"), "sample")  # the scan keeps its tasks; `bound` rows move
    known = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if len(known) < 2 or min(known.values()) < 2:
        share = known.get(1.0, 0) / max(1, sum(known.values()))
        return docs.select(*named(keep), F.lit(float(share)).alias(column))
    model = fit(sample, trees, depth)
    discard(sample)
    return kept(model.score(with_features(docs, model.lexicon, keep)), keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "toxicity")), column)
