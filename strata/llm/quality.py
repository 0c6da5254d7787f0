"""Quality by naive Bayes support vectors over character n-grams (operator 9).

A text's features are indicators of its byte n-grams (orders 1 to 3) and of n-grams
over whether each word repeats the one before it (orders 1 to 6), hashed to
``2**bits`` slots. Each indicator is scaled by its class log-count ratio from the labelled sample, rows are brought to unit length, and a linear model with
hinge loss is fitted to them by dual coordinate descent. A logistic curve,
fitted on a part of the sample that the model has not seen, turns margins into
scores of 0 to 1. The sample is bounded in rows, and a row takes ``2**bits / 8``
bytes at most, 8 KiB; so what reaches the driver (64 MiB at most with the defaults)
and the fit are small whatever the input. Scoring is one pass without a shuffle.

Defined results: null and empty texts have no features and score by the bias
alone; repeated rows get equal scores; without usable labels of both classes
every score is the share of good labels (1.0 without labels); a text of any
length is scored whole; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.bytebpe import text_of
from strata.llm.common import named
from strata.llm.labelled import kept, text_in, training_sample, with_row

_CHUNK = 1 << 20


def slots(text: str, bits: int) -> np.ndarray:
    """Sorted distinct slots of the text's n-grams."""
    raw = np.frombuffer(text.encode(), np.uint8)
    seen = np.zeros(1 << bits, bool)
    shift = np.uint32(32 - bits)
    for at in range(0, len(raw), _CHUNK):
        b = raw[at : at + _CHUNK + 2].astype(np.uint32)
        for order in (1, 2, 3):
            n = len(b) - order + 1
            if n > 0:
                gram = np.full(n, order, np.uint32)
                for k in range(order):
                    gram = gram * np.uint32(257) + b[k : k + n]
                seen[(gram * np.uint32(2654435761)) >> shift] = True
    words = text.split()
    same = np.fromiter((a == b for a, b in pairwise(words)), np.uint32, max(0, len(words) - 1))
    for order in range(1, 7):
        n = len(same) - order + 1
        if n > 0:
            gram = np.full(n, 1 << order, np.uint32)
            for k in range(order):
                gram += same[k : k + n] << np.uint32(k)
            seen[((gram + np.uint32(1 << 28)) * np.uint32(2654435761)) >> shift] = True
    return np.flatnonzero(seen).astype(np.int32)


def packed(slot: np.ndarray, bits: int) -> bytes:
    """Slots as 32-bit numbers, or as a bitmap where that is shorter."""
    if 4 * len(slot) < (1 << bits) // 8:
        return slot.astype("<i4").tobytes()
    seen = np.zeros(1 << bits, bool)
    seen[slot] = True
    return np.packbits(seen).tobytes()


def unpacked(raw: bytes, bits: int) -> np.ndarray:
    """The slots again: a bitmap has the length that no list has."""
    if len(raw) == (1 << bits) // 8:
        return np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8))).astype(np.int32)
    return np.frombuffer(raw, "<i4")


class Packed(Sequence):
    """Rows of slots, unpacked as they are asked for."""

    def __init__(self, rows: list[bytes], bits: int):
        self.rows, self.bits = rows, bits

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        return unpacked(self.rows[i], self.bits)


def fit(rows: Sequence[np.ndarray], labels: np.ndarray, size: int, c: float = 1.0, epochs: int = 12, seed: int = 3, alpha: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights of each indicator (ratio and model together) and the bias, for labels of 1 and -1."""
    counts = {y: np.full(size, alpha) for y in (1, -1)}
    for slot, y in zip(rows, labels, strict=True):
        counts[y][slot] += 1
    ratio = np.log((counts[1] / counts[1].sum()) / (counts[-1] / counts[-1].sum()))
    scale = np.array([1 / (np.sqrt((ratio[slot] ** 2).sum()) or 1.0) for slot in rows])
    # classes weigh alike, whatever their shares
    share = {y: max(1, int((labels == y).sum())) for y in (1, -1)}
    upper = np.array([c * len(labels) / (2 * share[y]) for y in labels])
    dual, w, bias, rng = np.zeros(len(rows)), np.zeros(size), 0.0, np.random.default_rng(seed)
    norm = np.array([(ratio[slot] ** 2).sum() for slot in rows]) * scale**2 + 1
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            slot, y = rows[i], labels[i]
            v = ratio[slot] * scale[i]
            gradient = y * (w[slot] @ v + bias) - 1
            new = min(max(dual[i] - gradient / norm[i], 0.0), upper[i])
            step = (new - dual[i]) * y
            if step:
                w[slot] += step * v
                bias += step
                moved = max(moved, abs(step))
                dual[i] = new
        if moved < 1e-3:
            break
    return np.stack([w * ratio, ratio**2]), bias


def margin(slot: np.ndarray, weights: np.ndarray, bias: float) -> float:
    return float(weights[0][slot].sum() / (np.sqrt(weights[1][slot].sum()) or 1.0) + bias)


def logistic(margins: np.ndarray, labels: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Platt's curve by Newton steps: score = 1 / (1 + exp(-(a * margin + b)))."""
    good, n = (labels > 0).sum(), len(labels)
    target = np.where(labels > 0, (good + 1) / (good + 2), 1 / (n - good + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g, h = p - target, p * (1 - p) + 1e-9
        hessian = np.array([[(h * margins**2).sum() + 1e-6, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        da, db = np.linalg.solve(hessian, [(g * margins).sum(), g.sum()])
        a, b = a - np.clip(da, -5, 5), b - np.clip(db, -5, 5)
        if abs(da) + abs(db) < 1e-9:
            break
    return float(max(a, 1e-3)), float(b)


def score_quality(docs: DataFrame, labels: DataFrame, allowed: Column, keep: list[str], bound: int = 8_000, bits: int = 16, label: str = "quality", column: str = "score") -> DataFrame:
    """``keep`` columns and a score of 0 to 1, named ``column``, for every document; ``bound`` labelled documents at most are fitted on."""

    def featurise(batches):
        for b in batches:
            found = [packed(slots(t, bits), bits) for t in map(text_of, b.column("text"))]
            yield pa.record_batch([b.column("key"), b.column("label"), b.column("part"), pa.array(found, pa.binary())], names=["key", "label", "part", "slots"])

    sample = training_sample(docs, labels, label, allowed, bound).select(F.xxhash64("doc_id", "text").alias("key"), "label", "part", "text")
    # bounded: `bound` rows of at most 2**bits bits; ordered, so that the order in which tasks ended has no influence
    rows = sample.mapInArrow(featurise, "key long, label double, part int, slots binary").toArrow().sort_by("key")
    known = np.where(rows["label"].to_numpy() > 0, 1, -1)
    if len(set(known.tolist())) < 2 or min((known > 0).sum(), (known < 0).sum()) < 2:
        return docs.select(*named(keep), F.lit(float((known > 0).mean()) if len(known) else 1.0).alias(column))
    found = rows["slots"].to_pylist()
    part = rows["part"].to_numpy()
    fitted = part < 8
    if len(set(known[fitted].tolist())) < 2 or len(set(known[~fitted].tolist())) < 2:
        fitted = np.ones(len(known), bool)
    check = ~fitted if not fitted.all() else fitted
    weights, bias = fit(Packed([found[i] for i in np.flatnonzero(fitted)], bits), known[fitted], 1 << bits)
    a, b = logistic(np.array([margin(unpacked(found[i], bits), weights, bias) for i in np.flatnonzero(check)]), known[check])
    weights = weights.astype(np.float32)
    del rows, found
    pa.default_memory_pool().release_unused()

    def run(batches):
        for batch in batches:
            m = np.array([margin(slots(t, bits), weights, bias) for t in map(text_of, text_in(batch))])
            score = 1 / (1 + np.exp(-np.clip(a * m + b, -500, 500)))
            yield pa.record_batch([batch.column("_row"), pa.array(score, pa.float64())], names=["_row", "score"])

    source, schema = with_row(docs, keep, T.StructField("score", T.DoubleType()))
    return kept(source.mapInArrow(run, schema), keep, F.col("score"), column)
