"""Runs of periodic repetition among a text's words, on a harmonic grid (operator 13).

A run is a stretch of words with a smallest period, repeated twice at least, that
no neighbouring word extends. For each period ``p`` the grid has the points
``jp``. A run of period ``p`` covers two neighbouring points, so the longest
common extensions of ``jp`` and ``(j+1)p``, forward and backward, give its ends.
Over all periods these are about ``n ln n`` queries. Forward extensions come from
the suffix array, its common prefix lengths and range minima, backward ones from
the same of the reversed words. Points at unlike words have none and are not asked.

Texts are worked on in groups of some ten thousand words, each text's suffixes
apart from the others'; a long text is a group by itself. Suffixes are sorted by
doubling, and only those that are still tied are sorted again.

Defined results: null text counts as empty and has no words; texts without a run
have an empty list; a text of any length is one stretch of words, held by one task
with some 100 bytes a word, and one where most repeats up to twice that; a row's
result depends on its text alone, so repeated rows repeat it; null ids stay null;
text that isn't UTF-8 has its wrong bytes replaced; an empty table gives none;
further columns are not read.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
RUN = "struct<start:long,length:long,period:long>"


def _ranks(w: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each suffix's rank, and ranks by the first 1, 2, 4, … words. ``end``: where each position's text ends; texts share no words."""
    n = len(w)
    order = np.argsort(w, kind="stable")
    head = np.flatnonzero(np.r_[True, w[order][1:] != w[order][:-1]])
    size = np.diff(np.r_[head, n])
    rank = np.empty(n, np.int64)
    rank[order] = np.repeat(head, size)
    tied, levels, k = order[np.repeat(size > 1, size)], [rank], 1
    while len(tied):
        ahead = tied + k
        inside = ahead < end[tied]
        old = rank[tied]
        key = old * (n + 1) + np.where(inside, rank[np.where(inside, ahead, 0)] + 1, 0)
        by = np.argsort(key, kind="stable")
        tied, key, old = tied[by], key[by], old[by]
        at = np.arange(len(tied))
        new_head = np.r_[True, key[1:] != key[:-1]]
        old_first = np.maximum.accumulate(np.where(np.r_[True, old[1:] != old[:-1]], at, 0))
        first = np.maximum.accumulate(np.where(new_head, at, 0))
        rank = rank.copy()
        rank[tied] = old + first - old_first
        size = np.diff(np.r_[np.flatnonzero(new_head), len(tied)])
        tied = tied[np.repeat(size > 1, size)]
        levels.append(rank)
        k *= 2
    return rank, [x.astype(np.int32) for x in levels[:-1]]


class Extensions:
    """Longest common extensions of positions in a row of texts' words."""

    def __init__(self, w: np.ndarray, end: np.ndarray):
        self.rank, levels = _ranks(w, end)
        n = len(w)
        suffixes = np.empty(n, np.int64)
        suffixes[self.rank] = np.arange(n)
        x, y = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(max(0, n - 1), np.int32)
        for t in reversed(range(len(levels))):
            near = np.flatnonzero((x < n) & (y < n))
            same = near[levels[t][x[near]] == levels[t][y[near]]]
            x[same] += 1 << t
            y[same] += 1 << t
            common[same] += 1 << t
        self.minima = [common]  # of the range from i on, 1, 2, 4, … long
        k = 1
        while 2 * k <= len(common) and self.minima[-1].any():
            last = self.minima[-1]
            self.minima.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Common prefix lengths of the suffixes at i and j, unlike positions."""
        a, b = np.minimum(self.rank[i], self.rank[j]), np.maximum(self.rank[i], self.rank[j])
        level = np.frexp((b - a).astype(np.float64))[1] - 1  # the largest power of two within the range
        out = np.zeros(len(a), np.int64)
        for t in np.unique(level).tolist():
            if t < len(self.minima):  # beyond these all minima are zero
                at = np.flatnonzero(level == t)
                m = self.minima[t]
                out[at] = np.minimum(m[a[at]], m[b[at] - (1 << t)])
        return out


def _grid(starts: np.ndarray, sizes: np.ndarray, chunk: int = 1 << 18):
    """(first point, second point, period) of all neighbouring points of all texts, in chunks."""
    tops = sizes // 2
    periods = np.arange(1, int(tops.sum()) + 1) - np.repeat(np.cumsum(tops) - tops, tops)
    origin = np.repeat(starts, tops)
    count = (np.repeat(sizes, tops) - 1) // periods
    done = np.cumsum(count)
    at = 0
    while at < len(periods):
        to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + chunk, "right")))
        c = count[at:to]
        p = np.repeat(periods[at:to], c)
        j = np.arange(len(p)) - np.repeat(np.cumsum(c) - c, c)
        x = np.repeat(origin[at:to], c) + j * p
        yield x, x + p, p
        at = to


def runs_of(texts: list[np.ndarray], least: int) -> list[np.ndarray]:
    """Rows of (start, length, period) for each text, given by its words' numbers: by start, then period."""
    found = [np.zeros((0, 3), np.int64) for _ in texts]
    which = [i for i, t in enumerate(texts) if len(t) >= least]
    if not which:
        return found
    sizes = np.array([len(texts[i]) for i in which])
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    text = np.repeat(np.arange(len(which)), sizes)
    plain = np.concatenate([texts[i] for i in which]).astype(np.int64)
    w = text * (int(plain.max()) + 1) + plain
    ends = np.repeat(starts + sizes, sizes)
    forward = Extensions(w, ends)
    backward = Extensions(w[::-1].copy(), (n - np.repeat(starts, sizes))[::-1].copy())
    out = []
    for x, y, p in _grid(starts, sizes):
        at = np.flatnonzero(plain[x] == plain[y])
        x, y, p = x[at], y[at], p[at]
        f = forward(x, y)
        b = np.zeros(len(x), np.int64)
        inner = np.flatnonzero(x > starts[text[x]])
        b[inner] = backward(n - x[inner], n - y[inner])
        long = np.flatnonzero(f + b >= np.maximum(p, least - p))
        out.append(np.stack([x[long] - b[long], f[long] + b[long] + p[long], p[long]], axis=1))
    rows = np.concatenate(out)
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(1)] if len(rows) else np.zeros(0, bool)
    rows = rows[new]  # of one stretch the smallest period
    rows = rows[np.lexsort((rows[:, 2], rows[:, 0]))]
    of = text[rows[:, 0]]
    for k, i in enumerate(which):
        mine = rows[of == k] if len(which) < 64 else rows[np.searchsorted(of, k) : np.searchsorted(of, k, "right")]
        found[i] = mine - np.array([starts[k], 0, 0])
    return found


def without_repeats(n: int, runs: np.ndarray) -> np.ndarray:
    """Places of the words that no run contains after its first period."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.flatnonzero(np.cumsum(depth[:n]) == 0)


def periodic_runs(docs: DataFrame, least: int = 12, id_col: str = "doc_id", text_col: str = "text", group: int = 1 << 15) -> DataFrame:
    """(id, n_words, runs, collapsed): the text's runs of at least ``least`` words by start and period, and its other words, joined by one space. No shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.make_valid_utf8(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def made(ids: pa.Array, texts: list[list[bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        coded = [np.array([numbers.setdefault(w, len(numbers)) for w in t], np.int64) for t in texts]
        found = runs_of(coded, least)
        flat = np.concatenate([np.zeros((0, 3), np.int64), *found])
        runs = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(run_type)))
        kept = [b" ".join(t if not len(r) else [t[i] for i in without_repeats(len(t), r).tolist()]) for t, r in zip(texts, found, strict=True)]
        return pa.record_batch([ids, pa.array(list(map(len, texts)), pa.int64()), runs, pa.array([k.decode() for k in kept], pa.string())], names=["id", "n_words", "runs", "collapsed"])

    def run(batches):
        for b in batches:
            at, held, size = 0, [], 0
            for t in b.column("text"):
                held.append(_WORD.findall(t.as_py().encode()))
                size += len(held[-1])
                if size >= group:
                    yield made(b.column("id").slice(at, len(held)), held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield made(b.column("id").slice(at), held)

    found = source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, n_words long, runs array<{RUN}>, collapsed string")
    return found.select(F.col("id").alias(id_col), "n_words", "runs", "collapsed")


def damaged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): in a tenth of the documents, by crc32 of the id's decimal text, the words are made periodic from some word on."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), h.alias("h"))
    # columns of their own, so that a text is split once and not again for each of its words
    rows = rows.withColumn("words", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    rows = rows.withColumns({"g": F.floor(F.col("h") / 10), "n": F.size("words").cast("long")}).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    rows = rows.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (F.lit(3) + F.col("g") % 8)))
    repeated = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get("words", (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return rows.select(F.col("id").alias(id_col), F.when(F.col("n") > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256) from :func:`periodic_runs`."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    rows = found.withColumn("_best", best)
    return rows.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
