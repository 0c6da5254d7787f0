"""Exact top-k inner product by MaxScore over integer postings (operator 5).

Every dimension is a term; a block of rows holds one posting list for each,
with the list's least and greatest value. For a query, a term's contribution
lies between two products with these bounds, so each term has a greatest gain
over its least contribution. Terms are split by that gain: the non-essential
ones are those whose gains together cannot lift a row over the threshold, the
k-th best score seen so far. The essential lists are traversed for all rows;
the others are probed, largest gain first, only for rows that can still
compete. Queries of a block are asked a batch at a time, so that essential lists are
traversed by matrix products. Blocks are shards whose best k are merged. Scores are exact.

The queries are a share of the rows, so pairs grow with the square of the rows, and these
embeddings leave no block out by its bounds: what is kept low is the cost of a pair.

Defined results: vectors that are null, empty or hold a null or non-finite
component take no part; of a repeated id the smallest vector counts; equal
scores go to the smaller id; fewer candidates than k give fewer rows; empty
tables give none; extra columns are not read. Quantised components and scores
have to fit a long.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm import blocks
from strata.llm.common import written


def quantised(rows: DataFrame, scale: int = 64, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector): floor(scale * x) of each component, in double precision."""
    ints = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
    return blocks.one_a_key(rows.where(blocks.finite(vector)).select(F.col(key), ints.alias("v")), key, "v")


#: Queries that are asked together; rows that give the first threshold, at least; rows that are traversed together.
TOGETHER, FIRST, STRETCH = 128, 1_024, 4_096


def _merged(at: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each query its k best, ties to the smaller id, in the order of queries."""
    order = np.lexsort((ids, -score, at))
    at = at[order]
    top = np.arange(len(at)) - np.searchsorted(at, at) < k
    return at[top], ids[order[top]], score[order[top]]


def maxscores(ids: np.ndarray, postings: np.ndarray, queries: np.ndarray, own: np.ndarray, k: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of one shard for each of a few queries: positions of the queries, row ids and scores.

    The first rows are scored whole and give each query its threshold. The rest come in stretches: one product
    traverses the essential lists of all queries (a coefficient is zero where the term isn't essential to a query),
    what may still compete is probed, and thresholds rise with each stretch.
    """
    n, terms, first = len(ids), len(postings), min(len(ids), max(FIRST, 4 * k))
    lowest = -np.inf if queries.dtype.kind == "f" else np.iinfo(queries.dtype).min
    scores = np.where(ids[:first] == own[:, None], lowest, queries @ postings[:, :first])
    least = np.partition(scores, first - k, axis=1)[:, first - k] if first > k else np.full(len(queries), lowest)
    at, row = np.nonzero((scores >= least[:, None]) & (ids[:first] != own[:, None]))
    found = _merged(at, ids[row], scores[at, row], k)
    if first == n:
        return found
    threshold = found[2].reshape(len(queries), k)[:, -1]  # there are more than k rows
    a, b = queries * low, queries * high
    order = np.argsort(-np.abs(b - a), axis=1, kind="stable")  # strongest terms first
    floor, gain = (np.take_along_axis(x, order, 1) for x in (np.minimum(a, b), np.abs(b - a)))
    after = lambda x: np.hstack([np.cumsum(x[:, ::-1], axis=1)[:, ::-1], np.zeros((len(x), 1), x.dtype)])  # noqa: E731  of the terms from each on
    best_left, lifted = after(floor + gain), floor.sum(1, keepdims=True) + after(gain)
    # not essential: terms that can't lift a row over the threshold, of these the ones that decide little; a probe costs far more than a product's step
    essential = int(np.argmax((lifted < threshold[:, None]) & (4 * best_left <= np.abs(threshold)[:, None]), axis=1).max()) or terms
    weights = np.zeros_like(queries)
    np.put_along_axis(weights, order[:, :essential], np.take_along_axis(queries, order[:, :essential], 1), 1)
    for start in range(first, n, STRETCH):
        partial = weights @ postings[:, start : start + STRETCH]
        at, row = np.divmod(np.flatnonzero(partial >= (threshold - best_left[:, essential])[:, None]), partial.shape[1])
        score, row = partial[at, row], row + start
        other = ids[row] != own[at]
        at, row, score = at[other], row[other], score[other]
        for j in range(essential, terms):
            t = order[at, j]
            score = score + queries[at, t] * postings[t, row]
            alive = score + best_left[at, j + 1] >= threshold[at]
            at, row, score = at[alive], row[alive], score[alive]
        found = _merged(*(np.concatenate(x) for x in zip(found, (at, ids[row], score), strict=True)), k)
        threshold = found[2].reshape(len(queries), k)[:, -1]
    return found


def maxscore(ids: np.ndarray, postings: np.ndarray, query: np.ndarray, own: int, k: int, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best k of one shard: row ids and scores. ``postings`` has a row for each term; low and high are its bounds."""
    _, found, score = maxscores(ids, postings, query[None], np.array([own]), k, low, high)
    return found, score.astype(np.int64)


def top_k(rows: DataFrame, queries: DataFrame, k: int = 20, n_blocks: int | None = None) -> DataFrame:
    """The k highest inner products of each query, its own id left out: (query_id, rank, vec_id, score)."""

    def index(ids, vectors):
        largest = float(np.abs(vectors).max()) * vectors.shape[1]
        by_kind = {}

        def ask(queries, asked):
            parts = []
            for i in range(0, len(queries), TOGETHER):
                own, some = queries[i : i + TOGETHER], asked[i : i + TOGETHER]
                bound = largest * float(np.abs(some).max())
                kind = np.float32 if bound < 2**22 else np.float64 if bound < 2**51 else np.int64  # each is exact
                if kind not in by_kind:
                    postings = np.ascontiguousarray(vectors.T.astype(kind))
                    by_kind[kind] = postings, postings.min(1), postings.max(1)
                postings, low, high = by_kind[kind]
                at, found, score = maxscores(ids, postings, some.astype(kind), own, k, low, high)
                parts.append((own[at], found, score.astype(np.int64)))
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        return ask

    return blocks.search(rows, queries, index, k, "long", ascending=False, n_blocks=n_blocks, together=True)


def search_table(rows: DataFrame, is_query, k: int = 20, scale: int = 64, key: str = "vec_id", vector: str = "embedding", **index) -> DataFrame:
    vectors = written(quantised(rows, scale, key, vector), "vectors")
    return top_k(vectors, vectors.where(is_query), k, **index)
