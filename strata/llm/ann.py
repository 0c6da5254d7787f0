"""Approximate nearest neighbours by a permutation index (operator 3).

Equal vectors are one class from the start: classes are indexed and searched, and
those found give their ids in ascending order, so no cut falls among copies. Pivots
are a bounded sample of the classes, the same at every size. Each vector is
represented by its ``prefix`` nearest pivots in order. Each block of classes is
posted once in inverted files, which hold (row, place of the pivot in its order)
for each pivot. A query walks the files of its own pivots and sums what the places agree
on: the Spearman footrule over orders cut at ``prefix``, where a pivot outside
a prefix counts as place ``prefix``. The share ``keep`` of a block with the
smallest footrule distance (``least`` rows at least) is reranked by the true
distance in double precision. Every row is indexed; recall is measured against
brute force in the tests.

Defined results: vectors that are null, empty, zero or hold a null or
non-finite component take no part; of a repeated id the smallest vector counts;
equal distances go to the smaller id; fewer candidates than k give fewer rows;
empty tables give none; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strata.llm import blocks
from strata.llm.common import written


def valid_vectors(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    some = blocks.finite(vector) & F.exists(vector, lambda x: x != 0)
    doubles = F.transform(vector, lambda x: x.cast("double"))
    return blocks.one_a_key(rows.where(some).select(F.col(key), doubles.alias("v")), key, "v")


def pivots_of(vectors: DataFrame, pivots: int, seed: int = 7) -> dict[int, np.ndarray]:
    """A sample of ``pivots`` rows with the smallest keyed hashes, by vector length: bounded whatever the input."""
    sample = vectors.orderBy(F.xxhash64(F.lit(seed), "vec_id"), "vec_id").limit(pivots).collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(len(r["vector"]), []).append(r["vector"])
    return {d: np.unique(np.array(v, np.float64), axis=0) for d, v in by_dim.items()}


def pivot_orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each row's nearest pivots in order."""
    distance = (pivots**2).sum(1) - 2 * (vectors @ pivots.T)
    return np.argsort(distance, axis=1, kind="stable")[:, :prefix].astype(np.int32)


class Files:
    """The inverted files of a block: for each pivot, the rows that have it in their orders and its place there."""

    def __init__(self, orders: np.ndarray, n_pivots: int):
        self.n, self.prefix = orders.shape
        by_pivot = np.argsort(orders.ravel(), kind="stable")
        self.rows, self.places = (by_pivot // self.prefix).astype(np.int32), (by_pivot % self.prefix).astype(np.int32)
        self.edges = np.searchsorted(orders.ravel()[by_pivot], np.arange(n_pivots + 1))

    def agreement(self, order: np.ndarray) -> np.ndarray:
        """Prefix-scaled agreement of a query's order with every row, by walking the files of its pivots (higher: nearer)."""
        total = np.zeros(self.n, np.int64)
        for place, pivot in enumerate(order):
            part = slice(self.edges[pivot], self.edges[pivot + 1])
            # both outside: 0; footrule falls by 2 * (prefix - the larger place) where both have the pivot
            total[self.rows[part]] += 2 * (self.prefix - np.maximum(self.places[part], place))
        return total


def classes_of(rows: DataFrame, most: int, block: int = 8192) -> DataFrame:
    """(vec_id, vector, ids): each distinct vector with its ``most`` smallest ids, of which vec_id is the first.

    Copies are dealt out before they are gathered, so no task holds all ids of a class.
    """
    parts = -(-rows.count() // block) or 1
    smallest = lambda ids: F.slice(F.array_sort(ids), 1, most)
    dealt = rows.groupBy("vector", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part")).agg(smallest(F.collect_list("vec_id")).alias("ids"))
    whole = dealt.groupBy("vector").agg(smallest(F.flatten(F.collect_list("ids"))).alias("ids"))
    return whole.select(F.col("ids")[0].alias("vec_id"), "vector", "ids")


def nearest_neighbours(rows: DataFrame, queries: DataFrame, k: int = 10, pivots: int = 256, prefix: int = 64, keep: float = 0.2, least: int = 64, n_blocks: int | None = None) -> DataFrame:
    """The k nearest rows found for each query, its own id left out: (query_id, rank, vec_id, score).

    ``rows`` and ``queries`` are (vec_id, vector) as :func:`valid_vectors` gives them.
    """
    # one more than k of each, as one may be the query itself
    classes = written(classes_of(rows, k + 1), "classes")
    rows = classes.select("vec_id", "vector")
    points = pivots_of(rows, pivots)

    def index(ids, vectors):
        p = points.get(vectors.shape[1], vectors[:pivots])  # a length that no pivot has is rare, and has pivots of its own
        length = min(prefix, len(p))
        files = Files(pivot_orders(vectors, p, length), len(p))
        n = min(len(ids), max(least, k + 1, int(np.ceil(keep * len(ids)))))

        def ask(_, vector):
            agreement = files.agreement(pivot_orders(vector[None], p, length)[0])
            at = blocks.best(-agreement, ids, n)  # equal agreements go by id too
            distance = np.sqrt(((vectors[at] - vector) ** 2).sum(1))
            top = blocks.best(distance, ids[at], k + 1)
            return ids[at][top], distance[top]

        return ask

    near = blocks.search(rows, queries, index, k + 1, "double", ascending=True, n_blocks=n_blocks)
    every = near.join(classes.select("vec_id", "ids"), "vec_id").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = every.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(rows: DataFrame, is_query, k: int = 10, key: str = "vec_id", vector: str = "embedding", **index) -> DataFrame:
    """Search a table for those of its rows that meet ``is_query`` (a condition on vec_id)."""
    vectors = written(valid_vectors(rows, key, vector), "vectors")
    return nearest_neighbours(vectors, vectors.where(is_query), k, **index)
