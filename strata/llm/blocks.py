"""A stated query set against all rows, in blocks: what the two vector searches share.

Rows are dealt once into blocks of a bounded size by a hash of their ids, each
the work of one task; only the queries, a small share of the rows, are repeated
for each block. A task builds the index of its block and then takes the queries
as they stream by, a batch at a time, so it holds one block and one batch. It
gives its best k of every query, and a window merges the blocks. Nothing is
broadcast.

Defined results: null, empty and non-finite vectors and null ids take no part; of a
repeated id the smallest vector counts; ties go to the smaller id; vectors of unlike
lengths don't meet; an empty table, or one without queries, gives none.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, at most and (but for small tables) at least; blocks of small tables; bytes of a block's vectors at most.
MOST_ROWS, LEAST_ROWS, FEW_BLOCKS, MOST_BYTES = 65_536, 4_096, 16, 1 << 26


def finite(vector: str) -> Column:
    """Vectors that are present, not empty, and hold neither null nor non-finite components."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def one_a_key(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, vector): of repeated keys the smallest vector counts; null keys take no part."""
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("vec_id")).agg(F.min(vector).alias("vector"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k smallest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores <= np.partition(scores, k - 1)[k - 1])
        return near[np.lexsort((ids[near], scores[near]))[:k]]
    return np.lexsort((ids, scores))[:k]


def blocks_of(rows: int, widest: int) -> int:
    """Number of blocks: of 4,096 rows up to sixteen blocks, then of more, until a block has 65,536 rows or 64 MiB."""
    most = max(1, min(MOST_ROWS, MOST_BYTES // (8 * max(1, widest))))
    return max(1, -(-rows // most), min(FEW_BLOCKS, -(-rows // min(most, LEAST_ROWS))))


def search(
    rows: DataFrame, queries: DataFrame, index: Callable[[np.ndarray, np.ndarray], Callable[[int, np.ndarray], tuple[np.ndarray, np.ndarray]]], k: int, score_type: str, ascending: bool, n_blocks: int | None = None, together: bool = False,
) -> DataFrame:
    """The k best of each query: (query_id, rank, vec_id, score).

    ``index(ids, vectors)`` of a block gives a function from a query's id and vector to its best row ids and
    scores there. Vectors of another length than a query's are no candidates of it. With ``together`` it takes the ids
    and vectors of several queries, and gives query ids, row ids and scores.
    """
    if n_blocks is None:
        size = rows.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("dim")).first()
        n_blocks = blocks_of(size["n"], size["dim"] or 1)
    dim = F.size("vector").alias("dim")
    own = F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)).cast("int").alias("block")
    every = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block")
    both = rows.select("vec_id", "vector", dim, own, F.lit(False).alias("asks")).union(queries.select("vec_id", "vector", dim, every, F.lit(True)))
    dealt = both.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "dim", "asks")  # a partition a block
    number = np.float64 if score_type == "double" else np.int64

    def run(batches):
        at, ids, vectors, ask = None, [], [], None
        for b in batches:
            block, dims, asks = (b.column(c).to_numpy(zero_copy_only=False) for c in ("block", "dim", "asks"))
            cuts = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (dims[1:] != dims[:-1]) | (asks[1:] != asks[:-1])]) if len(block) else []
            for lo, hi in zip(cuts, [*cuts[1:], len(block)], strict=True):
                own_ids, own_vectors = b.column("vec_id").slice(lo, hi - lo).to_numpy(), matrix(b.column("vector").slice(lo, hi - lo), dims[lo])
                if at != (block[lo], dims[lo]):
                    at, ids, vectors, ask = (block[lo], dims[lo]), [], [], None
                if not asks[lo]:
                    ids.append(own_ids)
                    vectors.append(own_vectors)
                    continue
                if ids and ask is None:
                    ask = index(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors = [None], []
                join = lambda x, t: np.concatenate([np.zeros(0, t), *x]).astype(t)
                if together and ask:
                    q, i, s = ask(own_ids, own_vectors)
                else:
                    found = [(q, *ask(q, v)) for q, v in zip(own_ids.tolist(), own_vectors, strict=True)] if ask else []
                    q, i, s = join([np.full(len(i), q) for q, i, _ in found], np.int64), join([i for _, i, _ in found], np.int64), join([s for _, _, s in found], number)
                yield pa.record_batch([pa.array(q), pa.array(i), pa.array(s)], names=["query_id", "vec_id", "score"])

    found = dealt.mapInArrow(run, f"query_id long, vec_id long, score {score_type}")
    order = [F.asc("score") if ascending else F.desc("score"), F.asc("vec_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
