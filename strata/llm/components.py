"""Connected components of an edge table by alternating large and small stars.

Edges never leave Spark: each round is a few aggregations and joins, written to
the shared folder; the tables of a round go when the next has replaced them. A
hub's neighbours are pre-aggregated to a minimum before the shuffle, and the
rows of a hub are dealt out in the join with it. A round is written in as many
files as its edges need, so that small rounds are a few tasks.

Defined results: loops and repeated edges count for nothing; a node without an
edge is not in the result; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import discard, spread_join, written

#: Edges that a file holds; a task of a round reads one.
EDGES_A_FILE = 250_000


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has an edge; the root is the component's smallest node, itself included. A written table."""
    e = edges.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo <> hi").distinct()
    e = written(e, "edges")
    files = max(1, -(-e.count() // EDGES_A_FILE))
    before = None
    while True:
        both = e.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(e.select(F.col("hi").alias("u"), F.col("lo").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, "u", "v").where("v > u").select(F.least("v", "m").alias("lo"), F.greatest("v", "m").alias("hi")).where("lo <> hi").distinct()
        large = written(large.coalesce(files), "large")
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = spread_join(large, least, "hi", "lo")
        small = joined.select(F.col("m").alias("lo"), "hi").union(joined.where("lo <> m").select(F.col("m").alias("lo"), F.col("lo").alias("hi"))).distinct()
        small = written(small.coalesce(files), "small")
        discard(e, large)
        e = small
        now = e.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if before == now:
            found = e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(e.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
            found = written(found.coalesce(files), "components")
            discard(e)
            return found
        before = now
