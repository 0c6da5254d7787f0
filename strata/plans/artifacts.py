"""What is recorded of a run: results, nodes and edges of the graph, exposures included."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.sources.files import Folder
from strata.spec import Registry

RUN_RESULTS = "run_id string, invocation_id string, node_id string, node_name string, resource_type string, node_status string, execution_time double, thread_id string, message string, failed_at timestamp, completed_at timestamp"
NODES = "invocation_id string, node_id string, node_name string, resource_type string, package_name string, path string, description string, depends_on_nodes string, tags string, meta string"
EDGES = "invocation_id string, parent_id string, parent_name string, parent_type string, child_id string, child_name string, child_type string"
#: Lengths that stored texts are cut to.
MESSAGE_LENGTH, DEPENDS_LENGTH = 2000, 4000


def upsert(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Put an invocation's records beside those of others: its own rows of the same keys give way, its other rows stay.

    The invocation is a partition that Spark writes over as one commit; its records are as few as its nodes.
    """
    spark = rows.sparkSession
    invocation = rows.select("invocation_id").first()
    if invocation is None:
        return
    if Folder(spark, path).exists():
        old = spark.read.schema(rows.schema).parquet(path).where(F.col("invocation_id") == invocation[0])
        kept = old.join(rows.select(*keys), keys, "left_anti").select(rows.columns).collect()  # before its partition is written over
        rows = rows.unionByName(spark.createDataFrame(kept, rows.schema))
    rows.coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("invocation_id").parquet(path)


def graph(registry: Registry) -> dict[str, dict]:
    """Nodes by id: sources, each spec's nodes, and exposures."""
    nodes: dict[str, dict] = {}

    def add(kind, name, depends=(), **more):
        nodes[f"{kind}.{name}"] = {"name": name, "resource_type": kind, "depends": list(depends), "description": "", "tags": [], "meta": {}} | more

    for spec in registry.specs.values():
        add("source", spec.source)
        for n in registry.describe(spec.name):
            add(n["resource_type"], n["name"], n["depends_on"], description=n["description"], tags=n["tags"], meta={"spec": spec.name})
    for e in registry.exposures:
        add("exposure", e.name, e.depends_on, description=e.description, meta=e.meta | {"owner": e.owner})
    kinds: dict[str, str] = {}
    for key, n in nodes.items():
        kinds[n["name"]] = key
    for n in nodes.values():
        n["depends"] = [kinds[d] for d in n["depends"] if d in kinds]
    return nodes


def node_frame(spark: SparkSession, registry: Registry, invocation_id: str) -> DataFrame:
    rows = [
        (invocation_id, key, n["name"], n["resource_type"], "strata", "", n["description"][:MESSAGE_LENGTH], ", ".join(n["depends"])[:DEPENDS_LENGTH], ", ".join(n["tags"])[:MESSAGE_LENGTH], json.dumps(n["meta"], sort_keys=True)[:MESSAGE_LENGTH])
        for key, n in graph(registry).items()
    ]
    return spark.createDataFrame(rows, NODES)


def edge_frame(spark: SparkSession, registry: Registry, invocation_id: str) -> DataFrame:
    nodes = graph(registry)
    rows = [(invocation_id, d, nodes[d]["name"], nodes[d]["resource_type"], key, n["name"], n["resource_type"]) for key, n in nodes.items() for d in n["depends"]]
    return spark.createDataFrame(rows, EDGES)


def result_frame(spark: SparkSession, results: Iterable[dict], run_id: str, invocation_id: str) -> DataFrame:
    rows = [
        (run_id, invocation_id, f"{r['resource_type']}.{r['name']}", r["name"], r["resource_type"], r["status"].lower(), float(r.get("seconds", 0.0)), r.get("thread", ""), (r.get("message") or "")[:MESSAGE_LENGTH], r.get("failed_at"), r["completed_at"])
        for r in results
    ]
    return spark.createDataFrame(rows, RUN_RESULTS)
