"""Command line: run, rollback, restore, show, over a JSON config of specs.

python -m strata.plans CONFIG run --batch ID --at TIME [--select NAME | --tag TAG]
python -m strata.plans CONFIG build --batch ID --at TIME [--select NAME | --tag TAG]     (no publication)
python -m strata.plans CONFIG gate NAME --batch ID                                       (checks what is pending)
python -m strata.plans CONFIG publish NAME --batch ID --at TIME                          (gate, approve, publish)
python -m strata.plans CONFIG rollback NAME (--to-batch ID | --to-datetime TIME) [--execute] [--purge]
python -m strata.plans CONFIG restore NAME [--rollback-id ID]
python -m strata.plans CONFIG intake NAME --path PATH --checkpoint PATH --at TIME [--hold] (takes in extracts that are there)
python -m strata.plans CONFIG resume NAME --path PATH --at TIME                          (takes in what is held)
python -m strata.plans CONFIG show NAME

The config has "root", "sources" (name to Parquet path, whose schema extracts have), "dimensions" and "snapshots" (lists of spec fields).
"""

from __future__ import annotations

import argparse
import json
from datetime import UTC, datetime

from pyspark.sql import SparkSession

from strata.plans.pipeline import Pipeline, status_of, tests_of
from strata.spec import DimensionSpec, Registry, SnapshotSpec
from strata.streaming.ingest import Intake


def registry_of(config: dict) -> Registry:
    made = [kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}) for key, kind in (("dimensions", DimensionSpec), ("snapshots", SnapshotSpec)) for s in config.get(key, [])]
    return Registry(made)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> object:
    p = argparse.ArgumentParser(prog="strata")
    p.add_argument("config")
    sub = p.add_subparsers(dest="what", required=True)
    for what in ("run", "build"):
        run = sub.add_parser(what)
        run.add_argument("--batch", required=True)
        run.add_argument("--at", required=True)
        run.add_argument("--select")
        run.add_argument("--tag")
    for what in ("gate", "publish"):
        one = sub.add_parser(what)
        one.add_argument("name")
        one.add_argument("--batch", required=True)
        one.add_argument("--at", required=what == "publish")
    back = sub.add_parser("rollback")
    back.add_argument("name")
    back.add_argument("--to-batch")
    back.add_argument("--to-datetime")
    back.add_argument("--execute", action="store_true")
    back.add_argument("--purge", action="store_true")
    again = sub.add_parser("restore")
    again.add_argument("name")
    again.add_argument("--rollback-id")
    for what in ("intake", "resume"):
        one = sub.add_parser(what)
        one.add_argument("name")
        one.add_argument("--path", required=True)
        one.add_argument("--at", required=True)
        if what == "intake":
            one.add_argument("--checkpoint", required=True)
            one.add_argument("--hold", action="store_true")
    sub.add_parser("show").add_argument("name")
    a = p.parse_args(args)
    with open(a.config) as f:
        config = json.load(f)
    spark = spark or SparkSession.builder.appName("strata").getOrCreate()
    pipeline = Pipeline(spark, config["root"], registry_of(config))
    sources = lambda: {k: spark.read.parquet(v) for k, v in config["sources"].items()}
    if a.what in ("run", "build"):
        names = [a.select] if a.select else [s.name for s in pipeline.registry.tagged(a.tag)] if a.tag else None
        out = pipeline.run(sources(), a.batch, datetime.fromisoformat(a.at), names, publish=a.what == "run")
    elif a.what in ("gate", "publish"):
        out = pipeline.check(a.name, sources()[pipeline.registry[a.name].source], a.batch)
        if a.what == "publish":
            out = pipeline.approve(a.name, a.batch, datetime.fromisoformat(a.at), status_of(out, a.name), tests_of(out, a.name))
    elif a.what in ("intake", "resume"):
        schema = sources()[pipeline.registry[a.name].source].schema
        intake = Intake(spark, pipeline, a.name, a.path, schema)
        at = datetime.fromisoformat(a.at)
        out = intake.take_available(a.checkpoint, at, "hold" if a.hold else "stop") if a.what == "intake" else intake.resume(at)
    elif a.what == "rollback":
        out = pipeline.rollback(a.name, datetime.now(UTC).replace(tzinfo=None, microsecond=0), to_batch_id=a.to_batch, to_datetime=a.to_datetime, dry_run=not a.execute, purge=a.purge)
    elif a.what == "restore":
        out = pipeline.restore(a.name, a.rollback_id)
    else:
        out = pipeline.registry.describe(a.name)
    print(json.dumps(out, default=str, indent=1))
    return out


if __name__ == "__main__":
    main()
