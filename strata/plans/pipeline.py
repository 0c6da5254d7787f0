"""A run: purge, append, gate, approve, publish, record. State lies under one root folder."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.operators import checks, gates, views
from strata.operators.history import changed_versions, snapshot_rows
from strata.plans import artifacts, rollback
from strata.plans.publish import refresh
from strata.sources.latest import LatestState
from strata.sources.ledger import Ledger, RollbackLog
from strata.sources.scratch import discard, written
from strata.sources.store import BatchStore, VersionedTable
from strata.spec import DimensionSpec, Registry, SnapshotSpec

PASSED = ("pass", "success")


class RunError(RuntimeError):
    """A run that failed after an approval; the approval has been taken back."""


@dataclass
class State:
    """What one spec has stored."""

    spark: SparkSession
    root: str
    spec: DimensionSpec | SnapshotSpec
    fault: Callable[[str], None] | None = None

    def __post_init__(self):
        kind = "dimensions" if isinstance(self.spec, DimensionSpec) else "snapshots"
        self.store = BatchStore(self.spark, f"{self.root}/{self.spec.name}/history")
        self.table = VersionedTable(self.spark, f"{self.root}/{self.spec.name}/published")
        self.latest = LatestState(self.spark, f"{self.root}/{self.spec.name}/latest", self.spec)
        self.failures = f"{self.root}/audit/{self.spec.name}__gates"
        # ledgers of their own for each kind, a log for each spec
        self.ledger = Ledger(self.spark, f"{self.root}/audit/{kind}_approved/{self.spec.name}")
        self.rollbacks = RollbackLog(self.spark, f"{self.root}/audit/{kind}_rollbacks/{self.spec.name}")

    def approved(self) -> set[str]:
        return self.ledger.approved(self.spec.model)

    def history(self, approved: bool = False) -> DataFrame | None:
        rows = self.store.read()
        return views.approved_only(rows, self.ledger.frame(), self.spec.model) if approved and rows is not None else rows

    def candidate(self) -> DataFrame:
        """What the gates and tests look at: approved and pending rows, with their validity for a dimension."""
        rows = self.store.read()
        return views.candidate(rows, self.spec) if isinstance(self.spec, DimensionSpec) else rows

    def view(self) -> DataFrame:
        """The published view: lazy, approved batches only, columns with their docs."""
        make = views.published if isinstance(self.spec, DimensionSpec) else views.snapshot_published
        return views.documented(make(self.store.read(), self.ledger.frame(), self.spec), self.spec)

    def refresh(self) -> dict:
        return refresh(self, self.fault) if self.store.schema() is not None else {"ok": True, "row_count": 0}


def source_digest(source: DataFrame, spec: DimensionSpec | SnapshotSpec) -> str:
    """Count and sum of hashes of what a batch is made of, in any order of rows: key, date and hash of a dimension's source, all columns of a fact's."""
    names = [*spec.natural_key, spec.source_date, spec.hash_column] if isinstance(spec, DimensionSpec) else [f.name for f in source.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    found = source.agg(F.count("*").alias("n"), F.sum(F.xxhash64(*(F.col(f"`{c}`") for c in names)).cast("decimal(38,0)")).alias("sum")).first()
    return f"{found['n']} rows {found['sum'] or 0}"


def status_of(results: list[dict], name: str) -> str | None:
    """The status of a spec's gate among a run's results; None if it did not run."""
    return next((r["status"] for r in reversed(results) if r["resource_type"] == "test" and r["name"] == f"{name}__gates"), None)


def tests_of(results: list[dict], name: str) -> list[dict]:
    """A spec's other tests among a run's results."""
    return [r for r in results if r["resource_type"] == "test" and r.get("spec") == name and r["name"] != f"{name}__gates"]


def blocked_reason(gate_status: str | None, other_tests: list[dict] = ()) -> str | None:
    """Why a batch isn't approved, or None. ``other_tests`` have status and severity ("error" unless given)."""
    if gate_status is None:
        return "the gate test did not run"
    if gate_status == "skipped":
        return "the gate test was skipped"
    if gate_status not in PASSED:
        return f"the gate test's status is {gate_status}"
    if any(t["status"] in ("fail", "error") and t.get("severity", "error") == "error" for t in other_tests):
        return "a test failed"
    return None


class Pipeline:
    """Runs specs and keeps their state under ``root``."""

    def __init__(self, spark: SparkSession, root: str, registry: Registry):
        self.spark, self.root, self.registry = spark, root.rstrip("/"), registry
        self._states: dict[str, State] = {}

    def state(self, name: str, fault: Callable[[str], None] | None = None) -> State:
        if name not in self._states:  # what a ledger has read once is kept
            self._states[name] = State(self.spark, self.root, self.registry[name])
        self._states[name].fault = fault
        return self._states[name]

    def build(self, name: str, source: DataFrame, batch_id: str, loaded_at: datetime, digest: str | None = None) -> bool:
        """Claim the batch, purge what isn't approved, then append it. An approved batch is left as it is (False).

        ``digest`` tells the source's rows (:func:`source_digest` unless given); a batch that was approved with
        others raises ``ReusedBatch``.
        """
        s = self.state(name)
        if not s.ledger.claim(s.spec.model, batch_id, digest or source_digest(source, s.spec)):
            return False
        batches = s.ledger.identities(s.spec.model)
        s.store.purge(set(batches))
        history = s.store.read()
        if isinstance(s.spec, DimensionSpec) and history is not None:
            latest, mark = s.latest.read(s.store, batches)
            rows = changed_versions(source, s.spec, batch_id, loaded_at, history, mark, latest)
        else:
            rows = (changed_versions if isinstance(s.spec, DimensionSpec) else snapshot_rows)(source, s.spec, batch_id, loaded_at, history)
        s.store.append(rows, batch_id, set(batches), s.spec.date_column)
        return True

    def check(self, name: str, source: DataFrame, batch_id: str, at: datetime | None = None) -> list[dict]:
        """Run the gates and the spec's column tests on what would be published; keep their failures. A result for each."""
        s = self.state(name)
        rows = s.candidate()
        wanted = {c.lower(): c for t in s.spec.tests for c in t.columns} | {c.lower(): c for c in gates.gate_columns(s.spec)}
        rows = written(rows.select(*(F.col(f"`{c}`") for c in wanted.values())), "candidate")  # several checks read it, in few columns
        if isinstance(s.spec, DimensionSpec):
            failures = gates.dimension_gates(source, rows, s.spec)
        else:
            failures = gates.snapshot_gates(source, rows, s.spec, s.store.volumes(s.spec.volume_window))
        results = []
        for test, found in [(None, failures), *((t, checks.run_test(rows, t)) for t in s.spec.tests)]:
            test_name, severity = (f"{name}__{test.name}", test.severity) if test else (f"{name}__gates", s.spec.gate_severity)
            folder = f"{s.failures if test is None else f'{self.root}/audit/{test_name}'}/batch={batch_id}"
            found.write.mode("overwrite").parquet(folder)
            bad = self.spark.read.parquet(folder).limit(1).count() > 0
            status = "pass" if not bad else "fail" if severity == "error" else "warn"
            results.append({"resource_type": "test", "name": test_name, "spec": name, "status": status, "severity": severity, "completed_at": at, "failed_at": at if bad else None})
        discard(rows)
        return results

    def gate(self, name: str, source: DataFrame, batch_id: str) -> str | None:
        """The gates' status: pass, fail or warn."""
        return status_of(self.check(name, source, batch_id), name)

    def approve(self, name: str, batch_id: str, at: datetime, gate_status: str | None, other_tests: list[dict] = (), fault=None) -> dict:
        """Approve and publish unless blocked; if publishing fails, take the approval back and raise.

        A batch that is approved already, as after a run that died, keeps its approval and is published.
        """
        s = self.state(name, fault)
        before = batch_id in s.approved()
        reason = None if before else blocked_reason(gate_status, other_tests)
        if reason:
            return {"approved": False, "reason": reason}
        if not before:
            s.ledger.approve(s.spec.model, batch_id, at, claimed=True)
        done = s.refresh()
        if not done["ok"]:
            if not before:
                s.ledger.unapprove(s.spec.model, batch_id)
            raise RunError(f"{name}: batch {batch_id} was not published{'' if before else ' and its approval is taken back'}: {done['error']}")
        return {"approved": True} | done

    def run(self, sources: dict[str, DataFrame], batch_id: str, loaded_at: datetime, names: list[str] | None = None, record: bool = True, publish: bool = True, digests: dict[str, str] | None = None, invocation_id: str | None = None) -> list[dict]:
        """One night: every named spec (all if none are named) in turn. Results, also kept as run records.

        Without ``publish``, batches are built and checked, and stay pending. ``digests`` tell sources' rows, where
        they are known. Records are kept by invocation (the batch's id unless given) and node: a repeated run
        replaces its own.
        """
        results = []
        for name in names or list(self.registry.specs):
            s = self.registry[name]
            fresh = self.build(name, sources[s.source], batch_id, loaded_at, (digests or {}).get(s.source))
            results.append({"resource_type": "model", "name": s.model, "status": "success", "message": "" if fresh else "approved before", "completed_at": loaded_at})
            if fresh:
                results += self.check(name, sources[s.source], batch_id, loaded_at)
            if publish:
                done = self.approve(name, batch_id, loaded_at, status_of(results, name), tests_of(results, name))
                results.append({"resource_type": "table", "name": name, "status": "success" if done["approved"] else "skipped", "message": done.get("reason", ""), "completed_at": loaded_at, "row_count": done.get("row_count")})
        if record:
            self.record(results, batch_id, invocation_id or batch_id)
        return results

    def record(self, results: list[dict], batch_id: str, invocation_id: str | None = None) -> None:
        """Keep a run's records: of an invocation one row a node, and one an edge."""
        invocation, at = invocation_id or batch_id, f"{self.root}/operations"
        artifacts.upsert(artifacts.result_frame(self.spark, results, batch_id, invocation), f"{at}/run_results", ["node_id"])
        artifacts.upsert(artifacts.node_frame(self.spark, self.registry, invocation), f"{at}/nodes", ["node_id"])
        artifacts.upsert(artifacts.edge_frame(self.spark, self.registry, invocation), f"{at}/edges", ["parent_id", "child_id"])

    def read(self, name: str) -> DataFrame | None:
        """The consumption table as it is now."""
        return self.state(name).table.read()

    def distributed(self, name: str) -> DataFrame | None:
        """The consumption table in the buckets of its ``dist_column``: it joins with one of equal buckets on that column without an exchange."""
        return self.state(name).table.distributed()

    def description(self, name: str) -> str:
        """What the published table says of itself."""
        manifest = self.state(name).table.manifest()
        return manifest["comment"] if manifest else ""

    def rollback(self, name: str, at: datetime, **anchor) -> dict:
        s = self.state(name)
        return rollback.rollback(s, s.spec.model, at, **anchor)

    def restore(self, name: str, rollback_id: str | None = None) -> dict:
        s = self.state(name)
        return rollback.restore(s, s.spec.model, rollback_id)
