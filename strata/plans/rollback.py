"""Rollback of approved batches, and restoring the last rollback. Only ledger rows change, until the next purge."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class RollbackError(ValueError):
    """A rollback or restore that can't be done."""


def cutoff(entries: list[dict], to_batch_id: str | None = None, to_datetime: str | None = None) -> datetime:
    """The time after which approvals are undone. Exactly one anchor; a date alone means its end."""
    if (to_batch_id is None) == (to_datetime is None):
        raise RollbackError("give either to_batch_id or to_datetime")
    if to_batch_id is not None:
        found = [e["approved_at"] for e in entries if e["batch_id"] == to_batch_id]
        if not found:
            raise RollbackError(f"batch {to_batch_id} was never approved")
        return max(found)
    return datetime.fromisoformat(f"{to_datetime}T23:59:59" if len(to_datetime) == 10 else to_datetime)


def affected(entries: list[dict], after: datetime) -> list[dict]:
    """Approvals strictly later than the cutoff: equal times stay."""
    return [e for e in entries if e["approved_at"] > after]


def affected_batches(ledger: DataFrame, history: DataFrame, model: str, after) -> DataFrame:
    """(batch_id, approved_at, row_count) of what a rollback would undo, oldest first."""
    counts = history.groupBy(F.col("_batch_id").alias("batch_id")).agg(F.count("*").alias("row_count"))
    undone = ledger.where((F.col("model_name") == model) & (F.col("approved_at") > F.lit(after).cast("timestamp")))
    return undone.join(counts, "batch_id", "left").select("batch_id", "approved_at", F.coalesce("row_count", F.lit(0)).alias("row_count"))


def restore_orphans(restored: DataFrame, history: DataFrame) -> DataFrame:
    """Restored batches of which history has no rows any more."""
    return restored.select("batch_id").distinct().join(history.select(F.col("_batch_id").alias("batch_id")), "batch_id", "left_anti")


def rollback(state, model: str, at: datetime, to_batch_id: str | None = None, to_datetime: str | None = None, dry_run: bool = True, purge: bool = False, by: str = "strata") -> dict:
    """Undo approvals of ``model`` after an anchor, and publish again. ``state`` has its ledger, log, store and refresh."""
    entries = state.ledger.entries(model)
    after = cutoff(entries, to_batch_id, to_datetime)
    undone = affected(entries, after)
    batches = [e["batch_id"] for e in undone]
    report = {"model": model, "cutoff": after, "batches": batches, "dry_run": dry_run, "rollback_id": None, "rows": {}}
    if batches and (history := state.store.read()) is not None:
        counts = {r["_batch_id"]: r["count"] for r in history.where(F.col("_batch_id").isin(batches)).groupBy("_batch_id").count().collect()}
        report["rows"] = {b: counts.get(b, 0) for b in batches}
    if dry_run or not batches:
        return report
    report["rollback_id"] = rollback_id = uuid.uuid4().hex
    criteria = f"to_batch_id={to_batch_id}" if to_batch_id is not None else f"to_datetime={to_datetime}"
    for e in undone:
        state.rollbacks.add(rollback_id=rollback_id, model_name=model, batch_id=e["batch_id"], original_approved_at=e["approved_at"].isoformat(), criteria=criteria, executed_at=at.isoformat(), executed_by=by, purged=purge)
    for b in batches:
        state.ledger.unapprove(model, b)
    if purge:
        state.store.purge(set(state.store.batches()) - set(batches))
    return report | {"refresh": state.refresh()}


def restore(state, model: str, rollback_id: str | None = None) -> dict:
    """Approve again, at the original times, what a rollback (the last one unless named) undid."""
    rows = state.rollbacks.rows(model)
    if not rows:
        raise RollbackError(f"{model}: no rollback to restore")
    rollback_id = rollback_id or rows[-1]["rollback_id"]
    wanted = [r for r in rows if r["rollback_id"] == rollback_id]
    if not wanted:
        raise RollbackError(f"{model}: no rollback {rollback_id}")
    held, there = state.ledger.approved(model), set(state.store.batches())
    for r in wanted:
        if r["batch_id"] not in held:
            state.ledger.approve(model, r["batch_id"], r["original_approved_at"])
    orphans = sorted({r["batch_id"] for r in wanted} - there)
    return {"rollback_id": rollback_id, "batches": [r["batch_id"] for r in wanted], "orphans": orphans, "refresh": state.refresh()}
