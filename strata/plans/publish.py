"""Publication: write what changed as a version, compare counts, switch, compare again.

A version differs from the one before by the batches that were approved or taken
back since. Only the ranges that hold keys of these are written: a dimension's from
the rows that are published there and those of the new batches, with their
validity anew; of a snapshot, new batches are further files of their ranges, and
only what is taken back is written over. The other ranges' folders are named again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.operators import views
from strata.sources.store import VersionedTable
from strata.spec import DimensionSpec, SnapshotSpec


@dataclass
class Change:
    """What a version writes. ``kept`` are folders of the version before that it names again, by range."""

    rows: DataFrame
    n: int
    batches: dict[str, str]
    kept: dict[str, list[str]] = field(default_factory=dict)
    kept_rows: dict[str, int] = field(default_factory=dict)


def range_columns(spec: DimensionSpec | SnapshotSpec) -> list[str]:
    """What deals rows into ranges: the distribution column, if it keeps a key's versions together, else the key."""
    return [spec.dist_column] if isinstance(spec, SnapshotSpec) or spec.dist_column in spec.natural_key else list(spec.natural_key)


def plan_change(state) -> Change:
    """The change from the current version to the approved batches; the whole table where there is none to start from.

    The whole is written, too, where the presentation leaves out ``_batch_id``, so that rows of a batch can't be told,
    where most ranges are touched anyway, and where the table has outgrown its ranges.
    """
    spec, table, view = state.spec, state.table, state.view()
    batches = {b: i for b, i in state.ledger.identities(spec.model).items() if b in set(state.store.batches())}
    old, columns = table.manifest(), range_columns(spec)
    columns = [c for c in columns if c in view.columns] or list(spec.natural_key)

    def whole() -> Change:
        return Change(view, table.ranges_for(state.store.read(set(batches)).count()), batches)

    if old is None or "_batch_id" not in view.columns or old["columns"] != columns or old["n"] * 4 < table.ranges_for(sum(old["rows"].values())):
        return whole()
    gone = {b for b, i in old["batches"].items() if batches.get(b) != i}
    new = {b for b, i in batches.items() if old["batches"].get(b) != i}
    where = F.col("_batch_id").isin(sorted(gone)) if gone else F.lit(False)
    ranges = lambda df: {r[0] for r in df.select(table.range_of(columns, old["n"])).distinct().collect()}  # noqa: E731  numbers below n
    before = table.rows_of(old)
    back = ranges(before.where(where)) if gone else set()
    added = state.store.read(new)
    into = ranges(added) if new else set()
    dimension = isinstance(spec, DimensionSpec)
    crowded = {int(k) for k, folders in old["ranges"].items() if len(folders) >= table.parts}
    rewritten = back | (into if dimension else into & crowded)
    if 2 * len(rewritten) > old["n"] > 1:
        return whole()
    stays = table.rows_of(old, rewritten).where(~where)
    stays = stays.select(*(F.col(f"`{c}`") for c in stays.columns if not dimension or c not in ("valid_to", "is_current")))
    shown = [f.name for f in added.schema.fields if f.name in view.columns]
    rows = stays.unionByName(added.select(*(F.col(f"`{c}`") for c in shown)), allowMissingColumns=True)
    if dimension:
        rows = views.presentation(views.candidate(rows, spec), spec)
    rows = views.documented(rows.select(*(F.col(f"`{c}`") for c in view.columns)), spec)
    kept = {k: v for k, v in old["ranges"].items() if int(k) not in rewritten}
    return Change(rows, old["n"], batches, kept, {k: n for k, n in old["rows"].items() if k in kept})


def unchanged(state) -> int | None:
    """The current version's rows, if it is of the batches that are approved now, in the columns of now."""
    old, there = state.table.manifest(), set(state.store.batches())
    if old is None or old["schema"] != state.view().schema.json() or old["comment"] != state.spec.description or bool(old.get("buckets")) != bool(state.spec.dist_buckets):
        return None
    return sum(old["rows"].values()) if old["batches"] == {b: i for b, i in state.ledger.identities(state.spec.model).items() if b in there} else None


def refresh(state, fault: Callable[[str], None] | None = None, tries: int = 3) -> dict:
    """``{"ok": True, "row_count": n, "written": rows}`` or ``{"ok": False, "error": …}``; readers see the old version or the new.

    Rows are counted while they are written. Whatever fails after the switch and before the new version is
    verified withdraws it again, so a version whose approval is taken back is never the current one. Where another
    publication was faster, the change is planned anew from its version. Old versions that couldn't be removed stay
    for the next time. ``fault`` is called with the name of each step before it, for tests of failures between steps.
    """
    table: VersionedTable = state.table
    step, folder, switched = fault or (lambda _: None), None, None

    def undo() -> None:
        if switched is not None:
            table.withdraw(switched)
            if switched in table.versions():
                raise RuntimeError(f"version {switched} is still marked")
        if folder is not None:
            table.discard(folder)

    try:
        step("write")
        if (same := unchanged(state)) is not None:
            return {"ok": True, "row_count": same, "written": 0}
        version = max([0, *table.versions()]) + 1
        change = plan_change(state)
        columns = [c for c in range_columns(state.spec) if c in change.rows.columns] or list(state.spec.natural_key)
        folder, expected = table.write_version(change.rows, columns, change.n)
        step("count")
        built = table.written(folder)
        if expected != sum(built.values()):
            raise ValueError(f"the view has {expected} rows, the new version {sum(built.values())}")
        ranges, rows = dict(change.kept), dict(change.kept_rows)
        for k, n in built.items():
            ranges[str(k)] = [*ranges.get(str(k), []), f"{folder}/_range={k}"]
            rows[str(k)] = rows.get(str(k), 0) + n
        manifest = {"n": change.n, "columns": columns, "ranges": ranges, "rows": rows, "batches": change.batches, "schema": state.view().schema.json(), "comment": state.spec.description}
        if state.spec.dist_buckets:
            step("distribute")
            manifest["buckets"] = table.distribute(manifest, folder, state.spec.dist_column, state.spec.dist_buckets)
        step("switch")
        table.switch(version, manifest)
        switched = version
        step("verify")
        total, n = sum(rows.values()), table.rows_of(table.manifest(version)).count()
        if n != total:
            raise ValueError(f"after the switch there are {n} rows, not {total}")
    except FileExistsError as e:
        undo()
        return refresh(state, fault, tries - 1) if tries > 1 else {"ok": False, "error": f"other publications were faster: {e}"}
    except Exception as e:
        undo()
        return {"ok": False, "error": f"{type(e).__name__}: {e}"}
    done = {"ok": True, "row_count": total, "written": expected}
    try:
        step("tidy")
        table.tidy()
    except Exception as e:
        return done | {"warning": f"old versions stay: {type(e).__name__}: {e}"}
    return done
