"""Rows to append: changed versions of a dimension, and snapshots of a fact.

A key's rows of one date collapse in an aggregation, so a key that holds a third
of all rows is reduced on the map side. Everything after that is partitioned by
the keys once: deduplicated rows, the lag over them and the join with the latest
stored version share that partitioning.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.functions.keys import surrogate_key
from strata.functions.types import resolve_attributes
from strata.spec import FIRST_DATE, DimensionSpec, SnapshotSpec

STAMPS = ("_batch_id", "_loaded_at")


def high_water(history: DataFrame, date_column: str) -> date | None:
    """The latest stored date over all keys, read once by the driver: a literal reaches the source's scan."""
    return history.agg(F.max(date_column)).first()[0]


def _deduplicated(rows: DataFrame, keys: list[str], order: tuple[str, ...]) -> DataFrame:
    """One row of each key: the first by ``order`` (names, "name desc" for falling), then by all columns. Nulls come first."""
    others = [c for c in rows.columns if c not in keys]
    if any(o.lower().endswith((" desc", " asc")) for o in order):
        by = [F.expr(o.rsplit(" ", 1)[0]).desc_nulls_last() if o.lower().endswith(" desc") else F.expr(o.rsplit(" ", 1)[0] if o.lower().endswith(" asc") else o).asc_nulls_first() for o in order]
        w = Window.partitionBy(*keys).orderBy(*by, *(F.col(f"`{c}`").asc_nulls_first() for c in others))
        return rows.withColumn("_row", F.row_number().over(w)).where("_row = 1").drop("_row")
    first = F.min(F.struct(*(F.col(f"`{c}`").alias(f"o{i}") for i, c in enumerate(order)), *(F.col(f"`{c}`") for c in others))).alias("_first")
    return rows.groupBy(*keys).agg(first).select(*keys, *(F.col(f"_first.`{c}`") for c in others))


def _source_rows(source: DataFrame, spec: DimensionSpec | SnapshotSpec, history: DataFrame | None, own: list[str]) -> tuple[DataFrame, list[str]]:
    fixed = [*spec.natural_key, spec.source_date, *own]
    not_attributes = {*fixed, spec.surrogate_key, spec.date_column, "valid_to", "is_current", *STAMPS}
    found = resolve_attributes(source.schema, history.schema if history is not None else None, not_attributes)
    rows = source.select(*spec.natural_key, F.col(spec.source_date).cast("date").alias(spec.date_column), *own, *found.projection)
    return rows, found.names


def _after(rows: DataFrame, date_column: str, history: DataFrame | None, since: date | None) -> DataFrame:
    """Rows past the high-water mark; on a first run all of them, those without a date included."""
    if history is None:
        return rows
    mark = since or high_water(history, date_column)
    return rows.where(F.col(date_column) > F.lit(mark or FIRST_DATE).cast("date"))


def _stamped(rows: DataFrame, spec: DimensionSpec | SnapshotSpec, own: list[str], attributes: list[str], batch_id: str, loaded_at: datetime | str) -> DataFrame:
    key: Column = surrogate_key(spec.natural_key, spec.date_column, spec.key_width).alias(spec.surrogate_key)
    at = F.date_trunc("second", F.lit(loaded_at).cast("timestamp")).alias("_loaded_at")
    return rows.select(key, *spec.natural_key, spec.date_column, *own, *(F.col(f"`{a}`") for a in attributes), F.lit(batch_id).alias("_batch_id"), at)


def changed_versions(source: DataFrame, spec: DimensionSpec, batch_id: str, loaded_at: datetime | str, history: DataFrame | None = None, since: date | None = None, latest: DataFrame | None = None) -> DataFrame:
    """Versions to append: rows past the global high-water mark whose hash differs from the one before.

    ``history`` are the approved rows; None on a first run. The hash before is that of the
    key's previous date in this batch, else that of its latest stored version, so a null
    hash is kept on a new key and dropped on a known one. With ``latest`` (keys and hash of each
    key's latest version, a row a key) and ``since`` (the mark) no row of history is read.
    """
    keys, stored_hash = list(spec.natural_key), "_stored_hash"
    rows, attributes = _source_rows(source, spec, history, [spec.hash_column])
    rows = _after(rows, spec.date_column, history, since)
    rows = _deduplicated(rows, [*keys, spec.date_column], spec.dedupe)
    before = F.lag(spec.hash_column).over(Window.partitionBy(*keys).orderBy(F.col(spec.date_column).asc_nulls_first()))
    if history is None:
        rows = rows.withColumn("_before", before)
    else:
        if latest is None:
            latest = history.groupBy(*keys).agg(F.max_by(spec.hash_column, spec.date_column).alias(stored_hash))
        else:
            latest = latest.select(*keys, F.col(spec.hash_column).alias(stored_hash))
        rows = rows.join(latest, keys, "left").withColumn("_before", F.coalesce(before, F.col(stored_hash)))
    changed = rows.where(F.col("_before").isNull() | (F.col("_before") != F.col(spec.hash_column)))
    return _stamped(changed, spec, [spec.hash_column], attributes, batch_id, loaded_at)


def snapshot_rows(source: DataFrame, spec: SnapshotSpec, batch_id: str, loaded_at: datetime | str, history: DataFrame | None = None, since: date | None = None) -> DataFrame:
    """Snapshots to append: every key of every new date once, changed or not."""
    rows, attributes = _source_rows(source, spec, history, [])
    rows = _after(rows, spec.date_column, history, since)
    rows = _deduplicated(rows, [*spec.natural_key, spec.date_column], spec.dedupe)
    return _stamped(rows, spec, [], attributes, batch_id, loaded_at)
