"""Gates: checks on what a batch would publish. Each gives (failure_reason, offending_key) rows; none pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.functions.keys import key_display
from strata.spec import DimensionSpec, SnapshotSpec

#: Reasons as consumers of stored failures know them.
DUPLICATE_KEY = "duplicate surrogate key (grain violation)"
DUPLICATE_SNAPSHOT = "duplicate surrogate key (grain violation: key + snapshot_date)"
NULL_KEY = "null surrogate key, natural key or valid_from"
NULL_SNAPSHOT = "null surrogate key, natural key or snapshot_date"
SEVERAL_CURRENT = "more than one current row for natural key"
NOT_RECONCILED = "missing or stale in dim vs latest extract"
INCOMPLETE = "missing from latest snapshot vs latest source extract"
VOLUME = "volume anomaly: latest extract below trailing average threshold"
VOLUME_SNAPSHOT = "volume anomaly: latest snapshot below trailing average threshold"


def _failures(df: DataFrame, reason: str, key) -> DataFrame:
    return df.select(F.lit(reason).alias("failure_reason"), key.cast("string").alias("offending_key"))


def duplicate_keys(df: DataFrame, spec: DimensionSpec | SnapshotSpec) -> DataFrame:
    reason = DUPLICATE_KEY if isinstance(spec, DimensionSpec) else DUPLICATE_SNAPSHOT
    return _failures(df.groupBy(spec.surrogate_key).count().where("count > 1"), reason, F.col(spec.surrogate_key))


def null_keys(df: DataFrame, spec: DimensionSpec | SnapshotSpec) -> DataFrame:
    reason = NULL_KEY if isinstance(spec, DimensionSpec) else NULL_SNAPSHOT
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in (spec.surrogate_key, spec.date_column, *spec.natural_key)])
    return _failures(df.where(missing), reason, key_display(spec.natural_key))


def several_current(versions: DataFrame, spec: DimensionSpec) -> DataFrame:
    found = versions.where("is_current = 1").groupBy(*spec.natural_key).count().where("count > 1")
    return _failures(found, SEVERAL_CURRENT, key_display(spec.natural_key))


def latest(df: DataFrame, date_column: str) -> DataFrame:
    """Rows of the latest date, which the driver reads once; none where there is no date."""
    return df.where(F.col(date_column) == F.lit(df.agg(F.max(date_column)).first()[0]))


def reconciliation(source: DataFrame, versions: DataFrame, spec: DimensionSpec) -> DataFrame:
    """Rows of the latest extract, repeats included, whose key and hash no current version has."""
    now = versions.where("is_current = 1").select(*spec.natural_key, spec.hash_column)
    missing = latest(source, spec.source_date).join(now, [*spec.natural_key, spec.hash_column], "left_anti")
    return _failures(missing, NOT_RECONCILED, key_display(spec.natural_key))


def completeness(source: DataFrame, history: DataFrame, spec: SnapshotSpec) -> DataFrame:
    """Keys of the latest extract that the latest snapshot lacks; either latest date counts for itself."""
    have = latest(history, spec.date_column).select(*spec.natural_key)
    missing = latest(source, spec.source_date).join(have, list(spec.natural_key), "left_anti")
    return _failures(missing, INCOMPLETE, key_display(spec.natural_key))


def volume_guard(df: DataFrame, date_column: str, factor: float, window: int, reason: str = VOLUME) -> DataFrame:
    """One row if the latest date has fewer rows than ``factor`` times the mean of the last ``window`` dates, itself included."""
    recent = df.groupBy(date_column).agg(F.count("*").alias("n")).orderBy(F.col(date_column).desc_nulls_last()).limit(window)
    stats = recent.agg(F.avg(F.col("n").cast("double")).alias("mean"), F.max_by("n", date_column).alias("latest"))
    return _failures(stats.where(F.coalesce("latest", F.lit(0)) < factor * F.coalesce("mean", F.lit(0.0))), reason, F.lit(None))


def recent_volumes(df: DataFrame, date_column: str, window: int) -> list[tuple]:
    """(date, rows) of the last ``window`` dates, latest first: as many rows as the window has, read by the driver."""
    counts = df.groupBy(F.col(date_column).alias("d")).agg(F.count("*").alias("n"))
    return [(r["d"], r["n"]) for r in counts.orderBy(F.col("d").desc_nulls_last()).limit(window).collect()]


def _of_volumes(spark, volumes: list[tuple], factor: float, reason: str) -> DataFrame:
    low = bool(volumes) and volumes[0][0] is not None and volumes[0][1] < factor * sum(n for _, n in volumes) / len(volumes)
    low = low or bool(volumes) and volumes[0][0] is None and factor > 0  # no date at all: the latest extract has no rows
    return spark.createDataFrame([(reason, None)] if low else [], "failure_reason string, offending_key string")


def _of_groups(df: DataFrame, spec: DimensionSpec | SnapshotSpec) -> DataFrame:
    """:func:`duplicate_keys` and (of a dimension) :func:`several_current` from one aggregation, by surrogate key and by natural key; :func:`null_keys` from a filter.

    A group gives one failure at most, however many rows it has; rows with a null key are told one by one by the
    task that reads them.
    """
    dimension = isinstance(spec, DimensionSpec)
    keys = [F.col(k).alias(f"k{i}") for i, k in enumerate(spec.natural_key)]
    names = [f"k{i}" for i in range(len(keys))]
    now = F.col("is_current") == 1 if dimension else F.lit(False)
    rows = df.select(F.col(spec.surrogate_key).alias("sk"), *keys, now.cast("int").alias("now"))
    sets = [["sk"], names] if dimension else [["sk"]]
    groups = rows.groupingSets(sets, "sk", *names).agg(F.grouping("sk").alias("by_key"), F.count("*").alias("n"), F.sum("now").alias("now"))
    found = F.when((F.col("by_key") == 0) & (F.col("n") > 1), _failure(spec, "duplicate", F.col("sk"))).when((F.col("by_key") == 1) & (F.col("now") > 1), _failure(spec, "current", key_display(names)))
    return groups.select(found.alias("f")).where("f is not null").select("f.failure_reason", "f.offending_key").unionByName(null_keys(df, spec))


def _failure(spec: DimensionSpec | SnapshotSpec, what: str, key):
    of = {"duplicate": (DUPLICATE_KEY, DUPLICATE_SNAPSHOT), "null": (NULL_KEY, NULL_SNAPSHOT), "current": (SEVERAL_CURRENT, SEVERAL_CURRENT)}
    return F.struct(F.lit(of[what][isinstance(spec, SnapshotSpec)]).alias("failure_reason"), key.cast("string").alias("offending_key"))


def gate_columns(spec: DimensionSpec | SnapshotSpec) -> list[str]:
    """What the gates read of the rows they check."""
    own = [spec.hash_column, "is_current"] if isinstance(spec, DimensionSpec) else []
    return [spec.surrogate_key, *spec.natural_key, spec.date_column, *own]


def _on_date(df: DataFrame, column: str, volumes: list[tuple]) -> DataFrame:
    return df.where(F.col(column) == F.lit(volumes[0][0] if volumes else None))


def dimension_gates(source: DataFrame, versions: DataFrame, spec: DimensionSpec) -> DataFrame:
    """All checks of a dimension; ``versions`` is its candidate view.

    ``versions`` is read three times in few columns (give a written table), the source once for its volumes, which
    also name its latest date, and once for that date's rows.
    """
    volumes = recent_volumes(source, spec.source_date, spec.volume_window)
    now = versions.where("is_current = 1").select(*spec.natural_key, spec.hash_column)
    stale = _on_date(source, spec.source_date, volumes).join(now, [*spec.natural_key, spec.hash_column], "left_anti")
    return reduce(DataFrame.unionByName, [_of_groups(versions, spec), _failures(stale, NOT_RECONCILED, key_display(spec.natural_key)), _of_volumes(source.sparkSession, volumes, spec.volume_factor, VOLUME)])


def snapshot_gates(source: DataFrame, history: DataFrame, spec: SnapshotSpec, volumes: list[tuple] | None = None) -> DataFrame:
    """All checks of a snapshot fact; the volume guard counts history rows, and either latest date counts for itself.

    ``volumes`` are history's rows of its last dates where they are kept (``BatchStore.volumes``); without them it is scanned.
    """
    volumes = recent_volumes(history, spec.date_column, spec.volume_window) if volumes is None else volumes
    have = _on_date(history, spec.date_column, volumes).select(*spec.natural_key)
    missing = latest(source, spec.source_date).join(have, list(spec.natural_key), "left_anti")
    return reduce(DataFrame.unionByName, [_of_groups(history, spec), _failures(missing, INCOMPLETE, key_display(spec.natural_key)), _of_volumes(source.sparkSession, volumes, spec.volume_factor, VOLUME_SNAPSHOT)])
