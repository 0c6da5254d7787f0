"""Views over history: candidate, published, snapshots, points in time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strata.spec import OPEN_END, DimensionSpec, SnapshotSpec


def candidate(history: DataFrame, spec: DimensionSpec) -> DataFrame:
    """All versions with ``valid_to`` (exclusive, 9999-12-31 while open) and ``is_current`` (1 or 0)."""
    following = F.lead("valid_from").over(Window.partitionBy(*spec.natural_key).orderBy(F.col("valid_from").asc_nulls_first()))
    return history.withColumn("valid_to", following).withColumns({
        "is_current": F.when(F.col("valid_to").isNull(), 1).otherwise(0),
        "valid_to": F.coalesce("valid_to", F.lit(OPEN_END).cast("date")),
    })


def approved_only(history: DataFrame, ledger: DataFrame, model: str | None = None) -> DataFrame:
    """Rows of approved batches. The ledger is a few rows, one a batch, so it is broadcast: a shuffle by batch would put a whole batch into one task."""
    batches = (ledger.where(F.col("model_name") == model) if model else ledger).select(F.col("batch_id").alias("_batch_id"))
    return history.join(F.broadcast(batches), "_batch_id", "left_semi").select(history.columns)


def presentation(df: DataFrame, spec: DimensionSpec | SnapshotSpec) -> DataFrame:
    out = {c.lower() for c in spec.presentation_exclude}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in out])


def documented(df: DataFrame, spec: DimensionSpec | SnapshotSpec) -> DataFrame:
    """Columns that the spec describes, with the description as their comment, which Parquet keeps."""
    docs = {k.lower(): v for k, v in spec.column_docs.items()}
    return df.select(*(F.col(f"`{f.name}`").alias(f.name, metadata=f.metadata | {"comment": docs[f.name.lower()]}) if f.name.lower() in docs else F.col(f"`{f.name}`") for f in df.schema.fields))


def published(history: DataFrame, ledger: DataFrame, spec: DimensionSpec) -> DataFrame:
    """The dimension as consumers see it: approval first, validity from what is approved, then the presentation."""
    return presentation(candidate(approved_only(history, ledger, spec.model), spec), spec)


def snapshot_published(history: DataFrame, ledger: DataFrame, spec: SnapshotSpec) -> DataFrame:
    return presentation(approved_only(history, ledger, spec.model), spec)


def as_of(versions: DataFrame, day: Column | str) -> DataFrame:
    """Versions that hold on a day: valid_from <= day < valid_to."""
    d = F.lit(day).cast("date") if isinstance(day, str) else day
    return versions.where((F.col("valid_from") <= d) & (d < F.col("valid_to")))


def current(versions: DataFrame) -> DataFrame:
    return versions.where("is_current = 1")


def join_as_of(facts: DataFrame, versions: DataFrame, keys: list[str], day: str, columns: list[str], how: str = "left") -> DataFrame:
    """Facts with the version of their key on their day (a date, or an instant of it).

    The days on which a key has facts and its versions are sorted together once, and the last version is carried
    forward over the days; facts then get their day's. So a key costs its facts plus its versions, not
    their product. However many facts a key has, its sort holds its days and versions only, and the join
    by key and day may divide a day's facts. A key's versions don't overlap (the gates see to that); where
    they do, the one with the latest start counts, of one start that with the latest end. ``how``: left or inner.
    """
    if how not in ("left", "inner"):
        raise ValueError("how is left or inner")
    names = [f"_k{i}" for i in range(len(keys))]
    of = lambda df: [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names, strict=True)]
    known = lambda df, date: df.where(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*names, date)]))
    held = F.struct(F.col("valid_to").alias("_to"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)))
    v = known(versions.select(*of(versions), F.col("valid_from").cast("date").alias("_day"), held.alias("_version")), "_day")
    days = known(facts.select(*of(facts), F.col(f"`{day}`").cast("date").alias("_day")), "_day").distinct()
    both = v.withColumn("_asked", F.lit(False)).unionByName(days.withColumns({"_version": F.lit(None), "_asked": F.lit(True)}))
    carried = F.last("_version", ignorenulls=True).over(Window.partitionBy(*names).orderBy("_day", "_asked", F.col("_version._to")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    found = both.withColumn("_version", carried).where(F.col("_asked") & (F.col("_day") < F.col("_version._to")))
    found = found.select(*names, F.col("_day").alias("_on"), *(F.col(f"_version._c{i}").alias(f"_c{i}") for i in range(len(columns))))
    joined = facts.join(found, [*(F.col(f"`{k}`") == F.col(n) for k, n in zip(keys, names, strict=True)), F.col(f"`{day}`").cast("date") == F.col("_on")], how)
    return joined.select(*(F.col(f"`{c}`") for c in facts.columns), *(F.col(f"_c{i}").alias(c) for i, c in enumerate(columns)))
