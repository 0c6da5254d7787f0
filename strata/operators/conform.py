"""Conformance: source values to canonical codes by override, else by code or name, else unmatched."""

from __future__ import annotations

from functools import partial, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: names compare without case and accents.
NAME_COLLATION = "UNICODE_CI_AI"


def normalise(value: Column) -> Column:
    return F.upper(F.trim(value))


def _name_key(value: Column, collation: str) -> Column:
    return F.collate(F.trim(value), collation)


def _one_a_key(df: DataFrame, message: str) -> DataFrame:
    """Rows of (key, value), one a key; the query that reads the value of a repeated key fails."""
    key, value = df.columns
    held = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.first(value).alias(value))
    return held.select(key, F.when(F.col("_n") > 1, F.raise_error(F.lit(message))).otherwise(F.col(value)).alias(value))


def conform_dimension(
    source: DataFrame, canonical: DataFrame, overrides: DataFrame, entity: str, system: str, match_key: str, source_column: str, code_column: str, name_column: str,
    override_code_column: str = "canonical_code", collation: str = NAME_COLLATION, check_unique: bool = True,
) -> DataFrame:
    """The source with ``canonical_<entity>_code``, ``canonical_<entity>_name`` and ``<entity>_match_status``.

    ``match_key`` is "code" or "name". Status: override, exact_code, exact_name or unmatched.
    An override without a code falls through to the match; one to a code that the canonical
    table lacks keeps its status and has no name. Repeated overrides or canonical values would
    multiply rows: either side is reduced to a row a key as part of the join, and the query fails where
    that meets a repeated one (``check_unique`` off: rows are multiplied). Whether a side is
    broadcast is left to Spark, which knows its size.
    """
    if match_key not in ("code", "name"):
        raise ValueError("match_key is code or name")
    by_name = match_key == "name"
    key = partial(_name_key, collation=collation) if by_name else normalise
    mine = overrides.where((normalise(F.col("source_system")) == system.strip().upper()) & (F.lower(F.trim("match_key")) == match_key))
    mine = mine.select(key(F.col("source_value")).alias("_override_key"), F.col(override_code_column).alias("_override_code"))
    wanted = canonical.select(key(F.col(name_column if by_name else code_column)).alias("_match_key"), F.col(code_column).alias("_match_code"))
    names = canonical.select(normalise(F.col(code_column)).alias("_name_key"), F.col(name_column).alias(f"canonical_{entity}_name"))
    if check_unique:
        mine = _one_a_key(mine, f"{entity}: a repeated override would multiply rows")
        wanted = _one_a_key(wanted, f"{entity}: a repeated canonical {match_key} would multiply rows")
        names = _one_a_key(names, f"{entity}: a repeated canonical code would multiply rows")
    rows = source.withColumn("_key", key(F.col(source_column)))
    rows = rows.join(mine, F.col("_key") == F.col("_override_key"), "left").join(wanted, F.col("_key") == F.col("_match_key"), "left")
    status = F.when(F.col("_override_code").isNotNull(), "override").when(F.col("_match_code").isNotNull(), f"exact_{match_key}").otherwise("unmatched")
    rows = rows.withColumn(f"canonical_{entity}_code", F.coalesce("_override_code", "_match_code")).withColumn(f"{entity}_match_status", status)
    rows = rows.withColumn("_code", normalise(F.col(f"canonical_{entity}_code")))
    rows = rows.join(names, F.col("_code") == F.col("_name_key"), "left")
    return rows.select(*(F.col(f"`{c}`") for c in source.columns), f"canonical_{entity}_code", f"canonical_{entity}_name", f"{entity}_match_status")


def unmatched_report(entity: str, conformed: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(source_system, source_value, n) of unmatched values, for (frame, system, source column) each."""
    parts = [
        df.where(F.col(f"{entity}_match_status") == "unmatched").groupBy(F.col(column).cast("string").alias("source_value")).agg(F.count("*").alias("n"))
        .select(F.lit(system).alias("source_system"), "source_value", "n")
        for df, system, column in conformed
    ]
    return reduce(DataFrame.unionByName, parts)


country_conform = partial(conform_dimension, entity="country", override_code_column="canonical_country_code")
country_unmatched_report = partial(unmatched_report, "country")
