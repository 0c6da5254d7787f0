"""Column checks and freshness: each gives the offending rows, none if all is well."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.spec import ColumnTest


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    """(column, n) of values that stand several times; nulls don't count."""
    return unique_combination(df.where(F.col(column).isNotNull()), [column])


def unique_combination(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.groupBy(*columns).agg(F.count("*").alias("_rows")).where("_rows > 1").withColumnRenamed("_rows", "n")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    """(column, n) of values that aren't accepted; nulls pass."""
    return df.where(~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n"))


def run_test(df: DataFrame, test: ColumnTest) -> DataFrame:
    """The offending rows or values of a spec's column test."""
    if test.kind == "unique_combination":
        return unique_combination(df, list(test.columns))
    (column,) = test.columns
    return {"not_null": not_null, "unique": unique}[test.kind](df, column) if test.kind != "accepted_values" else accepted_values(df, column, list(test.values))


def freshness(df: DataFrame, column: str, as_of: datetime | str, warn_hours: float = 24, error_hours: float = 48) -> DataFrame:
    """One row: latest value, its age in hours and pass, warn or error (no rows at all: error)."""
    newest = df.agg(F.max(F.col(column).cast("timestamp")).alias("latest"))
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("latest")) / 3600
    status = F.when(F.col("age_hours").isNull() | (F.col("age_hours") > error_hours), "error").when(F.col("age_hours") > warn_hours, "warn").otherwise("pass")
    return newest.withColumn("age_hours", age).withColumn("status", status)
