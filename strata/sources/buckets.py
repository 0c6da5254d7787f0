"""Parquet folders that are dealt into buckets by a column's hash, as Spark's own bucketed tables.

Two such tables of equal buckets join on that column without an exchange. The
session's catalog holds nothing of value: a folder is entered there when it is read,
so any session can read it.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TAKEN = "strata_written_"


def _name(path: str) -> str:
    return f"strata_bucketed_{hashlib.md5(path.encode()).hexdigest()}"


def _escaped(text: str) -> str:
    return text.replace("\\", "\\\\").replace("'", "\\'")


def write_bucketed(df: DataFrame, path: str, column: str, n: int) -> None:
    """Write ``df`` into ``n`` buckets, a file each, sorted by the column. All rows of one value are one bucket's."""
    entry = _TAKEN + hashlib.md5(path.encode()).hexdigest()
    df.repartition(n, column).write.format("parquet").bucketBy(n, column).sortBy(column).option("path", path).mode("error").saveAsTable(entry)
    df.sparkSession.sql(f"drop table {entry}")  # the entry alone: the folder is its own


def read_bucketed(spark: SparkSession, path: str, schema: T.StructType, column: str, n: int) -> DataFrame:
    name = _name(path)
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"create table {name} ({columns}) using parquet clustered by (`{column}`) sorted by (`{column}`) into {n} buckets location '{_escaped(path)}'")
    return spark.table(name)
