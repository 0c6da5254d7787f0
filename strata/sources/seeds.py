"""Seeds: small CSV tables with pinned types, and the usual sources and sinks by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

OVERRIDE_SCHEMA = "source_system string, match_key string, source_value string, canonical_country_code string, note string"


def load_seed(spark: SparkSession, path: str, schema: str = OVERRIDE_SCHEMA) -> DataFrame:
    """A CSV with a header. Text such as NA stays text; a row with too many or too few fields is an error."""
    read = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False)
    return read.option("nullValue", "\u0000").option("emptyValue", "").option("escape", '"').csv(path)


def read_source(spark: SparkSession, path: str, kind: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A table by format: parquet, orc, csv, json. Text formats need a schema: nothing is inferred from data."""
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.options(**({"header": True} if kind == "csv" else {}) | options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def write_sink(df: DataFrame, path: str, dist_column: str | None = None, mode: str = "append", partitions: int | None = None) -> None:
    """Parquet, rows of a distribution key in one file where one is given."""
    if dist_column:
        df = df.repartition(partitions, dist_column) if partitions else df.repartition(dist_column)
    df.write.mode(mode).parquet(path)
