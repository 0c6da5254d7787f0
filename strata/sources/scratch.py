"""Scratch tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from strata.sources.files import Folder


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder is made and set, on one machine only."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-strata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path beneath the shared folder, which goes when the application ends."""
    root = f"{shared_dir(spark).rstrip('/')}/strata-{uuid.uuid4().hex}"
    Folder(spark, root).on_exit()
    return f"{root}/{name}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._scratch = path
    return found


def discard(*tables: DataFrame) -> None:
    """Remove tables that :func:`written` gave and nothing reads any more."""
    for t in tables:
        at = t._scratch.rsplit("/", 1)
        Folder(t.sparkSession, at[0]).delete(at[1])
