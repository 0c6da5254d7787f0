"""Labelled samples of a bounded size, and scored rows: what the two classifiers share.

Defined results: labels other than 0 and 1, null ids and ids without a document
give no sample row; without labels the sample is empty; kept columns may have any
name and type; an empty table gives none.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strata.llm.common import crc_mod, named, quoted


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, bound: int, seed: int = 11) -> DataFrame:
    """(doc_id, text, label double, part int of 0 to 9): one row for each of at most ``bound`` labelled ids, those with the smallest keyed hashes.

    Labels are read only where ``allowed`` (a condition on doc_id) holds. Of conflicting labels of an id the
    greatest counts, of repeated ids the smallest text; null texts are empty.
    """
    order = F.xxhash64(F.lit(seed), "doc_id")
    chosen = labels.where(allowed & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).cast("double").alias("label")).orderBy(order, "doc_id").limit(bound)
    # `bound` ids and labels: a size that does not follow the input
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    one = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))
    return one.withColumn("part", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(10)).cast("int"))


def with_row(docs: DataFrame, keep: list[str], field: T.StructField) -> tuple[DataFrame, T.StructType]:
    """(_row, text): the kept columns as one struct, so that no name of theirs meets one of ours; and the type of (_row, field).

    Where the text is kept anyway it is in the struct alone (:func:`text_in`), so that a batch holds it once.
    """
    there = "text" in keep and isinstance(docs.schema["text"].dataType, T.StringType)
    rows = docs.select(F.struct(*named(keep)).alias("_row"), *([] if there else [F.col("text").cast("string").alias("text")]))
    return rows, T.StructType([T.StructField("_row", rows.schema["_row"].dataType), field])


def text_in(batch: pa.RecordBatch) -> pa.Array:
    """The texts of a batch of :func:`with_row`."""
    return batch.column("text") if "text" in batch.schema.names else batch.column("_row").field(batch.schema.field("_row").type.get_field_index("text"))


def kept(scored: DataFrame, keep: list[str], score: Column, name: str) -> DataFrame:
    """The kept columns again, and a score."""
    return scored.select(*(F.col(f"_row.{quoted(c)}").alias(c) for c in keep), score.alias(name))


def held_out(modulus: int, remainder: int) -> Column:
    return F.coalesce(crc_mod("doc_id", modulus) == remainder, F.lit(False))
