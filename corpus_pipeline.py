"""The corpus pipeline: toxicity, quality, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and read again as the next one's docs. Every stage works on all rows that its
predecessor kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.llm import packing, quality, simhash, toxicity
from strata.llm.common import few, named, ship_package, table, written

#: Learned models, tokenizers and components: SQL can't express them; the stages are tested against brute force.
ORACLE_SQL = None


def _free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` doesn't have."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated toxicity stays under 0.7 (operator 6).

    Null and empty texts are scored like any other, texts of any length whole; repeated rows stay or go
    together; without labels all stay; an empty table gives none; further columns, of any name, are kept.
    """
    ship_package(spark)
    score = _free(docs, "score")
    scored = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), F.lit(True), docs.columns, column=score)
    return scored.where(F.col(score) < 0.7).select(*named(docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches 0.3 (operator 9). Edges as in :func:`drop_toxic`."""
    ship_package(spark)
    score = _free(docs, "score")
    scored = quality.score_quality(docs, table(spark, sf_dir, "labels"), F.lit(True), docs.columns, column=score)
    return scored.where(F.col(score) >= 0.3).select(*named(docs.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, the one with the smallest id (operator 2).

    Texts link at a Jaccard similarity of 0.8 or more of their shingles of five words; null text counts
    as empty, and texts without words are one component. Rows that repeat an id and a text count as one,
    unlike texts of one id each for themselves (the smaller digest stands for a component of such); rows
    without an id have nothing to be told apart by and stay. An empty table gives none; further columns,
    of any name, are kept; of rows that repeat id and text an arbitrary one's are.
    """
    ship_package(spark)
    row = _free(docs, "row")
    found = written(simhash.similar_documents(docs, words=5, percent=80, with_row=True), "similar")
    several = bool(found.where("chosen").groupBy("doc_id", "row").count().where("count > 1").limit(1).count())
    gone = few(written(found.where("not chosen").select("doc_id", F.col("row").alias(row)).distinct(), "gone"))
    kept = docs.where("doc_id is not null").withColumn(row, simhash.row_digest()).join(gone, ["doc_id", row], "left_anti")
    kept = kept.dropDuplicates(["doc_id", row]) if several else kept
    return kept.select(*named(docs.columns)).unionByName(docs.where("doc_id is null"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: every piece with its ids and place (operator 1).

    Null text counts as empty: its closing id alone; repeated rows are packed as often as they stand there;
    texts of any length are packed whole; an empty table gives none; further columns are not read.
    """
    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("quality", keep_quality), ("near_duplicates", drop_near_duplicates), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    ship_package(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
