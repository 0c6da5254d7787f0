"""The pipeline's stages: columns, decisions, edges."""

from pyspark.sql import functions as F

import corpus_pipeline
from strata.llm.common import written
from tests.llm.conftest import ODD_TEXTS, prose

SF = "/root/testdata/sf0.001"


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = [docs.count()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = written(stage(spark, docs, SF), name)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns and out.join(docs, "doc_id", "left_anti").count() == 0
            assert out.select("doc_id", "text").subtract(docs.select("doc_id", "text")).count() == 0
            kept.append(out.count())
            docs = out
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.4 * kept[0]
    assert set(corpus_pipeline.run(spark, SF).columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}


def test_one_of_each_group_stays(spark, documents):
    docs = documents([*ODD_TEXTS, *(["one two three four five six seven"] * 40)])
    out = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    texts = [r.text for r in out.collect()]
    assert texts.count("one two three four five six seven") == 1 and texts.count("same") == 1
    repeated = docs.unionByName(docs).unionByName(docs.where("doc_id = 4").withColumn("doc_id", F.lit(None).cast("long")))
    assert corpus_pipeline.drop_near_duplicates(spark, repeated, SF).count() == out.count() + 1


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_unlike_texts_of_one_id_are_told_apart(spark, documents, rng):
    one, two, three = (prose(rng, 80) for _ in range(3))
    docs = documents([one, two, three, one + " x", one, two, three], [1, 3, 3, 3, 5, 5, 3]).coalesce(1)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, one), (3, two), (3, three)])


def test_columns_of_any_name_are_kept(spark, documents, rng):
    toxic = ["you idiot stupid hate " * 5, prose(rng, 40)]
    docs = documents([prose(rng, 50), *toxic, None]).withColumns({"a.b": F.lit(1), "back`tick": F.lit("x"), "_row": F.lit(2), "score ": F.lit(3)})
    unlabelled = "/nowhere"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        for sf in (SF, None):
            if sf is None and name == "near_duplicates":
                continue
            with_labels = corpus_pipeline.table
            corpus_pipeline.table = with_labels if sf else lambda spark, sf_dir, name: spark.createDataFrame([], "doc_id long, quality int, toxic int")
            try:
                out = stage(spark, docs, sf or unlabelled)
                assert out.columns == docs.columns and {(r["a.b"], r["back`tick"], r["_row"], r["score "]) for r in out.collect()} <= {(1, "x", 2, 3)}
            finally:
                corpus_pipeline.table = with_labels
    assert corpus_pipeline.pack(spark, docs, SF).count() >= 4


def test_text_that_is_not_utf8_passes_all_stages(spark, documents, rng):
    odd = spark.sql("select 900L doc_id, cast(x'4F6BFF2E20776F726473' as string) text, 'en' lang, 's' source, 5L n_chars, 'x' fp, -1 rank, 0.5D score")
    docs = documents([prose(rng, 50), prose(rng, 60)]).unionByName(odd)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, SF), name)
        assert docs.where("doc_id = 900").count() >= 1, name


def test_long_texts_and_copies_pass_the_near_duplicates(spark, documents, rng):
    long = prose(rng, 150_000)  # above a million characters
    assert len(long) > 1_000_000
    docs = documents([long, long + " end", prose(rng, 30), *([prose(rng, 12)] * 1500)])
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [0, 2, 3]
