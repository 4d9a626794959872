"""The pipeline: every stage alone, and all of them."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import stages

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("k", range(4))
def test_stages_keep_the_columns(spark, docs, nothing, k):
    stage = corpus_pipeline.STAGES[k][1]
    for table in (docs, nothing):
        got = stage(spark, table, SF)
        assert got.columns == table.columns and [t for _, t in got.dtypes] == [t for _, t in table.dtypes]
        assert got.count() <= table.count()


def test_one_of_each_group_stays(spark, docs, corpus):
    got = stages.drop_copies(spark, docs, SF).collect()
    ids = [r["doc_id"] for r in got]
    assert [i for i in ids if i is not None and 100 <= i < 220] == [100]
    assert ids.count(500) == 2 and {400, 401, 402, 600, 601} <= set(ids) and ids.count(None) == 2


def test_documents_of_old_lines_go(spark, docs, corpus):
    ids = [r["doc_id"] for r in stages.drop_lines(spark, docs, SF).collect()]
    assert [i for i in ids if i is not None and 100 <= i < 130] == [100]
    assert {400, 401, 402, 403, 404, 405} <= set(ids) and set(range(40)) <= set(ids)


def test_repeats_go_and_rows_stay(spark, docs, corpus):
    got = {r["doc_id"]: r for r in stages.drop_repeats(spark, docs, SF).collect()}
    assert len(got) == len({i for i, _ in corpus})
    assert got[100]["text"] == "" and got[100]["n_chars"] == 0 and len(got[300]["text"]) < 400
    assert got[0]["text"] == dict(corpus)[0]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    order = ["doc_id", "piece"]
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    same = lambda df: [tuple(r)[:5] for r in df.orderBy(*order).collect()]
    assert same(got) == same(now)
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 2048").count() == 0
    assert got.select("doc_id").distinct().count() < docs.count()


def test_clean_documents_stay(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    kept = stages.keep_good(spark, docs, "/root/testdata/sf0.01").select("doc_id")
    good = labels.filter("quality = 1")
    assert good.join(kept, "doc_id").count() >= 0.98 * good.count()


def test_sweep_deletes_what_was_stored(spark):
    from sparkloom.llm import common

    path = common.stored(spark.range(3), "three").inputFiles()[0]
    assert common.sweep(spark) >= 1 and common.sweep(spark) == 0
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not to.getFileSystem(spark._jsc.hadoopConfiguration()).exists(to)
