"""Tables that are written once: scopes, removal, and joins with counted keys."""

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import shared
from millrace.llm.minhash import near_duplicates
from millrace.llm.shared import join_counted, removed, scratch, written


def folders(spark):
    base = f"{spark.conf.get('spark.checkpoint.dir').removeprefix('file://')}/millrace-{spark.sparkContext.applicationId}"
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def test_a_scope_removes_what_it_wrote(spark, tmp_path):
    df = spark.range(10)
    stays = written(df, "stays")
    before = folders(spark)
    with scratch():
        inner = written(df, "inner")
        with scratch():
            written(inner, "innermost")
        kept = written(inner, "kept", keep=True)
        near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).write.parquet(str(tmp_path / "out"))
    assert len(folders(spark) - before) == 1 and kept.count() == 10 and stays.count() == 10
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    removed(kept, df)
    assert folders(spark) == before


def test_the_pipeline_leaves_the_last_stages_table_alone(spark):
    spark.range(1).write.mode("overwrite").format("noop").save()
    written(spark.range(1), "first")
    before = folders(spark)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert len([f for f in folders(spark) - before if f.endswith("-pii")]) == 1 == len(folders(spark) - before)
    assert out.count() > 0


def test_hot_keys_join_like_others(spark, monkeypatch):
    rows = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 500 + [2] * 300 + list(range(3, 90)))], "k int, i int")
    keyed = rows.filter("k <> 50").groupBy("k").agg(F.count("*").alias("n"), F.max("i").alias("most"))
    for keys in (1, 4, 1 << 12):
        monkeypatch.setattr(shared, "HOT_KEYS", keys)
        for how in ("inner", "left"):
            got = join_counted(rows, keyed, ["k"], "n", how)
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(keyed, ["k"], how).collect()), key=str) and got.columns == ["k", "i", "n", "most"]
    assert join_counted(rows.limit(0), keyed.limit(0), ["k"], "n", "left").count() == 0


def test_tidy_tables_leave_the_setting_as_it_was(spark):
    """Whether Spark is asked to remove shuffle files is put back, after failures too."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    for tidy in (False, True):
        out = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n")), "tidy", tidy=tidy)
        assert out.agg(F.sum("n")).first()[0] == 1000 and spark.conf.get(name) == before
    with pytest.raises(Exception):
        written(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), "tidy", tidy=True)
    assert spark.conf.get(name) == before
