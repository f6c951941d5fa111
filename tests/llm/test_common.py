import pytest
from pyspark.sql import functions as F

from brevispark.llm import common, decontaminate, jaccard_join, language_id, license_scan, pii, queries, sentencepiece_codec, substring_dedup


def test_a_spread_join_equals_a_plain_one(spark, monkeypatch):
    left = spark.range(2000).select((F.col("id") % 7 * (F.col("id") % 2)).alias("k"), F.col("id").alias("x"), F.lit(1).alias("y"))
    right = common.stored(left.groupBy("k").agg(F.count("*").alias("n")).where("k <> 3"), "test-spread").withColumn("z", F.explode(F.array(F.lit(1), F.lit(2))))
    want = sorted(map(tuple, left.join(right, "k").select("k", "x", "y", "n", "z").collect()))
    for part in (1, 50, 10_000):
        monkeypatch.setattr(common, "LEAST_PART", part)
        got = common.spread_join(left, right, "k", "n", ["x"])
        assert sorted(map(tuple, got.select("k", "x", "y", "n", "z").collect())) == want
    assert common.spread_join(left.limit(0), right.limit(0), ["k"], "n", ["x"]).count() == 0


def test_discarded_tables_are_gone(spark):
    table = common.stored(spark.range(3), "test-discard")
    assert table.count() == 3
    common.discard(table, None, spark.range(1))
    with pytest.raises(Exception, match="(?i)does not exist|not_exist"):
        spark.read.schema(table.schema).parquet(table.stored_at).count()


def test_bytes_that_are_no_text_go_through_every_operator(spark):
    df = spark.sql("SELECT 1L AS doc_id, cast(concat(cast('call (555) 123-4567 the ' AS binary), X'61FF80', cast(' end. All rights reserved.' AS binary)) AS string) AS text, 'en' AS lang")
    df = df.unionByName(spark.createDataFrame([(2, "the end of it", "en")], "doc_id bigint, text string, lang string"))
    bench = spark.sql("SELECT 1L AS item_id, cast(concat(X'61FF80', cast(' end' AS binary)) AS string) AS text")
    assert {r.doc_id: len(r.spans) for r in pii.find_personal_data(df).collect()} == {1: 1, 2: 0}
    assert [r.family for r in license_scan.scan_licenses(df).collect()] == ["reserved"]
    assert language_id.identify(df, language_id.train(df)).count() == 2
    assert [r.doc_id for r in decontaminate.find_leaks(df, bench).collect()] == [1]
    assert sentencepiece_codec.encode_documents(df, queries.piece_model_path()).count() == 2
    assert jaccard_join.near_duplicates(df).count() == 2 and substring_dedup.digests(substring_dedup.remove_repeats(df)).count() == 2
