"""Cursors over many rows."""

from pyspark.sql import functions as F

from memloom.operators import ranking
from memloom.plans.catalogue import QUERIES


def test_a_cursor_is_read_once_a_row(spark):
    """Before, each use of a field read the JSON again."""
    plan = QUERIES["cursor_decoded"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_same_as_decode_cursor(spark):
    good = ranking.encode_cursor("memories", F.lit("1995-01-01"), F.col("id").cast("string"), F.lit("f"))
    texts = spark.range(40).select(F.when(F.col("id") % 4 == 0, good).when(F.col("id") % 4 == 1, F.substring(good, 2, 30)).when(F.col("id") % 4 == 2, F.repeat(F.lit("A"), F.col("id").cast("int"))).alias("c"))
    texts = texts.unionAll(spark.createDataFrame([(None,), ("",), ("A" * 4097,), ("a+b",)], "c string"))
    at, row, why = ranking.decode_cursor(F.col("c"), "memories", F.lit("f"))
    want = texts.select("c", at.alias("at"), row.alias("row"), why.alias("why"))
    got = ranking.with_cursor(texts, F.col("c"), "memories", F.lit("f"), ("at", "row", "why"))
    assert got.where("why IS NULL").count() == 10 and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
