"""Expressions that are computed once, and costs of cuts that come with the words."""

from pyspark.sql import functions as F

from quern.operators import extract, segment


def test_parts_are_cut_once(spark):
    """The text is split into articles (or sections) once, however often the parts are looked at."""
    df = spark.createDataFrame([("Điều 1. Tên\nnội dung của điều này\nĐiều 2: x",)], "c string")
    plan = lambda c: df.select(c.alias("r"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan(extract.articles(F.col("c"), F.lit("T"), F.lit("9"))).count("split(") == 1
    assert plan(extract.sections(F.col("c"))).count("split(") == 2  # by articles or by chapters


def test_cost_of_a_cut(spark):
    entries = spark.createDataFrame([("a", 100), ("b", 200), ("a b", 250)], "word string, cost long")
    rows = spark.createDataFrame([("a b",), ("a  c b",), ("",), (None,)], "t string")
    got = [r.w for r in rows.select(segment.segmented_at(F.col("t"), entries).alias("w")).collect()]
    assert [(w.words, w.cost) for w in got[:3]] == [(["a b"], 250), (["a", "c", "b"], 100 + 1250 + 200), ([], 0)]
    assert got[3].words == [] and got[3].cost == 0  # no text has no words, as before
