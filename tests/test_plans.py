"""What plans repeat, and what joins must not pair."""

from pyspark.sql import functions as F

from colophon.functions import citations as c
from colophon.operators import citations as oc
from colophon.operators import joins as j
from colophon.sources import paged


def replaced(df):
    return df._jdf.queryExecution().analyzed().toString().count("regexp_replace")


def test_lines_are_normalised_once(spark):
    """a line's clean form stood in its rules up to 80 times, and was computed as often."""
    pages = spark.createDataFrame([(1, 1, "a")], "d int, p int, t string")
    assert replaced(oc.scored_pages(pages, "d", "p", "t")) < 20
    assert replaced(oc.page_references(pages, "d", "p", "t")) < 50
    assert replaced(pages.select(c.titles(F.col("t")))) < 300


def test_names_are_made_once(spark):
    """the rows that names come from are not read again for every use of the names."""
    rows = spark.range(20).select(F.col("id").alias("i"), F.concat(F.lit("n"), (F.col("id") % 5).cast("string")).alias("name"))
    out = j.allocated_names(rows, "i", "name")
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {r["name"] for r in out.collect()} >= {"n0", "n0_2", "n0_3", "n0_4"}


def test_searches_are_dealt_over_tasks(spark):
    """twenty searches that one aggregation left in one partition are read by many tasks."""
    asked = spark.range(20).groupBy((F.col("id") % 20).alias("slug")).agg(F.lit(3).alias("c")).coalesce(1)
    load = lambda search, page: {"results": [{"id": "W"}] * 3, "meta": {"count": 3}}
    out = paged.scanned(asked, load)
    assert out.count() == 60
    assert out.select(F.spark_partition_id()).distinct().count() > 8
