"""Questions that repeat are answered once; numbers in error texts."""

import pytest
from pyspark.sql import functions as F

from quillon.catalog import load_catalog
from quillon.functions import text as T
from quillon.plans import data_queries
from quillon.plans.retrieval import retrieve
from quillon.plans.routing import once


@pytest.mark.parametrize("name", ["routed_questions", "question_contracts", "catalog_context"])
def test_equal_questions_are_answered_once(spark, sf, name):
    """The answers stand below a grouping of the questions, not beside every row."""
    plan = data_queries.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [" in plan and "Join" in plan


def test_once_is_the_same_as_every_time(spark):
    rows = [(1, "gmv by month"), (2, None), (3, "gmv by month"), (4, ""), (5, None), (6, "orders by state"), (6, "orders by state")]
    df = spark.createDataFrame(rows, "id int, question string")
    by_id = lambda d: sorted(map(str, d.select("id", "question", "metrics", "tables", "joins", "reason").collect()))
    assert by_id(once(df, ["question"], lambda q: retrieve(q, load_catalog()))) == by_id(retrieve(df, load_catalog()))


def test_numbers_of_things_are_no_error_codes(spark):
    said = {"something else at event 42501": "unknown", "syntax error at event 42703": "syntax", "row 142601 of batch 42804": "unknown", "relation t does not exist at event 42501": "unknown_table",
            "SQLSTATE 42501": "permission", "ERROR 42703": "unknown_column", "[42601] near x": "syntax", "42p01: t": "unknown_table", "error code 42804": "type_mismatch"}
    df = spark.createDataFrame(list(said.items()), "message string, want string").withColumn("got", T.error_category(F.col("message"))["category"])
    assert {r["message"]: r["got"] for r in df.collect()} == said


def test_error_categories_of_events_numbered_like_codes(spark, tmp_path):
    spark.range(42500, 42810).withColumnRenamed("id", "event_id").write.parquet(f"{tmp_path}/events.parquet")
    for r in data_queries.error_categories(spark, str(tmp_path)).collect():
        assert r["category"] == ["unknown_column", "timeout", "unknown_table", "permission", "syntax", "unknown", "connection"][r["id"] % 7]
