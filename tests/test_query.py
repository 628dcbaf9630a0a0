import pytest
from pyspark.sql import functions as F

from chronolake import EngineError, Key, Query
from chronolake.functions.keys import point_schema

TAGS = ("tag1", "tag2", "tag3")


@pytest.fixture(scope="module")
def dense(spark):
    """10,000 points and some with tags."""
    plain = spark.range(10_000).select(F.col("id").alias("timestamp"), F.lit("metric").alias("metric"), *(F.lit(None).cast("string").alias(f"tag_{t}") for t in TAGS), F.col("id").cast("double").alias("value"))
    more = [(5000, "metric2", "val1", None, None, 2.0), (5002, "metric2", "val1", "val2", None, 4.0), (5002, "metric2", "val1", None, None, 3.0), (5001, "metric1", "val1", None, None, 9.0)]
    points = plain.unionByName(spark.createDataFrame(more, point_schema(TAGS))).cache()
    return Query(lambda: points, TAGS)


def test_aggregates_over_everything(dense):
    q = dense.where_metric_is("metric")
    assert [q.count(), q.sum(), q.avg(), q.min(), q.max()] == [10_000, 49_995_000, 4999.5, 0, 9999]
    assert dense.count() == 10_004


def test_time_ranges_include_both_ends(dense):
    rows = dense.where_metric_is("metric").where_timestamp_between(5000, 10_000).execute().collect()
    assert [r["value"] for r in rows] == list(range(5000, 10_000))
    assert dense.where_timestamp_between(7, 6).count() == 0


def test_tags_and_key_order(dense):
    q = dense.where_tags_contain(("tag1", "val1")).where_metric_is("metric2")
    assert [q.count(), q.sum(), q.avg(), q.min(), q.max()] == [3, 9, 3, 2, 4]
    assert [r["value"] for r in q.where_timestamp_is(5002).execute().collect()] == [3, 4]
    assert dense.where_tags_contain_any_of(("tag2", "val2"), ("tag3", "x")).count() == 1
    assert dense.where_tags_contain_all_of(("tag1", "val1"), ("tag2", "val2")).count() == 1
    assert dense.where_tags_contain_any_of().count() == 0
    assert dense.where_tags_contain_all_of().count() == 10_004
    assert dense.where_metric_is_any_of("metric1", "metric2").count() == 4
    assert dense.where_metric_is_any_of().count() == 0
    assert dense.where_timestamp_is_any_of(1, 2, 5002).count() == 5
    assert dense.where_timestamp_is_any_of().count() == 0
    assert dense.where(F.col("timestamp") % 2 == 0).where_metric_is("metric").count() == 5000


def test_points_and_ranges_of_keys(dense):
    assert dense.get(5002, "metric2", {"tag1": "val1"}).sum() == 3
    assert dense.get(5002, "metric2", {"tag1": "val1"}).where_metric_is("other").count() == 1
    assert dense.get(5002, "metric2").count() == 0
    assert [r["value"] for r in dense.range(Key(5001, "metric"), Key(5003, "metric")).execute().collect()] == [5001, 9, 5002, 3, 4]
    assert dense.range(Key(5002, "metric2", {"tag1": "val1"}), Key(5002, "metric2", {"tag1": "val1", "tag2": "val2"})).sum() == 3
    assert dense.range(Key(9, "m"), Key(8, "m")).count() == 0


def test_order_of_tag_maps(spark):
    rows = [(1, "m", "1", None, 2.0), (1, "m", None, None, 1.0), (1, "m", None, "1", 4.0), (1, "m", "1", "2", 3.0)]
    points = spark.createDataFrame(rows, point_schema(("a", "b")))
    assert [r["value"] for r in Query(lambda: points, ("a", "b")).where_metric_is("m").execute().collect()] == [1, 2, 3, 4]


def test_errors(dense):
    nothing = dense.where_metric_is("none")
    assert nothing.count() == 0
    for name in ("sum", "avg", "min", "max"):
        with pytest.raises(EngineError, match="empty range"):
            getattr(nothing, name)()
        with pytest.raises(Exception, match="empty range"):
            nothing.aggregate(name).collect()
    with pytest.raises(EngineError, match="No query type"):
        dense.execute()
    with pytest.raises(EngineError, match="already set"):
        dense.get(1, "metric").get(2, "metric")
    with pytest.raises(EngineError, match="aggregable"):
        dense.put(1, "metric", {}, 1).sum()
    with pytest.raises(EngineError, match="tag9"):
        dense.where_tags_contain(("tag9", "x"))
    for metric in ("", "m" * 16):
        with pytest.raises(EngineError, match="Invalid metric"):
            dense.put(1, metric, {}, 1)
    with pytest.raises(EngineError, match="timestamp"):
        dense.get(-1, "metric")
