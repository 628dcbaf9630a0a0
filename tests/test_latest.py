import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from chronolake.sources import changelog


def rows_sorted(spark, frame):
    """Rows that come into each sort of a plan that has run, but for those behind another one."""

    def below(node):
        if node.metrics().contains("numOutputRows"):
            return node.metrics().apply("numOutputRows").value()
        return below(node.children().apply(0))

    def walk(node):
        children = [node.children().apply(n) for n in range(node.children().size())]
        return ([below(children[0])] if node.nodeName() == "Sort" else []) + [x for c in children for x in walk(c)]

    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return frame.collect(), walk(frame._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """6,000 lines of 20 keys, of which up to three have an order in common."""
    base = str(tmp_path_factory.mktemp("lines"))
    lines = spark.range(6000).selectExpr(
        "id DIV 3 AS l_orderkey", "hash(id) % 50 AS l_partkey", "id % 7 AS l_suppkey", "cast(hash(id, 1) % 2 AS int) AS l_linenumber",
        "cast(id AS double) AS l_quantity", "cast(id % 4 AS double) AS l_extendedprice", "id / 8 AS l_discount", "id / 16 AS l_tax",
        "'N' AS l_returnflag", "if(id DIV 3 % 2 = 0, 'O', NULL) AS l_linestatus", "TIMESTAMP_NTZ '1996-01-01 00:00:00' + make_interval(0, 0, 0, int(id DIV 3 % 20)) AS l_shipdate",
    )
    lines.coalesce(3).write.parquet(f"{base}/lineitem.parquet")
    return base


def test_only_the_newest_order_of_a_key_is_sorted(spark, folder):
    rows, sorted_rows = rows_sorted(spark, __spark_entry__.queries()["scan_current_upsert"](spark, folder))
    assert sorted_rows and max(sorted_rows) <= 60
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").collect()
    newest = {}
    for r in lines:
        key, seq = (r["l_shipdate"], r["l_linestatus"]), (r["l_orderkey"], r["l_linenumber"], r["l_partkey"], r["l_suppkey"], r["l_extendedprice"])
        newest[key] = max(newest.get(key, (seq, r)), (seq, r), key=lambda x: x[0])
    want = {m: (len(newest), round(sum(r[f"l_{m}"] for _, r in newest.values()), 4)) for m in ("quantity", "extendedprice", "discount", "tax")}
    assert {r["metric"]: (r["n"], r["total"]) for r in rows} == want


@pytest.mark.parametrize("bounded", [0, 3, 200_000])
def test_the_leading_order_changes_no_result(spark, monkeypatch, bounded):
    monkeypatch.setattr(changelog, "BOUNDED", bounded)
    some = random.Random(1)
    rows = [(some.randrange(5), some.choice(["m", "n"]), some.choice([None, "x"]), some.choice("PPD"), some.choice([None, 1, 2, 3, 4]), n) for n in range(400)]
    log = spark.createDataFrame(rows + [(9, "m", None, "P", None, 400), (9, "m", None, "P", None, 401)], "timestamp long, metric string, tag_a string, op string, a long, b long")
    log = log.withColumn("seq", F.struct("a", "b"))
    found = [sorted(map(str, changelog.current(log, ["a"], [F.desc("seq")], leading=leading).collect())) for leading in (None, F.col("seq.a"))]
    assert found[0] == found[1] and len(found[0]) > 5
