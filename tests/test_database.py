import io

import pytest
from pyspark.sql import functions as F

from chronolake import Database, EngineError, Key
from chronolake.functions.display import entry_text, parse_entry, parse_key, parse_points, scalar_text
from chronolake.sources.mock import random_points


@pytest.fixture
def db(spark, tmp_path):
    return Database(spark, str(tmp_path / "base"))


def run(db, text):
    out = io.StringIO()
    db.run(text, out)
    return out.getvalue()


def test_key_text():
    key = Key(1, "metric1", {"tag2": "value2", "tag1": "value1"})
    assert str(key) == "{00000000000000000001}{metric1}{tag1:value1,tag2:value2}"
    assert parse_key(str(key)) == Key(1, "metric1", {"tag1": "value1", "tag2": "value2"})
    assert entry_text(Key(1, "metric"), 1) == "[{00000000000000000001}{metric}{}|1]"
    assert parse_entry("[{00000000000000000001}{metric}{}|null]") == (Key(1, "metric"), None)
    assert parse_points("[]") == [] and len(parse_points("[[{00000000000000000001}{m}{}|1];[{00000000000000000002}{m}{}|2]]")) == 2
    assert (scalar_text(22.5), scalar_text(2), entry_text(Key(1, "m"), 1234567.0)[-12:]) == ("22.500000", "2", "1.23457e+06]")


SETUP = """
CREATE TABLE sensors TAGS location, type;
PUT temperature 1000 22.4 INTO sensors TAGS location=room1, type=celsius;
PUT temperature 1005 23.1 INTO sensors TAGS location=room1, type=celsius;
PUT temperature 1010 21.8 INTO sensors TAGS location=room2, type=celsius;
PUT humidity 1000 55.3 INTO sensors TAGS location=warehouse, type=humidity;
PUT temperature 1010 99 INTO sensors TAGS location=room2, type=celsius;
PUT temperature 1010 21.8 INTO sensors TAGS location=room2, type=celsius;
PUT temperature 1020 50 INTO sensors;
DELETE temperature 1020 FROM sensors;
DELETE temperature 7 FROM sensors TAGS location=nowhere;
"""


def test_statements(db):
    assert run(db, SETUP) == ""
    assert run(db, "SELECT DATA temperature FROM sensors ALL;") == (
        "[[{00000000000000001000}{temperature}{location:room1,type:celsius}|22.4];"
        "[{00000000000000001005}{temperature}{location:room1,type:celsius}|23.1];"
        "[{00000000000000001010}{temperature}{location:room2,type:celsius}|21.8]]\n"
    )
    assert run(
        db,
        "SELECT AVG temperature FROM sensors BETWEEN 1000 AND 1005; SELECT COUNT temperature FROM sensors ALL WHERE location=room1;"
        "SELECT MIN humidity FROM sensors AT 1000 WHERE location=warehouse; SELECT MAX temperature FROM sensors ALL; SELECT SUM temperature FROM sensors ALL;"
        "SELECT COUNT nothing FROM sensors ALL; SELECT DATA nothing FROM sensors ALL; TABLES;",
    ) == "22.750000\n2\n55.300000\n23.100000\n67.300000\n0\n[]\nsensors\n"


def test_reopening_compaction_and_pushdown(db, spark):
    run(db, SETUP)
    before = run(db, "SELECT DATA temperature FROM sensors ALL;")
    for _ in range(2):
        again = Database(spark, db.path)
        assert again.get_table("sensors").tag_columns == ["location", "type"]
        assert run(again, "SELECT DATA temperature FROM sensors ALL;") == before
    table = again.get_table("sensors")
    held = table.points()
    table.compact(604_800)
    assert held.count() == 4
    assert run(Database(spark, db.path), "SELECT DATA temperature FROM sensors ALL;") == before
    table.vacuum()
    run(again, "PUT temperature 1000 1 INTO sensors TAGS location=room1, type=celsius; DELETE temperature 1005 FROM sensors TAGS location=room1, type=celsius;")
    assert run(again, "SELECT SUM temperature FROM sensors BETWEEN 0 AND 2000;") == "22.800000\n"
    assert table.query().get(1005, "temperature", {"location": "room1", "type": "celsius"}).count() == 0
    plan = table.query().where_timestamp_between(0, 2000).where_metric_is("temperature").where_tags_contain(("location", "room1")).points()._jdf.queryExecution().toString()
    scan = plan[plan.index("Physical Plan") :]
    assert "PartitionFilters: [isnotnull(bucket" in scan
    assert all(f"EqualTo({c}" in scan for c in ("metric,temperature", "tag_location,room1")) and "GreaterThanOrEqual(timestamp,0)" in scan


def test_bulk_writes(db, spark):
    table = db.create_table("t", ["region"])
    table.put_points(random_points(spark, 1000, {"temperature": (0, 40), "humidity": (0, 100)}, {"region": "eu"}))
    assert table.query().where_metric_is("temperature").count() == 1000 and 0 <= table.query().where_metric_is("temperature").min()
    twice = spark.createDataFrame([(1, "m", 5.0, 2), (1, "m", 6.0, 1)], "timestamp long, metric string, value double, nth long")
    table.put_points(twice, F.col("nth"))
    assert table.query().get(1, "m").sum() == 5
    table.remove_points(twice)
    assert table.query().get(1, "m").count() == 0
    with pytest.raises(EngineError, match="city"):
        table.put_points(twice.withColumn("tag_city", F.lit("x")))
    assert table.log.statistics()["batches"] == 3


def test_tag_columns_lock_while_populated(db):
    table = db.create_table("t", ["a"])
    table.add_tag_column("b")
    table.remove_tag_column("a")
    for wrong in (lambda: table.add_tag_column("b"), lambda: table.remove_tag_column("a"), lambda: table.add_tag_column("B")):
        with pytest.raises(EngineError):
            wrong()
    table.query().remove(1, "m").execute()
    with pytest.raises(EngineError, match="holds data"):
        table.add_tag_column("c")
    table.clear()
    assert table.empty()
    table.add_tag_column("c")
    assert table.tag_columns == ["b", "c"]


def test_catalog(db, spark):
    db.create_table("b")
    db.create_table("a")
    assert db.tables() == ["a", "b"] and db.name == "base"
    with pytest.raises(EngineError, match="already exists"):
        db.create_table("a")
    db.drop_table("a")
    with pytest.raises(EngineError, match="does not exist"):
        db.drop_table("a")
    assert Database(spark, db.path).tables() == ["b"]
    db.clear()
    assert db.tables() == []


def test_errors_of_batches(spark, tmp_path):
    parse_errors, runtime_errors = [], []
    db = Database(spark, str(tmp_path / "base"), parse_errors.append, runtime_errors.append)
    assert run(db, "CREATE TABLE t TAGS a; TABLES; SELECT AVG m FROM t ALL;") == ""
    assert db.tables() == ["t"] and str(runtime_errors[-1]).startswith("[line 1] Runtime error: Cannot aggregate")
    assert run(db, "CREATE TABLE u; SELECT") == "" and db.tables() == ["t"] and len(parse_errors) == 1
    for text in ("SELECT COUNT m FROM nope ALL;", "SELECT COUNT m FROM t ALL WHERE b=c;", "PUT m -1 2 INTO t;", "PUT m 99999999999999999999 2 INTO t;", f"PUT m 1 {'9' * 400} INTO t;", "PUT m 1 1 INTO t TAGS b=c;", "PUT mmmmmmmmmmmmmmmm 1 1 INTO t;", "CREATE TABLE t;", "DROP TABLE u;"):
        before = len(runtime_errors)
        assert run(db, text) == "" and len(runtime_errors) == before + 1, text
    assert run(db, "PUT m 1.9 2 INTO t TAGS a=x, a=y; SELECT DATA m FROM t AT 1;") == "[[{00000000000000000001}{m}{a:x}|2]]\n"


def test_files_and_prompt(db, tmp_path):
    script = tmp_path / "s.vq"
    script.write_text("CREATE TABLE t; // a table\nTABLES;")
    out = io.StringIO()
    db.run_file(str(script), out)
    assert out.getvalue() == "t\n"
    script.write_text("SELECT")
    with pytest.raises(SystemExit) as e:
        db.run_file(str(script))
    assert e.value.code == 65
    script.write_text("DROP TABLE none;")
    with pytest.raises(SystemExit) as e:
        db.run_file(str(script))
    assert e.value.code == 70
    with pytest.raises(EngineError):
        db.run_file("script.txt")
    out = io.StringIO()
    db.run_prompt(io.StringIO("nonsense\nTABLES;\n\nTABLES;\n"), out)
    assert out.getvalue().count("t\n") == 1


def test_stream(db, spark, tmp_path):
    from chronolake.streaming.ingest import append_stream

    table = db.create_table("t", ["a"])
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "m", "x", 1.0), (2, "m", "x", 2.0)], "timestamp long, metric string, tag_a string, value double").write.parquet(source)
    stream = spark.readStream.schema("timestamp long, metric string, tag_a string, value double").parquet(source)
    append_stream(stream, table, str(tmp_path / "cp")).awaitTermination()
    assert table.query().where_metric_is("m").sum() == 3


def test_a_batch_that_was_cut_off_never_counts(db, spark, monkeypatch):
    from chronolake.sources.changelog import ChangeLog

    table = db.create_table("t", ["a"])
    rows = spark.createDataFrame([(1, "m", "x", 1.0)], "timestamp long, metric string, tag_a string, value double")
    save = ChangeLog._save
    monkeypatch.setattr(ChangeLog, "_save", lambda self, **c: (_ for _ in ()).throw(OSError()) if "seq" in c else save(self, **c))
    with pytest.raises(OSError):
        table.put_points(rows)
    monkeypatch.setattr(ChangeLog, "_save", save)
    for opened in (table, Database(spark, db.path).get_table("t")):
        assert opened.points().count() == 0
    table = Database(spark, db.path).get_table("t")
    table.put_points(rows.withColumn("metric", F.lit("n")))
    assert [r["metric"] for r in table.points().collect()] == ["n"]
    assert [r["metric"] for r in Database(spark, db.path).get_table("t").points().collect()] == ["n"]
    table.compact()
    assert table.points().count() == 1 and table.log.windows().collect()[0]["points"] == 1


def test_single_writes_outlive_their_session(db, spark):
    table = db.create_table("t", ["a"])
    table.query().put(1, "m", {"a": "x"}, 1.0).execute()
    table.query().put(2, "m", None, 2.0).execute()
    again = Database(spark, db.path).get_table("t")
    assert again.log.populated and {(r["timestamp"], r["tag_a"], r["value"]) for r in again.points().collect()} == {(1, "x", 1.0), (2, None, 2.0)}
    again.query().remove(1, "m", {"a": "x"}).execute()
    assert Database(spark, db.path).get_table("t").query().where_metric_is("m").count() == 1


def test_bulk_writes_are_checked(db, spark):
    table = db.create_table("t")
    schema = "timestamp long, metric string, value double"
    for row in ((None, "m", 1.0), (-1, "m", 1.0), (1, None, 1.0), (1, "", 1.0), (1, "m" * 16, 1.0), (1, "m", None)):
        with pytest.raises(Exception, match="Invalid timestamp, metric or value"):
            table.put_points(spark.createDataFrame([row], schema))
    assert table.points().count() == 0
    table.put_points(spark.createDataFrame([(1, "m", 1.0)], schema), stream=("s", 0))
    table.put_points(spark.createDataFrame([(1, "m", 9.0)], schema), stream=("s", 0))
    assert [r["value"] for r in table.points().collect()] == [1.0]


def test_buckets_that_widen_with_age(db, spark):
    table = db.create_table("t")
    day = 86_400
    rows = spark.range(0, 4000, 7).selectExpr(f"id * {day} + 5 AS timestamp", "'m' AS metric", "cast(id AS double) AS value")
    table.put_points(rows)
    wide = table.log.statistics()["buckets"]
    table.compact_by_age(4000 * day)
    assert table.log.statistics()["buckets"] < wide / 4 and table.points().count() == rows.count()
    table.put_points(rows.where("value % 14 = 0").withColumn("value", F.lit(-1.0)))
    for start in range(0, 4000, 333):
        got = table.query().where_timestamp_between(start * day, (start + 100) * day).points()
        want = rows.where(F.col("timestamp").between(start * day, (start + 100) * day))
        assert got.count() == want.count()
    assert table.query().where_timestamp_is(14 * day + 5).points().first()["value"] == -1.0
    table.cache()
    assert table.points().count() == rows.count()
    table.query().put(3, "m", None, 1.0).execute()
    assert table.points().count() == rows.count() + 1
