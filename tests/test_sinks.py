from photoflow.operators import cleaning as C
from photoflow.sources import sinks
from photoflow.sources.curves import read_curves


def test_cleaned_tables_come_back(spark, tmp_path):
    rows = [("007", "c", 4.0 * i, float(i % 7), 0.05) for i in range(40)]
    found = C.clean(spark.createDataFrame(rows, "source string, component string, t double, y double, s double"))
    sinks.write_cleaned(found, str(tmp_path))
    back = read_curves(spark, str(tmp_path / "clean"))
    assert back.count() == found.clean.count() and back.first().source == "007"
    assert spark.read.option("header", True).csv(str(tmp_path / "removed_by_reason")).count() == 1


def test_resuming(spark, tmp_path):
    pairs = spark.createDataFrame([("001", "a", "b"), ("002", "a", "b"), ("003", "a", "b")], "source string, a string, b string")
    done = pairs.where("source < '003'").selectExpr("*", "1.0 as delay")
    sinks.write_by_source(done, str(tmp_path / "out"))
    assert [r.source for r in sinks.unfinished(spark, pairs, str(tmp_path / "out")).collect()] == ["003"]
    assert [r.source for r in sinks.without_result(pairs, done).collect()] == ["003"]
