from photoflow.operators import classification as K
from photoflow.operators import display as V
from photoflow.streaming.bins import binned_stream

SCHEMA = "source string, component string, t double, y double, s double"


def test_stream_gives_the_bins_of_the_table(spark, tmp_path):
    rows = [("s", "c", 2450000.5 + i, float(i), 1.0) for i in range(100)]
    table = spark.createDataFrame(rows, SCHEMA)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    wanted = sorted(tuple(r) for r in binned_stream(table).collect())
    stream = binned_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("bins").option("checkpointLocation", str(tmp_path / "check")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(tuple(r) for r in spark.sql("SELECT * FROM bins").collect()) == wanted
    assert sum(r[-1] for r in wanted) == 100


def test_merged_windows_follow_their_first_point(spark):
    rows = [("s", "c", t, t, 1.0) for t in (0.0, 1.5, 2.0, 2.5, 4.4, 9.0)] + [("s", "one", 5.0, 1.0, None)]
    found = K.merged_windows(spark.createDataFrame(rows, SCHEMA), 2.0).where("component = 'c'").orderBy("t").collect()
    assert [(r.n, round(r.t, 6)) for r in found] == [(3, 1.166667), (2, 3.45), (1, 9.0)]


def test_thinning_keeps_the_ends(spark):
    curves = spark.createDataFrame([("s", "c", float(i), 0.0, 1.0) for i in range(100)], SCHEMA)
    t = sorted(r.t for r in V.thinned(curves, 10).collect())
    assert len(t) == 10 and t[0] == 0.0 and t[-1] == 99.0
    assert V.thinned(curves, 500).count() == 100


def test_fusion_of_lacking_scores(spark):
    one = spark.createDataFrame([("a", 0.9, True), ("b", 0.1, False)], "component string, score double, predicted boolean")
    two = spark.createDataFrame([("b", 0.8, True), ("c", 0.2, False)], "component string, score double, predicted boolean")
    found = K.fused(one, two)
    assert {r.component: r.positive for r in found.collect()} == {"a": True, "b": True, "c": False}
    every = spark.createDataFrame([("a",), ("z",)], "component string")
    assert {r.component: r.positive for r in K.with_predictions(every, found).collect()} == {"a": True, "z": False}
