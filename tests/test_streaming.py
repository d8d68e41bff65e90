import datetime as dt

from siteloom.streaming import reaudit


def test_changes_between_audits(spark, tmp_path):
    src = f"{tmp_path}/in"
    schema = "site string, audit long, slug string"
    batches = [[("a", 1, "x"), ("a", 1, "y"), ("b", 1, None)], [("a", 2, "y"), ("a", 2, "z"), ("b", 2, "w")], [("a", 1, "late")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        query = reaudit.changes(spark.readStream.schema(schema).parquet(src)).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 1, "x", "raised"), ("a", 1, "y", "raised"), ("a", 2, "x", "resolved"), ("a", 2, "z", "raised"), ("b", 2, "w", "raised")]


def test_windows_by_event_time(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "ts timestamp, severity string"
    t = dt.datetime(2025, 1, 1, 10)
    rows = [(t, "high"), (t + dt.timedelta(minutes=5), "high"), (t + dt.timedelta(hours=1), "low"), (t + dt.timedelta(hours=9), "low")]
    spark.createDataFrame(rows, schema).write.parquet(src)
    q = reaudit.severity_windows(spark.readStream.schema(schema).parquet(src)).writeStream.format("memory").queryName("windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.severity, r.n) for r in spark.sql("select * from windows").collect()) == [("high", 2), ("low", 1)]
