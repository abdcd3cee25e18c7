"""The metric roll-up as a stream in append mode: late rows, bounded state, repeated batches."""

import datetime as dt

from pyspark.sql import functions as F

from weftwork.streaming import metrics

SCHEMA = "ts timestamp, series string, value double"


def hour(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)


def test_late_rows_state_and_tail(spark, tmp_path):
    """Files arrive one by one. A row within the allowed delay counts, one beyond it does not; the state
    holds open windows only."""
    source, sink, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    arrivals = [
        [(hour(0), "a", 1.0), (hour(1), "a", 3.0)],
        [(hour(30), "a", 5.0)],  # watermark 24 hours after this batch
        [(hour(26), "a", 7.0), (hour(2), "a", 100.0)],  # the first is within the delay, the second is not
        [(hour(200 + i), f"s{i % 3}", 1.0) for i in range(60)],
        [(hour(500), "a", 1.0)],
    ]
    seen = []
    for i, rows in enumerate(arrivals):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        q = metrics.rollup_sink(metrics.metric_rollup(stream, "ts", "series", "value", "6 hours", late="6 hours"), sink, state)
        q.awaitTermination()
        seen.append([p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]][-1])
        if i == 2:
            closed = {(r["start"], r["series"]): (r["n"], r["mean"]) for r in spark.read.parquet(sink).collect()}
            assert closed == {(hour(0), "a"): (2, 2.0)}  # 100.0 came too late
            view = metrics.rollup_view(spark, sink, spark.read.parquet(source), "ts", "series", "value", "6 hours").collect()
            assert {(r["start"], r["n"], r["mean"]) for r in view} == {(hour(0), 2, 2.0), (hour(24), 1, 7.0), (hour(30), 1, 5.0)}
    assert seen[-1] == 1 and max(seen) <= 9  # open windows; some forty have closed
    last = spark.read.parquet(sink)
    assert last.count() == last.select("start", "series").distinct().count()
    log = spark.read.parquet(source).filter("value < 100")
    whole = metrics.metric_rollup(log, "ts", "series", "value", "6 hours")
    view = metrics.rollup_view(spark, sink, log, "ts", "series", "value", "6 hours")
    assert sorted(map(tuple, view.collect())) == sorted(map(tuple, whole.collect()))


def test_a_repeated_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "sink")
    batch = spark.createDataFrame([(1, "a")], "start int, series string")
    metrics.write_batch(batch, 4, path)
    metrics.write_batch(batch, 4, path)
    metrics.write_batch(batch.withColumn("start", F.lit(2)), 5, path)
    assert sorted(r["start"] for r in spark.read.parquet(path).collect()) == [1, 2]


def test_view_before_any_window_closes(spark, tmp_path):
    path = str(tmp_path / "none")
    rows = spark.createDataFrame([(hour(0), "a", 1.0)], SCHEMA)
    empty = metrics.metric_rollup(rows.limit(0), "ts", "series", "value", "1 hour")
    metrics.write_batch(empty, 0, path)
    assert metrics.rollup_view(spark, path, rows, "ts", "series", "value", "1 hour").count() == 1
