"""M: the metric log as a stream."""

from __future__ import annotations

from pyspark.sql import functions as F

from queries.registry import query, rounded, sr, t
from queries.sources import folder
from weftwork.streaming import metrics

ROLLUP_SQL = f"""
SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n,
  {sr('avg(value)', 9)} AS mean, {sr('min(value)', 9)} AS min, {sr('max(value)', 9)} AS max FROM events GROUP BY 1, 2"""


def replay(spark, root):
    """The events as a stream of files, whether the table is one file or a folder of parts."""
    events = t(spark, root, "events")
    files = events.inputFiles()
    reader = spark.readStream.schema(events.schema)
    if any(f.rsplit("/", 1)[-1] != "events.parquet" for f in files):
        return reader.parquet(f"{root}/events.parquet")
    return reader.option("pathGlobFilter", "events.parquet").parquet(root)


@query("m01_metric_sink", "SELECT event_id, user_id, event_type, value FROM events")
def m01(spark, root):
    out = folder(spark, "log")
    rows = replay(spark, root).select("event_id", "user_id", "event_type", "value")
    metrics.metric_sink(rows, out, folder(spark, "log-state")).awaitTermination()
    return spark.read.parquet(out)


@query("m02_metric_rollup", ROLLUP_SQL)
def m02(spark, root):
    path = folder(spark, "rollup")
    summary = metrics.metric_rollup(replay(spark, root), "ts", "event_type", "value", "6 hours", late="1 day")
    metrics.rollup_sink(summary, path, folder(spark, "rollup-state")).awaitTermination()
    out = metrics.rollup_view(spark, path, t(spark, root, "events"), "ts", "event_type", "value", "6 hours")
    return rounded(out.withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")), "mean", "min", "max", digits=9)
