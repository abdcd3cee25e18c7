"""The training-metric log as a stream: appended rows and a periodic summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from weftwork.functions.frame import one_row


def metric_sink(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", once: bool = True) -> StreamingQuery:
    """Append every row to files exactly once; with ``once`` stop when all present input is in."""
    writer = stream.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def metric_rollup(metrics: DataFrame, ts: str, series: str, value: str, every: str, late: str | None = None) -> DataFrame:
    """Count, mean, min and max per series and tumbling window; the same call serves a stream
    (give ``late``, the allowed delay) and a table."""
    if late is not None:
        metrics = metrics.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    window: Column = F.window(ts, every)
    return (
        metrics.groupBy(window.alias("w"), F.col(series))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
        .select(F.col("w.start").alias("start"), series, "n", "mean", "min", "max")
    )


def rollup_sink(summary: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append the windows of a ``metric_rollup`` stream as they close, each once. Windows close when the
    watermark passes their end and are then forgotten, so the state holds open windows only; rows that
    come later than that are left out. A batch has a folder of its own, which a repeated run of the
    batch writes anew."""

    writer = summary.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    writer = writer.foreachBatch(lambda batch, number: write_batch(batch, number, path))
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_batch(batch: DataFrame, number: int, path: str) -> None:
    batch.write.mode("overwrite").parquet(f"{path}/batch={number}")


def rollup_view(spark: SparkSession, path: str, log: DataFrame, ts: str, series: str, value: str, every: str) -> DataFrame:
    """The roll-up up to now: closed windows from the sink, those still open from the tail of the log,
    which is read from the end of the last closed window on."""
    closed = spark.read.parquet(path).drop("batch")
    length = F.expr(f"INTERVAL {every}")
    end = one_row(closed.agg(F.max(F.col("start") + length).alias("end")))["end"]
    tail = log.filter(F.coalesce(F.col(ts).cast("timestamp") >= end, F.lit(True)))
    return closed.unionByName(metric_rollup(tail, ts, series, value, every))
