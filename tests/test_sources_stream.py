"""Files, caches, model artefacts and the metric stream."""

import pytest
from pyspark.sql import functions as F

from weftwork.sources import cache, tables
from weftwork.streaming import metrics


def test_csv_round_trip_with_line_breaks_and_quotes(spark, tmp_path):
    rows = [(1, 'say "hi", ok'), (2, "two\nlines"), (3, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    tables.write_table(df, str(tmp_path / "t"), "csv")
    got = tables.read_table(spark, str(tmp_path / "t"), "id int, text string", multi_line=True).orderBy("id").collect()
    assert [tuple(r) for r in got] == rows


def test_annotation_files(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "img01.txt").write_text("HE  n/a\nMA\n")
    (tmp_path / "a" / "img02.txt").write_text("N/A\n")
    got = {r["item"]: (r["codes"], r["label"]) for r in tables.read_annotations(spark, str(tmp_path / "a")).collect()}
    assert got == {"img01": (["he", "ma"], 1), "img02": ([], 0)}
    (tmp_path / "ids.txt").write_text(" 7 \n\n8\n")
    assert sorted(r[0] for r in tables.read_ids(spark, str(tmp_path / "ids.txt")).collect()) == ["7", "8"]


def test_file_catalog(spark, tmp_path):
    for label, name in (("cat", "1.jpg"), ("dog", "2.jpg"), ("dog", "3.txt")):
        (tmp_path / "c" / label).mkdir(parents=True, exist_ok=True)
        (tmp_path / "c" / label / name).write_bytes(b"x")
    got = sorted((r["label"], r["length"]) for r in tables.file_catalog(spark, str(tmp_path / "c"), "*.jpg").collect())
    assert got == [("cat", 1), ("dog", 1)]


def test_json_records(spark, tmp_path):
    (tmp_path / "n.json").write_text('[{"titular": "a", "texto": "b", "x": 1}, {"titular": "c", "texto": null}]')
    got = [tuple(r) for r in tables.read_json_records(spark, str(tmp_path / "n.json"), ["titular", "texto"]).collect()]
    assert got == [("a", "b"), ("c", None)]


def test_resolve_column(spark):
    df = spark.createDataFrame([("x",)], "content string")
    assert tables.resolve_column(df, "text", ["text_content", "content"]).columns == ["text"]
    with pytest.raises(ValueError):
        tables.resolve_column(df, "text", ["body"])


def test_cache_notices_changed_content_of_equal_size(spark, tmp_path):
    build = lambda d: d.withColumn("n", F.length("t"))
    first = spark.createDataFrame([(1, "a"), (2, "bb")], "id int, t string")
    changed = spark.createDataFrame([(1, "a"), (2, "cc")], "id int, t string")
    path = str(tmp_path / "f")
    assert [cache.cached_features(d, build, path)[1] for d in (first, first, changed, changed)] == [False, True, False, True]


def test_stream_rollup_equals_the_table(spark, root, tmp_path):
    events = spark.read.parquet(f"{root}/events.parquet")
    out, state = str(tmp_path / "log"), str(tmp_path / "state")
    source = lambda: spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(root)
    metrics.metric_sink(source(), out, state).awaitTermination()
    metrics.metric_sink(source(), out, state).awaitTermination()  # restarted: nothing is added twice
    assert spark.read.parquet(out).count() == events.count()

    q = (
        metrics.metric_rollup(source(), "ts", "event_type", "value", "1 day", late="1 hour")
        .writeStream.format("memory").queryName("rollup").outputMode("complete").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    rows = lambda d: sorted((r["start"], r["event_type"], r["n"], round(r["mean"], 6)) for r in d.collect())
    assert rows(spark.table("rollup")) == rows(metrics.metric_rollup(events, "ts", "event_type", "value", "1 day"))
