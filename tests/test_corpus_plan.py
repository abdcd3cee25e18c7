"""The labelled-corpus flow cleans and deduplicates its rows once."""

from weftwork.plans import corpus


def test_features_start_from_the_written_corpus(spark):
    rows = [(1, "One two. Three!", 1), (2, " One  two. Three!", 1), (3, "Four five", 0), (4, None, 0)]
    raw = spark.createDataFrame(rows, "id long, text string, label int")
    a = corpus.harmonise(raw.filter("id < 4"), "first")
    b = corpus.harmonise(raw.filter("id = 4"), "second")
    features = corpus.feature_table(corpus.combine_corpora(a, b))
    plan = features._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "parquet" in plan
    assert sorted((r["id"], r["word_count"]) for r in features.collect()) == [(1, 3), (3, 2)]
