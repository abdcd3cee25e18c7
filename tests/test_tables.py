"""Profiling, cleaning, combining, grouping and splitting on hand-made cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftwork.operators import clean, combine, groups, profile, split
from weftwork.operators.quantiles import exact_quantiles
from weftwork.operators.scan import number_rows, prefix_scan

NAN = float("nan")


@pytest.fixture(scope="module")
def nums(spark):
    rows = [(1, None, 0.0, 5), (2, NAN, -1.0, 5), (3, 0.0, 1e9, 5), (4, -1.0, None, 5), (5, 1e9, 2.0, 5)]
    return spark.createDataFrame(rows, "id int, a double, b double, c int").withColumn("gone", F.lit(None).cast("double"))


def asdict(df, key="column", value="n"):
    return {r[key]: r[value] for r in df.collect()}


def test_missing_zero_distinct(nums):
    assert asdict(profile.null_counts(nums)) == {"gone": 5, "a": 2, "b": 1}
    assert asdict(profile.zero_counts(nums, ["a", "b"])) == {"a": 1, "b": 1}
    assert asdict(profile.distinct_counts(nums)) == {"id": 5, "a": 3, "b": 4, "c": 1, "gone": 0}
    assert asdict(profile.distinct_counts(nums, dropna=False)) == {"id": 5, "a": 4, "b": 5, "c": 1, "gone": 1}


def test_constant_columns(spark, nums):
    assert profile.constant_columns(nums) == ["c", "gone"]
    half = spark.createDataFrame([(1,), (None,)], "x int")
    assert profile.constant_columns(half) == [] and profile.constant_columns(half, dropna=True) == ["x"]
    assert clean.drop_constant(nums, keep=["id"]).columns == ["id", "a", "b"]


def test_histogram_closes_the_last_bin_and_keeps_empty_ones(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 0, 1, 10)], "v double")
    assert [r["n"] for r in profile.histogram(df, "v", 5).orderBy("bin").collect()] == [3, 0, 0, 0, 1]
    flat = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    got = profile.histogram(flat, "v", 2).orderBy("bin").collect()
    assert [r["n"] for r in got] == [0, 2] and got[0]["low"] == 2.5 and got[1]["high"] == 3.5


def pandas_like_quantile(values, p):
    v = sorted(values)
    pos = p * (len(v) - 1)
    lo, hi = v[math.floor(pos)], v[math.ceil(pos)]
    return lo + (hi - lo) * (pos - math.floor(pos))


@pytest.mark.parametrize("kind", ["uniform", "ties", "heavy"])
def test_quantiles_by_brackets_equal_the_sorted_ones(spark, kind):
    rng = random.Random(7)
    make = {"uniform": rng.random, "ties": lambda: float(rng.randint(0, 3)), "heavy": lambda: rng.random() ** 9 * 1e6}[kind]
    values = [make() for _ in range(4000)]
    df = spark.createDataFrame([(v, None if i % 5 == 0 else v) for i, v in enumerate(values)], "a double, b double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.99, 1.0]
    got = exact_quantiles(df, ["a", "b"], probs, row_limit=0, bracket_limit=50, accuracy=100)
    rest = [v for i, v in enumerate(values) if i % 5]
    assert got["a"] == pytest.approx([pandas_like_quantile(values, p) for p in probs])
    assert got["b"] == pytest.approx([pandas_like_quantile(rest, p) for p in probs])
    assert exact_quantiles(df, ["a"], probs)["a"] == pytest.approx(got["a"])


def test_quantiles_of_nothing(nums):
    assert exact_quantiles(nums, ["gone"], [0.5]) == {"gone": [None]}
    assert exact_quantiles(nums, ["gone", "a"], [0.5], row_limit=0) == {"gone": [None], "a": [0.0]}


def test_rules_treat_unknown_as_broken(nums):
    kept, report = clean.apply_rules(nums.withColumn("a", F.nanvl("a", F.lit(None))), {"a_pos": F.col("a") >= 0, "b_any": F.col("b") > -5})
    assert sorted(r["id"] for r in kept.collect()) == [3, 5]
    assert asdict(report, "rule") == {"rows_start": 5, "rows_after_filters": 2, "total_dropped": 3, "a_pos": 3, "b_any": 1}
    same, _ = clean.apply_rules(nums, {"b_any": F.col("b") > -5}, derived=True)
    assert sorted(r["id"] for r in same.collect()) == [1, 2, 3, 5]


def test_header_rows_need_all_fields(spark):
    df = spark.createDataFrame([("Season", "Line"), ("Season", "hello"), ("1", "Line")], "Season string, Line string")
    assert sorted(tuple(r) for r in clean.drop_header_rows(df).collect()) == [("1", "Line"), ("Season", "hello")]


def test_clip_is_idempotent_and_ignores_missing(spark):
    df = spark.createDataFrame([(float(i) if i % 10 else None,) for i in range(300)], "v double")
    once = clean.clip_quantiles(df, ["v"])
    assert once.filter("v is null").count() == 30
    lims = once.agg(F.min("v"), F.max("v")).first()
    assert clean.drop_iqr_outliers(once, ["v"]).count() == 300
    assert lims[0] > 1 and lims[1] < 299


def test_imputation(spark, nums):
    z = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "v double")
    assert sorted(r[0] for r in clean.impute_zero_mean(z, ["v"]).collect()) == [2.0, 3.0, 4.0]
    m = clean.fit_medians(nums, ["a", "gone"])
    assert m == {"a": 0.0, "gone": 0.0}
    assert clean.apply_medians(nums.select("id"), m).first()["gone"] == 0.0


def test_log1p_is_decided_on_train(spark):
    train = spark.createDataFrame([(1.0, 1.0, 0.0), (2000.0, 10.0, 5000.0)], "big double, low double, zero double")
    test = spark.createDataFrame([(3.0, 3.0, 3.0)], "big double, low double, zero double")
    got = clean.log1p_skewed(train, test, ["big", "low", "zero"])[1].first()
    assert got["big"] == pytest.approx(math.log1p(3)) and got["low"] == 3.0 and got["zero"] == 3.0


def test_dedup(spark):
    df = spark.createDataFrame([(3, "t", 0), (1, "t", 1), (2, "t", 1), (4, "a  b", 0), (5, "a b", 0), (6, None, 0), (7, None, 0)], "id int, text string, label int")
    ids = lambda d: sorted(r["id"] for r in d.collect())
    assert ids(combine.dedup_keep_first(df, ["text"], "id", digest=["text"])) == [1, 4, 5, 6]
    assert ids(combine.dedup_keep_first(df, ["text", "label"], "id", digest=["text"])) == [1, 3, 4, 5, 6]


def test_cap_categories_breaks_ties_by_value(spark):
    df = spark.createDataFrame([(c,) for c in "eedccbba"] + [(None,)], "c string")
    got = combine.cap_categories(df, "c", 2).groupBy("c").count().collect()
    assert {r["c"]: r["count"] for r in got} == {"b": 2, "c": 2, "other": 5}


def test_stack_predictions_checks(spark):
    ok = [(1, "a", 0.1), (2, "a", 0.2), (1, "b", 0.3), (2, "b", 0.4)]
    make = lambda rows: spark.createDataFrame(rows, "id int, model string, p double")
    assert sorted(tuple(r) for r in combine.stack_predictions(make(ok), "id", "model", "p", ["a", "b"]).collect()) == [(1, 0.1, 0.3), (2, 0.2, 0.4)]
    for bad in (ok[:2], ok + [(2, "b", 0.5)], ok[:3], ok[:3] + [(9, "b", 0.4)]):
        with pytest.raises(ValueError):
            combine.stack_predictions(make(bad), "id", "model", "p", ["a", "b"])


def test_missing_groups_and_presence(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 6), ("y", 2, 7)], "who string, season int, n int")
    for limit in (100, 1):
        got = sorted(tuple(r) for r in combine.fill_missing_groups(df, "who", "season", ["n"], max_periods=limit).collect())
        assert got == [("x", 1, 5), ("x", 2, 6), ("y", 1, 0), ("y", 2, 7)]
    assert [r[0] for r in combine.present_in_all(df, "who", "season").collect()] == ["x"]


def test_prefix_scan_with_one_hot_group(spark):
    rng = random.Random(3)
    rows = [(None if i % 11 == 0 else ("hot" if i % 3 else f"g{i % 7}"), i, rng.randint(-5, 5)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(5)
    got = prefix_scan(df, ["i"], {"s": ("sum", "v", True), "m": ("max", "v", False), "n": ("count", None, False)}, by=["g"]).collect()
    assert len(got) == 500
    for r in got:
        before = [v for g, i, v in rows if g == r["g"] and i < r["i"]]
        assert (r["s"], r["n"], r["m"]) == (sum(before) + r["v"], len(before), max(before, default=None))
    numbers = number_rows(df, [F.desc("i")], "k").collect()
    assert all(r["k"] == 499 - r["i"] for r in numbers)


def test_early_stop(spark):
    runs = {"up": [1, 2, 3, 4], "flat": [5, 5, 5, 5, 5], "late": [1, 3, 2, 2, 4, 1, 1, 1]}
    rows = [(k, i, float(v)) for k, vs in runs.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "run string, step int, v double")
    stops = lambda p: {r["run"]: r["stop_step"] for r in groups.early_stop(df, "run", ["step"], "v", p).collect()}
    assert stops(1) == {"up": None, "flat": 2, "late": 3}
    assert stops(3) == {"up": None, "flat": 4, "late": 8}
    assert stops(5) == {"up": None, "flat": None, "late": None}


def test_concat_text_continues_in_chunks(spark):
    df = spark.createDataFrame([("k", i, f"w{i}") for i in range(7)] + [("j", 0, None)], "k string, i int, text string")
    got = {(r["k"], r["chunk"]): r["text"] for r in groups.concat_text(df, "k", "text", ["i"], chunk_bytes=6).collect()}
    assert got == {("k", 0): "w0 w1 w2", ("k", 1): "w3 w4 w5", ("k", 2): "w6", ("j", 0): ""}


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame([(i, 1 if i % 100 else 0) for i in range(1000)], "id long, label int")


def test_stratified_split_sizes(skewed):
    got = split.stratified_split(skewed, "label", 0.2, "id", 1)
    assert {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()} == {
        (0, "test"): 2, (0, "train"): 8, (1, "test"): 198, (1, "train"): 792}


def test_folds_partition_rows_and_balance_classes(spark, skewed):
    got = split.stratified_folds(skewed, "label", 5, "id", 1)
    assert got.count() == 1000
    sizes = {(r["label"], r["fold"]): r["count"] for r in got.groupBy("label", "fold").count().collect()}
    assert all(sizes[(0, f)] == 2 and sizes[(1, f)] == 198 for f in range(5))
    tiny = spark.createDataFrame([(i, i % 2 if i < 4 else 0) for i in range(9)], "id long, label int")
    few = split.stratified_folds(tiny, "label", 5, "id", 1).groupBy("label", "fold").count().collect()
    assert sum(r["count"] for r in few) == 9 and all(r["count"] <= 2 and 0 <= r["fold"] < 5 for r in few)


@pytest.mark.parametrize("n_groups", [2, 3, 7])
def test_group_folds(spark, n_groups):
    df = spark.createDataFrame([(i, f"g{min(i % 20, n_groups - 1)}", i % 2) for i in range(200)], "id long, g string, label int")
    for limit in (100, 1):
        got = split.group_folds(df, "g", 5, 1, largest=limit)
        assert got.count() == 200
        assert got.groupBy("g").agg(F.count_distinct("fold").alias("n")).filter("n > 1").count() == 0
    assert split.group_folds(df, "g", 5, 1).select("fold").distinct().count() == min(5, n_groups)


def test_one_group_falls_back(spark):
    df = spark.createDataFrame([(i, "g", i % 2) for i in range(20)], "id long, g string, label int")
    assert split.group_folds(df, "g", 4, 1, label="label", id_col="id").select("fold").distinct().count() == 4


def test_split_fallback(spark, skewed):
    assert split.split_with_fallback(skewed, "label", 0.2, "id", 1)[1] == "stratified"
    assert split.split_with_fallback(skewed.filter("label = 1"), "label", 0.2, "id", 1)[1] == "single class"
    out, reason = split.split_with_fallback(skewed, "absent", 0.2, "id", 1)
    assert reason == "no label column" and 120 < out.filter("split = 'test'").count() < 280
    with pytest.raises(ValueError):
        split.flag_split(skewed.withColumn("f", F.lit(1)), "f")


def test_large_samples_and_top_rows_are_cut_exactly(spark, monkeypatch):
    from weftwork.operators import scan

    df = spark.createDataFrame([(i, i * 37 % 1000) for i in range(1000)], "id long, v long")
    few = {r["id"] for r in split.sample_n(df, 300, "id", 9).collect()}
    top = [r["v"] for r in scan.top_rows(df, [F.desc("v")], 30).collect()]
    monkeypatch.setattr(split, "TAKE_ROWS", 0)
    monkeypatch.setattr(scan, "TAKE_ROWS", 0)
    assert {r["id"] for r in split.sample_n(df, 300, "id", 9).collect()} == few and len(few) == 300
    assert split.sample_n(df, 5000, "id", 9).count() == 1000
    assert sorted((r["v"] for r in scan.top_rows(df, [F.desc("v")], 30).collect()), reverse=True) == top
