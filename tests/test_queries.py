"""Every registered query beside its SQL; partition invariance for the order-sensitive ones."""

import pytest

import __spark_entry__ as entry
from queries import catalogue
from tools.check import canonical, compare, duck

QUERIES = catalogue.queries()
SQL = catalogue.oracle_sql()


@pytest.fixture(scope="module")
def con(root):
    return duck(root)


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, root, con, name):
    df = QUERIES[name](spark, root)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    assert compare(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_gives_rows(spark, root, name):
    df = QUERIES[name](spark, root)
    rows = df.collect()
    assert rows and len(set(df.columns)) == len(df.columns)
    for p in {"p", "probability"} & set(df.columns):
        assert all(0.0 <= r[p] <= 1.0 for r in rows)


def test_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize(
    "name",
    ["f04_early_stop", "f05_rank_in_group", "g03_stratified_split", "g06_stratified_folds", "i08_build_dictionary",
     "i12_ngram_counts", "l06_fold_auc", "k24_dbscan", "k06_knn", "g09_smote", "e05_concat_text", "j02_label_encode"],
)
def test_partitioning_does_not_matter(spark, root, name):
    seen = []
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            df = QUERIES[name](spark, root)
            seen.append(canonical(df.columns, df.collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert seen[0] == seen[1]
