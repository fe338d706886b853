"""The search over algorithms and grids, fitted to the end, and its scores against SQL."""

import threading

import duckdb
import pytest
from pyspark.sql import functions as F

from ladle.functions import stats
from ladle.operators import models
from ladle.plans import analytics

INPUTS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.range(160).select(F.col("id").alias("item_id"), *[((F.pmod(F.xxhash64(F.lit(c), "id"), F.lit(1000))) / 1000.0).alias(c) for c in INPUTS])
    return df.withColumn("category", F.when(F.col("a") > 0.6, "High").when(F.col("b") > 0.5, "Low").otherwise("Medium")).withColumn("c", F.when(F.col("item_id") % 17 != 0, F.col("c"))).cache()


@pytest.fixture(scope="module")
def search(rows):
    return models.select_best(rows, INPUTS, "category", "item_id", models.candidates())


def test_every_point_is_fitted_for_every_fold(search, rows):
    grids = {name: len(grid) for name, (_, grid) in models.candidates().items()}
    assert grids == {"logistic_regression": 3, "decision_tree": 3, "random_forest": 4}
    train = search.predicted.where("algorithm = 'decision_tree' and not is_test").count()
    found = search.out_of_fold.groupBy("algorithm", "point").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"), F.countDistinct("fold").alias("folds")).collect()
    assert sorted((r["algorithm"], r["point"]) for r in found) == sorted((name, k) for name, n in grids.items() for k in range(n))
    assert {(r["n"], r["items"], r["folds"]) for r in found} == {(train, train, 5)}
    assert search.predicted.count() == 3 * rows.count()


def test_scores_equal_sql_over_the_stored_predictions(search):
    tried, said = search.out_of_fold.drop("params").toPandas(), search.predicted.toPandas()
    f1 = "2.0 * count(*) FILTER (c = label AND c = prediction) / nullif(count(*) FILTER (c = label) + count(*) FILTER (c = prediction), 0)"
    sql = f"""WITH c AS (SELECT DISTINCT algorithm, point, fold, label AS c FROM tried), s AS (SELECT algorithm, point, fold, c, coalesce({f1}, 0) AS f1 FROM tried JOIN c USING (algorithm, point, fold) GROUP BY ALL)
      SELECT algorithm, point, avg(m) FROM (SELECT algorithm, point, fold, avg(f1) AS m FROM s GROUP BY ALL) GROUP BY ALL"""
    own = {(r["algorithm"], r["point"]): r["macro_f1"] for r in models.fold_scores(search.out_of_fold).collect()}
    expected = {(a, p): m for a, p, m in duckdb.sql(sql).fetchall()}
    assert own.keys() == expected.keys() and all(own[k] == pytest.approx(expected[k]) for k in own)
    rows = {r["model"]: r for r in search.scores.collect()}
    for name, accuracy in duckdb.sql("SELECT algorithm, avg((category = predicted)::INT) FROM said WHERE is_test GROUP BY 1").fetchall():
        assert rows[name]["test_accuracy"] == pytest.approx(accuracy)
        assert rows[name]["cv_macro_f1"] == pytest.approx(max(m for (a, _), m in expected.items() if a == name))
    assert len(tried) and len(said)


def test_the_best_model_predicts_rows_of_inputs(search, rows):
    scores = search.scores.collect()
    assert search.best == min(scores, key=lambda r: (-round(r["test_macro_f1"], 6), -r["cv_macro_f1"], r["model"]))["model"]
    assert search.best != "logistic_regression" and max(r["test_macro_f1"] for r in scores) > 0.85
    out = models.predictions(search.models[search.best], rows, "category").collect()
    assert len(out) == 160 and all(0.3 < r["probability"] <= 1 for r in out)
    assert sum(r["category"] == r["predicted"] for r in out) > 150


def test_classes_that_are_predicted_only(spark):
    df = spark.createDataFrame([("k", "a", "a"), ("k", "a", "z"), ("k", "b", "a"), ("l", "b", "b")], "key string, y string, p string")
    found = {(r["key"], r["class"]): (r["support"], r["predicted"], r["correct"], r["f1"]) for r in stats.per_class_metrics(df, "y", "p", ["key"]).collect()}
    assert found == {("k", "a"): (2, 2, 1, 0.5), ("k", "b"): (1, 0, 0, 0.0), ("k", "z"): (0, 1, 0, 0.0), ("l", "b"): (1, 1, 1, 1.0)}
    scores = {r["key"]: (r["accuracy"], r["macro_f1"]) for r in stats.class_scores(df, "y", "p", ["key"]).collect()}
    assert scores == {"k": (1 / 3, 0.25), "l": (1.0, 1.0)}


def test_the_query_takes_all_three_grids(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(models, "select_best", lambda df, inputs, label, key, chosen, folds=5: seen.append((sorted(chosen), folds)) or models.Search("", {}, df, df, df))
    analytics.item_classifier(spark, "/root/testdata/sf0.001")
    assert seen == [(["decision_tree", "logistic_regression", "random_forest"], 5)]


def test_jobs_side_by_side_keep_local_properties_apart(spark):
    barrier = threading.Barrier(4)

    def work(job):
        spark.sparkContext.setLocalProperty("ladle.job", str(job))
        barrier.wait(30)
        return spark.sparkContext.getLocalProperty("ladle.job")

    assert models._each(spark, work, [0, 1, 2, 3]) == ["0", "1", "2", "3"]
