"""Areas under curves, errors at several levels, and features as of a day, against Spark's evaluators, SQL and plain loops."""

from datetime import date, timedelta

import duckdb
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ladle.functions import ranks, stats
from ladle.operators import features, forecast, integration, wastage

D = date(2024, 1, 1)


@pytest.mark.parametrize("ties", [7, 100_000])
def test_areas_equal_the_evaluator(spark, ties):
    df = spark.range(3_000).select((F.pmod(F.xxhash64("id"), F.lit(5)) == 0).cast("int").alias("label"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(ties)) / ties).alias("noise"))
    df = df.withColumn("score", F.floor((F.col("noise") + 0.3 * F.col("label")) * ties) / ties).cache()
    found = stats.curve_areas(df.unionByName(spark.createDataFrame([(None, 0.0, 0.9), (1, 0.0, None)], "label int, noise double, score double")), "label", "score").first()
    for name, metric in (("roc", "areaUnderROC"), ("pr", "areaUnderPR")):
        expected = BinaryClassificationEvaluator(rawPredictionCol="score", metricName=metric, numBins=0).evaluate(df.withColumn("label", F.col("label").cast("double")))
        assert found[name] == pytest.approx(expected, abs=1e-9)


def test_areas_without_both_labels(spark):
    for rows, expected in (([], (None, None)), ([(0, 0.5)], (None, None)), ([(1, 0.5), (1, 0.1)], (None, 1.0)), ([(1, 0.9), (0, 0.1)], (1.0, 1.0)), ([(1, 0.5), (0, 0.5)], (0.5, 0.5))):
        assert tuple(stats.curve_areas(spark.createDataFrame(rows, "label int, score double"), "label", "score").first()) == expected


def test_running_totals_of_several_columns(spark):
    df = spark.range(5_000).select((F.col("id") * 7919 % 5_000).alias("k"), (F.col("id") % 3).alias("a"), (F.col("id") % 5).alias("b"))
    rows = sorted(map(tuple, df.collect()))
    found = {r["k"]: (r["ta"], r["tb"], r["all"]) for r in ranks.running_totals(df, F.col("k"), totals={"ta": "a", "tb": "b"}, alls={"all": "b"}).collect()}
    a = b = 0
    for k, x, y in rows:
        assert found[k] == (a, b, sum(r[2] for r in rows))
        a, b = a + x, b + y


def test_forest_is_scored_from_stored_predictions(spark):
    rows = spark.range(900).select(F.concat(F.lit("l"), F.col("id") % 70).alias("location_id"), (F.col("id") % 3).cast("string").alias("category_id"), (F.pmod(F.xxhash64("id"), F.lit(100)) / 100).alias("x"), F.lit(1.0).alias("wasted"), F.lit("i").alias("item_id"))
    rows = rows.withColumn("label", ((F.col("x") > 0.7) & (F.col("category_id") != "2")).cast("int"))
    model = wastage.fit_risk(rows.where("x < 0.5 or x > 0.52"), ["x"], ["category_id"], ["location_id"], trees=5, depth=4)
    scored = wastage.risk_scored(model, rows.withColumn("location_id", F.when(F.col("x") > 0.9, "unseen").otherwise(F.col("location_id")))).cache()
    m = wastage.risk_metrics(scored).first()
    stored = scored.select("label", "prediction", "risk").toPandas()
    sql = "SELECT count(*), count(*) FILTER (label = 1 AND prediction = 1), count(*) FILTER (label = 0 AND prediction = 1), count(*) FILTER (label = 1 AND prediction = 0) FROM stored"
    assert (m["n"], m["tp"], m["fp"], m["fn"]) == duckdb.sql(sql).fetchall()[0] and len(stored) == 900
    pairs = duckdb.sql("SELECT avg(CASE WHEN a.risk > b.risk THEN 1.0 WHEN a.risk = b.risk THEN 0.5 ELSE 0 END) FROM stored a, stored b WHERE a.label = 1 AND b.label = 0").fetchall()[0][0]
    assert m["roc"] == pytest.approx(float(pairs), abs=1e-9) and m["roc"] > 0.9 and m["precision"] > 0.8


def test_levels_in_one_pass_equal_sql(spark):
    rows = [(i, k, i % 2, D + timedelta(d), float(i + d % 3), float(d % 4), float(i), float(i - 2)) for i in range(4) for k in ("a", "b", None) for d in range(6)]
    predicted = spark.createDataFrame(rows, "item_id int, location_id string, category_id int, target_day date, target double, baseline double, mean_14 double, prediction double")
    p = predicted.toPandas()
    keys = {"item_location": "item_id, location_id,", "item": "item_id,", "category": "category_id,", "location": "location_id,", "overall": ""}
    found = {(r["level"], r["model"]): r for r in forecast.level_metrics(predicted).collect()}
    assert len(found) == 10 and len(p)
    for level, own in keys.items():
        rolled = f"SELECT {own} target_day, sum(greatest(prediction, 0)) AS forecast, sum(target) AS target, sum(baseline) AS baseline, sum(mean_14) AS recent FROM p GROUP BY {own} target_day"
        for model in ("forecast", "baseline"):
            mae, rmse, n = duckdb.sql(f"SELECT avg(abs({model} - target)), sqrt(avg(({model} - target) ** 2)), count(*) FROM ({rolled})").fetchall()[0]
            r = found[level, model]
            assert (r["mae"], r["rmse"], r["n"]) == (pytest.approx(mae), pytest.approx(rmse), n)
        recent = duckdb.sql(f"SELECT sum(recent) FROM ({rolled})").fetchall()[0][0]
        assert forecast.roll_up_levels(predicted).where(F.col("level") == level).agg(F.sum("recent_average")).first()[0] == pytest.approx(recent)


def test_a_later_snapshot_changes_nothing_before_it(spark):
    days = [D, D + timedelta(10), D + timedelta(20)]
    snapshots = spark.createDataFrame([(i, d, 10.0 * n + i) for i in (1, 2) for n, d in enumerate(days)], "item_id int, as_of date, popularity double")
    rows = spark.createDataFrame([(i, D + timedelta(k), "r") for i in (1, 3, None) for k in (-1, 0, 1, 10, 11, 25)] + [(1, None, "r"), (1, D + timedelta(11), "r")], "item_id int, day date, popularity_of string")
    found = sorted(map(tuple, integration.features_before(rows, snapshots, ["item_id"], "day", "as_of", ["popularity"]).collect()), key=repr)
    def before(i, day):
        return max(((d, 10.0 * n + i) for n, d in enumerate(days) if i == 1 and day and d < day), default=(None, None))[1]
    assert found == sorted([(r[0], r[1], r[2], before(r[0], r[1])) for r in rows.collect()], key=repr)
    early = rows.where(F.col("day") <= F.lit(days[1]))
    changed = snapshots.withColumn("popularity", F.when(F.col("as_of") >= F.lit(days[1]), -1.0).otherwise(F.col("popularity")))
    assert sorted(map(tuple, integration.features_before(early, changed, ["item_id"], "day", "as_of", ["popularity"]).collect()), key=repr) == sorted(map(tuple, integration.features_before(early, snapshots, ["item_id"], "day", "as_of", ["popularity"]).collect()), key=repr)


def test_popularity_as_of_each_day(spark):
    items = spark.createDataFrame([(1, D), (2, D), (3, D + timedelta(15))], "item_id int, launch_day date")
    lines = spark.sql("SELECT * FROM VALUES (1, TIMESTAMP '2024-01-02 23:00:00', 5.0), (2, TIMESTAMP '2024-01-12 00:00:00', 9.0), (3, TIMESTAMP '2024-01-18 00:00:00', 7.0) AS t(item_id, ts, quantity)")
    found = {(r["as_of"], r["item_id"]): r["item_popularity"] for r in features.popularity_snapshots(lines, items, [D + timedelta(1), D + timedelta(20)]).collect()}
    assert found == {(D + timedelta(1), 1): 1.0, (D + timedelta(1), 2): 0.0, (D + timedelta(20), 1): 0.0, (D + timedelta(20), 3): 0.5, (D + timedelta(20), 2): 1.0}


def test_scored_rows_are_made_once_for_all_risk_measures(spark):
    made = spark.sparkContext.accumulator(0)

    def tell(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    rows = spark.createDataFrame([(k % 2, k % 3 % 2, k % 7 / 7) for k in range(100)], "label int, prediction int, risk double")
    found = wastage.risk_metrics(rows.mapInArrow(tell, rows.schema)).first()
    assert made.value == 100 and found["n"] == 100
    plain = stats.curve_areas(rows, "label", "risk").first()
    assert (found["roc"], found["pr"]) == (plain["roc"], plain["pr"])
    empty = wastage.risk_metrics(rows.where("label > 5")).first()
    assert (empty["n"], empty["tp"], empty["roc"]) == (0, 0, None)
