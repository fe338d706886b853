from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ladle.functions import ranks, scalar, stats
from ladle.plans import entities
from tests.conftest import SF


def one(df):
    return df.first()[0]


def test_safe_div_and_mapped(spark):
    df = spark.createDataFrame([(1.0, 0.0, "kgs"), (6.0, 3.0, "box"), (1.0, None, None)], "a double, b double, u string")
    assert [r[0] for r in df.select(scalar.safe_div(F.col("a"), F.col("b"))).collect()] == [None, 2.0, None]
    assert [r[0] for r in df.select(scalar.mapped(F.col("u"), {"kgs": "kg"})).collect()] == ["kg", "box", None]


def test_as_of_day_is_whole(spark):
    df = spark.createDataFrame([("2024-01-15 23:59:59",), ("2024-01-16 00:00:00",)], "t string").select(F.col("t").cast("timestamp").alias("ts"))
    assert [r[0] for r in df.select(scalar.before_end_of(F.col("ts"), date(2024, 1, 15))).collect()] == [True, False]


@pytest.mark.parametrize(("kind", "score", "expected"), [("z", 6.0, "Critical"), ("z", -4.5, "High"), ("z", 4.49, "Medium"), ("other", 9.0, "Review")])
def test_severity(spark, kind, score, expected):
    df = spark.createDataFrame([(kind, score)], "k string, s double")
    assert one(df.select(scalar.severity(F.col("k"), F.col("s"), ("z",)))) == expected


def test_hash_split_is_crc32(spark):
    import zlib

    df = spark.createDataFrame([(f"CUST{i:07d}",) for i in range(50)], "id string")
    assert all(r["h"] == (zlib.crc32(r["id"].encode()) % 5 == 0) for r in df.select("id", scalar.held_out(F.col("id")).alias("h")).collect())


def test_priority_buckets(spark):
    df = ranks.with_priority(spark.createDataFrame([(float(i),) for i in range(1, 101)], "impact double"), "impact", "p")
    assert {r["p"]: r["count"] for r in df.groupBy("p").count().collect()} == {"Critical": 10, "High": 20, "Medium": 40, "Low": 30}


def test_global_rank_equals_window(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("v"), "id")
    ranked = ranks.global_rank(df, F.col("v"), F.col("id"))
    assert ranked.where("rank != v + 1").count() == 0
    assert ranked.count() == 1000


@pytest.mark.parametrize("rows", [0, 3, 5, 998])
def test_ntile_equals_window(spark, rows):
    df = spark.range(rows).select("id", F.when(F.col("id") % 11 != 0, (F.col("id") * 7) % 13).alias("v"))
    for descending, order in ((False, F.col("v").asc_nulls_first()), (True, F.col("v").desc_nulls_first())):
        both = ranks.with_ntile(df, "v", "id", "found", descending=descending).withColumn("expected", F.ntile(5).over(Window.orderBy(order, "id")))
        assert both.where("found != expected or found is null").count() == 0
        assert both.count() == rows


@pytest.mark.parametrize("rows", [0, 1, 998])
def test_mean_ranks_equal_window(spark, rows):
    df = spark.range(rows).select("id", F.when(F.col("id") % 11 != 0, F.least(F.col("id") % 29, F.lit(9))).alias("v"))
    ties = Window.partitionBy("v")
    expected = (F.rank().over(Window.orderBy("v")) + (F.count("*").over(ties) - 1) / 2) / F.count("*").over(Window.partitionBy())
    both = ranks.with_mean_rank_shares(df, {"found": "v", "by_id": "id"}).withColumn("expected", expected)
    assert both.where("abs(found - expected) > 1e-12 or found is null or abs(by_id * %d - id - 1) > 1e-9" % max(rows, 1)).count() == 0
    assert both.count() == rows


def test_tiers_and_population(spark):
    df = spark.createDataFrame([(float(i), i % 2 == 0) for i in range(10)], "v double, inside boolean")
    rows = ranks.with_percent_ranks(df, ["v"], {"p": ("v", F.col("inside"))}).withColumn("t", ranks.tier(F.col("p"))).orderBy("v").collect()
    assert [r["p"] for r in rows if r["inside"]] == [0.0, 0.25, 0.5, 0.75, 1.0]
    assert all(r["t"] is None for r in rows if not r["inside"])
    assert [r["t"] for r in rows if r["inside"]] == ["Low", "Low", "Medium", "High", "High"]


@pytest.mark.parametrize("rows", [0, 1, 2, 1500])
def test_percent_ranks_equal_window(spark, rows):
    """Ties, nulls, populations that may be null, and a partition with two thirds of the rows, one of them null."""
    df = spark.range(rows).select("id", F.when(F.col("id") % 11 != 0, (F.col("id") * 7 % 40).cast("double")).alias("v"), F.when(F.col("id") % 13 != 0, F.col("id") % 5 != 0).alias("some"), F.when(F.col("id") % 3 == 0, F.col("id") % 4).when(F.col("id") % 7 != 0, 9).alias("k"))
    some = F.coalesce(F.col("some"), F.lit(False))
    expected = df.select("id", F.percent_rank().over(Window.orderBy("v")).alias("e0"), F.when(some, F.percent_rank().over(Window.partitionBy("k", some).orderBy("v"))).alias("e1"), F.when(some, F.percent_rank().over(Window.partitionBy("k", some).orderBy("id"))).alias("e2"))
    found = ranks.with_percent_ranks(df, ["id"], {"f0": ("v", F.lit(True))})
    found = ranks.with_percent_ranks(found, ["id"], {"f1": ("v", F.col("some")), "f2": ("id", F.col("some"))}, ["k"])
    both = found.join(expected, "id")
    assert both.count() == rows == found.count()
    assert both.where(" or ".join(f"not (e{i} <=> f{i} or abs(e{i} - f{i}) < 1e-12)" for i in range(3))).count() == 0


def test_priorities_equal_window(spark):
    df = spark.range(200).select("id", F.when(F.col("id") % 17 != 0, F.col("id") % 23).alias("impact"))
    share = F.rank().over(Window.orderBy(F.col("impact").desc())) / F.lit(200)
    both = ranks.with_priority(df, "impact").withColumn("e", F.when(share <= 0.1, "Critical").when(share <= 0.3, "High").when(share <= 0.7, "Medium").otherwise("Low"))
    assert both.count() == 200 and both.where("priority != e").count() == 0


def test_macro_f1_counts_occurring_classes_only(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "b")], "y string, p string")
    row = stats.class_scores(df, "y", "p").first()
    assert row["macro_f1"] == pytest.approx((2 / 3 + 0.5 + 0) / 3)
    assert row["accuracy"] == 0.5


def test_regression_metrics_skip_zero(spark):
    df = spark.createDataFrame([(0.0, 1.0), (2.0, 1.0), (4.0, 6.0), (10.0, 8.0)], "actual double, pred double")
    row = stats.regression_metrics(df, "actual", "pred").first()
    assert (row["mae"], row["n_zero"]) == (1.5, 1)
    assert row["mape"] == pytest.approx((0.5 + 0.5 + 0.2) / 3)
    assert row["r2"] == pytest.approx(1 - 10 / 56)


def test_mode_breaks_ties_by_name(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (2, "c"), (2, "c"), (2, "a")], "k int, v string")
    assert sorted(map(tuple, stats.most_frequent(df, ["k"], "v").collect())) == [(1, "a"), (2, "c")]


def test_ranks_within_partitions_equal_ranks_by_counts(spark):
    df = spark.range(400).select(F.col("id"), (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 != 0, (F.col("id") * 37 % 23).cast("double")).alias("v"), (F.col("id") % 3 > 0).alias("some"))
    asked = {"a": ("v", F.lit(True)), "b": ("v", F.col("some") & F.col("v").isNotNull())}
    within = ranks.with_percent_ranks_within(df, ["k"], asked)
    assert within.columns == [*df.columns, "a", "b"]
    assert sorted(map(tuple, within.collect()), key=repr) == sorted(map(tuple, ranks.with_percent_ranks(df, ["id"], asked, ["k"]).collect()), key=repr)


def test_chain_queries_leave_locations_alone(spark, monkeypatch):
    monkeypatch.setattr(entities, "item_location_features", lambda *_: pytest.fail("locations were asked for"))
    assert entities.category_counts(spark, SF).count() > 0
