from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ladle.operators import anomaly, basket, classify, cleaning, customers, features, forecast, integration, models, pricing, promotions, quality, recommend, scenario, segment, wastage
from ladle.sources import schemas, tables

D = date(2025, 1, 1)


def test_first_rule_wins_and_orphans_cascade(spark):
    parents = spark.createDataFrame([("p1",)], "id string")
    rows = spark.createDataFrame([("a", "p1", 1), ("b", "p9", -1), ("c", "p9", 1), ("d", None, 1)], "row string, parent string, q int")
    done = cleaning.clean(rows, cleaning.Step("t", "row", [("negative", F.col("q") < 0), ("orphan", F.col("_o"))], [("_o", "parent", parents, "id")]))
    assert sorted(r["row"] for r in done.clean.collect()) == ["a", "d"]
    assert {r["row"]: r["quarantine_reason"] for r in done.quarantined.collect()} == {"b": "negative", "c": "orphan"}
    assert done.log.count() == 2


def test_price_on_prefers_location_then_latest(spark):
    prices = spark.createDataFrame([("i", None, 5.0, D, None), ("i", "L", 7.0, D + timedelta(10), D + timedelta(20)), ("i", None, 6.0, D + timedelta(15), None)], "item_id string, location_id string, price double, effective_start_date date, effective_end_date date")
    lines = spark.createDataFrame([(k, "i", "L", D + timedelta(n)) for k, n in (("a", 5), ("b", 12), ("c", 20), ("d", 21), ("e", -1))], "line string, item_id string, location_id string, day date")
    found = {r["line"]: r["valid_price"] for r in cleaning.price_on(lines, prices, "line", "item_id", "location_id", "day").collect()}
    assert found == {"a": 5.0, "b": 7.0, "c": 7.0, "d": 6.0}


def test_waste_is_not_multiplied_by_duplicate_stock(spark):
    waste = spark.createDataFrame([("i", 5.0)], "k string, w double")
    stock = spark.createDataFrame([("i", 3.0, 1.0), ("i", 9.0, 1.0)], "k string, p double, c double")
    assert [r["_exceeds"] for r in cleaning.with_excess(waste, stock, ["k"], "w", "p", "c").collect()] == [False]


def test_restaurant_tables_are_cleaned_in_order(spark):
    s = {n: schemas.schema(n) for n in schemas.TABLES}
    from decimal import Decimal as M

    def df(name, *rows):
        return spark.createDataFrame([tuple(r) + (None,) * (len(s[name]) - len(r)) for r in rows], s[name])

    ts = __import__("datetime").datetime(2025, 5, 1, 12)
    raw = {
        "Restaurants": df("Restaurants", ["R1"]), "Menu_Items": df("Menu_Items", ["I1", "x", "C", M(0)], ["I2", "y", "C", M(3)]), "Pricing_History": df("Pricing_History", ["P1", "I1", None, M(4), M(2), D], ["P2", "I9", None, M(4), M(2), D]),
        "Customers": df("Customers", ["C1", date(2024, 1, 1)], ["C2", date(1900, 1, 1)]), "Orders": df("Orders", ["O1", "C1", "R1", ts, "web", "Completed"], ["O2", "C2", "R1", ts, "web", "Completed"], ["O1", "C1", "R1", ts, "web", "Completed"]),
        "Order_Items": df("Order_Items", ["L1", "O1", "I1", 2, M(0), M(1), M(0), M(0)], ["L2", "O2", "I1", 1, M(4), M(1), M(0), M(4)], ["L3", "O1", "I2", -1, M(4), M(1), M(0), M(4)]),
        "Ratings": df("Ratings", ["T1", "C1", "I1", "R1", "O1", 9, date(2025, 5, 2)], ["T2", "C1", "I1", "R1", "O1", 5, date(2025, 5, 2)]), "Inventory": df("Inventory", ["V1", "I1", "R1", D, M(0), M(0), M(9), M(1), M(0), "KG"]), "Wastage": df("Wastage", ["W1", "I1", "R1", D, M(20), "kgs", M(1)], ["W2", "I1", "R1", D, M(2), "kgs", M(1)]),
    }
    days = {"Customers": ("signup_date", "2021-01-01", "2025-12-20"), "Orders": ("order_datetime", "2025-01-01", "2025-12-31 23:59:59"), "Ratings": ("rating_date", "2025-01-01", "2026-01-10"), "Wastage": ("date", "2025-01-01", "2025-12-31")}
    out = cleaning.clean_restaurant_tables(raw, days, schemas.UNITS)
    kept = {t: sorted(r[0] for r in c.clean.collect()) for t, c in out.items()}
    assert kept == {"Menu_Items": ["I1", "I2"], "Pricing_History": ["P1"], "Customers": ["C1"], "Orders": ["O1"], "Order_Items": ["L1"], "Ratings": ["T2"], "Inventory": ["V1"], "Wastage": ["W2"]}
    assert out["Order_Items"].clean.first()["line_total"] == M(8)
    assert {r["unit"] for r in out["Wastage"].clean.collect()} == {"kg"}
    assert out["Orders"].log.where("action = 'removed'").count() == 1


def test_each_restaurant_table_is_judged_once(spark):
    from ladle.plans import cleaned
    from tests.conftest import SF

    out = cleaning.clean_restaurant_tables(cleaned._raw(spark, SF), cleaned.DAYS, schemas.UNITS)
    for c in out.values():
        for df in (c.clean, c.quarantined):
            plan = df._jdf.queryExecution().optimizedPlan().toString()
            assert "Join" not in plan and "Window" not in plan


def test_csv_round_trip_and_snapshots(spark, tmp_path):
    typed = schemas.schema("Promotions")
    (tmp_path / "p.csv").write_text("promotion_id,promotion_name,promotion_type,discount_value,start_date,end_date,min_order_value\nP1,a,b,1.50,2025-01-02,2025-13-07,\n")
    df = tables.read_csv(spark, str(tmp_path / "p.csv"), typed)
    row = df.first()
    assert row["start_date"] == date(2025, 1, 2) and row["end_date"] is None
    raw = tables.read_raw_csv(spark, str(tmp_path / "p.csv"), typed)
    assert {r["column_name"]: (r["blank"], r["unparseable"]) for r in quality.unparsed(df, raw, ["promotion_id"]).collect()}["end_date"] == (0, 1)
    assert tables.rewritten_csv(df.coalesce(1), str(tmp_path / "out")).first()["same"]
    for day in (date(2025, 1, 1), date(2025, 3, 1)):
        tables.write_snapshot(spark.range(day.month), str(tmp_path / "snap"), day)
    assert tables.latest_snapshot(spark, str(tmp_path / "snap")) == date(2025, 3, 1)
    assert tables.latest_snapshot(spark, str(tmp_path / "snap"), before=date(2025, 3, 1)) == date(2025, 1, 1)
    assert tables.read_snapshot(spark, str(tmp_path / "snap")).count() == 3
    assert not tables.write_quarantine(df.where("false"), str(tmp_path / "q"))


def test_range_join_keeps_lonely_events(spark):
    events = spark.createDataFrame([("a", date(2025, 3, 1)), ("b", date(2025, 3, 1))], "k string, d date")
    series = spark.createDataFrame([("a", date(2025, 3, 1) + timedelta(n), n) for n in range(-40, 41, 5)], "k string, day date, v int")
    rows = integration.within_days(events, series, ["k"], "d", "day", 30, 29).collect()
    assert sorted(r["v"] for r in rows if r["k"] == "a") == list(range(-30, 30, 5))
    assert [(r["v"], r["offset"]) for r in rows if r["k"] == "b"] == [(None, None)]


def test_rolling_z_flags_the_spike(spark):
    rows = [("L", D + timedelta(i), i, 100.0 if i == 9 else 10.0 + i % 2) for i in range(11)]
    df = spark.createDataFrame(rows, "location_id string, period_start date, d int, orders double")
    found = anomaly.rolling_z(df, ["location_id"], "d", ["orders"], -8, -1, 4, 3.0, "z", "location_id").collect()
    assert [r["period_start"] for r in found] == [D + timedelta(9)]


def test_classification_rules(spark):
    rows = [(f"f{i}", float(i), i / 20, 10.0 * i, 3.5, 0.3, 0.01, 200) for i in range(10)]
    rows += [("best", 99.0, 0.9, 500.0, 4.8, 0.9, 0.0, 200), ("new", 99.0, 0.9, 1.0, 4.0, 0.5, 0.0, 30), ("none", 0.0, None, 0.0, None, None, None, 200)]
    df = spark.createDataFrame(rows, "item_id string, total_quantity_sold double, profit_percentage double, contribution_margin double, average_rating double, repeat_purchase_rate double, wastage_percentage double, days_since_launch int")
    df = df.withColumns({"promotion_dependency": F.lit(0.6), "weekend_order_ratio": F.lit(None).cast("double"), "is_seasonal": F.lit(None).cast("boolean")})
    out = {r["item_id"]: r for r in classify.with_flags(classify.classify(df)).collect()}
    assert out["best"]["category"] == "Profit Driver"
    assert out["new"]["category"] == "Insufficient History" and out["new"]["demand_percentile"] is None
    assert out["none"]["category"] == "Low Performer"
    assert out["best"]["promotion_dependent"] and not out["best"]["weekend_skewed"] and not out["best"]["seasonal_item"]


def test_cluster_labels_are_given_once(spark):
    rows = [(0, 10, 5.0, 9.0, 900.0, 0.1, 50.0), (1, 10, 90.0, 2.0, 90.0, 0.1, 60.0), (2, 10, 9.0, 3.0, 80.0, 0.9, 70.0), (3, 10, 8.0, 2.0, 70.0, 0.2, 5.0)]
    df = spark.createDataFrame(rows, "cluster int, n_customers int, customer_recency double, customer_frequency double, customer_monetary_value double, promo_order_share double, tenure_days double")
    assert segment.label_clusters(df) == {0: "High-Value Loyal", 1: "At-Risk", 2: "Promotion-Driven", 3: "New"}


def test_pair_rules(spark):
    sets = [["A", "B"]] * 4 + [["A"]] * 2 + [["B", "C"]] * 2 + [["C"]] * 2
    df = spark.createDataFrame(list(enumerate(sets)), "order_id int, items array<string>")
    rows = {(r["antecedent"], r["consequent"]): r for r in basket.pair_rules(df, 0.1, 0.1).collect()}
    assert rows["A", "B"]["support"] == pytest.approx(0.4) and rows["A", "B"]["lift"] == pytest.approx((4 / 6) / 0.6)
    mined = {(r["antecedent"][0], r["consequent"][0]): r["lift"] for r in basket.mine(df, 0.1, 0.1).associationRules.collect()}
    assert mined["A", "B"] == pytest.approx(rows["A", "B"]["lift"])


def test_price_impact_against_control(spark):
    day0 = date(2025, 3, 1)
    rows = []
    for n in range(-30, 30):
        rows += [("x", "c", day0 + timedelta(n), 10.0 if n < 0 else 9.0), ("y", "c", day0 + timedelta(n), 20.0 if n < 0 else 25.0)]
    daily = spark.createDataFrame(rows, "item_id string, category_id string, day date, quantity double")
    changes = spark.createDataFrame([("x", day0, 10.0, 12.0), ("y", day0, 10.0, 10.1)], "item_id string, change_day date, old_price double, new_price double")
    out = {r["item_id"]: r for r in pricing.event_impact(changes, daily, day0 - timedelta(30), day0 + timedelta(29)).collect()}
    assert out["x"]["elasticity"] == pytest.approx((0.9 / 1.25 - 1) / 0.2) and out["x"]["evaluable"]
    assert not out["y"]["evaluable"]


def test_promotion_flags_are_null_outside_the_data(spark):
    promos = spark.createDataFrame([(1, D + timedelta(20), D + timedelta(24)), (2, D, D + timedelta(4))], "promotion_id int, start_day date, end_day date")
    base = {"orders": 10, "quantity": 100.0, "revenue": 100.0, "margin": 50.0, "customers": 8, "wastage_cost": 10.0, "margin_per_order": 5.0}
    metrics = [(1, "pre", *base.values()), (1, "during", 20, 200.0, 150.0, 40.0, 16, 20.0, 2.0), (1, "post", 5, 50.0, 60.0, 30.0, 5, 9.0, 6.0)]
    df = spark.createDataFrame(metrics, "promotion_id int, period string, orders int, quantity double, revenue double, margin double, customers int, wastage_cost double, margin_per_order double")
    out = {r["promotion_id"]: r for r in promotions.compare(promos, df, D, D + timedelta(60)).collect()}
    assert out[1]["trap_flags"] == 4 and out[1]["is_trap"]
    assert out[2]["wastage_up"] is None and out[2]["trap_flags"] == 0


def test_churn(spark):
    as_of = date(2025, 12, 31)
    days = {"A": [300, 150, 120, 100], "B": [200, 100, 10], "C": [40, 20, 5]}
    orders = spark.createDataFrame([(c, as_of - timedelta(n)) for c, ns in days.items() for n in ns], "customer_id string, ts date").withColumn("ts", F.col("ts").cast("timestamp"))
    people = spark.createDataFrame([(c, min(ns)) for c, ns in days.items()], "customer_id string, customer_recency int")
    out = {r["customer_id"]: r["at_risk"] for r in customers.churn_risk(orders, people, as_of, k=1.5).collect()}
    assert out == {"A": True, "B": False, "C": False}


def test_training_table_drops_gaps(spark):
    rows = [("i", "l", D + timedelta(n), float(n)) for n in range(90) if n != 40]
    df = spark.createDataFrame(rows, "item_id string, location_id string, day date, qty double")
    out = {(r["day"] - D).days: r for r in forecast.training_table(df, 7).collect()}
    assert out[30]["lag_7"] == 23.0 and out[30]["mean_7"] == pytest.approx(26.0) and out[30]["target"] == 36.0 and out[30]["baseline"] == 29.0
    assert not set(range(41, 55)) & set(out)


def test_risk_table_looks_back_without_the_day(spark):
    stock = spark.createDataFrame([("i", "l", D + timedelta(n), 40.0 if n < 3 else 0.0, 10.0 * (n + 1)) for n in range(4)], "item_id string, location_id string, day date, prepared double, consumed double")
    promotions = spark.createDataFrame([(1, D, D)], "promotion_id int, start_day date, end_day date"), spark.createDataFrame([(1, "i")], "promotion_id int, item_id string"), spark.createDataFrame([(1, "l")], "promotion_id int, location_id string")
    popularity = spark.createDataFrame([("i", 0.5)], "item_id string, item_popularity double")
    waste = spark.createDataFrame([("i", "l", D + timedelta(2), 8.0)], "item_id string, location_id string, day date, wasted double")
    out = [r.asDict() for r in wastage.risk_table(stock, waste, promotions, popularity).orderBy("day").collect()]
    # nothing was prepared on the fourth day
    assert [(r["promo_active"], r["item_popularity"]) for r in out] == [(1, 0.5), (0, 0.5), (0, 0.5)]
    assert [r["recent_demand"] for r in out] == [-1.0, 10.0, 15.0]
    assert [r["label"] for r in out] == [0, 0, 1] and out[2]["prep_ratio"] == pytest.approx(40 / 15)


def test_scenarios_by_hand(spark):
    base = spark.createDataFrame([("i", 100.0, 40.0, 1000.0, 0.2, 0.2, 0.3, -1.0, -0.1, 365, 10.0)], "item_id string, price double, unit_cost double, quantity double, wastage_pct double, discount_pct double, promotion_dependency double, elasticity double, promo_margin_effect double, period_days int, forecast_daily_demand double")
    rows = {r["scenario"]: r for r in scenario.simulate(base, [("price_change", 0.1), ("discount_change", 0.2), ("promotion_frequency", 2.0), ("remove_item", None), ("reduce_prep", 0.3), ("demand_change", -0.5), ("wastage_assumption", 0.1)]).collect()}
    assert rows["price_change"]["revenue"] == pytest.approx(110 * 900) and rows["price_change"]["wastage_units"] == pytest.approx(225)
    assert rows["discount_change"]["revenue_change"] == pytest.approx(0)
    assert rows["promotion_frequency"]["contribution_margin"] == pytest.approx(60_000 + 100_000 * 0.3 * 0.5)
    assert rows["remove_item"]["revenue"] == 0
    assert rows["reduce_prep"]["demand"] == pytest.approx(1000 - (375 - 250)) and len(rows["reduce_prep"]["flags"]) == 2
    assert rows["demand_change"]["revenue"] == pytest.approx(50_000)
    assert rows["wastage_assumption"]["wastage_units"] == pytest.approx(1000 / 9)


def test_recommendations_have_evidence_and_priorities(spark):
    chain = spark.createDataFrame([(1, "Low Performer", {"a": "Low Performer", "b": "Volume Driver", "c": "Low Performer", "d": "Low Performer"}, 5.0, -3.0, 2.0)], "item_id int, category string, location_categories map<string,string>, total_quantity_sold double, contribution_margin double, wastage_cost double")
    row = recommend.ranked(recommend.low_performers(chain)).first()
    assert row["impact"] == 5.0 and len(row["evidence"]) >= 2 and row["priority"] == "Low" and row["recommendation_id"] == "REC-001"


def test_folds_hold_every_class(spark):
    df = spark.range(60).select("id", F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("y"))
    folds = models.with_folds(df, "y", "id", 5).groupBy("fold", "y").count().collect()
    assert len(folds) == 10 and {r["count"] for r in folds} == {3, 9}


def test_saved_model_predicts_the_same(spark, tmp_path):
    rows = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i) for i in range(40)], "a double, b double, target double")
    model = forecast.fit(rows, ["a", "b"], iterations=3, depth=2)
    tables.save_model(model, str(tmp_path / "model"))
    again = tables.load_model(str(tmp_path / "model"))
    assert [r["prediction"] for r in again.transform(rows).collect()] == [r["prediction"] for r in model.transform(rows).collect()]


def test_times_without_zone_read_back_from_csv(spark, tmp_path):
    rows = spark.sql("SELECT 1 AS id, TIMESTAMP_NTZ '2025-01-02 03:04:05' AS ts")
    tables.write_csv(rows, str(tmp_path / "t"))
    typed = StructType().add("id", "integer").add("ts", "timestamp")
    assert str(tables.read_csv(spark, str(tmp_path / "t"), typed).first()["ts"]) == "2025-01-02 03:04:05"
    assert tables.read_raw_csv(spark, str(tmp_path / "t"), typed).first()["ts"] == "2025-01-02 03:04:05"


def test_sales_and_customers_equal_their_parts(spark):
    lines = spark.range(600).select((F.col("id") % 7).alias("item_id"), F.when(F.col("id") % 11 != 0, F.floor(F.col("id") / 3) % 40).alias("customer_id"), F.floor(F.col("id") / 3).alias("order_id"), F.expr("timestamp '2024-03-01 08:00:00' + make_dt_interval(cast(id % 9 as int))").alias("ts"),
        (F.col("id") % 5).cast("double").alias("quantity"), (F.col("id") % 13).cast("double").alias("revenue"), F.lit(1.5).alias("cost"), F.lit(0.5).alias("discount"), (F.col("id") % 4 == 0).alias("promo"))
    # an order has one customer
    lines = lines.withColumn("customer_id", F.when(F.col("order_id") % 11 != 0, F.col("order_id") % 40))
    for keys in (["item_id"], []):
        found = features.sales_and_customers(lines, keys)
        parts = features.sales(lines, keys)
        rate = features.repeat_rate(lines, keys)
        n = lines.groupBy(*keys).agg(F.countDistinct("customer_id").alias("unique_customers"))
        expected = parts.join(rate, keys).join(n, keys) if keys else parts.crossJoin(rate).crossJoin(n)
        assert sorted(map(tuple, found.select(*expected.columns).collect())) == sorted(map(tuple, expected.collect()))


def test_clusters_are_the_nearest_centers(spark):
    """Assignment, distance, margin and profiles of a fitted model, recomputed from its centers."""
    import numpy as np

    rows = spark.range(300).select(F.col("id").alias("customer_id"), (F.col("id") * 37 % 400).cast("int").alias("customer_recency"), (1 + F.col("id") % 9).alias("customer_frequency"), (F.col("id") * 13 % 900).cast("double").alias("customer_monetary_value"),
        (F.col("id") % 4 / 4).alias("promo_order_share"), (F.col("id") * 7 % 1000).cast("int").alias("tenure_days"), F.lit(100.0).alias("average_order_value"), F.lit(0.5).alias("weekend_ratio"), F.lit(0.5).alias("peak_hour_ratio"), F.lit(2.0).alias("average_basket_size"))
    found = segment.segment(rows, k=4)
    marked = segment.with_cluster_inputs(rows).fillna(0, segment.INPUTS).join(found.select("customer_id", "held_out"), "customer_id")
    model = segment.fit_clusters(marked.where("not held_out"), 4)
    centers = np.array([c for c in model.stages[-1].clusterCenters()])
    scaled = {r["customer_id"]: np.array(r["scaled"].toArray()) for r in model.transform(marked).collect()}
    got = {r["customer_id"]: r for r in found.collect()}
    for i, x in scaled.items():
        d = np.sqrt(((centers - x) ** 2).sum(axis=1))
        first, second = np.sort(d)[:2]
        assert got[i]["cluster"] == int(d.argmin()) and got[i]["distance"] == pytest.approx(first) and got[i]["margin"] == pytest.approx(second - first, abs=1e-9)
    labels = {(r["cluster"], r["segment"]) for r in got.values()}
    assert len(labels) == len({c for c, _ in labels}) == 4
    loyal = next(c for c, name in labels if name == "High-Value Loyal")
    spend = {c: np.mean([r["customer_monetary_value"] for r in got.values() if r["cluster"] == c and not r["held_out"]]) for c in range(4)}
    assert loyal == max(spend, key=spend.get)
