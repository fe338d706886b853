"""Queries of baskets, wastage risk, prices, promotions, anomalies, forecasts, recommendations, scenarios and reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.operators import anomaly, basket, classify, features, forecast, integration, models, pricing, promotions, recommend, reports, scenario, wastage
from ladle.plans import entities
from ladle.plans import frames as fr
from ladle.plans.frames import AS_OF, FIRST_DAY, LAST_DAY, Query, table
from ladle.sources import tables

# Baskets


def _baskets(spark: SparkSession, sf: str) -> DataFrame:
    return fr.lines(spark, sf).groupBy("order_id").agg(F.array_sort(F.collect_set("category_id")).alias("items"))


def pair_rules(spark: SparkSession, sf: str) -> DataFrame:
    return basket.pair_rules(_baskets(spark, sf), 0.01, 0.1)


PAIR_RULES = """WITH b AS (SELECT DISTINCT order_id, category_id FROM lines), t AS (SELECT count(DISTINCT order_id) AS total FROM b), s AS (SELECT category_id, count(*) AS n FROM b GROUP BY 1),
  p AS (SELECT x.category_id AS antecedent, y.category_id AS consequent, count(*) AS n FROM b x JOIN b y ON x.order_id = y.order_id AND x.category_id <> y.category_id GROUP BY 1, 2)
  SELECT antecedent, consequent, p.n, p.n / total AS support, p.n / a.n AS confidence, p.n * total / (a.n * c.n) AS lift FROM p JOIN s a ON a.category_id = antecedent JOIN s c ON c.category_id = consequent, t WHERE p.n / total >= 0.01 AND p.n / a.n >= 0.1"""


def top_rules(spark: SparkSession, sf: str) -> DataFrame:
    rows = pair_rules(spark, sf).withColumns({"lift": F.round("lift", 6), "confidence": F.round("confidence", 6)})
    return basket.top_rules(rows, 20, 1.05).drop("support")


TOP_RULES = f"SELECT antecedent, consequent, n, round(confidence, 6) AS confidence, round(lift, 6) AS lift, CASE WHEN round(lift, 6) >= 1.05 THEN 'Bundle' ELSE 'No bundle' END AS verdict FROM ({PAIR_RULES}) ORDER BY lift DESC, confidence DESC, antecedent, consequent LIMIT 20"


def frequent_itemsets(spark: SparkSession, sf: str) -> DataFrame:
    found = basket.mine(_baskets(spark, sf), 0.01, 0.1).freqItemsets
    return found.select(F.concat_ws("+", F.array_sort("items")).alias("items"), F.size("items").cast("bigint").alias("size"), F.col("freq").alias("n"))


FREQUENT_ITEMSETS = """WITH b AS (SELECT DISTINCT order_id, category_id AS c FROM lines), t AS (SELECT 0.01 * count(DISTINCT order_id) AS least FROM b),
  one AS (SELECT c AS items, 1 AS size, count(*) AS n FROM b GROUP BY c), two AS (SELECT x.c || '+' || y.c AS items, 2 AS size, count(*) AS n FROM b x JOIN b y ON x.order_id = y.order_id AND x.c < y.c GROUP BY 1),
  three AS (SELECT x.c || '+' || y.c || '+' || z.c AS items, 3 AS size, count(*) AS n FROM b x JOIN b y ON x.order_id = y.order_id AND x.c < y.c JOIN b z ON z.order_id = y.order_id AND y.c < z.c GROUP BY 1)
  SELECT items, size::BIGINT AS size, n FROM (SELECT * FROM one UNION ALL SELECT * FROM two UNION ALL SELECT * FROM three), t WHERE n >= least"""



def _rules(of: DataFrame, itemsets: DataFrame, confidence: float) -> DataFrame:
    found = basket.rules_of(itemsets, of.agg(F.count("*").cast("double").alias("total")), confidence)
    return found.select(F.array_join(F.col("antecedent").cast("array<string>"), "+").alias("antecedent"), F.size("antecedent").alias("size"), F.col("consequent").cast("string").alias("consequent"), "n", "support", "confidence", "lift")


def association_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules between categories, with antecedents of any size."""
    of = _baskets(spark, sf)
    return _rules(of, basket.mine(of, 0.01, 0.1).freqItemsets, 0.1)


def item_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Rules between single items that are bought together three times or more; an order has seven lines at most."""
    of = basket.baskets(fr.lines(spark, sf))
    return _rules(of, basket.frequent_sets(of, 3), 0.05)


def _rules_sql(item: str, least: str, confidence: float) -> str:
    return f"""WITH b AS (SELECT DISTINCT order_id, {item} AS c FROM lines), t AS (SELECT count(DISTINCT order_id)::DOUBLE AS total, {least} AS least FROM b),
  s1 AS (SELECT [c] AS s, count(*) AS n FROM b GROUP BY c), s2 AS (SELECT [x.c, y.c] AS s, count(*) AS n FROM b x JOIN b y ON x.order_id = y.order_id AND x.c < y.c GROUP BY x.c, y.c),
  s3 AS (SELECT [x.c, y.c, z.c] AS s, count(*) AS n FROM b x JOIN b y ON x.order_id = y.order_id AND x.c < y.c JOIN b z ON z.order_id = y.order_id AND y.c < z.c GROUP BY x.c, y.c, z.c),
  s AS (SELECT s, n FROM (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3), t WHERE n >= least), r AS (SELECT s, n, unnest(s) AS consequent FROM s WHERE len(s) > 1),
  a AS (SELECT *, list_filter(s, lambda x: x <> consequent) AS antecedent FROM r)
  SELECT array_to_string(antecedent, '+') AS antecedent, len(antecedent)::INT AS size, consequent::VARCHAR AS consequent, a.n, a.n / total AS support, a.n / l.n AS confidence, a.n * total / (l.n * o.n) AS lift FROM a JOIN s l ON l.s = antecedent JOIN s o ON o.s = [consequent], t WHERE a.n / l.n >= {confidence}"""


# Wastage


#: The risk model is tested on the days from the first one on; snapshots of item features are of the others.
TEST_FROM, SNAPSHOT_DAYS = date(2000, 1, 1), [date(1998, 7, 1), date(1999, 10, 1), date(2000, 7, 1), AS_OF]


def _popularity(spark: SparkSession, sf: str) -> DataFrame:
    return features.popularity_snapshots(fr.lines(spark, sf), fr.items(spark, sf), SNAPSHOT_DAYS)


_POPULARITY = " UNION ALL ".join(
    f"SELECT DATE '{d}' AS as_of, item_id, percent_rank() OVER (ORDER BY coalesce(q, 0)) AS item_popularity FROM items LEFT JOIN (SELECT item_id, sum(quantity) AS q FROM lines WHERE ts < DATE '{d}' + 1 GROUP BY 1) USING (item_id) WHERE launch_day <= DATE '{d}'" for d in SNAPSHOT_DAYS
)


def popularity_snapshots(spark: SparkSession, sf: str) -> DataFrame:
    return _popularity(spark, sf)


def popularity_before(spark: SparkSession, sf: str) -> DataFrame:
    """Waste, each row with its item's popularity in the last snapshot strictly before its day."""
    rows = integration.features_before(fr.waste(spark, sf), _popularity(spark, sf), ["item_id"], "day", "as_of", ["item_popularity"])
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.count("item_popularity").alias("known"), F.sum("item_popularity").alias("popularity"))


POPULARITY_BEFORE = f"""WITH s AS ({_POPULARITY}), w AS (SELECT day, (SELECT max(as_of) FROM s WHERE s.as_of < waste.day AND s.item_id = waste.item_id) AS as_of, item_id FROM waste)
  SELECT day, count(*) AS n, count(item_popularity) AS known, sum(item_popularity) AS popularity FROM w LEFT JOIN s USING (item_id, as_of) GROUP BY 1"""


def _risk_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Popularity is that of the last snapshot before the test days, so that nothing of them is known."""
    last = max(d for d in SNAPSHOT_DAYS if d < TEST_FROM)
    popularity = features.popularity_snapshots(fr.lines(spark, sf), fr.items(spark, sf), [last]).drop("as_of")
    return wastage.risk_table(fr.stock(spark, sf), fr.waste(spark, sf), fr.promotion_tables(spark, sf), popularity, 200)


def risk_table(spark: SparkSession, sf: str) -> DataFrame:
    return _risk_rows(spark, sf).select("item_id", "location_id", "day", "label", "recent_demand", "prep_ratio", "promo_active", "item_popularity", "dow", "month", "is_weekend")


RISK_TABLE = f"""WITH w AS (SELECT item_id, location_id, day, sum(wasted) AS wasted FROM waste GROUP BY 1, 2, 3), i AS (SELECT item_id, item_popularity FROM ({_POPULARITY}) WHERE as_of = DATE '1999-10-01'),
  j AS (SELECT item_id, location_id, day, prepared, consumed, coalesce(wasted, 0) AS wasted, (on_day IS NOT NULL)::INT AS promo_active, coalesce(item_popularity, 0) AS item_popularity FROM stock LEFT JOIN w USING (item_id, location_id, day) LEFT JOIN (SELECT item_id, location_id, day AS day, day AS on_day FROM covered) c USING (item_id, location_id, day) LEFT JOIN i USING (item_id) WHERE prepared > 0),
  r AS (SELECT *, avg(consumed) OVER (PARTITION BY item_id, location_id ORDER BY datediff('day', DATE '2000-01-01', day) RANGE BETWEEN 200 PRECEDING AND 1 PRECEDING) AS demand FROM j)
  SELECT item_id, location_id, day, coalesce(wasted / nullif(prepared, 0) > 0.1, false)::INT AS label, coalesce(demand, -1) AS recent_demand, coalesce(CASE WHEN demand > 0 THEN prepared / demand END, -1) AS prep_ratio, promo_active, item_popularity, (dayofweek(day) + 1)::INT AS dow, month(day)::INT AS month, (dayofweek(day) + 1 IN (6, 7, 1))::INT AS is_weekend FROM r"""


def _risk_model(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(scored test days, importances) of a forest trained on the days before them; the scores are stored once for each session and folder."""
    if (spark.sparkContext.applicationId, sf) not in _STORED_RISK:
        rows = _risk_rows(spark, sf).join(fr.items(spark, sf).select("item_id", "category_id"), "item_id")
        path = tables.new_folder(spark, "risk")
        rows.write.parquet(f"{path}/rows")
        train, test = wastage.split_by_day(spark.read.parquet(f"{path}/rows"), TEST_FROM)
        numeric = ["recent_demand", "prep_ratio", "prepared", "promo_active", "item_popularity", "dow", "month", "is_weekend"]
        model = wastage.fit_risk(train, numeric, ["category_id"], ["location_id"])
        wastage.risk_scored(model, test).write.parquet(f"{path}/scored")
        forecast.importances(model, [*numeric, "category_id", "location_id"], rows).write.parquet(f"{path}/importances")
        _STORED_RISK[spark.sparkContext.applicationId, sf] = path
    path = _STORED_RISK[spark.sparkContext.applicationId, sf]
    return spark.read.parquet(f"{path}/scored"), spark.read.parquet(f"{path}/importances")


_STORED_RISK: dict[tuple[str, str], str] = {}
_STORED_FORECASTS: dict[tuple[str, str], str] = {}


def risk_watch_list(spark: SparkSession, sf: str) -> DataFrame:
    """A forest trained on the days before 2000, and the pairs it expects to waste from then on."""
    return wastage.watch_list(_risk_model(spark, sf)[0])


def risk_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, precision, recall and areas of the forest on the test days, and the importances of its inputs."""
    scored, importances = _risk_model(spark, sf)
    return wastage.risk_metrics(scored).join(importances.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", F.round("importance", 6))))).alias("importances")))


#: A rule in the model's place, which SQL can give as well: what is prepared for each unit of recent demand, in tenths.
_RULE_SCORE, _RULE = "floor(10 * prep_ratio) / 10", "prep_ratio > 1.2"


def risk_rule_metrics(spark: SparkSession, sf: str) -> DataFrame:
    rows = risk_table(spark, sf).withColumns({"risk": F.expr(_RULE_SCORE), "prediction": F.expr(_RULE).cast("int")})
    return wastage.risk_metrics(rows)


RISK_RULE_METRICS = f"""WITH r AS (SELECT label, {_RULE_SCORE} AS s, ({_RULE})::INT AS p FROM ({RISK_TABLE})), c AS (SELECT s, sum(label) AS p, sum(1 - label) AS n FROM r GROUP BY 1),
  k AS (SELECT *, coalesce(sum(p) OVER w, 0) AS tp, coalesce(sum(n) OVER w, 0) AS fp FROM c WINDOW w AS (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  a AS (SELECT sum(n * (tp + p / 2)) / (sum(p) * sum(n)) AS roc, sum(p * (CASE WHEN tp + fp = 0 THEN (tp + p) / (tp + p + fp + n) ELSE tp / (tp + fp) END + (tp + p) / (tp + p + fp + n)) / 2) / sum(p) AS pr FROM k),
  t AS (SELECT count(*) FILTER (label = 1 AND p = 1) AS tp, count(*) FILTER (label = 0 AND p = 1) AS fp, count(*) FILTER (label = 1 AND p = 0) AS fn, count(*) FILTER (label = 0 AND p = 0) AS tn FROM r),
  m AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM t)
  SELECT tp + fp + fn + tn AS n, (tp + fn) / (tp + fp + fn + tn) AS positive_rate, tp, fp, fn, tn, (tp + tn) / (tp + fp + fn + tn) AS accuracy, precision, recall, 2 * precision * recall / nullif(precision + recall, 0) AS f1, roc, pr FROM m, a"""


# Prices


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    return pricing.price_changes(fr.prices(spark, sf))


def price_changes(spark: SparkSession, sf: str) -> DataFrame:
    return _changes(spark, sf)


PRICE_CHANGES = "SELECT item_id, change_day, old_price, new_price FROM (SELECT item_id, start_day AS change_day, lag(price) OVER (PARTITION BY item_id ORDER BY start_day) AS old_price, price AS new_price FROM prices WHERE location_id IS NULL) WHERE old_price <> new_price"


def _impact(spark: SparkSession, sf: str) -> DataFrame:
    daily = fr.lines(spark, sf).groupBy("item_id", "category_id", F.col("ts").cast("date").alias("day")).agg(F.sum("quantity").alias("quantity"))
    return pricing.event_impact(_changes(spark, sf), daily, FIRST_DAY, LAST_DAY, 90)


def price_impact(spark: SparkSession, sf: str) -> DataFrame:
    return _impact(spark, sf).where("category_id is not null").select("item_id", "change_day", "before", "after", "price_change_pct", "demand_change_pct", "control_change_pct", "adjusted_change_pct", "elasticity", "evaluable")


PRICE_IMPACT = f"""WITH d AS (SELECT item_id, category_id, ts::DATE AS day, sum(quantity) AS quantity FROM lines GROUP BY 1, 2, 3), e AS (SELECT c.*, category_id FROM ({PRICE_CHANGES}) c JOIN (SELECT DISTINCT item_id, category_id FROM d) USING (item_id)),
  o AS (SELECT e.item_id, e.change_day, coalesce(sum(quantity) FILTER (day < change_day), 0) AS before, coalesce(sum(quantity) FILTER (day >= change_day), 0) AS after FROM e LEFT JOIN d ON d.item_id = e.item_id AND day BETWEEN change_day - 90 AND change_day + 89 GROUP BY 1, 2),
  a AS (SELECT e.item_id, e.change_day, coalesce(sum(quantity) FILTER (day < change_day), 0) AS b, coalesce(sum(quantity) FILTER (day >= change_day), 0) AS f FROM e LEFT JOIN d ON d.category_id = e.category_id AND day BETWEEN change_day - 90 AND change_day + 89 GROUP BY 1, 2),
  r AS (SELECT item_id, change_day, before, after, (new_price - old_price) / old_price AS price_change_pct, (after - before) / nullif(before, 0) AS demand_change_pct, (f - after - (b - before)) / nullif(b - before, 0) AS control_change_pct, b - before AS rest FROM e JOIN o USING (item_id, change_day) JOIN a USING (item_id, change_day))
  SELECT item_id, change_day, before, after, price_change_pct, demand_change_pct, control_change_pct, (1 + demand_change_pct) / nullif(1 + control_change_pct, 0) - 1 AS adjusted_change_pct, CASE WHEN evaluable THEN ((1 + demand_change_pct) / nullif(1 + control_change_pct, 0) - 1) / price_change_pct END AS elasticity, evaluable
    FROM (SELECT *, change_day - 90 >= DATE '1995-01-01' AND change_day + 89 <= DATE '2001-08-01' AND before > 0 AND rest > 0 AND abs(price_change_pct) >= 0.05 AS evaluable FROM r)"""


def _sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    events = _impact(spark, sf).withColumns({"elasticity": F.round("elasticity", 6), "price_change_pct": F.round("price_change_pct", 6)})
    return pricing.sensitivity(fr.items(spark, sf), events)


def price_sensitivity(spark: SparkSession, sf: str) -> DataFrame:
    return _sensitivity(spark, sf)


PRICE_SENSITIVITY = f"""WITH e AS (SELECT item_id, round(elasticity, 6) AS elasticity, round(price_change_pct, 6) AS price_change_pct FROM ({PRICE_IMPACT}) WHERE evaluable QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY abs(round(price_change_pct, 6)) DESC, change_day) = 1),
  j AS (SELECT items.item_id, elasticity, price_change_pct, e.item_id IS NOT NULL AS found, coalesce(elasticity < 0, false) AS neg FROM items LEFT JOIN e USING (item_id)), p AS (SELECT *, percent_rank() OVER (PARTITION BY neg ORDER BY abs(elasticity) NULLS FIRST) AS p FROM j)
  SELECT item_id, elasticity, price_change_pct, CASE WHEN NOT found THEN 'Not Evaluated' WHEN NOT neg THEN 'Inconclusive' WHEN p > 0.67 THEN 'High' WHEN p < 0.33 THEN 'Low' ELSE 'Moderate' END AS sensitivity FROM p"""

# Promotions


def _scoped(spark: SparkSession, sf: str) -> DataFrame:
    return promotions.scope(fr.promotions(spark, sf), fr.promotion_items(spark, sf), fr.promotion_locations(spark, sf))


def promotion_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return promotions.window_metrics(_scoped(spark, sf), fr.lines(spark, sf), fr.waste(spark, sf))


_SCOPE = "SELECT promotion_id, item_id, location_id, start_day, end_day, (datediff('day', start_day, end_day) + 1)::INT AS len FROM promotions JOIN promotion_items USING (promotion_id) JOIN promotion_locations USING (promotion_id)"
_PERIOD = "CASE WHEN day < start_day THEN 'pre' WHEN day < start_day + len THEN 'during' ELSE 'post' END"
PROMOTION_METRICS = f"""WITH s AS ({_SCOPE}), l AS (SELECT promotion_id, {_PERIOD} AS period, lines.*, revenue - cost AS m FROM (SELECT *, ts::DATE AS day FROM lines) lines JOIN s USING (item_id, location_id) WHERE day >= start_day - len AND day < start_day + 2 * len),
  w AS (SELECT promotion_id, {_PERIOD} AS period, sum(waste_cost) AS wastage_cost FROM waste JOIN s USING (item_id, location_id) WHERE day >= start_day - len AND day < start_day + 2 * len GROUP BY 1, 2),
  t AS (SELECT promotion_id, period, count(DISTINCT order_id) AS orders, sum(quantity) AS quantity, sum(revenue) AS revenue, sum(m) AS margin, count(DISTINCT customer_id) AS customers FROM l GROUP BY 1, 2),
  j AS (SELECT t.*, coalesce(wastage_cost, 0) AS wastage_cost FROM t LEFT JOIN w USING (promotion_id, period))
  SELECT *, revenue / nullif(orders, 0) AS revenue_per_order, margin / nullif(orders, 0) AS margin_per_order, margin / nullif(revenue, 0) AS margin_pct FROM j"""


def _compared(spark: SparkSession, sf: str) -> DataFrame:
    return promotions.compare(fr.promotions(spark, sf), promotion_metrics(spark, sf), FIRST_DAY, LAST_DAY)


def promotion_traps(spark: SparkSession, sf: str) -> DataFrame:
    return _compared(spark, sf).select("promotion_id", "volume_up_margin_down", "customers_up_margin_per_order_down", "wastage_up", "post_promo_drop", "trap_flags", "is_trap")


_AT = ", ".join(f"max({m}) FILTER (period = '{p}') AS {p}_{m}" for p in ("pre", "during", "post") for m in ("orders", "quantity", "revenue", "margin", "customers", "wastage_cost", "margin_per_order"))
PROMOTION_TRAPS = f"""WITH x AS (SELECT promotion_id, {_AT} FROM ({PROMOTION_METRICS}) GROUP BY 1), f AS (SELECT p.promotion_id,
  CASE WHEN a THEN coalesce((during_revenue > pre_revenue OR during_orders > pre_orders) AND during_margin < pre_margin, false) END AS volume_up_margin_down, CASE WHEN a THEN coalesce(during_customers > pre_customers AND during_margin_per_order < pre_margin_per_order * (1 - 0.05), false) END AS customers_up_margin_per_order_down,
  CASE WHEN a THEN coalesce(during_wastage_cost > pre_wastage_cost * (1 + 0.1), false) END AS wastage_up, CASE WHEN a AND b THEN coalesce(post_quantity < pre_quantity * (1 - 0.05), false) END AS post_promo_drop
  FROM (SELECT *, start_day - (datediff('day', start_day, end_day) + 1)::INT >= DATE '1995-01-01' AS a, end_day + (datediff('day', start_day, end_day) + 1)::INT <= DATE '2001-08-01' AS b FROM promotions) p LEFT JOIN x USING (promotion_id))
  SELECT *, coalesce(volume_up_margin_down::INT, 0) + coalesce(customers_up_margin_per_order_down::INT, 0) + coalesce(wastage_up::INT, 0) + coalesce(post_promo_drop::INT, 0) AS trap_flags,
  coalesce(volume_up_margin_down::INT, 0) + coalesce(customers_up_margin_per_order_down::INT, 0) + coalesce(wastage_up::INT, 0) + coalesce(post_promo_drop::INT, 0) > 0 AS is_trap FROM f"""

# Anomalies


def sales_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.sales_anomalies(fr.orders(spark, sf).where("status != 'Cancelled'"), fr.lines(spark, sf), 365, 14, 3.0)


def _rolling(kind: str, keys: str, daily: str, metric: str, location: str) -> str:
    over = f"OVER (PARTITION BY {keys} ORDER BY datediff('day', DATE '2000-01-01', day) RANGE BETWEEN 365 PRECEDING AND 1 PRECEDING)"
    return f"""SELECT '{kind}' AS anomaly_type, {keys}::VARCHAR AS entity_id, {location} AS location_id, day AS period_start, '{metric}' AS metric, v AS value, m AS baseline_mean, s AS baseline_std, (v - m) / s AS score FROM (
    SELECT *, avg(v) {over} AS m, stddev(v) {over} AS s, count(v) {over} AS n FROM ({daily})) WHERE n >= 14 AND s > 0 AND abs((v - m) / s) > 3"""


_PLACE = "SELECT location_id, ts::DATE AS day, {0} AS v FROM ords WHERE status <> 'Cancelled' GROUP BY 1, 2"
SALES_ANOMALIES = " UNION ALL ".join([
    _rolling("location_sales", "location_id", _PLACE.format("count(*)::DOUBLE"), "daily_orders", "location_id::VARCHAR"), _rolling("location_sales", "location_id", _PLACE.format("sum(total)"), "daily_revenue", "location_id::VARCHAR"),
    _rolling("item_sales", "item_id", "SELECT item_id, ts::DATE AS day, sum(quantity) AS v FROM lines GROUP BY 1, 2", "daily_quantity", "NULL"),
    _rolling("item_sales", "item_id", "SELECT item_id, ts::DATE AS day, sum(revenue) AS v FROM lines GROUP BY 1, 2", "daily_revenue", "NULL"),
])


def rating_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.rating_anomalies(anomaly.rating_weeks(fr.ratings(spark, sf)), 8, 2, 2.0, 0.4, 10)


_OVER = "OVER (PARTITION BY item_id ORDER BY w RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING)"
RATING_ANOMALIES = f"""WITH c AS (SELECT item_id, date_trunc('week', day)::DATE AS period_start, floor(datediff('day', DATE '2000-01-03', date_trunc('week', day)::DATE) / 7) AS w, rating, count(*) AS n FROM ratings GROUP BY ALL),
  k AS (SELECT item_id, period_start, w, sum(n)::DOUBLE AS rating_count, sum(n * rating) / sum(n) AS avg_rating, max(n) / sum(n) AS same, arg_max(rating, n * 10 - rating) AS top FROM c GROUP BY 1, 2, 3),
  z AS (SELECT item_id, period_start, w, 'avg_rating' AS metric, avg_rating AS v FROM k UNION ALL SELECT item_id, period_start, w, 'rating_count', rating_count FROM k),
  s AS (SELECT *, avg(v) OVER q AS m, stddev(v) OVER q AS d, count(v) OVER q AS n FROM z WINDOW q AS (PARTITION BY item_id, metric ORDER BY w RANGE BETWEEN 8 PRECEDING AND 1 PRECEDING))
  SELECT 'rating_zscore' AS anomaly_type, item_id::VARCHAR AS entity_id, NULL AS location_id, period_start, metric, v AS value, m AS baseline_mean, d AS baseline_std, (v - m) / d AS score FROM s WHERE n >= 2 AND d > 0 AND abs((v - m) / d) > 2
  UNION ALL SELECT 'identical_ratings', item_id::VARCHAR, NULL, period_start, 'share_of_rating_' || top::VARCHAR, same, NULL, NULL, rating_count FROM k WHERE same >= 0.4 AND rating_count >= 10"""


def high_value_orders(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.high_value_orders(fr.orders(spark, sf), 0.4).select("anomaly_type", "entity_id", "period_start", "value", "score")


HIGH_VALUE_ORDERS = "SELECT 'high_value_order' AS anomaly_type, order_id::VARCHAR AS entity_id, ts::DATE AS period_start, total AS value, total / fence AS score FROM ords, (SELECT quantile_cont(total, 0.75) + 0.4 * (quantile_cont(total, 0.75) - quantile_cont(total, 0.25)) AS fence FROM ords) WHERE total > fence"


def duplicate_transactions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of a customer in a quarter with the same share of categories stand in for those of a minute."""
    o = fr.orders(spark, sf).withColumn("ts", F.date_trunc("quarter", "ts"))
    li = fr.all_lines(spark, sf).select("order_id", F.col("returnflag").alias("item_id"), F.lit(1).alias("quantity")).distinct()
    return anomaly.duplicate_transactions(o, li).select("entity_id", "value")


DUPLICATE_TRANSACTIONS = """WITH c AS (SELECT order_id, list_aggregate(list_sort(list(DISTINCT returnflag)), 'string_agg', ',') AS content FROM all_lines GROUP BY 1)
  SELECT order_id::VARCHAR AS entity_id, n AS value FROM (SELECT order_id, count(*) OVER (PARTITION BY customer_id, date_trunc('quarter', ts), content)::DOUBLE AS n FROM ords JOIN c USING (order_id)) WHERE n > 1"""


def anomaly_reports(spark: SparkSession, sf: str) -> DataFrame:
    found = sales_anomalies(spark, sf)
    busy = anomaly.busiest_days(found, fr.promotions(spark, sf), 5, 3)
    return busy.select("period_start", "n", F.concat_ws(",", F.col("promotions").cast("array<string>")).alias("promotions"))


ANOMALY_REPORTS = f"""WITH d AS (SELECT period_start, count(*) AS n FROM ({SALES_ANOMALIES}) GROUP BY 1 ORDER BY n DESC, period_start LIMIT 5)
  SELECT period_start, n, coalesce(list_aggregate(list_sort(list(promotion_id) FILTER (promotion_id IS NOT NULL)), 'string_agg', ','), '') AS promotions FROM d LEFT JOIN promotions ON abs(datediff('day', period_start, start_day)) <= 3 GROUP BY 1, 2"""


def anomaly_counts(spark: SparkSession, sf: str) -> DataFrame:
    found = anomaly.all_anomalies(sales_anomalies(spark, sf), rating_anomalies(spark, sf))
    weekly = reports.weekly_counts(found).groupBy("anomaly_type").agg(F.count("*").alias("weeks"))
    return anomaly.counts(found).join(weekly, "anomaly_type")


ANOMALY_COUNTS = f"""WITH a AS (SELECT * FROM ({SALES_ANOMALIES}) UNION ALL SELECT * FROM ({RATING_ANOMALIES})) SELECT anomaly_type, metric, count(*) AS n, weeks FROM a JOIN (SELECT anomaly_type, count(DISTINCT date_trunc('week', period_start)) AS weeks FROM a GROUP BY 1) USING (anomaly_type) GROUP BY ALL"""


def recent_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.recent(sales_anomalies(spark, sf), ["location_sales"], 10, date(1998, 1, 1)).select("entity_id", "period_start", "metric", "value")


RECENT_ANOMALIES = f"SELECT entity_id, period_start, metric, value FROM ({SALES_ANOMALIES}) WHERE anomaly_type = 'location_sales' AND period_start >= DATE '1998-01-01' ORDER BY period_start DESC, entity_id, metric LIMIT 10"

# Forecast: users of events stand in for items, types of event for locations


def _events_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Each series of a user and type has a row for each day from its first to its last, so that lags have whole history."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("item_id"), F.col("event_type").alias("location_id"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1.0).alias("quantity"))
    return forecast.daily_series(e)


_SERIES = "SELECT item_id, location_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY))::DATE AS day FROM e GROUP BY 1, 2"
_DAILY = f"WITH e AS (SELECT user_id AS item_id, event_type AS location_id, ts::DATE AS day FROM events), n AS (SELECT item_id, location_id, day, count(*)::DOUBLE AS q FROM e GROUP BY 1, 2, 3) SELECT item_id, location_id, day, coalesce(q, 0) AS qty FROM ({_SERIES}) LEFT JOIN n USING (item_id, location_id, day)"


def _table(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.training_table(_events_daily(spark, sf), 7)


def training_table(spark: SparkSession, sf: str) -> DataFrame:
    return _table(spark, sf).select("item_id", "location_id", "day", "lag_1", "lag_7", "lag_14", "mean_7", "mean_14", "target", "target_day", "baseline")


def _back(name: str, days: int) -> str:
    return f"LEFT JOIN d {name} ON {name}.item_id = d.item_id AND {name}.location_id = d.location_id AND {name}.day = d.day - {days}"


_MEANS = "SELECT item_id, location_id, day, CASE WHEN count(*) OVER s = 7 THEN avg(qty) OVER s END AS m7, CASE WHEN count(*) OVER f = 14 THEN avg(qty) OVER f END AS m14 FROM d WINDOW s AS (PARTITION BY item_id, location_id ORDER BY datediff('day', DATE '2000-01-01', day) RANGE 6 PRECEDING), f AS (PARTITION BY item_id, location_id ORDER BY datediff('day', DATE '2000-01-01', day) RANGE 13 PRECEDING)"
TRAINING_TABLE = f"""WITH d AS ({_DAILY}), m AS ({_MEANS}) SELECT d.item_id, d.location_id, d.day, a.qty AS lag_1, b.qty AS lag_7, c.qty AS lag_14, m7 AS mean_7, m14 AS mean_14, t.qty AS target, d.day + 6 AS target_day, l.qty AS baseline
  FROM d {_back("a", 1)} {_back("b", 7)} {_back("c", 14)} {_back("t", -6)} {_back("l", 1)} LEFT JOIN m ON m.item_id = d.item_id AND m.location_id = d.location_id AND m.day = d.day - 1
  WHERE a.qty IS NOT NULL AND b.qty IS NOT NULL AND c.qty IS NOT NULL AND m7 IS NOT NULL AND m14 IS NOT NULL AND t.qty IS NOT NULL AND l.qty IS NOT NULL"""


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """A plain prediction in the model's place, which SQL can give as well: 0.93 of the mean of a week."""
    return _table(spark, sf).withColumns({"prediction": F.col("mean_7") * 0.93, "category_id": F.col("item_id") % 4})


def forecast_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.level_metrics(_predicted(spark, sf))


_LEVEL = "SELECT {1} sum(greatest(mean_7 * 0.93, 0)) AS forecast, sum(target) AS target, sum(baseline) AS baseline FROM p GROUP BY {1} target_day"
_ERRORS = "SELECT '{0}' AS level, '{2}' AS model, avg(abs({2} - target)) AS mae, sqrt(avg(({2} - target) ** 2)) AS rmse, avg(abs(({2} - target) / target)) FILTER (target <> 0) AS mape, 1 - sum(({2} - target) ** 2) / (var_pop(target) * count(*)) AS r2, count(*) AS n, count(*) FILTER (target = 0) AS n_zero FROM ({1})"
FORECAST_METRICS = f"WITH p AS (SELECT *, item_id % 4 AS category_id FROM ({TRAINING_TABLE})) " + " UNION ALL ".join(
    _ERRORS.format(level, _LEVEL.format(level, keys), model) for level, keys in (("item_location", "item_id, location_id,"), ("item", "item_id,"), ("category", "category_id,"), ("location", "location_id,"), ("overall", "")) for model in ("forecast", "baseline")
)


def forecast_by_volume(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.errors_by_volume(forecast.roll_up(_predicted(spark, sf), "item"))


FORECAST_BY_VOLUME = f"""WITH r AS (SELECT item_id, target_day, sum(greatest(mean_7 * 0.93, 0)) AS forecast, sum(baseline) AS baseline, sum(target) AS target FROM ({TRAINING_TABLE}) GROUP BY 1, 2),
  e AS (SELECT *, CASE WHEN target <= 5 THEN '1-5' WHEN target <= 20 THEN '6-20' WHEN target <= 50 THEN '21-50' ELSE '51+' END AS bucket, abs(forecast - target) / target AS m, abs(baseline - target) / target AS b, (forecast > target)::INT AS o FROM r WHERE target > 0)
  SELECT bucket, count(*) AS n, avg(m) AS model_ape, avg(b) AS baseline_ape, avg(o) AS over_share FROM e GROUP BY 1 UNION ALL SELECT 'all', count(*), quantile_cont(m, 0.5), quantile_cont(b, 0.5), avg(o) FROM e HAVING count(*) > 0"""


def forecast_split(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.chronological_split(_table(spark, sf), 5).groupBy("is_test").agg(F.count("*").alias("n"), F.min("target_day").alias("first_day"))


FORECAST_SPLIT = f"SELECT target_day > (SELECT max(target_day) FROM ({TRAINING_TABLE})) - 5 AS is_test, count(*) AS n, min(target_day) AS first_day FROM ({TRAINING_TABLE}) GROUP BY 1"


def _with_covariates(spark: SparkSession, sf: str) -> DataFrame:
    # written once: promotions and prices are made from it too
    tables.checkpoint_dir(spark)
    rows = _table(spark, sf).checkpoint()
    promo = rows.select("item_id", "location_id", F.col("target_day").alias("day")).where("item_id % 3 = 0")
    price = rows.select("item_id", "location_id", F.col("target_day").alias("day"), (F.col("item_id") * 1.5).alias("price")).distinct()
    return forecast.with_covariates(rows, promo, price, fr.items(spark, sf))


def forecast_covariates(spark: SparkSession, sf: str) -> DataFrame:
    return _with_covariates(spark, sf).select("item_id", "location_id", "target_day", "dow", "month", "is_weekend", "on_promo", "is_seasonal", "price")


FORECAST_COVARIATES = f"SELECT t.item_id, location_id, target_day, (dayofweek(target_day) + 1)::INT AS dow, month(target_day)::INT AS month, (dayofweek(target_day) + 1 IN (6, 7, 1))::INT AS is_weekend, (t.item_id % 3 = 0)::INT AS on_promo, coalesce(is_seasonal, false)::INT AS is_seasonal, t.item_id * 1.5 AS price FROM ({TRAINING_TABLE}) t LEFT JOIN items ON items.item_id = t.item_id"


def _item_days(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.roll_up(_predicted(spark, sf), "item").withColumn("actual", F.col("target"))


def high_demand(spark: SparkSession, sf: str) -> DataFrame:
    return forecast.high_demand_days(_item_days(spark, sf), 1.2)


_ITEM_DAYS = f"SELECT item_id, target_day, sum(greatest(mean_7 * 0.93, 0)) AS forecast, sum(mean_14) AS recent_average, sum(target) AS actual FROM ({TRAINING_TABLE}) GROUP BY 1, 2"
HIGH_DEMAND = f"SELECT target_day, count(*) AS n_items, sum(forecast - recent_average) AS extra FROM ({_ITEM_DAYS}) WHERE forecast >= 1.2 * recent_average GROUP BY 1"


def _forecasts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(predictions for the test days, importances) of a boosted model trained on the days before them. They are a snapshot, written once for each session and folder, which all that follows reads."""
    if (spark.sparkContext.applicationId, sf) not in _STORED_FORECASTS:
        path = tables.new_folder(spark, "forecasts")
        _with_covariates(spark, sf).write.parquet(f"{path}/rows")
        split = forecast.chronological_split(spark.read.parquet(f"{path}/rows"), 5)
        model = forecast.fit(split.where("not is_test"), forecast.INPUTS)
        kept = [*forecast.KEYS, "day", "target_day", "target", "baseline", forecast.RECENT]
        tables.write_snapshot(forecast.predict(model, split.where("is_test"), kept), f"{path}/predicted", AS_OF)
        forecast.importances(model, forecast.INPUTS, split).write.parquet(f"{path}/importances")
        _STORED_FORECASTS[spark.sparkContext.applicationId, sf] = path
    path = _STORED_FORECASTS[spark.sparkContext.applicationId, sf]
    return tables.read_snapshot(spark, f"{path}/predicted").drop("as_of_date").withColumn("category_id", F.col("item_id") % 4), spark.read.parquet(f"{path}/importances")


def forecast_model(spark: SparkSession, sf: str) -> DataFrame:
    """Importances of a boosted model's inputs."""
    return _forecasts(spark, sf)[1]


def forecast_model_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Errors of the boosted model and of the baseline on the test days, at five levels."""
    return forecast.level_metrics(_forecasts(spark, sf)[0])


def forecast_model_peaks(spark: SparkSession, sf: str) -> DataFrame:
    """Days on which the boosted model expects items at 1.25 of their recent level or more."""
    return forecast.high_demand_days(forecast.roll_up(_forecasts(spark, sf)[0], "item"))


def forecast_model_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What the boosted model expects of each category on the test days, its recent level, and what came."""
    return reports.forecast_totals(forecast.roll_up(_forecasts(spark, sf)[0], "category").withColumn("actual", F.col("target")), ["category_id"])


def forecast_totals(spark: SparkSession, sf: str) -> DataFrame:
    return reports.forecast_totals(_item_days(spark, sf), ["item_id"])


# Item classifier


def item_classifier(spark: SparkSession, sf: str) -> DataFrame:
    """Test and cross-validation scores of three algorithms that learn the categories."""
    chain = entities._chain(spark, sf)
    inputs = ["profit_percentage", "total_quantity_sold", "average_rating", "repeat_purchase_rate", "wastage_percentage"]
    rows = models.prepare(chain, inputs, ["wastage_percentage"])
    return models.select_best(rows, inputs, "category", "item_id", models.candidates()).scores


# Recommendations and scenarios


def _recommendations(spark: SparkSession, sf: str) -> DataFrame:
    """The parts are made and written one after the other, and so are the tables that several of them read: in one plan they would hold all their broadcasts in the driver at once."""

    def kept(df: DataFrame) -> DataFrame:
        return tables.written(df, "recommended")

    chain = kept(entities._chain(spark, sf))
    compared = classify.with_consistency(chain, kept(entities._local(spark, sf)))
    rules = kept(pair_rules(spark, sf)).withColumns({"antecedent": F.array("antecedent"), "consequent": F.array("consequent"), "lift": F.round("lift", 6), "confidence": F.round("confidence", 6)})
    revenue = chain.groupBy(F.col("category_id").alias("item_id")).agg(F.sum("total_revenue").alias("total_revenue"))
    risk = _risk_rows(spark, sf).select("item_id", F.expr(_RULE).cast("int").alias("prediction"))
    customers = kept(entities._rounded_customers(spark, sf))
    segments = customers.join(entities.rule_segments(spark, sf).select("customer_id", F.col("rule_segment").alias("segment")), "customer_id")
    parts = [
        recommend.hidden_opportunities(chain), recommend.high_wastage(chain, risk), recommend.price_sensitive(_sensitivity(spark, sf), chain), recommend.bundles(rules, revenue, 1.05), recommend.low_performers(compared), recommend.stock_before_peak(_item_days(spark, sf), chain, 0.2, 0),
        recommend.segment_campaigns(kept(segments), kept(entities.churn(spark, sf))), recommend.ineffective_promotions(_compared(spark, sf)), recommend.anomalous_locations(kept(sales_anomalies(spark, sf)), 3, 2),
    ]
    # a little is added, as amounts of few decimals may lie half way between two cents
    return recommend.ranked(*[kept(p.withColumn("impact", F.round(F.col("impact") + 3.14159e-5, 2))) for p in parts])


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return _recommendations(spark, sf).select("recommendation_id", "type", "target_id", "priority", "impact", F.concat_ws("; ", "evidence").alias("evidence"))


def recommendation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return reports.recommendation_counts(_recommendations(spark, sf)).groupBy("type").agg(F.sum("n").alias("n"))


_CHAIN = entities._CHAIN_SQL
RECOMMENDATION_COUNTS = f"""SELECT 'Promote hidden opportunity' AS type, count(*) AS n FROM ({_CHAIN}) WHERE category = 'Hidden Opportunity' AND profit_tier = 'High'
  UNION ALL SELECT 'Reduce preparation', count(*) FROM ({_CHAIN}) LEFT JOIN (SELECT item_id, avg(({_RULE})::INT) AS s FROM ({RISK_TABLE}) GROUP BY 1) USING (item_id) WHERE excessive_wastage OR s >= 0.5
  UNION ALL SELECT 'Review price', count(*) FROM ({PRICE_SENSITIVITY}) JOIN ({_CHAIN}) USING (item_id) WHERE sensitivity = 'High'
  UNION ALL SELECT 'Bundle items', count(DISTINCT [least(antecedent, consequent), greatest(antecedent, consequent)]) FROM ({PAIR_RULES}) WHERE round(lift, 6) >= 1.05 HAVING count(*) > 0
  UNION ALL SELECT 'Remove or redesign', count(*) FROM ({_CHAIN}) JOIN (SELECT item_id, avg((category = 'Low Performer')::INT) AS low FROM ({entities._LOCAL_CLASSES}) GROUP BY 1 HAVING count(*) >= 3) USING (item_id) WHERE category = 'Low Performer' AND low >= 0.75
  UNION ALL SELECT 'Stock before peak', count(DISTINCT item_id) FROM ({_ITEM_DAYS}) JOIN ({_CHAIN}) USING (item_id) WHERE forecast >= recent_average * 1.2 AND total_quantity_sold > 0 HAVING count(*) > 0
  UNION ALL SELECT 'Target segment', count(DISTINCT rule_segment) FROM ({entities.RULE_SEGMENTS})
  UNION ALL SELECT 'Review promotion', count(*) FROM ({PROMOTION_TRAPS}) WHERE trap_flags > 0
  UNION ALL SELECT 'Investigate location', count(*) FROM (SELECT location_id FROM ({SALES_ANOMALIES}) JOIN (SELECT period_start, count(DISTINCT location_id) AS k FROM ({SALES_ANOMALIES}) WHERE anomaly_type = 'location_sales' GROUP BY 1) USING (period_start) WHERE anomaly_type = 'location_sales' AND k < 3 GROUP BY 1 HAVING count(*) >= 2)"""



def recommendation_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every recommendation with its number, target, priority and impact."""
    return _recommendations(spark, sf).select("recommendation_id", "type", "target_type", "target_id", "priority", "impact")


def recommendation_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.recommendation_counts(_recommendations(spark, sf))


_ALL_RECOMMENDATIONS = f"""WITH chain AS (SELECT * FROM ({_CHAIN})), rules AS (SELECT least(antecedent, consequent) || '+' || greatest(antecedent, consequent) AS id, antecedent, consequent, round(lift, 6) AS lift, round(confidence, 6) AS confidence FROM ({PAIR_RULES}) WHERE round(lift, 6) >= 1.05),
  worth AS (SELECT category_id, sum(total_revenue) AS revenue FROM chain GROUP BY 1), odd AS (SELECT * FROM ({SALES_ANOMALIES}) WHERE anomaly_type = 'location_sales'), alone AS (SELECT period_start FROM odd GROUP BY 1 HAVING count(DISTINCT location_id) < 3),
  peaks AS (SELECT item_id, max(forecast - recent_average) AS extra FROM ({_ITEM_DAYS}) WHERE forecast >= recent_average * 1.2 AND forecast - recent_average >= 0 GROUP BY 1),
  wide AS (SELECT promotion_id, {_AT} FROM ({PROMOTION_METRICS}) GROUP BY 1),
  r AS (SELECT 'Promote hidden opportunity' AS type, 'item' AS target_type, item_id::VARCHAR AS target_id, contribution_margin AS impact FROM chain WHERE category = 'Hidden Opportunity' AND profit_tier = 'High'
  UNION ALL SELECT 'Reduce preparation', 'item', item_id::VARCHAR, wastage_cost FROM chain LEFT JOIN (SELECT item_id, avg(({_RULE})::INT) AS s FROM ({RISK_TABLE}) GROUP BY 1) USING (item_id) WHERE excessive_wastage OR s >= 0.5
  UNION ALL SELECT 'Review price', 'item', item_id::VARCHAR, total_revenue FROM ({PRICE_SENSITIVITY}) JOIN chain USING (item_id) WHERE sensitivity = 'High'
  UNION ALL SELECT 'Bundle items', 'item_set', id, (lift - 1) * (coalesce(a.revenue, 0) + coalesce(c.revenue, 0)) FROM (SELECT * FROM rules QUALIFY row_number() OVER (PARTITION BY id ORDER BY confidence DESC, lift DESC, antecedent) = 1) LEFT JOIN worth a ON a.category_id = antecedent LEFT JOIN worth c ON c.category_id = consequent
  UNION ALL SELECT 'Remove or redesign', 'item', item_id::VARCHAR, wastage_cost + greatest(-contribution_margin, 0) FROM chain JOIN (SELECT item_id, avg((category = 'Low Performer')::INT) AS low FROM ({entities._LOCAL_CLASSES}) GROUP BY 1 HAVING count(*) >= 3) USING (item_id) WHERE category = 'Low Performer' AND low >= 0.75
  UNION ALL SELECT 'Stock before peak', 'item', item_id::VARCHAR, extra * contribution_margin / total_quantity_sold FROM peaks JOIN chain USING (item_id) WHERE total_quantity_sold > 0
  UNION ALL SELECT 'Target segment', 'segment', rule_segment, sum(round(customer_monetary_value, 2)) FROM ({entities.CUSTOMER_FEATURES}) JOIN ({entities.RULE_SEGMENTS}) USING (customer_id) GROUP BY rule_segment
  UNION ALL SELECT 'Review promotion', 'promotion', promotion_id::VARCHAR, greatest(pre_margin - during_margin, (pre_margin_per_order - during_margin_per_order) * during_orders, 0) + greatest(during_wastage_cost - pre_wastage_cost, 0) FROM ({PROMOTION_TRAPS}) JOIN wide USING (promotion_id) WHERE trap_flags > 0
  UNION ALL SELECT 'Investigate location', 'location', location_id, coalesce(sum(abs(value - baseline_mean)) FILTER (metric = 'daily_revenue'), 0) FROM odd WHERE period_start IN (SELECT period_start FROM alone) GROUP BY location_id HAVING count(*) >= 2),
  m AS (SELECT type, target_type, target_id, round(impact + 3.14159e-5::DOUBLE, 2) AS impact FROM r), n AS (SELECT *, row_number() OVER (ORDER BY impact DESC, type, target_id) AS k, rank() OVER (ORDER BY impact DESC) / count(*) OVER () AS s FROM m)
  SELECT 'REC-' || CASE WHEN k < 1000 THEN lpad(k::VARCHAR, 3, '0') ELSE k::VARCHAR END AS recommendation_id, type, target_type, target_id, CASE WHEN s <= 0.1 + 1e-12 THEN 'Critical' WHEN s <= 0.1 + 0.2 + 1e-12 THEN 'High' WHEN s <= 0.1 + 0.2 + 0.4 + 1e-12 THEN 'Medium' ELSE 'Low' END AS priority, impact FROM n"""
RECOMMENDATION_SUMMARY = f"SELECT priority, type, count(*) AS n, max(impact) AS highest_impact FROM ({_ALL_RECOMMENDATIONS}) GROUP BY 1, 2"

_GRID: list[tuple[str, float | None]] = [("price_change", 0.1), ("price_change", -0.05), ("discount_change", 0.2), ("promotion_frequency", 1.5), ("remove_item", None), ("reduce_prep", 0.3), ("demand_change", -0.2), ("wastage_assumption", 0.1)]


def scenarios(spark: SparkSession, sf: str) -> DataFrame:
    compared = _compared(spark, sf).where("volume_up_margin_down is not null").select("promotion_id", (F.col("pre_margin") / F.nullif(F.col("pre_revenue"), F.lit(0.0))).alias("pre_margin_pct"), (F.col("during_margin") / F.nullif(F.col("during_revenue"), F.lit(0.0))).alias("during_margin_pct"))
    base = scenario.baseline_rows(entities._item_table(spark, sf), _sensitivity(spark, sf), compared, _item_days(spark, sf), AS_OF)
    return scenario.simulate(base, _GRID).select("item_id", "scenario", "value", "revenue", "contribution_margin", "demand", "wastage_units", "net_margin_after_wastage", F.size("flags").cast("bigint").alias("n_flags"))


_WASTE = "quantity * wastage_pct / (1 - wastage_pct)"
SCENARIOS = f"""WITH e AS (SELECT coalesce(quantile_cont(d - p, 0.5), 0) AS effect FROM (SELECT max(margin / nullif(revenue, 0)) FILTER (period = 'pre') AS p, max(margin / nullif(revenue, 0)) FILTER (period = 'during') AS d FROM ({PROMOTION_METRICS}) JOIN promotions USING (promotion_id) WHERE start_day - (datediff('day', start_day, end_day) + 1)::INT >= DATE '1995-01-01' GROUP BY promotion_id) WHERE p IS NOT NULL AND d IS NOT NULL),
  f AS (SELECT item_id, avg(forecast) AS daily FROM ({_ITEM_DAYS}) GROUP BY 1), q AS (SELECT * FROM ({PRICE_SENSITIVITY})),
  b AS (SELECT i.item_id, coalesce(total_revenue / nullif(total_quantity_sold, 0), 0) AS price, coalesce(total_cost / nullif(total_quantity_sold, 0), 0) AS unit_cost, total_quantity_sold AS quantity, coalesce(wastage_percentage, 0) AS wastage_pct, coalesce(discount_rate, 0) AS disc, coalesce(promotion_dependency, 0) AS dep,
    CASE WHEN sensitivity IN ('High', 'Moderate', 'Low') AND elasticity < 0 THEN greatest(-3.0, elasticity) ELSE -0.7 END AS el, effect, least(days_since_launch, 212) + 1 AS days, daily FROM ({entities._ITEMS_SQL}) i LEFT JOIN q USING (item_id) LEFT JOIN f USING (item_id), e),
  g AS (SELECT *, CASE WHEN wastage_pct < 1 THEN {_WASTE} ELSE 0 END AS w FROM b, (SELECT unnest([{', '.join(f"'{n}'" for n, _ in _GRID)}]) AS scenario, unnest([{', '.join('NULL' if v is None else f'{v}::DOUBLE' for _, v in _GRID)}]) AS value)),
  p AS (SELECT *, CASE scenario WHEN 'price_change' THEN value WHEN 'discount_change' THEN (1 - value) / nullif(1 - disc, 0) - 1 END AS pct FROM g),
  s AS (SELECT *, CASE WHEN scenario IN ('price_change', 'discount_change') THEN greatest(0, quantity * (1 + el * pct)) WHEN scenario = 'promotion_frequency' THEN quantity * (1 + dep * (value - 1)) WHEN scenario = 'remove_item' THEN 0 WHEN scenario = 'reduce_prep' THEN quantity - greatest(0, (quantity + w) * value - w)
    WHEN scenario = 'demand_change' THEN quantity * greatest(0, 1 + value) ELSE quantity END AS q2, CASE WHEN scenario IN ('price_change', 'discount_change') THEN price * (1 + pct) ELSE price END AS price2 FROM p),
  t AS (SELECT *, CASE WHEN scenario IN ('price_change', 'discount_change') THEN w * coalesce(q2 / nullif(quantity, 0), 0) WHEN scenario = 'promotion_frequency' THEN w * (1 + dep * (value - 1)) WHEN scenario = 'remove_item' THEN 0 WHEN scenario = 'reduce_prep' THEN greatest(0, w - (quantity + w) * value)
    WHEN scenario = 'demand_change' THEN w * greatest(0, 1 + value) ELSE quantity * value / (1 - value) END AS w2 FROM s),
  m AS (SELECT *, CASE WHEN scenario = 'promotion_frequency' THEN price * quantity * (1 + dep * (value - 1)) ELSE price2 * q2 END AS revenue, CASE WHEN scenario = 'promotion_frequency' THEN (price - unit_cost) * quantity + price * quantity * dep * (value - 1) * (coalesce((price - unit_cost) * quantity / nullif(price * quantity, 0), 0) + effect)
    ELSE (price2 - unit_cost) * q2 END AS contribution_margin FROM t)
  SELECT item_id, scenario, value, revenue, contribution_margin, q2 AS demand, w2 AS wastage_units, contribution_margin - w2 * unit_cost AS net_margin_after_wastage,
    coalesce((scenario = 'price_change' AND quantity * (1 + el * value) <= 0)::BIGINT, 0) + coalesce((scenario = 'promotion_frequency' AND dep = 0)::BIGINT, 0) + coalesce((scenario = 'reduce_prep' AND (quantity + w) * value > w)::BIGINT, 0) + coalesce((scenario = 'reduce_prep' AND (quantity + w) * (1 - value) / days < daily)::BIGINT, 0) AS n_flags FROM m"""

# Reports


def kpis(spark: SparkSession, sf: str) -> DataFrame:
    return reports.executive_kpis(fr.orders(spark, sf), fr.lines(spark, sf), fr.waste(spark, sf))


KPIS = """SELECT count(*) FILTER (status <> 'Cancelled') AS orders, avg((status = 'Cancelled')::INT) AS cancel_rate, (SELECT sum(revenue) FROM lines) AS net_sales, (SELECT sum(revenue - cost) FROM lines) AS profit, (SELECT count(DISTINCT customer_id) FROM ords WHERE status <> 'Cancelled') AS active_customers,
  (SELECT count(*) FROM (SELECT customer_id FROM ords WHERE status <> 'Cancelled' GROUP BY 1 HAVING count(*) > 1)) AS repeat_customers, (SELECT sum(waste_cost) FROM waste) AS waste_cost, (SELECT sum(revenue) FROM lines) / count(*) FILTER (status <> 'Cancelled') AS average_order_value FROM ords"""


def monthly(spark: SparkSession, sf: str) -> DataFrame:
    return reports.monthly_sales(fr.lines(spark, sf))


MONTHLY = """WITH m AS (SELECT date_trunc('month', ts)::DATE AS month, sum(revenue) AS net_sales, coalesce(sum(revenue) FILTER (promo), 0) / sum(revenue) AS promo_share FROM lines GROUP BY 1) SELECT *, net_sales / lag(net_sales) OVER (ORDER BY month) - 1 AS change, month = (SELECT arg_max(month, net_sales) FROM m) AS is_best FROM m"""


def sales_by_location(spark: SparkSession, sf: str) -> DataFrame:
    return reports.sales_by(fr.lines(spark, sf), ["location_id"])


def segment_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities._rounded_customers(spark, sf).join(entities.rule_segments(spark, sf).select("customer_id", F.col("rule_segment").alias("segment")), "customer_id").join(entities.churn(spark, sf).select("customer_id", "at_risk"), "customer_id")
    return reports.segment_summary(rows)


SEGMENT_REPORT = f"""SELECT rule_segment AS segment, count(*) AS customers, sum(round(customer_monetary_value, 2)) AS spend, avg(round(customer_monetary_value, 2)) AS average_spend, avg(customer_recency) AS average_recency, avg(customer_frequency) AS average_frequency, avg(at_risk::INT) AS churn_share,
  sum(round(customer_monetary_value, 2)) / sum(sum(round(customer_monetary_value, 2))) OVER () AS spend_share FROM ({entities.CUSTOMER_FEATURES}) JOIN ({entities.RULE_SEGMENTS}) USING (customer_id) JOIN ({entities.CHURN}) USING (customer_id) GROUP BY 1"""


def rfm_report(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities.rfm(spark, sf).join(entities.rule_segments(spark, sf).select("customer_id", "rule_segment"), "customer_id")
    return reports.rfm_distribution(rows, "rule_segment")


RFM_REPORT = f"SELECT rule_segment, quantile_cont(rfm_score, 0.5) AS median_rfm, avg((rfm_score >= 12)::INT) AS high_share, avg((rfm_score <= 6)::INT) AS low_share FROM ({entities.RFM}) JOIN ({entities.RULE_SEGMENTS}) USING (customer_id) GROUP BY 1"


def customer_lists(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities._rounded_customers(spark, sf).withColumn("promo_order_share", F.round("promo_order_share", 6)).join(entities.churn(spark, sf).select("customer_id", "at_risk"), "customer_id")
    return reports.customer_lists(rows)


CUSTOMER_LISTS = f"""WITH c AS (SELECT customer_id, round(customer_monetary_value, 2) AS v, round(promo_order_share, 6) AS p, at_risk FROM ({entities.CUSTOMER_FEATURES}) JOIN ({entities.CHURN}) USING (customer_id))
  SELECT * FROM (SELECT 'high_value' AS list, row_number() OVER (ORDER BY v DESC, customer_id)::INT AS rank, customer_id, v AS value FROM c QUALIFY rank <= 10) UNION ALL SELECT * FROM (SELECT 'at_risk', row_number() OVER (ORDER BY v DESC, customer_id)::INT AS rank, customer_id, v FROM c WHERE at_risk QUALIFY rank <= 10)
  UNION ALL SELECT * FROM (SELECT 'promotion_sensitive', row_number() OVER (ORDER BY p DESC, customer_id)::INT AS rank, customer_id, p FROM c WHERE p >= 0.5 QUALIFY rank <= 10)"""


def waste_reports(spark: SparkSession, sf: str) -> DataFrame:
    return reports.weekly_waste(fr.waste(spark, sf))


def waste_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return reports.waste_by_reason(fr.waste(spark, sf))


def sales_cube(spark: SparkSession, sf: str) -> DataFrame:
    return reports.daily_item_sales(fr.lines(spark, sf)).groupBy("location_id", "category_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))


SALES_CUBE = "SELECT location_id, category_id, count(DISTINCT (ts::DATE, item_id)) AS n, sum(quantity) AS quantity, sum(revenue) AS revenue FROM lines GROUP BY 1, 2"


def dishes(spark: SparkSession, sf: str) -> DataFrame:
    rows = entities._item_table(spark, sf).withColumn("contribution_margin", F.round("contribution_margin", 2))
    return reports.dish_rankings(rows, "contribution_margin", 10, ("order_frequency", 5))


DISHES = f"""WITH i AS (SELECT item_id, round(contribution_margin, 2) AS value, total_quantity_sold / nullif(days_since_launch, 0) AS units_per_day FROM ({entities._ITEMS_SQL}) WHERE order_frequency >= 5) (SELECT 'top' AS "end", * FROM i ORDER BY value DESC, item_id LIMIT 10) UNION ALL (SELECT 'bottom', * FROM i ORDER BY value, item_id LIMIT 10)"""


def categories(spark: SparkSession, sf: str) -> DataFrame:
    return reports.category_summary(fr.lines(spark, sf))


CATEGORIES = "SELECT category_id, sum(revenue) AS revenue, count(DISTINCT order_id) AS orders, sum(revenue) / sum(sum(revenue)) OVER () AS revenue_share, (sum(revenue) - sum(cost)) / sum(revenue) AS margin_rate, count(DISTINCT order_id) / (SELECT count(DISTINCT order_id) FROM lines) AS penetration FROM lines GROUP BY 1"


def heat_map(spark: SparkSession, sf: str) -> DataFrame:
    return reports.weekday_by_hour(table(spark, sf, "events").select("ts"))


HEAT_MAP = "SELECT (dayofweek(ts) + 1)::INT AS dow, " + ", ".join(f"count(*) FILTER (hour(ts) = {h}) AS h{h}" for h in range(24)) + " FROM events GROUP BY 1"


def busy_hours(spark: SparkSession, sf: str) -> DataFrame:
    return reports.peak_shares(table(spark, sf, "events"))


BUSY_HOURS = "SELECT sum(p) / sum(n) AS peak_share, avg(n) FILTER (dayofweek(day) + 1 IN (6, 7, 1)) / avg(n) FILTER (dayofweek(day) + 1 NOT IN (6, 7, 1)) AS weekend_lift FROM (SELECT ts::DATE AS day, count(*) AS n, count(*) FILTER ((hour(ts) >= 12 AND hour(ts) < 14) OR (hour(ts) >= 19 AND hour(ts) < 22)) AS p FROM events GROUP BY 1)"


def weekdays(spark: SparkSession, sf: str) -> DataFrame:
    return reports.weekday_averages(table(spark, sf, "events"))


def hours(spark: SparkSession, sf: str) -> DataFrame:
    return reports.hour_profile(table(spark, sf, "events"), F.dayofmonth("ts") <= 10)


HOURS = "SELECT hour(ts)::INT AS hour, count(*) FILTER (day(ts) <= 10) / sum(count(*) FILTER (day(ts) <= 10)) OVER () AS share_inside, count(*) FILTER (day(ts) > 10) / sum(count(*) FILTER (day(ts) > 10)) OVER () AS share_outside FROM events GROUP BY 1"


def location_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return reports.profile_by(fr.lines(spark, sf), fr.locations(spark, sf), "kind")


LOCATION_KINDS = "SELECT kind, locations, coalesce(revenue, 0) AS revenue, coalesce(orders, 0) AS orders, coalesce(revenue, 0) / locations AS per_location, revenue / orders AS per_order FROM (SELECT kind, count(*) AS locations FROM locations GROUP BY 1) LEFT JOIN (SELECT kind, sum(revenue) AS revenue, count(DISTINCT order_id) AS orders FROM lines JOIN locations USING (location_id) GROUP BY 1) USING (kind)"


def preferred_channels(spark: SparkSession, sf: str) -> DataFrame:
    from ladle.operators.features import preferred_channel

    o = fr.orders(spark, sf)
    return reports.preferred_share(o, preferred_channel(o))


PREFERRED_CHANNELS = "SELECT channel, count(*) AS orders, avg((channel = own)::INT) AS in_preferred FROM ords JOIN (SELECT customer_id, channel AS own FROM (SELECT customer_id, channel, count(*) AS n FROM ords GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, channel) = 1) USING (customer_id) GROUP BY 1"


def promo_lines(spark: SparkSession, sf: str) -> DataFrame:
    return reports.promo_split(fr.lines(spark, sf))


PROMO_LINES = "SELECT promo, count(*) AS lines, avg(revenue) AS mean_revenue, avg(quantity) AS mean_quantity, (sum(revenue) - sum(cost)) / sum(revenue) AS margin_rate FROM lines GROUP BY 1"


def promo_periods(spark: SparkSession, sf: str) -> DataFrame:
    return reports.inside_promotions(fr.lines(spark, sf), fr.promotions(spark, sf), fr.promotion_locations(spark, sf))


PROMO_PERIODS = """WITH c AS (SELECT DISTINCT location_id, day FROM (SELECT promotion_id, unnest(generate_series(start_day, end_day, INTERVAL 1 DAY))::DATE AS day FROM promotions) JOIN promotion_locations USING (promotion_id)), d AS (SELECT location_id, ts::DATE AS day, sum(revenue) AS revenue FROM lines GROUP BY 1, 2)
  SELECT c.day IS NOT NULL AS in_promotion, count(*) AS location_days, avg(revenue) AS revenue_per_day FROM d LEFT JOIN c USING (location_id, day) GROUP BY 1"""


def campaigns(spark: SparkSession, sf: str) -> DataFrame:
    return reports.campaign_margins(fr.promotions(spark, sf), promotion_metrics(spark, sf))


CAMPAIGNS = f"SELECT promotion_id, start_day, revenue, margin, margin_pct FROM promotions LEFT JOIN (SELECT * FROM ({PROMOTION_METRICS}) WHERE period = 'during') USING (promotion_id)"

# means and deviations of a window can lie between two roundings; the score says as much
_SCORES = "SELECT * EXCLUDE (baseline_mean, baseline_std) FROM ({0})"


def _scores(found: DataFrame) -> DataFrame:
    return found.drop("baseline_mean", "baseline_std")


QUERIES = {
    "pair_rules": Query(pair_rules, PAIR_RULES, ("support", "confidence", "lift"), 6),
    "top_rules": Query(top_rules, TOP_RULES),
    "association_rules": Query(association_rules, _rules_sql("category_id", "ceil(0.01 * count(DISTINCT order_id))", 0.1), ("support", "confidence", "lift"), 6),
    "item_rules": Query(item_rules, _rules_sql("item_id", "3", 0.05), ("support", "confidence", "lift"), 6),
    "frequent_itemsets": Query(frequent_itemsets, FREQUENT_ITEMSETS),
    "risk_table": Query(risk_table, RISK_TABLE, ("recent_demand", "prep_ratio")),
    "risk_watch_list": Query(risk_watch_list),
    "risk_model_metrics": Query(risk_model_metrics),
    "risk_rule_metrics": Query(risk_rule_metrics, RISK_RULE_METRICS, ("positive_rate", "accuracy", "precision", "recall", "f1", "roc", "pr"), 6),
    "popularity_snapshots": Query(popularity_snapshots, _POPULARITY, ("item_popularity",), 6),
    "popularity_before": Query(popularity_before, POPULARITY_BEFORE, ("popularity",)),
    "price_changes": Query(price_changes, PRICE_CHANGES),
    "price_impact": Query(price_impact, PRICE_IMPACT, ("before", "after", "price_change_pct", "demand_change_pct", "control_change_pct", "adjusted_change_pct", "elasticity")),
    "price_sensitivity": Query(price_sensitivity, PRICE_SENSITIVITY),
    "promotion_metrics": Query(promotion_metrics, PROMOTION_METRICS, ("quantity", "revenue", "margin", "wastage_cost", "revenue_per_order", "margin_per_order", "margin_pct")),
    "promotion_traps": Query(promotion_traps, PROMOTION_TRAPS),
    "sales_anomalies": Query(lambda spark, sf: _scores(sales_anomalies(spark, sf)), _SCORES.format(SALES_ANOMALIES), ("value", "score")),
    "rating_anomalies": Query(lambda spark, sf: _scores(rating_anomalies(spark, sf)), _SCORES.format(RATING_ANOMALIES), ("value", "score")),
    "high_value_orders": Query(high_value_orders, HIGH_VALUE_ORDERS, ("value", "score")),
    "duplicate_transactions": Query(duplicate_transactions, DUPLICATE_TRANSACTIONS),
    "anomaly_reports": Query(anomaly_reports, ANOMALY_REPORTS),
    "anomaly_counts": Query(anomaly_counts, ANOMALY_COUNTS),
    "recent_anomalies": Query(recent_anomalies, RECENT_ANOMALIES, ("value",)),
    "training_table": Query(training_table, TRAINING_TABLE, ("mean_7", "mean_14")),
    "forecast_metrics": Query(forecast_metrics, FORECAST_METRICS, ("mae", "rmse", "mape", "r2")),
    "forecast_by_volume": Query(forecast_by_volume, FORECAST_BY_VOLUME, ("model_ape", "baseline_ape", "over_share")),
    "forecast_split": Query(forecast_split, FORECAST_SPLIT),
    "forecast_covariates": Query(forecast_covariates, FORECAST_COVARIATES, ("price",)),
    "high_demand": Query(high_demand, HIGH_DEMAND, ("extra",)),
    "forecast_model": Query(forecast_model),
    "forecast_model_metrics": Query(forecast_model_metrics),
    "forecast_model_peaks": Query(forecast_model_peaks),
    "forecast_model_totals": Query(forecast_model_totals),
    "forecast_totals": Query(forecast_totals, f"SELECT item_id, sum(forecast) AS forecast, sum(recent_average) AS recent, sum(actual) AS actual FROM ({_ITEM_DAYS}) GROUP BY 1", ("forecast", "recent", "actual")),
    "item_classifier": Query(item_classifier),
    "recommendations": Query(recommendations),
    "recommendation_counts": Query(recommendation_counts, RECOMMENDATION_COUNTS),
    "recommendation_rows": Query(recommendation_rows, _ALL_RECOMMENDATIONS),
    "recommendation_summary": Query(recommendation_summary, RECOMMENDATION_SUMMARY),
    "scenarios": Query(scenarios, SCENARIOS, ("revenue", "contribution_margin", "demand", "wastage_units", "net_margin_after_wastage"), 2, 3.14159e-5),
    "kpis": Query(kpis, KPIS, ("cancel_rate", "net_sales", "profit", "waste_cost", "average_order_value")),
    "monthly": Query(monthly, MONTHLY, ("net_sales", "promo_share", "change")),
    "sales_by_location": Query(sales_by_location, "SELECT location_id, sum(revenue) AS net_sales, sum(quantity) AS quantity, count(DISTINCT order_id) AS orders FROM lines GROUP BY 1", ("net_sales", "quantity")),
    "segment_report": Query(segment_report, SEGMENT_REPORT, ("spend", "average_spend", "average_recency", "average_frequency", "churn_share", "spend_share")),
    "rfm_report": Query(rfm_report, RFM_REPORT, ("median_rfm", "high_share", "low_share")),
    "customer_lists": Query(customer_lists, CUSTOMER_LISTS),
    "weekly_waste": Query(waste_reports, "SELECT date_trunc('week', day)::DATE + 6 AS week_end, sum(waste_cost) AS waste_cost FROM waste GROUP BY 1", ("waste_cost",)),
    "waste_reasons": Query(waste_reasons, "SELECT reason, count(*) AS n, sum(waste_cost) AS waste_cost, sum(waste_cost) / sum(sum(waste_cost)) OVER () AS share FROM waste GROUP BY 1", ("waste_cost", "share")),
    "sales_cube": Query(sales_cube, SALES_CUBE, ("quantity", "revenue")),
    "dishes": Query(dishes, DISHES, ("units_per_day",)),
    "categories": Query(categories, CATEGORIES, ("revenue", "revenue_share", "margin_rate", "penetration")),
    "heat_map": Query(heat_map, HEAT_MAP),
    "busy_hours": Query(busy_hours, BUSY_HOURS, ("peak_share", "weekend_lift")),
    "weekdays": Query(weekdays, "SELECT (dayofweek(ts) + 1)::INT AS dow, count(*) AS n, count(DISTINCT ts::DATE) AS active_days, count(*) / count(DISTINCT ts::DATE) AS per_day FROM events GROUP BY 1", ("per_day",)),
    "hours": Query(hours, HOURS, ("share_inside", "share_outside")),
    "location_kinds": Query(location_kinds, LOCATION_KINDS, ("revenue", "per_location", "per_order")),
    "preferred_channels": Query(preferred_channels, PREFERRED_CHANNELS, ("in_preferred",)),
    "promo_lines": Query(promo_lines, PROMO_LINES, ("mean_revenue", "mean_quantity", "margin_rate")),
    "promo_periods": Query(promo_periods, PROMO_PERIODS, ("revenue_per_day",)),
    "campaigns": Query(campaigns, CAMPAIGNS, ("revenue", "margin", "margin_pct")),
}
