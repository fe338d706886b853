"""Queries of aggregates, windows, ranks and measures of predictions."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.functions import ranks, scalar, stats
from ladle.operators import basket, features, reports, wastage
from ladle.plans import frames as fr
from ladle.plans.frames import AS_OF, Query, table
from ladle.sources import tables


def item_sales(spark: SparkSession, sf: str) -> DataFrame:
    return features.sales(fr.lines(spark, sf), ["item_id"])


ITEM_SALES = """SELECT item_id, sum(revenue) AS total_revenue, sum(cost) AS total_cost, sum(quantity) AS total_quantity_sold, coalesce(sum(quantity) FILTER (dayofweek(ts) + 1 IN (6, 7, 1)), 0) AS weekend_quantity, count(DISTINCT order_id) AS order_frequency,
  coalesce(sum(revenue) FILTER (promo), 0) AS promo_revenue, sum(discount) AS total_discount FROM lines GROUP BY 1"""


def repeat_rates(spark: SparkSession, sf: str) -> DataFrame:
    return features.repeat_rate(fr.lines(spark, sf), ["category_id"])


REPEAT_RATES = "SELECT category_id, avg((n > 1)::INT) AS repeat_purchase_rate FROM (SELECT category_id, customer_id, count(DISTINCT order_id) AS n FROM lines GROUP BY 1, 2) GROUP BY 1"


def trends(spark: SparkSession, sf: str) -> DataFrame:
    return features.monthly_trend(fr.lines(spark, sf), ["location_id"])


TRENDS = """SELECT location_id, CASE WHEN count(*) >= 3 THEN covar_pop(v, m) / nullif(var_pop(m), 0) END AS sales_trend FROM (SELECT location_id, (year(ts) * 12 + month(ts))::DOUBLE AS m, sum(quantity) AS v FROM lines GROUP BY 1, 2) GROUP BY 1"""


def rating_means(spark: SparkSession, sf: str) -> DataFrame:
    rated = fr.ratings(spark, sf).groupBy("item_id").agg(F.avg("rating").alias("average_rating"), F.count("*").alias("n"))
    wasted = fr.waste(spark, sf).groupBy("item_id").agg(F.sum("waste_cost").alias("waste_cost"))
    return rated.join(wasted, "item_id", "left")


RATING_MEANS = "SELECT item_id, average_rating, n, waste_cost FROM (SELECT item_id, avg(rating) AS average_rating, count(*) AS n FROM ratings GROUP BY 1) LEFT JOIN (SELECT item_id, sum(waste_cost) AS waste_cost FROM waste GROUP BY 1) USING (item_id)"


def price_ends(spark: SparkSession, sf: str) -> DataFrame:
    return features.price_change(fr.prices(spark, sf))


PRICE_ENDS = "SELECT item_id, first_price, last_price, (last_price - first_price) / first_price AS price_change_pct FROM (SELECT item_id, arg_min(price, start_day) AS first_price, arg_max(price, start_day) AS last_price FROM prices WHERE location_id IS NULL GROUP BY 1)"


def distinct_counts(spark: SparkSession, sf: str) -> DataFrame:
    return fr.lines(spark, sf).groupBy("location_id").agg(F.countDistinct("order_id").alias("orders"), F.countDistinct("customer_id").alias("customers"), stats.share_where(F.col("promo")).alias("promo_share"), stats.share_where(scalar.is_weekend(F.col("ts"))).alias("weekend_share"))


DISTINCT_COUNTS = "SELECT location_id, count(DISTINCT order_id) AS orders, count(DISTINCT customer_id) AS customers, avg(promo::INT) AS promo_share, avg((dayofweek(ts) + 1 IN (6, 7, 1))::INT) AS weekend_share FROM lines GROUP BY 1"


_LEVELS = {"month": ["month"], "location": ["location_id"], "chain": []}


def distinct_rollups(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct customers and orders by month, by location and of the chain, from sketches per day and location that are stored once and united; beside the exact numbers.

    error_ok: both estimates are within 4 % (five standard errors) of the exact number."""
    lines = fr.lines(spark, sf).withColumn("day", F.col("ts").cast("date"))
    path = tables.new_folder(spark, "sketches")
    stats.distinct_sketches(lines, ["day", "location_id"], {"customers": "customer_id", "orders": "order_id"}).write.parquet(path)
    stored = spark.read.parquet(path).withColumn("month", F.trunc("day", "month"))
    out = None
    for level, keys in _LEVELS.items():
        guess = stats.distinct_estimates(stats.united_sketches(stored, keys, ["customers", "orders"]), ["customers", "orders"])
        exact = lines.withColumn("month", F.trunc("day", "month")).groupBy(*keys).agg(F.countDistinct("customer_id").alias("n_customers"), F.countDistinct("order_id").alias("n_orders"))
        both = guess.join(exact, keys) if keys else guess.join(exact)
        near = [F.abs(F.col(c) - F.col(f"n_{c}")) <= F.greatest(F.lit(1.0), 0.04 * F.col(f"n_{c}")) for c in ("customers", "orders")]
        rows = both.select(F.lit(level).alias("level"), (F.col(keys[0]).cast("string") if keys else F.lit("all")).alias("key"), "n_customers", "n_orders", (near[0] & near[1]).alias("error_ok"))
        out = rows if out is None else out.union(rows)
    return out


DISTINCT_ROLLUPS = " UNION ALL ".join(f"SELECT '{level}' AS level, {key} AS key, count(DISTINCT customer_id) AS n_customers, count(DISTINCT order_id) AS n_orders, true AS error_ok FROM lines GROUP BY {by}" for level, key, by in (("month", "date_trunc('month', ts)::DATE::VARCHAR", "date_trunc('month', ts)"), ("location", "location_id::VARCHAR", "location_id"), ("chain", "'all'", "ALL")))


def modes(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.orders(spark, sf)
    return stats.most_frequent(rows, ["customer_id"], "channel").join(features.preferred_channel(rows), "customer_id")


MODES = """SELECT customer_id, channel AS mode, channel AS preferred_channel FROM (SELECT customer_id, channel, count(*) AS n FROM ords GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, channel) = 1"""


def basket_sets(spark: SparkSession, sf: str) -> DataFrame:
    return basket.baskets(fr.lines(spark, sf)).select("order_id", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"), F.size("items").cast("bigint").alias("n"))


BASKET_SETS = "SELECT order_id, list_aggregate(list_sort(list_distinct(list(item_id))), 'string_agg', ',') AS items, count(DISTINCT item_id) AS n FROM lines GROUP BY 1"


def pivoted(spark: SparkSession, sf: str) -> DataFrame:
    return stats.cross_tab(fr.orders(spark, sf).withColumn("place", F.col("location_id").cast("string")), "place", "status", ["Completed", "Cancelled"])


PIVOTED = "SELECT location_id::VARCHAR AS place, count(*) FILTER (status = 'Completed') AS Completed, count(*) FILTER (status = 'Cancelled') AS Cancelled FROM ords GROUP BY 1"


def waste_rates(spark: SparkSession, sf: str) -> DataFrame:
    return wastage.wastage_by(wastage.daily_grain(fr.lines(spark, sf), fr.waste(spark, sf)), ["location_id"])


WASTE_RATES = """SELECT location_id, coalesce(w, 0) AS waste_cost, coalesce(c, 0) AS cogs, coalesce(w, 0) / nullif(coalesce(w, 0) + coalesce(c, 0), 0) AS wastage_rate FROM (SELECT location_id, sum(cost) AS c FROM lines GROUP BY 1) FULL JOIN (SELECT location_id, sum(waste_cost) AS w FROM waste GROUP BY 1) USING (location_id)"""


def waste_levels(spark: SparkSession, sf: str) -> DataFrame:
    daily = wastage.daily_grain(fr.lines(spark, sf), fr.waste(spark, sf), fr.promotion_tables(spark, sf)).join(fr.items(spark, sf).select("item_id", "category_id"), "item_id")
    daily = daily.withColumn("weekday", F.dayofweek("day"))
    return wastage.wastage_levels(daily, ["category_id", "location_id", "weekday", "promo"])


WASTE_LEVELS = """WITH s AS (SELECT item_id, location_id, ts::DATE AS day, sum(cost) AS cogs FROM lines GROUP BY 1, 2, 3), w AS (SELECT item_id, location_id, day, sum(waste_cost) AS waste_cost FROM waste GROUP BY 1, 2, 3),
  d AS (SELECT item_id, location_id, day, coalesce(cogs, 0) AS cogs, ((item_id, location_id, day) IN (SELECT (item_id, location_id, day) FROM covered))::INT AS promo, coalesce(waste_cost, 0) AS waste_cost, category_id, dayofweek(day) + 1 AS weekday FROM s FULL JOIN w USING (item_id, location_id, day) JOIN items USING (item_id)),
  u AS (SELECT unnest(['category_id', 'location_id', 'weekday', 'promo']) AS level, unnest([category_id, location_id::VARCHAR, weekday::VARCHAR, promo::VARCHAR]) AS value, waste_cost, cogs FROM d)
  SELECT level, value, sum(waste_cost) AS waste_cost, sum(cogs) AS cogs, sum(waste_cost) / nullif(sum(waste_cost) + sum(cogs), 0) AS wastage_rate FROM u GROUP BY 1, 2"""


def best_and_worst(spark: SparkSession, sf: str) -> DataFrame:
    return wastage.best_and_worst(waste_rates(spark, sf).withColumn("wastage_rate", F.round("wastage_rate", 6)), 5, "wastage_rate", "location_id").select("end", "location_id", "wastage_rate")


BEST_AND_WORST = f"""WITH r AS (SELECT location_id, round(wastage_rate, 6) AS wastage_rate FROM ({WASTE_RATES})) (SELECT 'worst' AS "end", * FROM r ORDER BY wastage_rate DESC, location_id LIMIT 5) UNION ALL (SELECT 'best', * FROM r ORDER BY wastage_rate, location_id LIMIT 5)"""


def _predicted(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up prediction of whether a line is returned, from its keys."""
    li = table(spark, sf, "lineitem")
    return li.select(
        (F.col("l_returnflag") == "R").cast("int").alias("label"), ((F.col("l_partkey") + F.col("l_orderkey")) % 3 == 0).cast("int").alias("prediction"), F.col("l_returnflag").alias("kind"), F.when(F.col("l_suppkey") % 4 == 0, "A").otherwise(F.col("l_returnflag")).alias("guess"),
        (F.col("l_quantity") - F.when(F.col("l_orderkey") % 50 == 0, F.col("l_quantity")).otherwise(0)).alias("actual"), (F.col("l_quantity") + F.col("l_partkey") % 7 - 3).alias("forecast"), F.col("l_linenumber").alias("line"),
    )


_PREDICTED = """SELECT (l_returnflag = 'R')::INT AS label, ((l_partkey + l_orderkey) % 3 = 0)::INT AS prediction, l_returnflag AS kind, CASE WHEN l_suppkey % 4 = 0 THEN 'A' ELSE l_returnflag END AS guess,
  l_quantity - CASE WHEN l_orderkey % 50 = 0 THEN l_quantity ELSE 0 END AS actual, l_quantity + l_partkey % 7 - 3 AS forecast, l_linenumber AS line FROM lineitem"""


def binary_measures(spark: SparkSession, sf: str) -> DataFrame:
    return stats.binary_metrics(_predicted(spark, sf), "label", "prediction")


BINARY_MEASURES = f"""SELECT *, (tp + tn) / (tp + tn + fp + fn) AS accuracy, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * (tp / (tp + fp)) * (tp / (tp + fn)) / (tp / (tp + fp) + tp / (tp + fn)) AS f1 FROM
  (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp, count(*) FILTER (label = 0 AND prediction = 1) AS fp, count(*) FILTER (label = 1 AND prediction = 0) AS fn, count(*) FILTER (label = 0 AND prediction = 0) AS tn FROM ({_PREDICTED}))"""


def class_measures(spark: SparkSession, sf: str) -> DataFrame:
    return stats.per_class_metrics(_predicted(spark, sf), "kind", "guess")


CLASS_MEASURES = f"""WITH p AS ({_PREDICTED}), c AS (SELECT kind AS class, count(*) AS support, count(*) FILTER (kind = guess) AS correct FROM p GROUP BY 1), g AS (SELECT guess AS class, count(*) AS predicted FROM p GROUP BY 1)
  SELECT class, support, correct, predicted, correct / predicted AS precision, correct / support AS recall, 2 * correct / (predicted + support) AS f1 FROM c JOIN g USING (class)"""


def macro_scores(spark: SparkSession, sf: str) -> DataFrame:
    return stats.class_scores(_predicted(spark, sf), "kind", "guess")


MACRO_SCORES = f"SELECT sum(correct) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM ({CLASS_MEASURES})"


def regression_measures(spark: SparkSession, sf: str) -> DataFrame:
    return stats.regression_metrics(_predicted(spark, sf), "actual", "forecast", ["line"])


REGRESSION_MEASURES = f"""SELECT line, avg(abs(forecast - actual)) AS mae, sqrt(avg((forecast - actual) ** 2)) AS rmse, avg(abs((forecast - actual) / actual)) FILTER (actual <> 0) AS mape, 1 - sum((forecast - actual) ** 2) / (var_pop(actual) * count(*)) AS r2,
  count(*) AS n, count(*) FILTER (actual = 0) AS n_zero FROM ({_PREDICTED}) GROUP BY 1"""


def fences(spark: SparkSession, sf: str) -> DataFrame:
    return stats.upper_fence(fr.orders(spark, sf), "total", 1.5)


FENCES = "SELECT q1, q3, q3 + 1.5 * (q3 - q1) AS fence FROM (SELECT quantile_cont(total, 0.25) AS q1, quantile_cont(total, 0.75) AS q3 FROM ords)"


def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    return stats.class_counts(fr.orders(spark, sf).select("channel"), "channel")


CLASS_WEIGHTS = "SELECT channel, count(*) AS n, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight FROM ords GROUP BY channel"


def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    rows = stats.with_balanced_weights(_predicted(spark, sf).select("label"), "label")
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.max("weight").alias("weight"))


BALANCED_WEIGHTS = f"SELECT label, n, CASE label WHEN 1 THEN 0.5 / p ELSE 0.5 / (1 - p) END AS weight FROM (SELECT label, count(*) AS n FROM ({_PREDICTED}) GROUP BY 1), (SELECT avg(label) AS p FROM ({_PREDICTED}))"


def supported_top(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.ratings(spark, sf).groupBy("item_id").agg(F.round(F.avg("rating"), 6).alias("rating"), F.count("*").alias("n")).where("n >= 30")
    best = rows.orderBy(F.desc("rating"), "item_id").limit(5).withColumn("end", F.lit("top"))
    return best.unionByName(rows.orderBy("rating", "item_id").limit(5).withColumn("end", F.lit("bottom")))


SUPPORTED_TOP = """WITH r AS (SELECT item_id, round(avg(rating), 6) AS rating, count(*) AS n FROM ratings GROUP BY 1 HAVING count(*) >= 30) (SELECT *, 'top' AS "end" FROM r ORDER BY rating DESC, item_id LIMIT 5) UNION ALL (SELECT *, 'bottom' FROM r ORDER BY rating, item_id LIMIT 5)"""


def weighted_means(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.ratings(spark, sf).groupBy("location_id", "item_id").agg(F.avg("rating").alias("r"), F.count("*").alias("n"))
    return rows.groupBy("location_id").agg(stats.weighted_mean(F.col("r"), F.col("n")).alias("rating"))


WEIGHTED_MEANS = "SELECT location_id, sum(r * n) / sum(n) AS rating FROM (SELECT location_id, item_id, avg(rating) AS r, count(*) AS n FROM ratings GROUP BY 1, 2) GROUP BY 1"


def rank_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return stats.spearman(item_sales(spark, sf).select(F.round("total_revenue", 2).alias("a"), "order_frequency"), "a", "order_frequency")


RANK_CORRELATION = f"""WITH s AS (SELECT round(total_revenue, 2) AS a, order_frequency AS b FROM ({ITEM_SALES})) SELECT corr(ra, rb) AS spearman FROM
  (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM s)"""


def shares_and_deciles(spark: SparkSession, sf: str) -> DataFrame:
    spend = fr.orders(spark, sf).groupBy("customer_id").agg(F.sum("total").alias("spend"), F.count("*").alias("n"))
    once = spend.agg(F.avg((F.col("n") == 1).cast("double")).alias("one_time_share"))
    return stats.top_share(spend, "spend", "customer_id").join(once)


SHARES_AND_DECILES = """WITH s AS (SELECT customer_id, sum(total) AS spend, count(*) AS n FROM ords GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY spend DESC, customer_id) AS k, count(*) OVER () AS c FROM s)
  SELECT sum(spend) FILTER (k <= floor(c * 0.1)) / sum(spend) AS top_share, avg((n = 1)::INT) AS one_time_share FROM r"""


def channel_shares(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.orders(spark, sf).groupBy("channel").agg(F.sum("total").alias("revenue"))
    return rows.withColumn("share", stats.share_of_total(F.col("revenue")))


CHANNEL_SHARES = "SELECT channel, sum(total) AS revenue, sum(total) / sum(sum(total)) OVER () AS share FROM ords GROUP BY 1"


def rand_index(spark: SparkSession, sf: str) -> DataFrame:
    return stats.adjusted_rand(_predicted(spark, sf), "kind", "guess")


RAND_INDEX = f"""WITH c AS (SELECT kind, guess, count(*) AS n FROM ({_PREDICTED}) GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS ab, (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM c GROUP BY kind)) AS a,
  (SELECT sum(k * (k - 1) / 2) FROM (SELECT sum(n) AS k FROM c GROUP BY guess)) AS b, (SELECT sum(n) * (sum(n) - 1) / 2 FROM c) AS t) SELECT (ab - a * b / t) / ((a + b) / 2 - a * b / t) AS adjusted_rand FROM s"""


def basket_size(spark: SparkSession, sf: str) -> DataFrame:
    return features.order_level(fr.orders(spark, sf), fr.lines(spark, sf)).groupBy("basket_size").agg(F.count("*").alias("orders"), F.sum("total").alias("total"))


BASKET_SIZE = "SELECT coalesce(n, 0) AS basket_size, count(*) AS orders, sum(total) AS total FROM ords LEFT JOIN (SELECT order_id, count(*) AS n FROM lines GROUP BY 1) USING (order_id) GROUP BY 1"


def popularity(spark: SparkSession, sf: str) -> DataFrame:
    rows = item_sales(spark, sf).select("item_id", "total_quantity_sold").join(fr.items(spark, sf).select("item_id", "category_id"), "item_id")
    inside = F.col("total_quantity_sold") >= 300
    ranked = ranks.with_percent_ranks(rows, ["item_id"], {"overall": ("total_quantity_sold", F.lit(True)), "within": ("total_quantity_sold", inside)})
    return ranks.with_percent_ranks(ranked, ["item_id"], {"in_category": ("total_quantity_sold", inside)}, ["category_id"])


POPULARITY = f"""WITH s AS (SELECT item_id, total_quantity_sold, category_id, total_quantity_sold >= 300 AS i FROM ({ITEM_SALES}) JOIN items USING (item_id)) SELECT item_id, total_quantity_sold, category_id, percent_rank() OVER (ORDER BY total_quantity_sold) AS overall,
  CASE WHEN i THEN percent_rank() OVER (PARTITION BY i ORDER BY total_quantity_sold) END AS within, CASE WHEN i THEN percent_rank() OVER (PARTITION BY category_id, i ORDER BY total_quantity_sold) END AS in_category FROM s"""


def first_and_last(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.orders(spark, sf).select("customer_id", "order_id", "ts")
    first = ranks.first_of(rows, ["customer_id"], F.col("ts"), F.col("order_id")).withColumn("which", F.lit("first"))
    return first.unionByName(ranks.first_of(rows, ["customer_id"], F.col("ts").desc(), F.col("order_id").desc()).withColumn("which", F.lit("last")))


FIRST_AND_LAST = """SELECT customer_id, order_id, ts, 'first' AS which FROM ords QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ts, order_id) = 1 UNION ALL SELECT customer_id, order_id, ts, 'last' FROM ords QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ts DESC, order_id DESC) = 1"""


def trailing_means(spark: SparkSession, sf: str) -> DataFrame:
    return reports.daily_sales(fr.lines(spark, sf))


TRAILING_MEANS = "SELECT ts::DATE AS day, sum(revenue) AS net_sales, avg(sum(revenue)) OVER (ORDER BY ts::DATE ROWS 6 PRECEDING) AS trailing_mean FROM lines GROUP BY 1"


def tertiles(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.orders(spark, sf).groupBy("customer_id").agg(F.count("*").alias("n"))
    return ranks.with_mean_rank_shares(rows, {"share": "n"}).withColumn("tertile", ranks.tertile(F.col("share")))


TERTILES = """WITH s AS (SELECT customer_id, count(*) AS n FROM ords GROUP BY 1), r AS (SELECT *, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2) / count(*) OVER () AS share FROM s)
  SELECT *, CASE WHEN share <= 1 / 3 THEN 1 WHEN share <= 2 / 3 THEN 2 ELSE 3 END AS tertile FROM r"""


def priorities(spark: SparkSession, sf: str) -> DataFrame:
    return waste_rates(spark, sf).select("location_id", F.round("waste_cost", 2).alias("impact")).transform(lambda rows: ranks.with_priority(rows, "impact"))


PRIORITIES = f"""WITH r AS (SELECT location_id, round(waste_cost, 2) AS impact FROM ({WASTE_RATES})), s AS (SELECT *, rank() OVER (ORDER BY impact DESC) / count(*) OVER () AS s FROM r)
  SELECT location_id, impact, CASE WHEN s <= 0.1 + 1e-12 THEN 'Critical' WHEN s <= 0.3 + 1e-12 THEN 'High' WHEN s <= 0.7 + 1e-12 THEN 'Medium' ELSE 'Low' END AS priority FROM s"""


def global_ranks(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return ranks.global_rank(rows, F.col("o_totalprice").desc(), F.col("o_orderkey"))


GLOBAL_RANKS = "SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders"


def custom_order(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.orders(spark, sf).select("order_id", "channel", "total")
    return reports.by_custom_order(rows, "channel", ["2-HIGH", "1-URGENT"], "total", 20).drop("place")


CUSTOM_ORDER = "SELECT order_id, channel, total FROM ords ORDER BY CASE channel WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, total DESC LIMIT 20"


def snapshot_days(spark: SparkSession, sf: str) -> DataFrame:
    return features.snapshot_days(fr.orders(spark, sf))


SNAPSHOT_DAYS = "SELECT unnest([max(ts)::DATE, (max(ts)::DATE - INTERVAL 3 MONTH)::DATE]) AS as_of FROM ords"


def last_week(spark: SparkSession, sf: str) -> DataFrame:
    return reports.last_days(fr.lines(spark, sf).withColumn("day", F.col("ts").cast("date")), "day", AS_OF, 30).groupBy("day").agg(F.count("*").alias("n")).where(F.col("day") <= F.lit(date(2001, 8, 1)))


LAST_WEEK = "SELECT ts::DATE AS day, count(*) AS n FROM lines WHERE ts::DATE BETWEEN DATE '2001-08-01' - 29 AND DATE '2001-08-01' GROUP BY 1"

QUERIES = {
    "item_sales": Query(item_sales, ITEM_SALES, ("total_revenue", "total_cost", "total_quantity_sold", "weekend_quantity", "promo_revenue", "total_discount")),
    "repeat_rates": Query(repeat_rates, REPEAT_RATES, ("repeat_purchase_rate",)),
    "trends": Query(trends, TRENDS, ("sales_trend",)),
    "rating_means": Query(rating_means, RATING_MEANS, ("average_rating", "waste_cost")),
    "price_ends": Query(price_ends, PRICE_ENDS, ("price_change_pct",)),
    "distinct_counts": Query(distinct_counts, DISTINCT_COUNTS, ("promo_share", "weekend_share")),
    "distinct_rollups": Query(distinct_rollups, DISTINCT_ROLLUPS),
    "modes": Query(modes, MODES),
    "basket_sets": Query(basket_sets, BASKET_SETS),
    "pivoted": Query(pivoted, PIVOTED),
    "waste_rates": Query(waste_rates, WASTE_RATES, ("waste_cost", "cogs", "wastage_rate"), 3),
    "waste_levels": Query(waste_levels, WASTE_LEVELS, ("waste_cost", "cogs", "wastage_rate"), 3),
    "best_and_worst": Query(best_and_worst, BEST_AND_WORST),
    "binary_measures": Query(binary_measures, BINARY_MEASURES, ("accuracy", "precision", "recall", "f1")),
    "class_measures": Query(class_measures, CLASS_MEASURES, ("precision", "recall", "f1")),
    "macro_scores": Query(macro_scores, MACRO_SCORES, ("accuracy", "macro_f1", "weighted_f1")),
    "regression_measures": Query(regression_measures, REGRESSION_MEASURES, ("mae", "rmse", "mape", "r2")),
    "fences": Query(fences, FENCES, ("q1", "q3", "fence")),
    "class_weights": Query(class_weights, CLASS_WEIGHTS, ("weight",)),
    "balanced_weights": Query(balanced_weights, BALANCED_WEIGHTS, ("weight",)),
    "supported_top": Query(supported_top, SUPPORTED_TOP),
    "weighted_means": Query(weighted_means, WEIGHTED_MEANS, ("rating",)),
    "rank_correlation": Query(rank_correlation, RANK_CORRELATION, ("spearman",)),
    "shares_and_deciles": Query(shares_and_deciles, SHARES_AND_DECILES, ("top_share", "one_time_share")),
    "channel_shares": Query(channel_shares, CHANNEL_SHARES, ("revenue", "share"), 3),
    "rand_index": Query(rand_index, RAND_INDEX, ("adjusted_rand",)),
    "basket_size": Query(basket_size, BASKET_SIZE, ("total",), 2),
    "popularity": Query(popularity, POPULARITY, ("total_quantity_sold", "overall", "within", "in_category")),
    "first_and_last": Query(first_and_last, FIRST_AND_LAST),
    "trailing_means": Query(trailing_means, TRAILING_MEANS, ("net_sales", "trailing_mean")),
    "tertiles": Query(tertiles, TERTILES, ("share",), 6),
    "priorities": Query(priorities, PRIORITIES),
    "global_ranks": Query(global_ranks, GLOBAL_RANKS),
    "custom_order": Query(custom_order, CUSTOM_ORDER),
    "snapshot_days": Query(snapshot_days, SNAPSHOT_DAYS),
    "last_week": Query(last_week, LAST_WEEK),
}
