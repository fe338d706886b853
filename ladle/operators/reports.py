"""Result tables of dashboards and exploration."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions.scalar import is_peak_hour, is_weekend, month_start, safe_div
from ladle.functions.stats import share_of_total
from ladle.operators.integration import with_coverage


def executive_kpis(orders: DataFrame, lines: DataFrame, waste: DataFrame, cancelled: str = "Cancelled") -> DataFrame:
    """One row: net sales, profit, orders, order value, active and repeat customers, waste cost, cancel rate. lines: of completed orders."""
    done = F.col("status") != cancelled
    head = orders.agg(F.count_if(done).alias("orders"), F.avg((~done).cast("double")).alias("cancel_rate"))
    money = lines.agg(F.sum("revenue").alias("net_sales"), F.sum(F.col("revenue") - F.col("cost")).alias("profit"))
    people = orders.where(done & F.col("customer_id").isNotNull()).groupBy("customer_id").count().agg(F.count("*").alias("active_customers"), F.count_if(F.col("count") > 1).alias("repeat_customers"))
    one = head.join(money).join(people).join(waste.agg(F.sum("waste_cost").alias("waste_cost")))  # a row each
    return one.withColumn("average_order_value", safe_div(F.col("net_sales"), F.col("orders")))


def daily_sales(lines: DataFrame, rows: int = 7) -> DataFrame:
    """(day, net_sales, trailing_mean) over the last rows of the table of days, fewer at its start."""
    days = lines.groupBy(F.col("ts").cast("date").alias("day")).agg(F.sum("revenue").alias("net_sales"))
    return days.withColumn("trailing_mean", F.avg("net_sales").over(Window.orderBy("day").rowsBetween(-(rows - 1), 0)))


def monthly_sales(lines: DataFrame) -> DataFrame:
    """(month, net_sales, promo_share, is_best, change): change against the month before."""
    months = lines.groupBy(month_start(F.col("ts")).alias("month")).agg(F.sum("revenue").alias("net_sales"), F.sum(F.when(F.col("promo"), F.col("revenue")).otherwise(0.0)).alias("_promo"))
    rated = months.withColumns({"promo_share": safe_div(F.col("_promo"), F.col("net_sales")), "change": safe_div(F.col("net_sales"), F.lag("net_sales").over(Window.orderBy("month"))) - 1})
    best = months.agg(F.max_by("month", F.struct("net_sales", "month")).alias("_best"))
    return rated.join(F.broadcast(best)).withColumn("is_best", F.col("month") == F.col("_best")).drop("_best", "_promo")


def sales_by(lines: DataFrame, keys: list[str]) -> DataFrame:
    return lines.groupBy(*keys).agg(F.sum("revenue").alias("net_sales"), F.sum("quantity").alias("quantity"), F.countDistinct("order_id").alias("orders"))


def forecast_totals(item_days: DataFrame, keys: list[str] = ()) -> DataFrame:
    return item_days.groupBy(*keys).agg(F.sum("forecast").alias("forecast"), F.sum("recent_average").alias("recent"), F.sum("actual").alias("actual"))


def segment_summary(customers: DataFrame) -> DataFrame:
    """A row per segment. customers: features with segment and at_risk."""
    rows = customers.groupBy("segment").agg(F.count("*").alias("customers"), F.sum("customer_monetary_value").alias("spend"), F.avg("customer_monetary_value").alias("average_spend"), F.avg("customer_recency").alias("average_recency"), F.avg("customer_frequency").alias("average_frequency"), F.avg(F.col("at_risk").cast("double")).alias("churn_share"))
    return rows.withColumn("spend_share", share_of_total(F.col("spend")))


def rfm_distribution(scored: DataFrame, by: str) -> DataFrame:
    """Median of the RFM sum per group, and the shares of high (12 or more) and low (6 or less) sums."""
    s = F.col("rfm_score")
    return scored.groupBy(by).agg(F.percentile(s, F.lit(0.5)).alias("median_rfm"), F.avg((s >= 12).cast("double")).alias("high_share"), F.avg((s <= 6).cast("double")).alias("low_share"))


def customer_lists(customers: DataFrame, n: int = 10, promo_share: float = 0.5) -> DataFrame:
    """(list, rank, customer_id, value): the n first of high value, at risk, and promotion-sensitive customers."""

    def top(name: str, rows: DataFrame, value: str) -> DataFrame:
        ordered = rows.orderBy(F.desc(value), "customer_id").limit(n)
        return ordered.select(F.lit(name).alias("list"), F.row_number().over(Window.orderBy(F.desc(value), "customer_id")).alias("rank"), "customer_id", F.col(value).cast("double").alias("value"))

    high = top("high_value", customers, "customer_monetary_value")
    return high.unionByName(top("at_risk", customers.where("at_risk"), "customer_monetary_value")).unionByName(top("promotion_sensitive", customers.where(F.col("promo_order_share") >= promo_share), "promo_order_share"))


def weekly_waste(waste: DataFrame) -> DataFrame:
    """(week_end, waste_cost) of weeks from Monday to Sunday."""
    return waste.groupBy(F.date_add(F.date_trunc("week", "day").cast("date"), 6).alias("week_end")).agg(F.sum("waste_cost").alias("waste_cost"))


def waste_by_reason(waste: DataFrame) -> DataFrame:
    rows = waste.groupBy("reason").agg(F.count("*").alias("n"), F.sum("waste_cost").alias("waste_cost"))
    return rows.withColumn("share", share_of_total(F.col("waste_cost")))


def daily_item_sales(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("ts").cast("date").alias("day"), "item_id", "location_id", "category_id").agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))


def weekly_counts(anomalies: DataFrame) -> DataFrame:
    return anomalies.groupBy("anomaly_type", F.date_trunc("week", "period_start").cast("date").alias("week")).agg(F.count("*").alias("n"))


def dish_rankings(items: DataFrame, metric: str, n: int = 10, least: tuple[str, int] | None = None) -> DataFrame:
    """The n best and n worst items by a metric, those with a minimum of support only."""
    rated = items.withColumn("units_per_day", safe_div(F.col("total_quantity_sold"), F.col("days_since_launch")))
    if least:
        rated = rated.where(F.col(least[0]) >= least[1])
    rated = rated.where(F.col(metric).isNotNull())
    best = rated.orderBy(F.desc(metric), "item_id").limit(n).withColumn("end", F.lit("top"))
    return best.unionByName(rated.orderBy(F.asc(metric), "item_id").limit(n).withColumn("end", F.lit("bottom"))).select("end", "item_id", F.col(metric).alias("value"), "units_per_day")


def category_summary(lines: DataFrame) -> DataFrame:
    """Revenue share, margin rate, and share of orders with a line of the category."""
    total = lines.agg(F.countDistinct("order_id").alias("_orders"))
    rows = lines.groupBy("category_id").agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"), F.countDistinct("order_id").alias("orders")).join(F.broadcast(total))
    return rows.select("category_id", "revenue", "orders", share_of_total(F.col("revenue")).alias("revenue_share"), safe_div(F.col("revenue") - F.col("cost"), F.col("revenue")).alias("margin_rate"), safe_div(F.col("orders"), F.col("_orders")).alias("penetration"))


def weekday_by_hour(events: DataFrame) -> DataFrame:
    """Counts of events (ts) by weekday, with a column for each hour from h0 to h23."""
    rows = events.groupBy(F.dayofweek("ts").alias("dow")).pivot("_hour", list(range(24))) if "_hour" in events.columns else events.withColumn("_hour", F.hour("ts")).groupBy(F.dayofweek("ts").alias("dow")).pivot("_hour", list(range(24)))
    wide = rows.count().fillna(0)
    return wide.select("dow", *[F.col(str(h)).alias(f"h{h}") for h in range(24)])


def peak_shares(events: DataFrame) -> DataFrame:
    """One row: share of events in peak hours, and how much busier a weekend day is than another."""
    days = events.groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(is_peak_hour(F.col("ts"))).alias("peak"))
    weekend = is_weekend(F.col("day"))
    return days.agg(safe_div(F.sum("peak"), F.sum("n")).alias("peak_share"), safe_div(F.avg(F.when(weekend, F.col("n"))), F.avg(F.when(~weekend, F.col("n")))).alias("weekend_lift"))


def weekday_averages(events: DataFrame) -> DataFrame:
    """(dow, n, active_days, per_day)."""
    rows = events.groupBy(F.dayofweek("ts").alias("dow")).agg(F.count("*").alias("n"), F.countDistinct(F.col("ts").cast("date")).alias("active_days"))
    return rows.withColumn("per_day", safe_div(F.col("n"), F.col("active_days")))


def hour_profile(events: DataFrame, inside: Column) -> DataFrame:
    """(hour, share_inside, share_outside): the hours of events that meet a condition, and of the others."""
    rows = events.groupBy(F.hour("ts").alias("hour")).agg(F.count_if(inside).alias("_in"), F.count_if(~inside).alias("_out"))
    return rows.select("hour", share_of_total(F.col("_in")).alias("share_inside"), share_of_total(F.col("_out")).alias("share_outside"))


def profile_by(lines: DataFrame, locations: DataFrame, kind: str) -> DataFrame:
    """Sales per kind of location: total, per location, per order."""
    n = locations.groupBy(kind).agg(F.count("*").alias("locations"))
    rows = lines.join(locations.select("location_id", kind), "location_id").groupBy(kind).agg(F.sum("revenue").alias("revenue"), F.countDistinct("order_id").alias("orders"))
    return n.join(rows, kind, "left").fillna(0, ["revenue", "orders"]).withColumns({"per_location": safe_div(F.col("revenue"), F.col("locations")), "per_order": safe_div(F.col("revenue"), F.col("orders"))})


def preferred_share(orders: DataFrame, preferred: DataFrame) -> DataFrame:
    """(channel, orders, in_preferred): share of a channel's orders that came from customers who prefer it."""
    rows = orders.join(preferred.withColumnRenamed("preferred_channel", "_own"), "customer_id")
    return rows.groupBy("channel").agg(F.count("*").alias("orders"), F.avg((F.col("channel") == F.col("_own")).cast("double")).alias("in_preferred"))


def promo_split(lines: DataFrame) -> DataFrame:
    """Promoted and other lines: number, mean revenue, mean quantity, margin rate."""
    rows = lines.groupBy("promo").agg(F.count("*").alias("lines"), F.avg("revenue").alias("mean_revenue"), F.avg("quantity").alias("mean_quantity"), F.sum("revenue").alias("_r"), F.sum("cost").alias("_c"))
    return rows.withColumn("margin_rate", safe_div(F.col("_r") - F.col("_c"), F.col("_r"))).drop("_r", "_c")


def inside_promotions(lines: DataFrame, promotions: DataFrame, locations: DataFrame) -> DataFrame:
    """(in_promotion, location_days, revenue_per_day): days of a location inside and outside of promotions there, whatever their items."""
    days = lines.groupBy("location_id", F.col("ts").cast("date").alias("day")).agg(F.sum("revenue").alias("revenue"))
    marked = with_coverage(days, promotions, None, locations, "_covered").withColumn("in_promotion", F.col("_covered") == 1)
    return marked.groupBy("in_promotion").agg(F.count("*").alias("location_days"), F.avg("revenue").alias("revenue_per_day"))


def campaign_margins(promotions: DataFrame, metrics: DataFrame) -> DataFrame:
    """(promotion_id, start_day, revenue, margin, margin_pct) during each promotion."""
    during = metrics.where("period = 'during'").select("promotion_id", "revenue", "margin", "margin_pct")
    return promotions.select("promotion_id", "start_day").join(during, "promotion_id", "left")


def recommendation_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("priority", "type").agg(F.count("*").alias("n"), F.max("impact").alias("highest_impact"))


def by_custom_order(df: DataFrame, column: str, order: list[str], magnitude: str, n: int) -> DataFrame:
    """The first n rows by the place of a column's value in order, others last, then by falling magnitude."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column)), F.lit(0)), F.lit(len(order) + 1))
    return df.withColumn("place", place).orderBy("place", F.desc(magnitude)).limit(n)


def last_days(df: DataFrame, day: str, last: date, n: int) -> DataFrame:
    return df.where(F.col(day).between(F.date_sub(F.lit(last), n - 1), F.lit(last)))
