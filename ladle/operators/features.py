"""Feature tables as of a day: items, items by location, customers, locations.

The input is order lines of completed orders (order_id, item_id, category_id, location_id, customer_id,
channel, ts, quantity, revenue, cost, discount, promo), ratings (item_id, location_id, rating, day), waste
(item_id, location_id, waste_cost, day), prices (item_id, location_id, price, start_day) and dimensions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ladle.functions.ranks import first_of, with_percent_ranks
from ladle.functions.scalar import before_end_of, is_peak_hour, is_weekend, month_start, safe_div, up_to
from ladle.functions.stats import share_where, slope


def completed(lines: DataFrame, as_of: date, status: str = "status", cancelled: str = "Cancelled") -> DataFrame:
    """Lines up to the end of the day whose order wasn't cancelled."""
    return lines.where(before_end_of(F.col("ts"), as_of) & (F.col(status) != cancelled))


def sales(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Totals per key: revenue, cost, quantity, weekend and promoted shares, orders."""
    return lines.groupBy(*keys).agg(
        F.sum("revenue").alias("total_revenue"), F.sum("cost").alias("total_cost"), F.sum("quantity").alias("total_quantity_sold"),
        F.sum(F.when(is_weekend(F.col("ts")), F.col("quantity")).otherwise(0.0)).alias("weekend_quantity"),
        F.countDistinct("order_id").alias("order_frequency"), F.sum(F.when(F.col("promo"), F.col("revenue")).otherwise(0.0)).alias("promo_revenue"), F.sum("discount").alias("total_discount"),
    )


def repeat_rate(lines: DataFrame, keys: list[str], name: str = "repeat_purchase_rate") -> DataFrame:
    """Share of the customers of a key with more than one order of it. Lines without a customer don't count."""
    per_customer = lines.where("customer_id is not null").groupBy(*keys, "customer_id").agg(F.countDistinct("order_id").alias("_n"))
    return per_customer.groupBy(*keys).agg(share_where(F.col("_n") > 1).alias(name))


def sales_and_customers(lines: DataFrame, keys: list[str], rate: str = "repeat_purchase_rate") -> DataFrame:
    """What ``sales`` and ``repeat_rate`` give, and unique_customers, from one pass: lines are summed by order, orders by customer, customers by key.

    An order has one customer, or none: then it counts among the orders and not for the rate. Each step shuffles what the one before has summed, and a key with many lines is spread over its orders."""
    measures = {
        "total_revenue": F.col("revenue"), "total_cost": F.col("cost"), "total_quantity_sold": F.col("quantity"), "weekend_quantity": F.when(is_weekend(F.col("ts")), F.col("quantity")).otherwise(0.0),
        "promo_revenue": F.when(F.col("promo"), F.col("revenue")).otherwise(0.0), "total_discount": F.col("discount"),
    }
    sums = [F.sum(c).alias(c) for c in measures]
    by_order = lines.groupBy(*keys, "customer_id", "order_id").agg(*[F.sum(c).alias(name) for name, c in measures.items()])
    by_customer = by_order.groupBy(*keys, "customer_id").agg(*sums, F.count("order_id").alias("_n"))
    return by_customer.groupBy(*keys).agg(*sums, F.sum("_n").alias("order_frequency"), F.count("customer_id").alias("unique_customers"), share_where(F.when(F.col("customer_id").isNotNull(), F.col("_n") > 1)).alias(rate))


def monthly_trend(lines: DataFrame, keys: list[str], value: str = "quantity", name: str = "sales_trend") -> DataFrame:
    """Slope of a monthly total over the months in which there is one; null under three."""
    monthly = lines.groupBy(*keys, month_start(F.col("ts")).alias("_month")).agg(F.sum(value).alias("_v"))
    number = (F.year("_month") * 12 + F.month("_month")).cast("double")
    return monthly.groupBy(*keys).agg(slope(F.col("_v"), number).alias(name))


def rating_trend(ratings: DataFrame, keys: list[str]) -> DataFrame:
    """Slope of the monthly mean rating, in points a month; null under three months."""
    rated = ratings.where(F.col("rating").isNotNull() & F.col("day").isNotNull())
    monthly = rated.groupBy(*keys, month_start(F.col("day")).alias("_month")).agg(F.avg("rating").alias("_v"))
    return monthly.groupBy(*keys).agg(slope(F.col("_v"), (F.year("_month") * 12 + F.month("_month")).cast("double")).alias("rating_trend"))


def price_change(prices: DataFrame) -> DataFrame:
    """(item_id, first_price, last_price, price_change_pct) of chain-wide prices."""
    chain = prices.where("location_id is null")
    ends = chain.groupBy("item_id").agg(F.min_by("price", F.struct("start_day", "price")).alias("first_price"), F.max_by("price", F.struct("start_day", "price")).alias("last_price"))
    return ends.withColumn("price_change_pct", safe_div(F.col("last_price") - F.col("first_price"), F.col("first_price")))


def wasted_share(waste_cost, unit_cost, sold):
    """(portions, share): waste as portions of the unit cost, and its share of portions wasted and sold."""
    portions = safe_div(waste_cost, unit_cost)
    return portions, safe_div(portions, portions + sold)


def basket_sizes(lines: DataFrame) -> DataFrame:
    """(order_id, basket_size): lines of an order."""
    return lines.groupBy("order_id").agg(F.count("*").alias("basket_size"))


def _entity_features(base: DataFrame, keys: list[str], lines: DataFrame, ratings: DataFrame, waste: DataFrame) -> DataFrame:
    """Sales, repeat rate, trend, rating and waste of each row of base; a unit cost comes from sales, else from base_cost."""
    rated = ratings.groupBy(*keys).agg(F.avg("rating").alias("average_rating"))
    wasted = waste.groupBy(*keys).agg(F.sum("waste_cost").alias("wastage_cost"))
    joined = base
    for part in (sales_and_customers(lines, keys).drop("unique_customers"), monthly_trend(lines, keys), rated, wasted):
        joined = joined.join(part, keys, "left")
    joined = joined.fillna(0, ["total_revenue", "total_cost", "total_quantity_sold", "weekend_quantity", "order_frequency", "promo_revenue", "total_discount", "wastage_cost"])
    sold = F.col("total_quantity_sold")
    portions, share = wasted_share(F.col("wastage_cost"), F.coalesce(safe_div(F.col("total_cost"), sold), F.col("base_cost")), sold)
    margin = F.col("total_revenue") - F.col("total_cost")
    return joined.withColumns({
        "contribution_margin": margin, "profit_percentage": safe_div(margin, F.col("total_revenue")), "wasted_portions": portions, "wastage_percentage": share,
        "promotion_dependency": safe_div(F.col("promo_revenue"), F.col("total_revenue")), "weekend_order_ratio": safe_div(F.col("weekend_quantity"), sold), "discount_rate": safe_div(F.col("total_discount"), F.col("total_revenue") + F.col("total_discount")),
    }).drop("weekend_quantity", "promo_revenue")


def item_features(lines: DataFrame, items: DataFrame, ratings: DataFrame, waste: DataFrame, prices: DataFrame, as_of: date, popularity: bool = True) -> DataFrame:
    """A row per item launched by the day; items without sales have zeros.

    items: item_id, category_id, launch_day, base_cost, is_seasonal. item_popularity is the percent_rank of quantity; it takes a pass of its own over the table, which who doesn't read it may leave out."""
    launched = items.where(up_to(F.col("launch_day"), as_of)).withColumn("days_since_launch", F.datediff(F.lit(as_of), "launch_day"))
    rated = ratings.where(up_to(F.col("day"), as_of))
    known = _entity_features(launched, ["item_id"], lines, rated, waste.where(up_to(F.col("day"), as_of))).join(rating_trend(rated, ["item_id"]), "item_id", "left")
    priced = known.join(price_change(prices.where(up_to(F.col("start_day"), as_of))), "item_id", "left")
    rows = priced.drop("launch_day")
    return with_percent_ranks(rows, ["item_id"], {"item_popularity": ("total_quantity_sold", F.lit(True))}) if popularity else rows


def popularity_snapshots(lines: DataFrame, items: DataFrame, days: list[date]) -> DataFrame:
    """(as_of, item_id, item_popularity) for each day: the percent_rank of what the items launched by then had sold by its end. One pass over the lines."""
    names = [f"_{day.isoformat()}" for day in days]
    sold = lines.groupBy("item_id").agg(*[F.sum(F.when(before_end_of(F.col("ts"), day), F.col("quantity"))).alias(name) for name, day in zip(names, days)])
    known = items.select("item_id", "launch_day").join(sold, "item_id", "left").fillna(0, names)
    ranked = with_percent_ranks(known, ["item_id"], {f"{name}_rank": (name, up_to(F.col("launch_day"), day)) for name, day in zip(names, days)})
    each = F.explode(F.array(*[F.struct(F.lit(day).alias("as_of"), F.col(f"{name}_rank").alias("item_popularity")) for name, day in zip(names, days)]))
    return ranked.select("item_id", each.alias("_s")).select("_s.as_of", "item_id", "_s.item_popularity").where("item_popularity is not null")


def item_location_features(lines: DataFrame, items: DataFrame, ratings: DataFrame, waste: DataFrame, as_of: date) -> DataFrame:
    """A row per item and location with a completed sale."""
    pairs = lines.select("item_id", "location_id").distinct().join(items.where(up_to(F.col("launch_day"), as_of)).select("item_id", "category_id", "base_cost"), "item_id")
    return _entity_features(pairs, ["item_id", "location_id"], lines, ratings.where(up_to(F.col("day"), as_of)), waste.where(up_to(F.col("day"), as_of)))


def order_level(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders with their basket size, 0 for orders without lines."""
    return orders.join(basket_sizes(lines), "order_id", "left").fillna(0, ["basket_size"])


def preferred_channel(orders: DataFrame, key: str = "customer_id") -> DataFrame:
    """The channel of most orders; in a tie the first by name."""
    counts = orders.groupBy(key, "channel").agg(F.count("*").alias("_n"))
    return first_of(counts, [key], F.col("_n").desc(), F.col("channel")).select(key, F.col("channel").alias("preferred_channel"))


def customer_features(orders: DataFrame, as_of: date) -> DataFrame:
    """A row per customer with an order by the day: recency, frequency, value, and shares of their orders.

    orders: order_id, customer_id, channel, ts, total, promo, basket_size; of completed orders."""
    known = orders.where(before_end_of(F.col("ts"), as_of) & F.col("customer_id").isNotNull())
    totals = known.groupBy("customer_id").agg(
        F.datediff(F.lit(as_of), F.max(F.col("ts").cast("date"))).alias("customer_recency"), F.count("*").alias("customer_frequency"), F.sum("total").alias("customer_monetary_value"), F.avg("total").alias("average_order_value"),
        share_where(is_peak_hour(F.col("ts"))).alias("peak_hour_ratio"), share_where(is_weekend(F.col("ts"))).alias("weekend_ratio"), F.avg("basket_size").alias("average_basket_size"),
        share_where(F.col("promo")).alias("promo_order_share"), F.datediff(F.lit(as_of), F.min(F.col("ts").cast("date"))).alias("tenure_days"),
    )
    return totals.join(preferred_channel(known), "customer_id")


def location_features(locations: DataFrame, orders: DataFrame, lines: DataFrame, waste: DataFrame, as_of: date) -> DataFrame:
    """A row per location, also without sales: revenue, profit, order value, customers, repeat and waste rates."""
    totals = sales_and_customers(lines, ["location_id"], "repeat_customer_rate")
    sold = totals.select("location_id", "total_revenue", "total_cost", F.col("order_frequency").alias("total_orders"), "unique_customers", "repeat_customer_rate")
    wasted = waste.where(up_to(F.col("day"), as_of)).groupBy("location_id").agg(F.sum("waste_cost").alias("wastage_cost"))
    joined = locations.join(sold, "location_id", "left").join(wasted, "location_id", "left")
    joined = joined.fillna(0, ["total_revenue", "total_cost", "total_orders", "unique_customers", "wastage_cost"])
    profit = F.col("total_revenue") - F.col("total_cost")
    return joined.withColumns({"gross_profit": profit, "profit_margin": safe_div(profit, F.col("total_revenue")), "average_order_value": safe_div(F.col("total_revenue"), F.col("total_orders")), "wastage_rate": safe_div(F.col("wastage_cost"), F.col("total_revenue"))})


def snapshot_days(orders: DataFrame, months_back: tuple[int, ...] = (0, 3)) -> DataFrame:
    """The days of the snapshots: the last day with an order, and so many months before it."""
    return orders.agg(F.max(F.col("ts").cast("date")).alias("last")).select(F.explode(F.array(*[F.add_months("last", -m) for m in months_back])).alias("as_of"))
