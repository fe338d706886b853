"""Queries of scalar functions, quality checks, cleaning and joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ladle.functions import ranks, scalar, stats
from ladle.operators import cleaning, integration, quality
from ladle.plans import frames as fr
from ladle.plans.frames import Query, table
from ladle.sources.tables import checkpoint_dir


def top_categories(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.lines(spark, sf).groupBy("category_id").agg(F.sum("revenue").alias("revenue"), F.sum("cost").alias("cost"), F.sum("quantity").alias("units"))
    rated = rows.withColumn("margin_rate", scalar.safe_div(F.col("revenue") - F.col("cost"), F.col("revenue")))
    return rated.orderBy(F.desc("revenue"), "category_id").limit(10)


TOP_CATEGORIES = """SELECT category_id, sum(revenue) AS revenue, sum(cost) AS cost, sum(quantity) AS units, (sum(revenue) - sum(cost)) / nullif(sum(revenue), 0) AS margin_rate FROM lines GROUP BY category_id ORDER BY revenue DESC, category_id LIMIT 10"""


def as_of_filters(spark: SparkSession, sf: str) -> DataFrame:
    day = date(2024, 1, 15)
    rows = table(spark, sf, "events")
    both = rows.select(scalar.before_end_of(F.col("ts"), day).alias("ts_in"), scalar.up_to(F.col("ts").cast("date"), day).alias("day_in"))
    return both.groupBy("ts_in", "day_in").agg(F.count("*").alias("n"))


AS_OF_FILTERS = """SELECT ts < TIMESTAMP '2024-01-16' AS ts_in, ts::DATE <= DATE '2024-01-15' AS day_in, count(*) AS n FROM events GROUP BY ALL"""


def event_calendar(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("day", F.col("ts").cast("date"))
    rows = scalar.with_calendar(e, "day").select(
        "event_id", "dow", "month", "is_weekend", scalar.is_peak_hour(F.col("ts")).alias("is_peak"), scalar.day_number(F.col("day")).alias("day_number"), scalar.week_start(F.col("ts")).alias("week"), scalar.week_number(F.col("ts")).alias("week_number"), scalar.month_start(F.col("ts")).alias("month_start")
    )
    return rows


EVENT_CALENDAR = """SELECT event_id, (dayofweek(ts) + 1)::INT AS dow, month(ts)::INT AS month, (dayofweek(ts) + 1 IN (6, 7, 1))::INT AS is_weekend, (hour(ts) >= 12 AND hour(ts) < 14) OR (hour(ts) >= 19 AND hour(ts) < 22) AS is_peak,
  datediff('day', DATE '2000-01-01', ts::DATE)::INT AS day_number, date_trunc('week', ts)::DATE AS week, floor(datediff('day', DATE '2000-01-03', date_trunc('week', ts)::DATE) / 7)::INT AS week_number, date_trunc('month', ts)::DATE AS month_start FROM events"""


def scalar_helpers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    share = scalar.safe_div(F.col("p_retailprice"), (F.col("p_size") % 4).cast("double"))
    rows = p.select(
        F.col("p_partkey").alias("item_id"), share.alias("ratio"), scalar.not_negative(F.col("p_retailprice") - 1000).alias("clipped"), scalar.mapped(F.col("p_type"), {"ECONOMY": "low", "STANDARD": "mid"}).alias("kept"),
        scalar.mapped(F.col("p_type"), {"ECONOMY": "low", "STANDARD": "mid"}, keep_unknown=False).alias("known"), F.log1p("p_retailprice").alias("log_price"), scalar.joined_text(F.array("p_brand", "p_type")).alias("text"),
        scalar.severity(F.when(F.col("p_size") % 5 == 0, "other").otherwise("z"), F.col("p_size") / 8 - 3, ("z",)).alias("severity"), ranks.tier(F.col("p_size") / 50).alias("tier"),
    )
    return scalar.with_values(rows, sentinel=["ratio"])


SCALAR_HELPERS = """SELECT p_partkey AS item_id, coalesce(p_retailprice / nullif(p_size % 4, 0), -1) AS ratio, greatest(p_retailprice - 1000, 0) AS clipped,
  CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'STANDARD' THEN 'mid' ELSE p_type END AS kept, CASE p_type WHEN 'ECONOMY' THEN 'low' WHEN 'STANDARD' THEN 'mid' END AS known, ln(1 + p_retailprice) AS log_price, p_brand || ' | ' || p_type AS text,
  CASE WHEN p_size % 5 = 0 THEN 'Review' WHEN abs(p_size / 8 - 3) >= 6 THEN 'Critical' WHEN abs(p_size / 8 - 3) >= 4.5 THEN 'High' ELSE 'Medium' END AS severity, CASE WHEN p_size / 50 < 0.33 THEN 'Low' WHEN p_size / 50 > 0.67 THEN 'High' ELSE 'Medium' END AS tier FROM part"""


def filters_and_search(spark: SparkSession, sf: str) -> DataFrame:
    rows = scalar.choose(fr.lines(spark, sf).withColumn("day", F.col("ts").cast("date")), "day", date(1997, 1, 1), date(1998, 12, 31), category_id=["Brand#1", "Brand#12", "Brand#21"], channel=[])
    found = scalar.search(rows, "brand#1", ["category_id"])
    return scalar.of_kind(found, "status", "Completed", F.col("quantity") >= 10).groupBy("category_id").agg(F.count("*").alias("n"), F.sum("quantity").alias("units"))


FILTERS_AND_SEARCH = """SELECT category_id, count(*) AS n, sum(quantity) AS units FROM lines WHERE ts::DATE BETWEEN DATE '1997-01-01' AND DATE '1998-12-31' AND category_id IN ('Brand#1', 'Brand#12', 'Brand#21') AND lower(category_id) LIKE '%brand#1%' AND quantity >= 10 GROUP BY 1"""


def decimals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.col("o_orderstatus"))
    return scalar.decimals_as_double(rows, ["o_orderkey", "price"])


DECIMALS = "SELECT o_orderkey, o_totalprice::DECIMAL(12, 2)::DOUBLE AS price FROM orders"


def _defects(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with defects that follow from their keys."""
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey") + F.col("l_linenumber")
    return li.select(
        "l_orderkey", "l_linenumber", F.when(k % 97 != 0, F.col("l_partkey")).alias("item_id"), F.when(k % 89 == 0, F.col("l_suppkey") + 1_000_000).otherwise(F.col("l_suppkey")).alias("location_id"), F.when(k % 83 == 0, -F.col("l_quantity")).otherwise(F.col("l_quantity")).alias("quantity"),
        F.when(k % 79 == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("price"), F.when(k % 73 == 0, F.lit(date(1900, 1, 1))).when(k % 71 == 0, F.lit(None)).otherwise(F.col("l_shipdate").cast("date")).alias("day"), F.when(k % 5 == 0, "KG").when(k % 7 == 0, "crate").otherwise("kg").alias("unit"),
        (k % 8).cast("int").alias("rating"), (F.col("l_extendedprice") * F.when(k % 67 == 0, 2).otherwise(F.col("l_discount"))).alias("discount"),
    )


_DEFECTS = """SELECT l_orderkey, l_linenumber, CASE WHEN k % 97 <> 0 THEN l_partkey END AS item_id, CASE WHEN k % 89 = 0 THEN l_suppkey + 1000000 ELSE l_suppkey END AS location_id, CASE WHEN k % 83 = 0 THEN -l_quantity ELSE l_quantity END AS quantity,
  CASE WHEN k % 79 = 0 THEN 0.0 ELSE l_extendedprice END AS price, CASE WHEN k % 73 = 0 THEN DATE '1900-01-01' WHEN k % 71 = 0 THEN NULL ELSE l_shipdate::DATE END AS day, CASE WHEN k % 5 = 0 THEN 'KG' WHEN k % 7 = 0 THEN 'crate' ELSE 'kg' END AS unit,
  (k % 8)::INT AS rating, l_extendedprice * CASE WHEN k % 67 = 0 THEN 2 ELSE l_discount END AS discount FROM (SELECT *, l_orderkey + l_linenumber AS k FROM lineitem)"""

def _checks() -> list:
    return [
        *quality.missing(["item_id", "day"]), *quality.not_positive(["price"]), *quality.negative(["quantity"]), *quality.outside("day", date(1990, 1, 1), date(2010, 1, 1), "invalid_date"),
    *quality.outside("rating", 1, 5, "invalid_rating"), *quality.exceeds("discount", "price", "incorrect_discount"), *quality.not_among("unit", ("pcs", "kg", "liters"), "inconsistent_unit"),
]
_SQL_CHECKS = [
    ("item_id", "missing_value", "item_id IS NULL"), ("day", "missing_value", "day IS NULL"), ("price", "invalid_price", "price <= 0"), ("quantity", "negative_quantity", "quantity < 0"), ("day", "invalid_date", "day < DATE '1990-01-01' OR day > DATE '2010-01-01'"),
    ("rating", "invalid_rating", "rating < 1 OR rating > 5"), ("discount", "incorrect_discount", "discount > price"), ("unit", "inconsistent_unit", "unit NOT IN ('pcs', 'kg', 'liters')"),
]


def issue_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = _defects(spark, sf)
    twice = quality.duplicates(rows, "lineitem", ["l_orderkey", "l_linenumber"], "duplicate_rows")
    return quality.issues(quality.issue_rows(rows, "lineitem", _checks()), twice)


_ISSUE = "SELECT 'lineitem' AS table_name, '{0}' AS column_name, '{1}' AS rule, count(*) FILTER ({2}) AS n_rows, count(*) AS table_rows, round(100 * count(*) FILTER ({2}) / count(*), 4) AS pct, '' AS note FROM d"
ISSUE_TABLE = (
    f"SELECT * FROM (WITH d AS ({_DEFECTS}) " + " UNION ALL ".join(_ISSUE.format(*c) for c in _SQL_CHECKS)
    + " UNION ALL SELECT 'lineitem', 'l_orderkey+l_linenumber', 'duplicate_rows', (count(*) - count(DISTINCT (l_orderkey, l_linenumber))), count(*), round(100 * (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) / count(*), 4), '' FROM d)"
)


def orphan_checks(spark: SparkSession, sf: str) -> DataFrame:
    tables = {"lines": _defects(spark, sf), "part": table(spark, sf, "part"), "supplier": table(spark, sf, "supplier")}
    return quality.orphan_issues(tables, (("lines", "item_id", "part", "p_partkey"), ("lines", "location_id", "supplier", "s_suppkey")), {("lines", "location_id"): "invalid_restaurant_id"}).select("table_name", "column_name", "rule", "n_rows", "table_rows")


ORPHAN_CHECKS = f"""SELECT * FROM (WITH d AS ({_DEFECTS}) SELECT 'lines' AS table_name, 'item_id' AS column_name, 'orphan_foreign_key' AS rule, count(*) FILTER (item_id IS NOT NULL AND item_id NOT IN (SELECT p_partkey FROM part)) AS n_rows, count(*) AS table_rows FROM d
  UNION ALL SELECT 'lines', 'location_id', 'invalid_restaurant_id', count(*) FILTER (location_id NOT IN (SELECT s_suppkey FROM supplier)), count(*) FROM d)"""


def orphan_rows(spark: SparkSession, sf: str) -> DataFrame:
    return quality.orphans(_defects(spark, sf), "location_id", table(spark, sf, "supplier"), "s_suppkey").groupBy("location_id").agg(F.count("*").alias("n"))


ORPHAN_ROWS = f"SELECT location_id, count(*) AS n FROM ({_DEFECTS}) WHERE location_id NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1"


def cast_diff(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    raw = o.select("o_orderkey", F.when(k % 61 == 0, "").when(k % 59 == 0, "2025-13-07").when(k % 53 == 0, "not_a_date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"), F.when(k % 47 == 0, "n/a").when(k % 43 == 0, None).otherwise(F.col("o_custkey").cast("string")).alias("customer"))
    typed = raw.select("o_orderkey", F.try_to_timestamp("day", F.lit("yyyy-MM-dd")).cast("date").alias("day"), F.col("customer").try_cast("bigint").alias("customer"))
    return quality.unparsed(typed, raw, ["o_orderkey"])


CAST_DIFF = """SELECT 'day' AS column_name, count(*) FILTER (o_orderkey % 61 = 0) AS blank, count(*) FILTER (o_orderkey % 61 <> 0 AND (o_orderkey % 59 = 0 OR o_orderkey % 53 = 0)) AS unparseable FROM orders
  UNION ALL SELECT 'customer', count(*) FILTER (o_orderkey % 47 <> 0 AND o_orderkey % 43 = 0), count(*) FILTER (o_orderkey % 47 = 0) FROM orders"""


def impossible_waste(spark: SparkSession, sf: str) -> DataFrame:
    wasted = fr.waste(spark, sf).groupBy("item_id", "location_id", "day").agg(F.sum("wasted").alias("wasted"))
    return quality.impossible_waste(wasted, fr.stock(spark, sf), ["item_id", "location_id", "day"], "wasted", "prepared", "consumed").select("rule", "n_rows", "table_rows")


IMPOSSIBLE_WASTE = """SELECT 'impossible_wastage_quantity' AS rule, count(*) FILTER (w > prepared - consumed) AS n_rows, count(*) AS table_rows FROM (SELECT item_id, location_id, day, sum(wasted) AS w FROM waste GROUP BY ALL) JOIN stock USING (item_id, location_id, day)"""


def reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    found = issue_table(spark, sf)
    k = F.col("l_orderkey") + F.col("l_linenumber")
    injected = table(spark, sf, "lineitem").agg(F.count_if(k % 97 == 0).alias("a"), F.count_if(k % 83 == 0).alias("b"), F.count_if(k % 79 == 0).alias("c"))
    rows = injected.select(F.explode(F.array(*[F.struct(F.lit("lineitem").alias("table_name"), F.lit(n).alias("rule"), F.col(c).alias("n_rows")) for c, n in (("a", "blank"), ("b", "negative_quantity"), ("c", "invalid_price"))])).alias("x")).select("x.*")
    return quality.reconcile(rows, found.where("rule in ('missing_value', 'negative_quantity', 'invalid_price', 'invalid_rating')"), {"missing_value": "blank"})


RECONCILIATION = f"""SELECT 'lineitem' AS table_name, coalesce(i.rule, f.rule) AS rule, coalesce(injected, 0) AS injected, coalesce(found, 0) AS found, coalesce(found, 0) - coalesce(injected, 0) AS gap FROM
  (SELECT unnest(['blank', 'negative_quantity', 'invalid_price']) AS rule, unnest([count(*) FILTER (k % 97 = 0), count(*) FILTER (k % 83 = 0), count(*) FILTER (k % 79 = 0)]) AS injected FROM (SELECT l_orderkey + l_linenumber AS k FROM lineitem)) i
  FULL JOIN (WITH d AS ({_DEFECTS}) SELECT unnest(['blank', 'negative_quantity', 'invalid_price', 'invalid_rating']) AS rule,
    unnest([count(*) FILTER (item_id IS NULL) + count(*) FILTER (day IS NULL), count(*) FILTER (quantity < 0), count(*) FILTER (price <= 0), count(*) FILTER (rating < 1 OR rating > 5)]) AS found FROM d) f ON i.rule = f.rule"""


def _cleaned(spark: SparkSession, sf: str) -> cleaning.Cleaned:
    rules = [
        ("missing_value", F.col("item_id").isNull()), ("negative_quantity", F.col("quantity") < 0), ("invalid_price", F.col("price") <= 0),
        ("invalid_date", cleaning.invalid_day("day", date(1990, 1, 1), date(2010, 1, 1))), ("orphan_foreign_key", F.col("_no_place")),
    ]
    rows = _defects(spark, sf).withColumn("line", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    return cleaning.clean(rows, cleaning.Step("lineitem", "line", rules, [("_no_place", "location_id", table(spark, sf, "supplier"), "s_suppkey")], unit_col="unit", units={"KG": "kg"}))


_BROKEN = """CASE WHEN item_id IS NULL THEN 'missing_value' WHEN quantity < 0 THEN 'negative_quantity' WHEN price <= 0 THEN 'invalid_price' WHEN day IS NULL OR day < DATE '1990-01-01' OR day > DATE '2010-01-01' THEN 'invalid_date'
  WHEN location_id NOT IN (SELECT s_suppkey FROM supplier) THEN 'orphan_foreign_key' END"""


def quarantine(spark: SparkSession, sf: str) -> DataFrame:
    done = _cleaned(spark, sf)
    kept = done.clean.groupBy("unit").agg(F.count("*").alias("n"), F.sum("quantity").alias("units")).select(F.lit("kept").alias("reason"), "unit", "n", "units")
    return kept.union(done.quarantined.groupBy("quarantine_reason", "unit").agg(F.count("*").alias("n"), F.sum("quantity").alias("units")))


QUARANTINE = f"""SELECT coalesce({_BROKEN}, 'kept') AS reason, CASE unit WHEN 'KG' THEN 'kg' ELSE unit END AS unit, count(*) AS n, sum(quantity) AS units FROM ({_DEFECTS}) GROUP BY 1, 2"""


def cleaning_log(spark: SparkSession, sf: str) -> DataFrame:
    return _cleaned(spark, sf).log.groupBy("table_name", "issue", "action", "detail").agg(F.count("*").alias("n"))


CLEANING_LOG = f"""SELECT 'lineitem' AS table_name, 'inconsistent_unit' AS issue, 'normalized' AS action, 'KG -> kg' AS detail, count(*) AS n FROM ({_DEFECTS}) WHERE unit = 'KG' GROUP BY ALL
  UNION ALL SELECT 'lineitem', reason, 'quarantined', '', count(*) FROM (SELECT {_BROKEN} AS reason FROM ({_DEFECTS})) WHERE reason IS NOT NULL GROUP BY reason"""


def before_after(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.row_counts({"lineitem": _defects(spark, sf)}, {"lineitem": _cleaned(spark, sf).clean})


BEFORE_AFTER = f"SELECT 'lineitem' AS table_name, count(*) AS before, count(*) FILTER (reason IS NULL) AS after, count(*) FILTER (reason IS NOT NULL) AS removed FROM (SELECT {_BROKEN} AS reason FROM ({_DEFECTS}))"


def deduplicated(spark: SparkSession, sf: str) -> DataFrame:
    first, _ = cleaning.deduplicate(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], F.col("l_partkey"), F.col("l_suppkey"), F.col("l_extendedprice"))
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


DEDUPLICATED = "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1"


def base_prices(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("item_id"), F.when(F.col("p_partkey") % 13 == 0, 0.0).otherwise(F.col("p_retailprice")).alias("base_price"))
    return cleaning.corrected_base_price(rows, fr.prices(spark, sf), start="start_day").withColumnRenamed("_corrected", "corrected")


BASE_PRICES = """SELECT p_partkey AS item_id, CASE WHEN p_partkey % 13 = 0 THEN latest ELSE p_retailprice END AS base_price, p_partkey % 13 = 0 AS corrected FROM part
  JOIN (SELECT item_id, arg_max(price, start_day) AS latest FROM prices WHERE location_id IS NULL GROUP BY 1) ON item_id = p_partkey"""


def line_prices(spark: SparkSession, sf: str) -> DataFrame:
    rows = fr.all_lines(spark, sf).groupBy("order_id", "item_id").agg(F.min("location_id").alias("location_id"), F.min("ship_day").alias("day"), F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"))
    # written once, as four steps read them: each would join orders and parts anew and hold the parts in memory again
    checkpoint_dir(spark)
    rows = rows.checkpoint()
    rows = rows.withColumns({"line": F.concat_ws("-", "order_id", "item_id"), "price": F.when(F.col("order_id") % 3 == 0, 0.0).otherwise(5.0), "discount": F.lit(1.0)})
    done = cleaning.corrected_line_price(rows, fr.prices(spark, sf), "line", "item_id", "location_id", "day", "price", "quantity", "discount", "revenue", start="start_day", end="end_day")
    return done.select("line", "price", "revenue", F.col("_corrected").alias("corrected"))


LINE_PRICES = """WITH r AS (SELECT order_id, item_id, min(location_id) AS location_id, min(ship_day) AS day, sum(quantity) AS quantity, sum(revenue) AS revenue FROM all_lines GROUP BY 1, 2),
  f AS (SELECT order_id, r.item_id, price FROM r JOIN prices p ON p.item_id = r.item_id AND day BETWEEN start_day AND end_day AND (p.location_id IS NULL OR p.location_id = r.location_id)
    QUALIFY row_number() OVER (PARTITION BY order_id, r.item_id ORDER BY p.location_id IS NOT NULL DESC, start_day DESC, price DESC) = 1)
  SELECT order_id || '-' || item_id AS line, CASE WHEN order_id % 3 <> 0 THEN 5.0 ELSE coalesce(price, 0.0) END AS price, CASE WHEN order_id % 3 = 0 AND price IS NOT NULL THEN quantity * price - 1.0 ELSE revenue END AS revenue, order_id % 3 = 0 AND price IS NOT NULL AS corrected
  FROM r LEFT JOIN f USING (order_id, item_id)"""


def excess_waste(spark: SparkSession, sf: str) -> DataFrame:
    rows = cleaning.with_excess(fr.waste(spark, sf), fr.stock(spark, sf), ["item_id", "location_id", "day"], "wasted", "prepared", "consumed", "exceeds")
    return rows.groupBy("exceeds").agg(F.count("*").alias("n"), F.sum("waste_cost").alias("waste_cost"))


EXCESS_WASTE = "SELECT coalesce(wasted > prepared - consumed, false) AS exceeds, count(*) AS n, sum(waste_cost) AS waste_cost FROM waste LEFT JOIN stock USING (item_id, location_id, day) GROUP BY 1"


def _tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """The source tables' names over the test tables, as far as the fixed joins need them."""
    t = {n: table(spark, sf, n) for n in ("orders", "lineitem", "customer", "part", "supplier", "nation")}
    return {
        "Orders": fr.orders(spark, sf).select("order_id", "customer_id", "location_id", F.col("ts").alias("order_datetime"), F.col("channel").alias("order_channel"), F.col("status").alias("order_status"), F.when(F.col("promo"), F.col("customer_id") % 25).alias("promotion_id"), F.col("total").alias("total_amount"), (F.col("total") * 0.1).alias("discount_amount")),
        "Order_Items": fr.all_lines(spark, sf).select(F.concat_ws("-", "order_id", "line_number").alias("order_item_id"), "order_id", "item_id", "quantity", F.col("revenue").alias("line_total")),
        "Customers": t["customer"].select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("age_group"), F.col("c_name").alias("gender"), (F.col("c_acctbal") > 0).alias("loyalty_member")),
        "Menu_Items": t["part"].select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_brand").alias("category_id")),
        "Menu_Categories": t["part"].select(F.col("p_brand").alias("category_id"), F.concat(F.lit("Category "), "p_brand").alias("category_name")).distinct(),
        "Restaurants": t["nation"].select(F.col("n_nationkey").cast("bigint").alias("location_id"), F.col("n_name").alias("city"), F.col("n_regionkey").alias("region"), F.col("n_name").alias("location_type")),
        "Promotions": fr.promotions(spark, sf).select("promotion_id", F.concat(F.lit("Promotion "), "promotion_id").alias("promotion_name"), F.lit("percent").alias("promotion_type")),
        "Pricing_History": fr.prices(spark, sf).select(F.concat_ws("-", "item_id", "start_day").alias("price_id"), "item_id", "location_id", "price", F.col("price").alias("cost"), F.col("start_day").alias("effective_start_date"), F.col("end_day").alias("effective_end_date")),
        "Ratings": fr.ratings(spark, sf).select(F.col("day").cast("string").alias("rating_id"), "item_id", F.col("rating").alias("rating_value"), F.col("day").alias("rating_date")),
        "Inventory": fr.stock(spark, sf).select(F.lit("s").alias("inventory_id"), "item_id", "location_id", F.col("day").alias("date"), F.col("prepared").alias("prepared_quantity"), F.col("consumed").alias("closing_stock")),
        "Wastage": fr.waste(spark, sf).select(F.lit("w").alias("wastage_id"), "item_id", "location_id", F.col("day").alias("date"), F.col("wasted").alias("quantity_wasted"), F.col("waste_cost").alias("cost_of_waste"), "reason"),
    }


def star_joins(spark: SparkSession, sf: str) -> DataFrame:
    tables = _tables(spark, sf)
    return integration.join_counts({name: integration.star_join(tables, name) for name in integration.STAR_JOINS})


STAR_JOINS = """SELECT unnest(['orders_customers', 'orders_order_items', 'order_items_menu_items', 'menu_items_categories', 'orders_restaurants', 'orders_promotions', 'menu_items_pricing_history', 'menu_items_ratings', 'menu_items_inventory', 'menu_items_wastage']) AS name,
  unnest([(SELECT count(*) FROM orders JOIN customer ON o_custkey = c_custkey), (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey), (SELECT count(*) FROM lineitem JOIN part ON l_partkey = p_partkey), (SELECT count(*) FROM part),
    (SELECT count(*) FROM ords JOIN nation ON location_id = n_nationkey), (SELECT count(*) FROM ords WHERE promo), (SELECT count(*) FROM prices), (SELECT count(*) FROM ratings JOIN part ON item_id = p_partkey), (SELECT count(*) FROM stock), (SELECT count(*) FROM waste)]) AS n_rows"""


def order_fact(spark: SparkSession, sf: str) -> DataFrame:
    t = _tables(spark, sf)
    head = t["Orders"].select("order_id", "customer_id", "location_id", "order_status", "promotion_id")
    fact = integration.order_line_fact(t["Order_Items"], (head, ["order_id"]), (t["Menu_Items"], ["item_id"]), (t["Menu_Categories"], ["category_id"]), (t["Restaurants"], ["location_id"]), (t["Promotions"], ["promotion_id"]))
    return fact.groupBy("category_name", "city", "promotion_name").agg(F.count("*").alias("n"), F.sum("line_total").alias("line_total"))


ORDER_FACT = """SELECT 'Category ' || category_id AS category_name, n_name AS city, CASE WHEN o.promo THEN 'Promotion ' || (o.customer_id % 25) END AS promotion_name, count(*) AS n, sum(l.revenue) AS line_total
  FROM all_lines l JOIN ords o USING (order_id) LEFT JOIN nation ON o.location_id = n_nationkey GROUP BY ALL"""


def named_join(name: str) -> Query:
    """One of the ten fixed joins, by a digest of its rows."""
    spec = {
        "orders_customers": ("age_group", "total_amount", "SELECT c_mktsegment AS k, o_totalprice AS v FROM orders JOIN customer ON o_custkey = c_custkey"),
        "orders_order_items": ("order_channel", "line_total", "SELECT o_orderpriority AS k, l_extendedprice * (1 - l_discount) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"),
        "order_items_menu_items": ("category_id", "quantity", "SELECT p_brand AS k, l_quantity AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey"),
        "menu_items_categories": ("category_name", "item_id", "SELECT 'Category ' || p_brand AS k, p_partkey::DOUBLE AS v FROM part"),
        "orders_restaurants": ("city", "total_amount", "SELECT n_name AS k, total AS v FROM ords JOIN nation ON location_id = n_nationkey"),
        "orders_promotions": ("promotion_name", "discount_amount", "SELECT 'Promotion ' || (customer_id % 25) AS k, total * 0.1 AS v FROM ords WHERE promo"),
        "menu_items_pricing_history": ("item_name", "price", "SELECT p_name AS k, price AS v FROM prices JOIN part ON item_id = p_partkey"),
        "menu_items_ratings": ("item_name", "rating_value", "SELECT p_name AS k, rating AS v FROM ratings JOIN part ON item_id = p_partkey"),
        "menu_items_inventory": ("item_name", "prepared_quantity", "SELECT p_name AS k, prepared AS v FROM stock JOIN part ON item_id = p_partkey"),
        "menu_items_wastage": ("item_name", "cost_of_waste", "SELECT p_name AS k, waste_cost AS v FROM waste JOIN part ON item_id = p_partkey"),
    }[name]
    key, value, sql = spec

    def run(spark: SparkSession, sf: str) -> DataFrame:
        joined = integration.star_join(_tables(spark, sf), name)
        return joined.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("double")).alias("total"))

    return Query(run, f"SELECT k, count(*) AS n, sum(v) AS total FROM ({sql}) GROUP BY k", ("total",), 2)


def anti_join(spark: SparkSession, sf: str) -> DataFrame:
    done = fr.orders(spark, sf).where("status = 'Completed'").select("customer_id")
    return integration.without(table(spark, sf, "customer").select(F.col("c_custkey").alias("customer_id"), "c_mktsegment"), done, ["customer_id"])


ANTI_JOIN = "SELECT c_custkey AS customer_id, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT customer_id FROM ords WHERE status = 'Completed')"


def fused_daily(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["item_id", "day"]
    sold = fr.lines(spark, sf).groupBy("item_id", F.col("ts").cast("date").alias("day")).agg(F.sum("quantity").alias("quantity"))
    wasted = fr.waste(spark, sf).groupBy(*keys).agg(F.sum("waste_cost").alias("waste_cost"))
    return integration.fused(sold, wasted, keys, ["quantity", "waste_cost"])


FUSED_DAILY = """SELECT item_id, day, coalesce(quantity, 0) AS quantity, coalesce(waste_cost, 0) AS waste_cost FROM (SELECT item_id, ts::DATE AS day, sum(quantity) AS quantity FROM lines GROUP BY 1, 2)
  FULL JOIN (SELECT item_id, day, sum(waste_cost) AS waste_cost FROM waste GROUP BY 1, 2) USING (item_id, day)"""


def promo_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return integration.promotion_coverage(*fr.promotion_tables(spark, sf))


PROMO_COVERAGE = """SELECT location_id, count(*) AS n, min(day) AS first_day, max(day) AS last_day FROM (SELECT DISTINCT item_id, location_id, day FROM (SELECT promotion_id, unnest(generate_series(start_day, end_day, INTERVAL 1 DAY))::DATE AS day FROM promotions)
  JOIN promotion_items USING (promotion_id) JOIN promotion_locations USING (promotion_id)) GROUP BY 1"""


def effective_prices(spark: SparkSession, sf: str) -> DataFrame:
    grid = fr.all_lines(spark, sf).select("item_id", "location_id", F.col("ship_day").alias("day")).distinct()
    return integration.price_in_effect(grid, fr.prices(spark, sf))


EFFECTIVE_PRICES = """WITH g AS (SELECT DISTINCT item_id, location_id, ship_day AS day FROM all_lines),
  f AS (SELECT g.item_id, g.location_id, g.day, price FROM g JOIN prices p ON p.item_id = g.item_id AND start_day <= day AND (p.location_id IS NULL OR (p.location_id = g.location_id AND end_day >= day))
    QUALIFY row_number() OVER (PARTITION BY g.item_id, g.location_id, g.day ORDER BY p.location_id IS NOT NULL DESC, start_day DESC, price DESC) = 1)
  SELECT g.*, price FROM g LEFT JOIN f USING (item_id, location_id, day)"""


def lagged_days(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.withColumns({f"lag_{k}": integration.lagged("n", ["user_id"], "day", k) for k in (1, 7)})


LAGGED_DAYS = """WITH d AS (SELECT user_id, ts::DATE AS day, count(*) AS n FROM events GROUP BY 1, 2)
  SELECT d.*, a.n AS lag_1, b.n AS lag_7 FROM d LEFT JOIN d a ON a.user_id = d.user_id AND a.day = d.day - 1 LEFT JOIN d b ON b.user_id = d.user_id AND b.day = d.day - 7"""


def order_margins(spark: SparkSession, sf: str) -> DataFrame:
    margin = fr.all_lines(spark, sf).groupBy("order_id").agg(F.sum(F.col("revenue") - F.col("cost")).alias("margin"))
    return fr.orders(spark, sf).join(margin, "order_id", "left").fillna(0, ["margin"]).select("order_id", "customer_id", "total", "margin")


ORDER_MARGINS = "SELECT order_id, customer_id, total, coalesce(margin, 0) AS margin FROM ords LEFT JOIN (SELECT order_id, sum(revenue - cost) AS margin FROM all_lines GROUP BY 1) USING (order_id)"


def waste_with_items(spark: SparkSession, sf: str) -> DataFrame:
    return fr.waste(spark, sf).join(fr.items(spark, sf).select("item_id", "category_id", "is_seasonal"), "item_id", "left").groupBy("category_id", "is_seasonal").agg(F.sum("waste_cost").alias("waste_cost"), F.count("*").alias("n"))


WASTE_WITH_ITEMS = "SELECT category_id, is_seasonal, sum(waste_cost) AS waste_cost, count(*) AS n FROM waste LEFT JOIN items USING (item_id) GROUP BY 1, 2"


def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", scalar.held_out(F.col("c_custkey")).alias("held_out"))


def distribution(spark: SparkSession, sf: str) -> DataFrame:
    return stats.summary(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


DISTRIBUTION = " UNION ALL ".join(f"SELECT '{c}' AS feature, avg({c}) AS mean, " + ", ".join(f"quantile_cont({c}, {p / 100}) AS p{p}" for p in (25, 50, 75, 90, 99)) + " FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount"))

QUERIES = {
    "top_categories": Query(top_categories, TOP_CATEGORIES, ("revenue", "cost", "units", "margin_rate")),
    "as_of_filters": Query(as_of_filters, AS_OF_FILTERS),
    "event_calendar": Query(event_calendar, EVENT_CALENDAR),
    "scalar_helpers": Query(scalar_helpers, SCALAR_HELPERS, ("ratio", "clipped", "log_price")),
    "filters_and_search": Query(filters_and_search, FILTERS_AND_SEARCH, ("units",)),
    "decimals_as_double": Query(decimals, DECIMALS),
    "issue_table": Query(issue_table, ISSUE_TABLE),
    "orphan_checks": Query(orphan_checks, ORPHAN_CHECKS),
    "orphan_rows": Query(orphan_rows, ORPHAN_ROWS),
    "cast_diff": Query(cast_diff, CAST_DIFF),
    "impossible_waste": Query(impossible_waste, IMPOSSIBLE_WASTE),
    "reconciliation": Query(reconciliation, RECONCILIATION),
    "quarantine": Query(quarantine, QUARANTINE, ("units",)),
    "cleaning_log": Query(cleaning_log, CLEANING_LOG),
    "before_after": Query(before_after, BEFORE_AFTER),
    "deduplicated": Query(deduplicated, DEDUPLICATED),
    "base_prices": Query(base_prices, BASE_PRICES, ("base_price",)),
    "line_prices": Query(line_prices, LINE_PRICES, ("price", "revenue")),
    "excess_waste": Query(excess_waste, EXCESS_WASTE, ("waste_cost",), 2),
    "star_joins": Query(star_joins, STAR_JOINS),
    "order_fact": Query(order_fact, ORDER_FACT, ("line_total",)),
    **{f"join_{name}": named_join(name) for name in integration.STAR_JOINS},
    "anti_join": Query(anti_join, ANTI_JOIN),
    "fused_daily": Query(fused_daily, FUSED_DAILY, ("quantity", "waste_cost")),
    "promo_coverage": Query(promo_coverage, PROMO_COVERAGE),
    "effective_prices": Query(effective_prices, EFFECTIVE_PRICES, ("price",)),
    "lagged_days": Query(lagged_days, LAGGED_DAYS),
    "order_margins": Query(order_margins, ORDER_MARGINS, ("margin",)),
    "waste_with_items": Query(waste_with_items, WASTE_WITH_ITEMS, ("waste_cost",), 2),
    "hash_split": Query(hash_split),
    "distribution": Query(distribution, DISTRIBUTION, ("mean", "p25", "p50", "p75", "p90", "p99")),
}
