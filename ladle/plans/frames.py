"""The operators' input tables, made from the TPC-H-like tables, and the same in SQL.

An order line is a lineitem, a location a supplier, an item a part, its category the brand, the channel the order
priority; status P is cancelled; a returned line is waste; events stand in for ratings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2001, 8, 1)
FIRST_DAY, LAST_DAY = date(1995, 1, 1), date(2001, 8, 1)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def all_lines(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderpriority", "o_orderstatus", "o_orderdate")
    rows = table(spark, sf, "lineitem").join(orders, "l_orderkey").join(part, "l_partkey")
    return rows.select(
        F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_number"), F.col("l_partkey").alias("item_id"), F.col("p_brand").alias("category_id"), F.col("l_suppkey").alias("location_id"), F.col("o_custkey").alias("customer_id"), F.col("o_orderpriority").alias("channel"),
        F.when(F.col("o_orderstatus") == "P", "Cancelled").otherwise("Completed").alias("status"), F.col("o_orderdate").alias("ts"), F.col("l_quantity").alias("quantity"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
        (F.col("l_quantity") * F.col("p_retailprice")).alias("cost"), (F.col("l_extendedprice") * F.col("l_discount")).alias("discount"), (F.col("l_discount") >= 0.05).alias("promo"), F.col("l_returnflag").alias("returnflag"), F.col("l_shipdate").cast("date").alias("ship_day"),
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return all_lines(spark, sf).where("status != 'Cancelled'")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    places = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").cast("bigint").alias("location_id"))
    rows = table(spark, sf, "orders").join(places, "o_custkey", "left")
    return rows.select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), "location_id", F.col("o_orderpriority").alias("channel"), F.when(F.col("o_orderstatus") == "P", "Cancelled").otherwise("Completed").alias("status"), F.col("o_orderdate").alias("ts"), F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("promo"),
    )


def waste(spark: SparkSession, sf: str) -> DataFrame:
    rows = all_lines(spark, sf).where("returnflag = 'R'")
    return rows.select("item_id", "location_id", F.col("ship_day").alias("day"), (F.col("cost") * 0.1).alias("waste_cost"), (F.col("quantity") * 0.1).alias("wasted"), F.col("channel").alias("reason"))


def ratings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("user_id").alias("item_id"), (F.col("event_id") % 10).alias("location_id"), F.col("ts").cast("date").alias("day"), (F.pmod(F.floor(F.col("value")), F.lit(5)) + 1).cast("double").alias("rating"))


def items(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    return p.select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("category_id"), F.date_add(F.lit(date(1994, 6, 1)), (F.col("p_partkey") % 2600).cast("int")).alias("launch_day"), F.col("p_retailprice").alias("base_cost"), (F.col("p_size") % 7 == 0).alias("is_seasonal"), (F.col("p_size") % 10 != 0).alias("is_active")
    )


def prices(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "part").select("p_partkey", "p_retailprice", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    start = F.date_add(F.lit(date(1995, 1, 1)), ((F.col("p_partkey") % 97) + F.col("k") * 300).cast("int"))
    price = F.round(F.col("p_retailprice") * (1 + ((F.col("p_partkey") * 7 + F.col("k") * 13) % 11 - 5) / 50), 2)
    rows = rows.select(F.col("p_partkey").alias("item_id"), F.when(F.col("k") == 5, F.col("p_partkey") % 100).alias("location_id"), price.alias("price"), start.alias("start_day"), F.col("k"))
    return rows.withColumn("end_day", F.when(F.col("k") == 5, F.date_add("start_day", 400)).otherwise(F.date_add("start_day", 299))).drop("k")


def promotions(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("promotion_id"))
    start = F.date_add(F.lit(date(1995, 1, 10)), (F.col("promotion_id") * 99).cast("int"))
    return n.withColumn("start_day", start).withColumn("end_day", F.date_add("start_day", (20 + F.col("promotion_id") % 10).cast("int")))


def promotion_items(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select((F.col("p_partkey") % 25).alias("promotion_id"), F.col("p_partkey").alias("item_id"))


def promotion_locations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(F.col("s_nationkey").cast("bigint").alias("promotion_id"), F.col("s_suppkey").alias("location_id"))


def locations(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_regionkey").alias("r_regionkey"))
    region = table(spark, sf, "region").select("r_regionkey", "r_name")
    return table(spark, sf, "supplier").join(nation, "s_nationkey").join(region, "r_regionkey").select(F.col("s_suppkey").alias("location_id"), F.col("r_name").alias("kind"))


def stock(spark: SparkSession, sf: str) -> DataFrame:
    """What was prepared: twice what was sold on a day, or a little more than was wasted."""
    rows = all_lines(spark, sf).groupBy("item_id", "location_id", F.col("ship_day").alias("day")).agg(F.sum("quantity").alias("q"), F.count("*").alias("n"))
    return rows.select("item_id", "location_id", "day", F.when(F.pmod("item_id", F.lit(3)) == 0, F.col("q") * 0.8).otherwise(F.col("q") * 2).alias("prepared"), (F.col("q") * 0.75).alias("consumed"))


def promotion_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return promotions(spark, sf), promotion_items(spark, sf), promotion_locations(spark, sf)


def channel_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with the sums of their lines before discounts, and of the discounts from 5 % on."""
    sums = all_lines(spark, sf).groupBy("order_id").agg(F.sum(F.col("revenue") + F.col("discount")).alias("subtotal"), F.sum(F.when(F.col("promo"), F.col("discount")).otherwise(0.0)).alias("discount"))
    return orders(spark, sf).join(sums, "order_id", "left")


CTES = {
    "all_lines": """SELECT l_orderkey AS order_id, l_linenumber AS line_number, l_partkey AS item_id, p_brand AS category_id, l_suppkey AS location_id, o_custkey AS customer_id, o_orderpriority AS channel,
  CASE WHEN o_orderstatus = 'P' THEN 'Cancelled' ELSE 'Completed' END AS status, o_orderdate AS ts, l_quantity AS quantity, l_extendedprice * (1 - l_discount) AS revenue, l_quantity * p_retailprice AS cost,
  l_extendedprice * l_discount AS discount, l_discount >= 0.05 AS promo, l_returnflag AS returnflag, l_shipdate::DATE AS ship_day
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey""",
    "lines": "SELECT * FROM all_lines WHERE status <> 'Cancelled'",
    "ords": """SELECT o_orderkey AS order_id, o_custkey AS customer_id, c_nationkey::BIGINT AS location_id, o_orderpriority AS channel, CASE WHEN o_orderstatus = 'P' THEN 'Cancelled' ELSE 'Completed' END AS status, o_orderdate AS ts,
  o_totalprice AS total, o_orderpriority IN ('1-URGENT', '2-HIGH') AS promo FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "waste": "SELECT item_id, location_id, ship_day AS day, cost * 0.1 AS waste_cost, quantity * 0.1 AS wasted, channel AS reason FROM all_lines WHERE returnflag = 'R'",
    "ratings": "SELECT user_id AS item_id, event_id % 10 AS location_id, ts::DATE AS day, (floor(value)::BIGINT % 5 + 1)::DOUBLE AS rating FROM events",
    "items": "SELECT p_partkey AS item_id, p_brand AS category_id, DATE '1994-06-01' + (p_partkey % 2600)::INT AS launch_day, p_retailprice AS base_cost, p_size % 7 = 0 AS is_seasonal, p_size % 10 <> 0 AS is_active FROM part",
    "prices": """SELECT p_partkey AS item_id, CASE WHEN k = 5 THEN p_partkey % 100 END AS location_id, round(p_retailprice * (1 + ((p_partkey * 7 + k * 13) % 11 - 5) / 50), 2) AS price,
  DATE '1995-01-01' + (p_partkey % 97 + k * 300)::INT AS start_day, DATE '1995-01-01' + (p_partkey % 97 + k * 300)::INT + CASE WHEN k = 5 THEN 400 ELSE 299 END AS end_day FROM part, range(6) AS t(k)""",
    "promotions": "SELECT n_nationkey::BIGINT AS promotion_id, DATE '1995-01-10' + n_nationkey * 99 AS start_day, DATE '1995-01-10' + n_nationkey * 99 + 20 + n_nationkey % 10 AS end_day FROM nation",
    "promotion_items": "SELECT p_partkey % 25 AS promotion_id, p_partkey AS item_id FROM part",
    "promotion_locations": "SELECT s_nationkey::BIGINT AS promotion_id, s_suppkey AS location_id FROM supplier",
    "locations": "SELECT s_suppkey AS location_id, r_name AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "covered": "SELECT DISTINCT item_id, location_id, day FROM (SELECT promotion_id, unnest(generate_series(start_day, end_day, INTERVAL 1 DAY))::DATE AS day FROM promotions) JOIN promotion_items USING (promotion_id) JOIN promotion_locations USING (promotion_id)",
    "stock": "SELECT item_id, location_id, ship_day AS day, CASE WHEN item_id % 3 = 0 THEN sum(quantity) * 0.8 ELSE sum(quantity) * 2 END AS prepared, sum(quantity) * 0.75 AS consumed FROM all_lines GROUP BY item_id, location_id, ship_day",
}


@dataclass
class Query:
    """A query and its SQL. doubles are rounded on both sides, as sums of doubles depend on their order. nudge is added before, where
    amounts of few decimals may lie half way between two rounded ones."""

    spark: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None
    doubles: tuple[str, ...] = ()
    digits: int = 4
    nudge: float = 0.0

    def run(self, spark: SparkSession, sf: str) -> DataFrame:
        df = self.spark(spark, sf)
        # adding 0 turns a negative zero into zero
        return df.withColumns({c: F.round(F.col(c) + F.lit(self.nudge), self.digits) + F.lit(0.0) for c in self.doubles}) if self.doubles else df

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        rounded = ", ".join(f"round({c} + {self.nudge!r}::DOUBLE, {self.digits}) + 0.0 AS {c}" for c in self.doubles)
        body = f"SELECT *{f' REPLACE ({rounded})' * bool(rounded)} FROM (\n{self.sql.strip()}\n)"
        return f"WITH {', '.join(f'{k} AS ({v})' for k, v in CTES.items())}\n{body}"
