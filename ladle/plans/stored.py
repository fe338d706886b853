"""Queries of the readers and writers: tables are written to the shared folder and read back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ladle.operators import cleaning, forecast
from ladle.plans.frames import Query, table
from ladle.sources import tables

ORDERS = StructType().add("o_orderkey", "long").add("o_custkey", "long").add("o_orderstatus", "string").add("o_totalprice", "double").add("o_orderdate", "timestamp").add("o_orderpriority", "string")


def _written_orders(spark: SparkSession, sf: str) -> str:
    path = tables.new_folder(spark, "orders")
    tables.write_csv(table(spark, sf, "orders").select(*ORDERS.fieldNames()), path)
    return path


def csv_typed(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as CSV, read with their types."""
    rows = tables.read_csv(spark, _written_orders(spark, sf), ORDERS)
    return rows.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count("o_orderdate").alias("dated"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.sum("o_totalprice").alias("total"))


CSV_TYPED = "SELECT o_orderpriority, count(*) AS n, count(o_orderdate) AS dated, min(o_orderdate) AS first, max(o_orderdate) AS last, sum(o_totalprice) AS total FROM orders GROUP BY 1"


def csv_raw(spark: SparkSession, sf: str) -> DataFrame:
    """The same files as strings."""
    rows = tables.read_raw_csv(spark, _written_orders(spark, sf), ORDERS)
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("first"), F.max(F.length("o_orderkey")).cast("bigint").alias("longest_key"), F.max("o_orderkey").alias("last_key"))


CSV_RAW = "SELECT o_orderstatus, count(*) AS n, min(strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')) AS first, max(length(o_orderkey::VARCHAR)) AS longest_key, max(o_orderkey::VARCHAR) AS last_key FROM orders GROUP BY 1"


def csv_partitioned(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as CSV in a folder per segment; rows written and read."""
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    return tables.rewritten_csv(rows, tables.new_folder(spark, "customers"), ["c_mktsegment"])


CSV_PARTITIONED = "SELECT count(*) AS n_written, count(*) AS n_read, true AS same FROM customer"


def inferred_types(spark: SparkSession, sf: str) -> DataFrame:
    """The types Spark infers from the orders' CSV against the declared ones: keys come as int, the rest as declared."""
    return tables.inferred_schema(spark, _written_orders(spark, sf), ORDERS)


INFERRED_TYPES = """SELECT name AS "column", CASE WHEN name IN ('o_orderkey', 'o_custkey') THEN 'bigint' WHEN name = 'o_totalprice' THEN 'double' WHEN name = 'o_orderdate' THEN 'timestamp' ELSE 'string' END AS declared,
  CASE WHEN name IN ('o_orderkey', 'o_custkey') THEN if(top > 2147483647, 'bigint', 'int') WHEN name = 'o_totalprice' THEN 'double' WHEN name = 'o_orderdate' THEN 'timestamp' ELSE 'string' END AS inferred, declared = inferred AS same
  FROM (SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS name), (SELECT max(o_orderkey) AS top FROM orders)"""


def json_dimension(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as JSON."""
    rows, path = table(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey"), tables.new_folder(spark, "nations")
    tables.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


JSON_DIMENSION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"


def parquet_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines with their order's date, as Parquet in a folder per year and month."""
    parents = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").cast("date").alias("day"))
    rows = tables.with_parent_date(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity"), parents, "l_orderkey", "day")
    path = tables.new_folder(spark, "lines")
    tables.write_by_month(rows, path, "day")
    return spark.read.parquet(path).groupBy("year", "month").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.min("day").alias("first"))


PARQUET_BY_MONTH = "SELECT year(o_orderdate)::INT AS year, month(o_orderdate)::INT AS month, count(*) AS n, sum(l_quantity) AS quantity, min(o_orderdate::DATE) AS first FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2"


def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Snapshots of two tables: one replaced, the latest that both have, the last before it, and the latest of one alone."""
    paths = [tables.new_folder(spark, name) for name in ("orders", "lines")]
    o, l = table(spark, sf, "orders").select(F.col("o_orderkey").alias("key")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    days = [date(2001, month, 1) for month in (1, 2, 3)]
    for day, part in zip(days, (o.where("key = -1"), o.where("key > 100"), o)):
        tables.write_snapshot(part, paths[0], day)
    tables.write_snapshot(o.where("key > 200"), paths[0], days[0])
    for day, part in zip(days[:2], (l, l.where("key > 100"))):
        tables.write_snapshot(part, paths[1], day)
    common = tables.latest_snapshot(spark, *paths)
    before = tables.latest_snapshot(spark, *paths, before=common)

    def counted(which: str, path: str, as_of: date | None) -> DataFrame:
        rows = tables.read_snapshot(spark, path, as_of)
        return rows.groupBy(F.lit(which).alias("which"), F.col("as_of_date").cast("date").alias("as_of_date")).agg(F.count("*").alias("n"), F.sum("key").alias("keys"))

    parts = [counted("common orders", paths[0], common), counted("common lines", paths[1], common), counted("orders before", paths[0], before), counted("latest orders", paths[0], None)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


_SNAPSHOT = "SELECT '{}' AS which, DATE '{}' AS as_of_date, count(*) AS n, sum({})::BIGINT AS keys FROM {} WHERE {} HAVING count(*) > 0"
SNAPSHOTS = " UNION ALL ".join(
    _SNAPSHOT.format(*a)
    for a in (("common orders", "2001-02-01", "o_orderkey", "orders", "o_orderkey > 100"), ("common lines", "2001-02-01", "l_orderkey", "lineitem", "l_orderkey > 100"), ("orders before", "2001-01-01", "o_orderkey", "orders", "o_orderkey > 200"), ("latest orders", "2001-03-01", "o_orderkey", "orders", "true"))
)


def stored_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """Orders that break a rule, with the first one they break, written and read back."""
    rows = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").withColumn("_helper", F.lit(1))
    step = cleaning.Step("orders", "o_orderkey", [("pending", F.col("o_orderstatus") == "P"), ("small", F.col("o_totalprice") < 50_000)])
    path = tables.new_folder(spark, "quarantine")
    found = cleaning.clean(rows, step).quarantined
    if not tables.write_quarantine(found, path):
        return found.drop("_helper").select("o_orderkey", "o_totalprice", cleaning.REASON)
    return spark.read.parquet(path).drop("o_orderstatus")


STORED_QUARANTINE = "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN 'pending' ELSE 'small' END AS quarantine_reason FROM orders WHERE o_orderstatus = 'P' OR o_totalprice < 50000"


def rewritten_table(spark: SparkSession, sf: str) -> DataFrame:
    """Orders, read, given a column more, written as a new version, and queried by SQL as a view."""
    path = tables.new_folder(spark, "versions")
    table(spark, sf, "orders").select("o_orderkey", "o_orderdate").write.parquet(f"{path}/v1")
    grown = tables.rewrite(spark.read.parquet(f"{path}/v1").withColumn("year", F.year("o_orderdate")), path, "v2")
    tables.register({"ladle_rewritten": grown})
    return spark.sql("SELECT year, count(*) AS n, max(o_orderkey) AS last_key FROM ladle_rewritten GROUP BY year")


REWRITTEN_TABLE = "SELECT year(o_orderdate)::INT AS year, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1"



def cleaned_table(spark: SparkSession, sf: str) -> DataFrame:
    """Parts and their brands as the source tables Menu_Items and Menu_Categories, written and read under their names, typed and as strings."""
    path, part = tables.new_folder(spark, "cleaned"), table(spark, sf, "part")
    tables.write_csv(part.select(F.col("p_brand").alias("category_id"), F.concat(F.lit("Brand "), F.substring("p_brand", 7, 2)).alias("category_name"), F.lit(None).cast("string").alias("description")).distinct(), f"{path}/Menu_Categories.csv")
    none = F.lit(None).cast("string")
    items = part.select(
        F.col("p_partkey").cast("string").alias("item_id"), F.concat(F.lit("Part "), F.col("p_partkey")).alias("item_name"), F.col("p_brand").alias("category_id"), F.col("p_retailprice").cast("decimal(12,2)").alias("base_price"), F.lit(1).cast("decimal(12,2)").alias("base_cost"), none.alias("description"),
        (F.col("p_size") % 10 != 0).alias("is_active"), F.date_add(F.lit(date(1994, 6, 1)), (F.col("p_partkey") % 2600).cast("int")).alias("launch_date"), F.lit(False).alias("is_seasonal"), none.alias("season"),
    )
    tables.write_csv(items, f"{path}/Menu_Items.csv")
    typed, raw = tables.read_table(spark, "Menu_Items", path), tables.read_table(spark, "Menu_Items", path, raw=True)
    both = typed.join(tables.read_table(spark, "Menu_Categories", path), "category_id").join(raw.select("item_id", F.col("launch_date").alias("_day")), "item_id")
    return both.groupBy("category_id", "category_name").agg(F.count("*").alias("n"), F.sum(F.col("base_price").cast("double")).alias("price"), F.count_if("is_active").alias("n_active"), F.min("launch_date").alias("first"), F.max("_day").alias("last"))


CLEANED_TABLE = """SELECT p_brand AS category_id, 'Brand ' || substr(p_brand, 7, 2) AS category_name, count(*) AS n, sum(round(p_retailprice, 2)) AS price, count(*) FILTER (p_size % 10 <> 0) AS n_active, min(DATE '1994-06-01' + (p_partkey % 2600)::INT) AS first,
  strftime(max(DATE '1994-06-01' + (p_partkey % 2600)::INT), '%Y-%m-%d') AS last FROM part GROUP BY 1, 2"""


def stored_model(spark: SparkSession, sf: str) -> DataFrame:
    """A model fitted on order totals, saved, loaded, and held against itself: rows and those that both predict alike."""
    rows = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("target"))
    model = forecast.fit(rows, ["n"], iterations=2, depth=2)
    path = tables.new_folder(spark, "model")
    tables.save_model(model, path)
    said = tables.load_model(path).transform(model.transform(rows).withColumnRenamed("prediction", "first").drop("features"))
    return said.agg(F.count("*").alias("n"), F.count_if(F.col("first") == F.col("prediction")).alias("n_alike"))


STORED_MODEL = "SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) AS n_alike FROM orders"

QUERIES = {
    "cleaned_table": Query(cleaned_table, CLEANED_TABLE, ("price",), 2),
    "stored_model": Query(stored_model, STORED_MODEL),
    "csv_typed": Query(csv_typed, CSV_TYPED, ("total",), 2),
    "csv_raw": Query(csv_raw, CSV_RAW),
    "csv_partitioned": Query(csv_partitioned, CSV_PARTITIONED),
    "inferred_types": Query(inferred_types, INFERRED_TYPES),
    "json_dimension": Query(json_dimension, JSON_DIMENSION),
    "parquet_by_month": Query(parquet_by_month, PARQUET_BY_MONTH, ("quantity",)),
    "snapshots": Query(snapshots, SNAPSHOTS),
    "stored_quarantine": Query(stored_quarantine, STORED_QUARANTINE),
    "rewritten_table": Query(rewritten_table, REWRITTEN_TABLE),
}
