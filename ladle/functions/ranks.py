"""Ranks, percentiles and tiers.

A window over a whole table runs in one task. Nothing here does: rows, or counts of their values, are range-partitioned, and running
totals of the partitions are added to those within.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.sources.tables import checkpoint_dir

LOW, HIGH = 0.33, 0.67


def tier(percentile: Column, low: float = LOW, high: float = HIGH) -> Column:
    """Low under low, High over high, else Medium; null stays null."""
    return F.when(percentile < low, "Low").when(percentile > high, "High").when(percentile.isNotNull(), "Medium")


def with_percent_ranks(df: DataFrame, keys: list[str], ranks: dict[str, tuple[str, Column]], partition: list[str] = ()) -> DataFrame:
    """Adds percent_rank of values among the rows of a population, null outside of it. ranks: name of the new column -> (value, population).

    keys tell rows apart. Rows are ranked within each partition; equal values share their least rank, nulls come first, and one row alone has 0.
    The values of all ranks are counted and the counts put in one order over range partitions, whose running totals give the ranks: no task sees a
    whole partition, however large. The rows are written once to the checkpoint folder; only keys and values are shuffled for the ranks."""
    checkpoint_dir(df.sparkSession)
    rows = df.checkpoint()
    asked = F.array(*[F.struct(F.lit(name).alias("_name"), F.coalesce(population, F.lit(False)).alias("_in"), F.col(value).cast("double").alias("_value")) for name, (value, population) in ranks.items()])
    parts = [F.col(c).alias(f"_part_of_{k}") for k, c in enumerate(partition)]
    names = [f"_part_of_{k}" for k in range(len(partition))]
    long = rows.select(*keys, *[p for p in parts], F.explode(asked).alias("_r")).where("_r._in").select(*keys, *names, "_r._name", "_r._value")
    groups = ["_name", *names]
    counts = long.groupBy(*groups, "_value").agg(F.count("*").alias("_n"))
    placed = global_rank(counts, *[F.col(c).asc_nulls_first() for c in (*groups, "_value")], name="_before", weight="_n")
    # where a group begins in the order of all, and how many rows it has
    sizes = placed.groupBy(*[F.col(c).alias(f"_of{c}") for c in groups]).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_rows"))

    def same(columns: list[str], other: str) -> list[Column]:
        return [F.col(c).eqNullSafe(F.col(f"{other}{c}")) for c in columns]

    ranked = placed.join(sizes, same(groups, "_of")).select(*[F.col(c).alias(f"_by{c}") for c in (*groups, "_value")], F.try_divide(F.col("_before") - F.col("_first"), F.col("_rows") - 1).alias("_rank"))
    found = long.join(ranked, same([*groups, "_value"], "_by")).select(*keys, "_name", F.coalesce("_rank", F.lit(0.0)).alias("_rank"))
    wide = found.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_rank"))).alias(name) for name in ranks])
    return rows.join(wide, keys, "left")


def with_percent_ranks_within(df: DataFrame, partition: list[str], ranks: dict[str, tuple[str, Column]]) -> DataFrame:
    """As ``with_percent_ranks``, for partitions of a bounded number of rows (a location has a row for an item at most) of which there are many.

    Rows are dealt out once by partition, and each rank is a sort of what a task has, which spills if it must; nothing is written, and columns that nobody reads are left out."""
    out = df.repartition(*partition)
    for k, (name, (value, population)) in enumerate(ranks.items()):
        out = out.withColumn(f"_in_{k}", F.coalesce(population, F.lit(False)))
        order = Window.partitionBy(*partition, f"_in_{k}").orderBy(F.col(value).cast("double").asc_nulls_first())
        out = out.withColumn(name, F.when(F.col(f"_in_{k}"), F.percent_rank().over(order))).drop(f"_in_{k}")
    return out


def with_ntile(df: DataFrame, value: str, key: str, name: str, n: int = 5, descending: bool = False) -> DataFrame:
    """Adds ntile in the order of value, nulls first; the key, which is unique, breaks ties, so that reruns agree."""
    order = F.col(value).desc_nulls_first() if descending else F.col(value).asc_nulls_first()
    rank, size, rest = F.col("_rank"), F.floor(F.col("_total") / n), F.col("_total") % n
    # the first buckets have a row more than the others
    wide = rest * (size + 1)
    bucket = F.when(rank <= wide, F.ceil(rank / (size + 1))).otherwise(rest + F.ceil((rank - wide) / F.nullif(size, F.lit(0))))
    return global_rank(df, order, F.col(key), name="_rank", total="_total").withColumn(name, bucket.cast("int")).drop("_rank", "_total")


def with_mean_rank_shares(df: DataFrame, shares: dict[str, str]) -> DataFrame:
    """Adds rank over the number of rows, where equal values share the mean of their ranks. shares: name of the new column -> value.

    Values are counted first, so that a frequent one is a row like others when values are put in order; the counts' running
    totals are joined back to the rows, which are written once."""
    checkpoint_dir(df.sparkSession)
    out = rows = df.checkpoint()
    for name, value in shares.items():
        counts = rows.groupBy(F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
        placed = global_rank(counts, F.col("_value").asc_nulls_first(), name="_before", total="_total", weight="_n")
        share = (F.col("_before") + (F.col("_n") + 1) / 2) / F.col("_total")
        out = out.join(placed.select("_value", share.alias(name)), F.col(value).eqNullSafe(F.col("_value")), "left").drop("_value")
    return out


def tertile(share: Column) -> Column:
    return F.when(share.isNull(), None).when(share <= 1 / 3, 1).when(share <= 2 / 3, 2).otherwise(3)


def with_priority(df: DataFrame, impact: str, name: str = "priority", critical: float = 0.10, high: float = 0.20, medium: float = 0.40) -> DataFrame:
    """Adds a bucket by descending rank over the number of rows; the shares are those of the buckets, in turn. Equal impacts share their least rank, nulls come last.

    Impacts are counted and the counts put in order, as in ``with_percent_ranks``."""
    checkpoint_dir(df.sparkSession)
    rows = df.checkpoint()
    counts = rows.groupBy(F.col(impact).alias("_value")).agg(F.count("*").alias("_n"))
    placed = global_rank(counts, F.col("_value").desc_nulls_last(), name="_before", total="_total", weight="_n")
    share, slack = (F.col("_before") + 1) / F.col("_total"), 1e-12
    bucket = F.when(share <= critical + slack, "Critical").when(share <= critical + high + slack, "High").when(share <= critical + high + medium + slack, "Medium").otherwise("Low")
    return rows.join(placed.select("_value", bucket.alias(name)), F.col(impact).eqNullSafe(F.col("_value")), "left").drop("_value")


def first_of(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row for each key, the first in order; the order should have no ties."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_nth = 1").drop("_nth")


def global_rank(df: DataFrame, *order: Column, name: str = "rank", staging: str | None = None, total: str | None = None, weight: str | None = None) -> DataFrame:
    """Adds each row's number, from 1, in the order of all rows, without a task that sees them all; as total, if named, the number of all rows.

    With weight, adds the sum of that column over the rows before instead, and its sum over all rows.
    Rows are range-partitioned and sorted; sums of the partitions before, one row each, are added to those
    within. The sorted rows are written to staging (or the checkpoint folder), so that both steps see one partitioning."""
    if weight:
        return running_totals(df, *order, totals={name: weight}, alls={total: weight} if total else {}, staging=staging)
    numbered = running_totals(df.withColumn("_one", F.lit(1).cast("long")), *order, totals={name: "_one"}, alls={total: "_one"} if total else {}, staging=staging)
    return numbered.withColumn(name, F.col(name) + 1).drop("_one")


def running_totals(df: DataFrame, *order: Column, totals: dict[str, str], alls: dict[str, str] = {}, staging: str | None = None) -> DataFrame:  # noqa: B006
    """Adds sums of columns over the rows before each row in the order of all rows (totals: name of the new column -> column), and over all rows (alls)."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_id"))
    if staging:
        sorted_.write.mode("overwrite").parquet(staging)
        sorted_ = df.sparkSession.read.parquet(staging)
    else:
        checkpoint_dir(df.sparkSession)
        sorted_ = sorted_.checkpoint()
    earlier = (Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(*earlier)
    # a row for each partition
    parts = sorted_.groupBy("_part").agg(*[F.sum(c).alias(f"_sum_{k}") for k, c in enumerate(totals.values())], *[F.sum(c).alias(f"_whole_{k}") for k, c in enumerate(alls.values())])
    over = Window.orderBy("_part").rowsBetween(*earlier)
    before = parts.select("_part", *[F.coalesce(F.sum(f"_sum_{k}").over(over), F.lit(0)).alias(f"_start_{k}") for k in range(len(totals))], *[F.sum(f"_whole_{k}").over(Window.partitionBy()).alias(f"_all_{k}") for k in range(len(alls))])
    placed = sorted_.withColumns({f"_within_{k}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for k, c in enumerate(totals.values())}).join(F.broadcast(before), "_part")
    return placed.select(*df.columns, *[(F.col(f"_start_{k}") + F.col(f"_within_{k}")).alias(name) for k, name in enumerate(totals)], *[F.col(f"_all_{k}").alias(name) for k, name in enumerate(alls)])
