"""Menu classification, its flags, and how consistent it is over locations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.functions.ranks import tier, with_percent_ranks, with_percent_ranks_within


@dataclass(frozen=True)
class Limits:
    low: float = 0.33
    high: float = 0.67
    new_item_days: int = 90
    waste_floor: float = 0.05
    promo_dependent: float = 0.50
    weekend_skewed: float = 0.55
    high_rating: float = 4.3
    low_rating: float = 3.0
    least_locations: int = 3
    mismatch: float = 0.25


METRICS = {"profit": "profit_percentage", "demand": "total_quantity_sold", "quality": "quality_score", "wastage": "wastage_percentage"}


def quality_score() -> Column:
    """Mean of rating / 5 and the repeat rate; the one that exists if the other is null."""
    rating, repeat = F.col("average_rating") / 5, F.col("repeat_purchase_rate")
    return F.coalesce((rating + repeat) / 2, rating, repeat)


def classify(df: DataFrame, limits: Limits = Limits(), partition: list[str] = ()) -> DataFrame:
    """Adds quality_score, a percentile and a tier for each metric, excessive_wastage and category.

    Percentiles rank items that have sold and aren't new and have the metric, in each partition; other items have none. Rules, in order: new:
    Insufficient History; unsold: Low Performer; high demand and profit without excessive waste: Profit Driver; high
    demand: Volume Driver; high profit or quality: Hidden Opportunity; else Low Performer."""
    new = F.coalesce(F.col("days_since_launch") < limits.new_item_days, F.lit(False))
    sold = F.coalesce(F.col("total_quantity_sold") > 0, F.lit(False))
    df = df.withColumns({"quality_score": quality_score(), "_in": sold & ~new})
    ranks = {f"{name}_percentile": (column, F.col("_in") & F.col(column).isNotNull()) for name, column in METRICS.items()}
    df = with_percent_ranks_within(df, list(partition), ranks) if partition else with_percent_ranks(df, ["item_id"], ranks)
    df = df.withColumns({f"{name}_tier": tier(F.col(f"{name}_percentile"), limits.low, limits.high) for name in METRICS})
    excessive = F.coalesce((F.col("wastage_tier") == "High") & (F.col("wastage_percentage") > limits.waste_floor), F.lit(False))
    demand, profit, quality = (F.col(f"{x}_tier") == "High" for x in ("demand", "profit", "quality"))
    category = (
        F.when(new, "Insufficient History").when(~sold, "Low Performer").when(demand & profit & ~F.col("excessive_wastage"), "Profit Driver")
        .when(demand, "Volume Driver").when(profit | quality, "Hidden Opportunity").otherwise("Low Performer")
    )
    return df.withColumn("excessive_wastage", excessive).withColumn("category", category).drop("_in")


def with_flags(df: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Adds eight flags to classified items; what can't be told is false."""
    flags = {
        "loss_making": F.col("contribution_margin") < 0,
        "rarely_purchased_high_margin": (F.col("demand_tier") == "Low") & (F.col("profit_tier") == "High"),
        "high_rating_low_profit": (F.col("average_rating") >= limits.high_rating) & (F.col("profit_tier") == "Low"),
        "low_rating_high_sales": (F.col("average_rating") <= limits.low_rating) & (F.col("demand_tier") == "High"),
        "promotion_dependent": F.col("promotion_dependency") > limits.promo_dependent,
        "weekend_skewed": F.col("weekend_order_ratio") > limits.weekend_skewed,
        "seasonal_item": F.col("is_seasonal"),
        "insufficient_history": F.col("category") == "Insufficient History",
    }
    return df.withColumns({name: F.coalesce(condition, F.lit(False)) for name, condition in flags.items()})


def location_consistency(chain: DataFrame, by_location: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(item_id, n_locations, location_categories, mismatch_share, inconsistent): how often an item's category at a location differs from its chain category.

    Under limits.least_locations share and categories are null and inconsistent is false; else it needs a share of limits.mismatch."""
    known = by_location.select("item_id", "location_id", F.col("category").alias("local"))
    both = known.join(chain.select("item_id", F.col("category").alias("overall")), "item_id")
    rows = both.groupBy("item_id").agg(
        F.count("*").alias("n_locations"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("location_id", "local")))).alias("location_categories"), F.avg((F.col("local") != F.col("overall")).cast("double")).alias("mismatch_share")
    )
    enough = F.col("n_locations") >= limits.least_locations
    rows = rows.withColumns({c: F.when(enough, F.col(c)) for c in ("location_categories", "mismatch_share")})
    return rows.withColumn("inconsistent", F.coalesce(F.col("mismatch_share") >= limits.mismatch, F.lit(False)))


def chain_classification(items: DataFrame, item_features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Active items classified and flagged, by the whole chain."""
    active = items.where("is_active").select("item_id", "is_seasonal")
    return with_flags(classify(item_features.drop("is_seasonal").join(active, "item_id"), limits), limits)


def local_classification(items: DataFrame, item_features: DataFrame, item_location_features: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Active items classified by location. Their ages are those of item_features."""
    ages = item_features.select("item_id", "days_since_launch")
    return classify(item_location_features.join(ages, "item_id").join(items.where("is_active").select("item_id"), "item_id"), limits, ["location_id"])


def with_consistency(chain: DataFrame, local: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Classified items compared over locations."""
    return chain.join(location_consistency(chain, local, limits), "item_id", "left").fillna(False, ["inconsistent"])


def classification(items: DataFrame, item_features: DataFrame, item_location_features: DataFrame, limits: Limits = Limits()) -> tuple[DataFrame, DataFrame]:
    """(active items classified, flagged and compared over locations; items classified by location)."""
    local = local_classification(items, item_features, item_location_features, limits)
    return with_consistency(chain_classification(items, item_features, limits), local, limits), local


def category_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("category").agg(F.count("*").alias("n_items"), F.sum("total_revenue").alias("revenue"))


def driver_shares(classified: DataFrame, category: str = "Low Performer") -> DataFrame:
    """One row: the shares of a category's items with low demand, profit and quality, and with excessive waste."""
    rows = classified.where(F.col("category") == category)
    return rows.agg(F.count("*").alias("n_items"), *[F.avg(F.coalesce(F.col(f"{x}_tier") == "Low", F.lit(False)).cast("double")).alias(f"low_{x}") for x in ("demand", "profit", "quality")], F.avg(F.col("excessive_wastage").cast("double")).alias("excessive_wastage"))
