"""Wastage: the daily grain of sales and waste, rates by any key, and the table of the risk model."""

from __future__ import annotations

from datetime import date

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions.scalar import day_number, safe_div, with_calendar
from ladle.functions.stats import binary_metrics, curve_areas, with_balanced_weights
from ladle.operators.integration import fused, with_coverage
from ladle.sources.tables import checkpoint_dir

KEYS = ["item_id", "location_id", "day"]


def daily_grain(lines: DataFrame, waste: DataFrame, promotions: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """A row per item, location and day with a sale or waste: quantity, revenue, cogs, waste_cost, and promo if promotions, their items and their locations are given.

    promo is 1 where a promotion covers the item there on the day, whether it sold or not."""
    sold = lines.groupBy("item_id", "location_id", F.col("ts").cast("date").alias("day")).agg(F.sum("quantity").alias("quantity"), F.sum("revenue").alias("revenue"), F.sum("cost").alias("cogs"))
    wasted = waste.groupBy(*KEYS).agg(F.sum("waste_cost").alias("waste_cost"))
    daily = fused(sold, wasted, KEYS, ["quantity", "revenue", "cogs", "waste_cost"])
    return with_coverage(daily, *promotions) if promotions else daily


def wastage_by(daily: DataFrame, keys: list[str]) -> DataFrame:
    """Waste cost, cost of goods and their rate, waste / (waste + cost), per key."""
    sums = daily.groupBy(*keys).agg(F.sum("waste_cost").alias("waste_cost"), F.sum("cogs").alias("cogs"))
    return sums.withColumn("wastage_rate", safe_div(F.col("waste_cost"), F.col("waste_cost") + F.col("cogs")))


def wastage_levels(daily: DataFrame, levels: list[str]) -> DataFrame:
    """(level, value, waste_cost, cogs, wastage_rate) for several single-column levels in one pass of grouping sets."""
    sums = daily.groupingSets([[F.col(c)] for c in levels], *[F.col(c) for c in levels]).agg(F.sum("waste_cost").alias("waste_cost"), F.sum("cogs").alias("cogs"), *[F.grouping(c).alias(f"_g_{c}") for c in levels])
    level = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.lit(c)) for c in levels])
    value = F.coalesce(*[F.when(F.col(f"_g_{c}") == 0, F.col(c).cast("string")) for c in levels])
    return sums.select(level.alias("level"), value.alias("value"), "waste_cost", "cogs", safe_div(F.col("waste_cost"), F.col("waste_cost") + F.col("cogs")).alias("wastage_rate"))


def best_and_worst(rates: DataFrame, n: int = 5, value: str = "wastage_rate", key: str = "value") -> DataFrame:
    """The n largest and n smallest, marked; two top-k queries."""
    worst = rates.orderBy(F.col(value).desc_nulls_last(), key).limit(n).withColumn("end", F.lit("worst"))
    best = rates.orderBy(F.col(value).asc_nulls_last(), key).limit(n).withColumn("end", F.lit("best"))
    return worst.unionByName(best)


def risk_table(stock: DataFrame, waste: DataFrame, promotions: tuple[DataFrame, DataFrame, DataFrame], popularity: DataFrame, lookback: int = 7, threshold: float = 0.10) -> DataFrame:
    """A row per item, location and day on which something was prepared: label, recent demand, ratio of preparation to it, promo_active, item_popularity, calendar.

    stock: KEYS, prepared, consumed. waste: KEYS, wasted. promotions: they, their items and their locations. popularity: item_id, item_popularity. label: more than threshold of what was prepared is
    wasted. recent_demand: mean consumption of the lookback days before, without the day itself; -1 where there is no history, and so
    is prep_ratio where nothing was consumed."""
    wasted = waste.groupBy(*KEYS).agg(F.sum("wasted").alias("wasted"))
    prepared = stock.where("prepared > 0").join(wasted, KEYS, "left")
    joined = with_coverage(prepared, *promotions, name="promo_active").join(popularity, "item_id", "left").fillna(0, ["wasted", "item_popularity"])
    before = Window.partitionBy("item_id", "location_id").orderBy(day_number(F.col("day"))).rangeBetween(-lookback, -1)
    rated = joined.withColumn("recent_demand", F.avg("consumed").over(before))
    rated = rated.withColumns({"waste_share": safe_div(F.col("wasted"), F.col("prepared")), "prep_ratio": F.when(F.col("recent_demand") > 0, safe_div(F.col("prepared"), F.col("recent_demand")))})
    labelled = rated.withColumn("label", F.coalesce(F.col("waste_share") > threshold, F.lit(False)).cast("int")).fillna(-1, ["recent_demand", "prep_ratio"])
    return with_calendar(labelled, "day")


def fit_risk(train: DataFrame, numeric: list[str], categories: list[str], ordered: list[str] = (), trees: int = 50, depth: int = 8, seed: int = 42) -> PipelineModel:
    """A weighted random forest for the label.

    categories have a few values each and are split by any subset of them; ordered ones (locations) may have any number, and are numbered
    by how often they occur and split by that number, so that the forest's histograms don't grow with them."""
    indexers = [StringIndexer(inputCol=c, outputCol=f"{c}_index", handleInvalid="keep") for c in (*categories, *ordered)]
    # a plain number, where the index would be taken for a category of so many values
    plain = SQLTransformer(statement=f"SELECT *{''.join(f', {c}_index + 0.0 AS {c}_number' for c in ordered)} FROM __THIS__")
    assembler = VectorAssembler(inputCols=[*numeric, *[f"{c}_index" for c in categories], *[f"{c}_number" for c in ordered]], outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed, maxBins=64)
    return Pipeline(stages=[*indexers, plain, assembler, forest]).fit(with_balanced_weights(train, "label"))


def risk_scored(model: PipelineModel, test: DataFrame) -> DataFrame:
    """Test rows with prediction and risk, the chance of waste."""
    return model.transform(test).withColumn("risk", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "features")


def risk_metrics(scored: DataFrame, label: str = "label", prediction: str = "prediction", risk: str = "risk") -> DataFrame:
    """One row: n, positive_rate, tp, fp, fn, tn, accuracy, precision, recall, f1, roc, pr.

    Rows are counted by label, prediction and risk, and the counts written once: whatever scored is made from is not made for each measure."""
    checkpoint_dir(scored.sparkSession)
    cells = scored.groupBy(label, prediction, F.col(risk).cast("double").alias(risk)).agg(F.count("*").alias("_rows")).checkpoint()
    counts = binary_metrics(cells, label, prediction, "_rows")
    n = sum((F.col(c) for c in ("tp", "fp", "fn", "tn")), F.lit(0))
    return counts.select(n.alias("n"), F.try_divide(F.col("tp") + F.col("fn"), n).alias("positive_rate"), "*").join(F.broadcast(curve_areas(cells, label, risk, "_rows")))


def split_by_day(df: DataFrame, test_from: date) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("day") < F.lit(test_from)), df.where(F.col("day") >= F.lit(test_from))


def watch_list(scored: DataFrame, least_share: float = 0.5) -> DataFrame:
    """(item_id, location_id, n_days, risk_share, wasted): pairs that are predicted to waste on so many of their days."""
    rows = scored.groupBy("item_id", "location_id").agg(F.count("*").alias("n_days"), F.avg(F.col("prediction").cast("double")).alias("risk_share"), F.sum("wasted").alias("wasted"))
    return rows.where(F.col("risk_share") >= least_share)
