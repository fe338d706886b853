"""Demand forecasting: the daily grid, the training table, the model, and its errors at several levels."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions.scalar import day_number, with_calendar
from ladle.functions.stats import medians, regression_metrics
from ladle.operators.integration import lagged

KEYS = ["item_id", "location_id"]
LAGS, ROLLS = (1, 7, 14), (7, 14)
INPUTS = [*[f"lag_{n}" for n in LAGS], *[f"mean_{n}" for n in ROLLS], "dow", "month", "is_weekend", "on_promo", "is_seasonal", "price"]
#: The recent level is the mean of the longest window.
RECENT = f"mean_{max(ROLLS)}"
#: Series are dealt out in partitions of so many days.
PARTITION_DAYS = 500_000
LEVELS = {"item_location": ["item_id", "location_id"], "item": ["item_id"], "category": ["category_id"], "location": ["location_id"], "overall": []}


def daily_quantity(grid: DataFrame, lines: DataFrame) -> DataFrame:
    """The grid of (item_id, location_id, day) with qty, 0 on a day without a sale."""
    sold = lines.groupBy(*KEYS, F.col("ts").cast("date").alias("day")).agg(F.sum("quantity").alias("qty"))
    return grid.select(*KEYS, "day").distinct().join(sold, [*KEYS, "day"], "left").fillna(0, ["qty"])


def daily_series(lines: DataFrame) -> DataFrame:
    """(item_id, location_id, day, qty) with a row for each day from a series' first to its last, qty being 0 on a day without a line.

    A day with lines is followed by the empty days up to the next one, so that no grid is made, joined or shuffled: the days with lines are dealt out
    by series, in as many partitions as the days to be made need, and everything that goes on by series stays there. Keys that are null have no quantity."""
    sold = lines.groupBy(*KEYS, F.col("ts").cast("date").alias("day")).agg(F.sum("quantity").alias("qty")).where("day is not null")
    spans = sold.groupBy(*KEYS).agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("_n"))
    n_days = spans.agg(F.sum("_n")).first()[0] or 0
    dealt = sold.repartition(max(1, -(-n_days // PARTITION_DAYS)), *KEYS)
    then = dealt.withColumn("_next", F.lead("day").over(Window.partitionBy(*KEYS).orderBy("day")))
    days = then.select(*KEYS, F.col("day").alias("_sold"), "qty", F.explode(F.sequence("day", F.coalesce(F.date_sub("_next", 1), "day"))).alias("_day"))
    counts = (F.col("_day") == F.col("_sold")) & F.col(KEYS[0]).isNotNull() & F.col(KEYS[1]).isNotNull()
    return days.select(*KEYS, F.col("_day").alias("day"), F.when(counts & F.col("qty").isNotNull(), F.col("qty")).otherwise(0).alias("qty"))


def _complete_mean(days: int) -> Column:
    """Mean of the last days up to the row's own; null unless each of them has a row."""
    window = Window.partitionBy(*KEYS).orderBy(day_number(F.col("day"))).rangeBetween(-(days - 1), 0)
    return F.when(F.count("qty").over(window) == days, F.avg("qty").over(window))


def _ahead(days: int) -> Column:
    window = Window.partitionBy(*KEYS).orderBy(day_number(F.col("day"))).rangeBetween(days, days)
    return F.max("qty").over(window)


def baseline_days(horizon: int) -> int:
    """How many days before the target the same weekday lies that is known at the origin."""
    return 7 * -(-horizon // 7)


def training_table(daily: DataFrame, horizon: int = 7) -> DataFrame:
    """Rows with whole history: lags and means as of the day before the origin, target and its day, baseline.

    An origin is a day; lag_k is the quantity k days before it, means end on the day before it, the target lies horizon - 1 days
    after it, and the baseline is the same weekday as the target's. One window per item and place; no self-join."""
    shifted = daily.withColumn("qty", F.col("qty").cast("double"))
    table = shifted.withColumns({f"lag_{n}": lagged("qty", KEYS, "day", n) for n in LAGS})
    before = table.withColumns({f"_m{n}": _complete_mean(n) for n in ROLLS})
    before = before.withColumns({f"mean_{n}": lagged(f"_m{n}", KEYS, "day", 1) for n in ROLLS})
    back = baseline_days(horizon) - (horizon - 1)
    full = before.withColumns({"target": _ahead(horizon - 1), "target_day": F.date_add("day", horizon - 1), "baseline": lagged("qty", KEYS, "day", back)})
    needed = [*[f"lag_{n}" for n in LAGS], *[f"mean_{n}" for n in ROLLS], "target", "baseline"]
    return full.drop(*[f"_m{n}" for n in ROLLS]).dropna(subset=needed)


def with_covariates(table: DataFrame, promo_days: DataFrame, prices: DataFrame, items: DataFrame) -> DataFrame:
    """Adds calendar, promotion and price of the target day, and whether the item is seasonal. promo_days and prices: item_id, location_id, day, and price; items: item_id, is_seasonal."""
    dated = with_calendar(table, "target_day")
    promo = promo_days.select(*KEYS, F.col("day").alias("target_day")).distinct().withColumn("on_promo", F.lit(1))
    priced = prices.select(*KEYS, F.col("day").alias("target_day"), "price")
    seasonal = items.select("item_id", F.col("is_seasonal").cast("int").alias("is_seasonal"))
    return dated.join(promo, [*KEYS, "target_day"], "left").join(priced, [*KEYS, "target_day"], "left").join(seasonal, "item_id", "left").fillna(0, ["on_promo", "is_seasonal"])


def chronological_split(table: DataFrame, test_days: int = 45) -> DataFrame:
    """Adds is_test: the target is one of the last test_days days."""
    last = table.agg(F.max("target_day").alias("_last"))
    return table.join(F.broadcast(last)).withColumn("is_test", F.col("target_day") > F.date_sub("_last", test_days)).drop("_last")


def fit(train: DataFrame, inputs: list[str] = INPUTS, iterations: int = 40, depth: int = 6, step: float = 0.1, subsample: float = 0.8, seed: int = 42) -> PipelineModel:
    stages = [VectorAssembler(inputCols=inputs, outputCol="features", handleInvalid="keep"), GBTRegressor(labelCol="target", featuresCol="features", maxIter=iterations, maxDepth=depth, stepSize=step, subsamplingRate=subsample, seed=seed)]
    return Pipeline(stages=stages).fit(train)


_SUMS = ("forecast", "target", "baseline", "recent_average")


def _clipped(predicted: DataFrame) -> DataFrame:
    """Negative forecasts count as 0."""
    return predicted.withColumns({"forecast": F.greatest(F.col("prediction"), F.lit(0.0)), "recent_average": F.col(RECENT)})


def roll_up(predicted: DataFrame, level: str) -> DataFrame:
    """Forecast, target, baseline and recent level per key of the level and target day."""
    return _clipped(predicted).groupBy(*LEVELS[level], "target_day").agg(*[F.sum(c).alias(c) for c in _SUMS])


def roll_up_levels(predicted: DataFrame) -> DataFrame:
    """(level, keys, target_day, forecast, target, baseline, recent_average) at all five levels, from one pass of grouping sets; keys that a level lacks are null."""
    keys = list(dict.fromkeys(k for level in LEVELS.values() for k in level))
    columns = [F.col(k) for k in (*keys, "target_day")]
    sets = [[F.col(k) for k in (*level, "target_day")] for level in LEVELS.values()]
    sums = _clipped(predicted).groupingSets(sets, *columns).agg(*[F.sum(c).alias(c) for c in _SUMS], *[F.grouping(k).alias(f"_no_{k}") for k in keys])
    has = {name: [F.col(f"_no_{k}") == (k not in level) * 1 for k in keys] for name, level in LEVELS.items()}
    level = F.coalesce(*[F.when(reduce(lambda a, b: a & b, own), F.lit(name)) for name, own in has.items()])
    return sums.select(level.alias("level"), *keys, "target_day", *_SUMS)


def level_metrics(predicted: DataFrame) -> DataFrame:
    """Errors of model and baseline at each level: (level, model, mae, rmse, mape, r2, n, n_zero). One roll-up of all levels, one aggregate of all errors."""
    both = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("said")) for m in ("forecast", "baseline")]))
    rows = roll_up_levels(predicted).select("level", "target", both.alias("_m")).select("level", "target", "_m.model", "_m.said")
    return regression_metrics(rows, "target", "said", ["level", "model"])


def errors_by_volume(predicted: DataFrame, actual: str = "target", forecast: str = "forecast", baseline: str = "baseline", edges: tuple[int, ...] = (5, 20, 50)) -> DataFrame:
    """(bucket, n, model_ape, baseline_ape, over_share) of rows with volume, by their actual volume, and a row of bucket "all" with the medians.

    over_share: how often the forecast exceeds the actual volume."""
    a = F.col(actual)
    bucket = F.lit(f"{edges[-1] + 1}+")
    for low, high in reversed(list(zip((0, *edges), edges))):
        bucket = F.when(a <= high, f"{low + 1}-{high}").otherwise(bucket)
    rows = predicted.where(a > 0).withColumns({"bucket": bucket, "_model": F.abs(F.col(forecast) - a) / a, "_baseline": F.abs(F.col(baseline) - a) / a, "_over": (F.col(forecast) > a).cast("double")})
    buckets = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.avg("_model").alias("model_ape"), F.avg("_baseline").alias("baseline_ape"), F.avg("_over").alias("over_share"))
    whole = rows.agg(F.lit("all").alias("bucket"), F.count("*").alias("n"), F.avg("_over").alias("over_share")).join(medians(rows, ["_model", "_baseline"]))
    return buckets.union(whole.where("n > 0").select("bucket", "n", F.col("_model").alias("model_ape"), F.col("_baseline").alias("baseline_ape"), "over_share"))


def high_demand_days(item_days: DataFrame, rise: float = 1.25) -> DataFrame:
    """(target_day, n_items, extra): days on which items are forecast at so many times their recent level."""
    high = item_days.where(F.col("forecast") >= rise * F.col("recent_average"))
    return high.groupBy("target_day").agg(F.count("*").alias("n_items"), F.sum(F.col("forecast") - F.col("recent_average")).alias("extra"))


def predict(model: PipelineModel, rows: DataFrame, kept: list[str]) -> DataFrame:
    """The columns kept and the prediction, as they are stored for everything that reads forecasts."""
    return model.transform(rows).select(*kept, "prediction")


def importances(model: PipelineModel, inputs: list[str], df: DataFrame) -> DataFrame:
    """(feature, importance) of the last stage, a row per input."""
    found = model.stages[-1].featureImportances.toArray().tolist()
    return df.sparkSession.createDataFrame(list(zip(inputs, found)), "feature string, importance double")
