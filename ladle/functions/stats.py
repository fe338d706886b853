"""Statistics as aggregates and small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ladle.functions.ranks import global_rank, running_totals, with_mean_rank_shares


def share_where(condition: Column) -> Column:
    """Share of rows for which a condition holds; rows where it is null count as neither."""
    return F.avg(condition.cast("double"))


def slope(y: Column, x: Column, least: int = 3) -> Column:
    """Least-squares slope of y over x; null with fewer points than least, or if x doesn't vary."""
    return F.when(F.count(y) >= least, F.try_divide(F.covar_pop(y, x), F.var_pop(x)))


def most_frequent(df: DataFrame, keys: list[str], value: str, name: str = "mode") -> DataFrame:
    """The most frequent value per key; in a tie the first in order."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).count()
    return counts.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(value).alias("v"))).alias("best")).select(*keys, F.col("best.v").alias(name))


def share_of_total(value: Column, partition: list[str] = ()) -> Column:
    """A value over its sum; over a table of an entity per row."""
    return F.try_divide(value, F.sum(value).over(Window.partitionBy(*partition)))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def exact_quantiles(df: DataFrame, columns: list[str], points: tuple[float, ...], keys: list[str] = ()) -> DataFrame:
    """(keys, feature, point, value): quantiles of each column per key, interpolated between neighbouring ranks, exactly; nulls don't count.

    Values are counted, all columns' counts are put in one order over range partitions, and their running totals say which values hold the ranks
    wanted: two passes over counts, and no task has all values of a column or key. A column without values has no row."""
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("_value")) for c in columns]))
    long = df.select(*keys, each.alias("_x")).select(*keys, "_x.feature", "_x._value").where("_value is not null")
    groups = [*keys, "feature"]
    counts = long.groupBy(*groups, "_value").agg(F.count("*").alias("_n"))
    placed = running_totals(counts, *[F.col(c).asc_nulls_first() for c in (*groups, "_value")], totals={"_before": "_n"})
    sizes = placed.groupBy(*[F.col(c).alias(f"_of_{c}") for c in groups]).agg(F.min("_before").alias("_first"), F.sum("_n").alias("_rows"))
    met = placed.join(sizes, [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in groups]).withColumn("_before", F.col("_before") - F.col("_first"))
    asked = met.select(*groups, "_value", "_before", "_n", "_rows", F.explode(F.array(*[F.lit(float(p)) for p in points])).alias("point")).withColumn("_at", (F.col("_rows") - 1) * F.col("point"))
    has = lambda rank: (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_n"))
    low, high = F.floor("_at"), F.ceil("_at")
    kept = asked.where(has(low) | has(high)).groupBy(*groups, "point").agg(F.max(F.when(has(low), F.col("_value"))).alias("_low"), F.max(F.when(has(high), F.col("_value"))).alias("_high"), F.first("_at").alias("_at"))
    value = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise(F.col("_low") * (F.ceil("_at") - F.col("_at")) + F.col("_high") * (F.col("_at") - F.floor("_at")))
    return kept.select(*groups, "point", value.alias("value"))


def _at_point(point: float) -> Column:
    return F.max(F.when(F.col("point") == point, F.col("value")))


def upper_fence(df: DataFrame, value: str, k: float = 3.0, exact: bool = True) -> DataFrame:
    """One row with q1, q3 and fence = q3 + k * (q3 - q1). Exact by default; the approximate form keeps sketches only, whose ranks are off by 1 / 10,000 of the rows at most."""
    if exact:
        row = exact_quantiles(df, [value], (0.25, 0.75)).agg(_at_point(0.25).alias("q1"), _at_point(0.75).alias("q3"))
    else:
        row = df.agg(F.percentile_approx(value, F.lit(0.25)).alias("q1"), F.percentile_approx(value, F.lit(0.75)).alias("q3"))
    return row.withColumn("fence", F.col("q3") + k * (F.col("q3") - F.col("q1")))


def medians(df: DataFrame, columns: list[str], keys: list[str] = ()) -> DataFrame:
    """(keys, columns): the median of each column, per key or in one row."""
    return exact_quantiles(df, columns, (0.5,), keys).groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in columns])


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, mean, p25, p50, p75, p90, p99), a row per column."""
    points = (0.25, 0.5, 0.75, 0.9, 0.99)
    wide = df.agg(*[F.avg(c).alias(c) for c in columns])
    means = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("mean")) for c in columns])).alias("x")).select("x.*")
    at = exact_quantiles(df, columns, points).groupBy("feature").agg(*[_at_point(p).alias(f"p{round(100 * p)}") for p in points])
    return means.join(at, "feature", "left")


def distinct_sketches(df: DataFrame, keys: list[str], values: dict[str, str], bits: int = 14) -> DataFrame:
    """(keys, a sketch for each name -> column of values): HyperLogLog sketches of distinct values, of 2 ** bits registers at most.

    They are stored like any column and united to coarser keys without the rows; the relative standard error is about 1.04 / sqrt(2 ** bits), 0.8 % by default."""
    return df.groupBy(*keys).agg(*[F.hll_sketch_agg(F.col(c), bits).alias(name) for name, c in values.items()])


def united_sketches(sketches: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Sketches per coarser key, or in one row without keys."""
    return sketches.groupBy(*keys).agg(*[F.hll_union_agg(name).alias(name) for name in names])


def distinct_estimates(sketches: DataFrame, names: list[str]) -> DataFrame:
    """The sketches' estimates in their place."""
    return sketches.withColumns({name: F.hll_sketch_estimate(name) for name in names})


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the rank correlation of two columns, equal values sharing their mean rank."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(a, b)
    return with_mean_rank_shares(rows, {"_ra": a, "_rb": b}).agg(F.corr("_ra", "_rb").alias("spearman"))


def top_share(df: DataFrame, value: str, key: str, share: float = 0.1) -> DataFrame:
    """One row: which share of the total the top rows by value have. key breaks ties."""
    ranked = global_rank(df.select(value, key), F.col(value).desc(), F.col(key), name="_n", total="_all")
    return ranked.agg(F.try_divide(F.sum(F.when(F.col("_n") <= F.floor(F.col("_all") * share), F.col(value)).otherwise(0.0)), F.sum(value)).alias("top_share"))


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row with the adjusted Rand index of two labellings; null where either has a single class."""
    cells = df.groupBy(a, b).count()

    def pairs(c: Column) -> Column:
        return (c * (c - 1) / 2).cast("double")

    def total(grouped: DataFrame, name: str) -> DataFrame:
        return grouped.agg(F.sum(pairs(F.col("count"))).alias(name))

    rows = cells.groupBy(a).agg(F.sum("count").alias("count"))
    columns = cells.groupBy(b).agg(F.sum("count").alias("count"))
    # one row each
    one = total(cells, "both").join(total(rows, "by_a")).join(total(columns, "by_b")).join(cells.agg(pairs(F.sum("count")).alias("all")))
    expected = F.try_divide(F.col("by_a") * F.col("by_b"), F.col("all"))
    return one.select(F.try_divide(F.col("both") - expected, (F.col("by_a") + F.col("by_b")) / 2 - expected).alias("adjusted_rand"))


def cross_tab(df: DataFrame, a: str, b: str, values: list[str]) -> DataFrame:
    """Counts of a by the given values of b, 0 where there is none."""
    return df.groupBy(a).pivot(b, values).count().fillna(0, values)


# Measures of predictions


def class_counts(df: DataFrame, label: str) -> DataFrame:
    """(label, n, weight): a weight of n_all / (k * n) makes the classes equal."""
    counts = df.groupBy(label).agg(F.count("*").alias("n"))
    # one row
    everything = counts.agg(F.sum("n").alias("_all"), F.count("*").alias("_classes"))
    return counts.join(F.broadcast(everything)).withColumn("weight", F.col("_all") / (F.col("_classes") * F.col("n"))).drop("_all", "_classes")


def with_balanced_weights(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    """Weights 0.5 / p and 0.5 / (1 - p) for labels 1 and 0, p being the share of 1."""
    p = df.agg(F.avg(F.col(label).cast("double")).alias("_p"))
    weight = F.when(F.col(label) == 1, F.try_divide(F.lit(0.5), F.col("_p"))).otherwise(F.try_divide(F.lit(0.5), 1 - F.col("_p")))
    return df.join(F.broadcast(p)).withColumn(name, weight).drop("_p")


def _n_where(condition: Column, weight: str | None) -> Column:
    """How many rows a condition holds for; with weight, rows stand for so many each."""
    return F.coalesce(F.sum(F.when(condition, F.col(weight))), F.lit(0).cast("long")) if weight else F.count_if(condition)


def binary_metrics(df: DataFrame, label: str, prediction: str, weight: str | None = None) -> DataFrame:
    """One row: tp, fp, fn, tn, accuracy, precision, recall, f1. weight: a column that says how many rows a row stands for."""

    def n(actual: int, predicted: int) -> Column:
        return _n_where((F.col(label) == actual) & (F.col(prediction) == predicted), weight)

    counts = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = counts.withColumns({"accuracy": F.try_divide(tp + tn, tp + tn + fp + fn), "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn)})
    return rated.withColumn("f1", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def curve_areas(df: DataFrame, label: str, score: str, weight: str | None = None) -> DataFrame:
    """One row: roc and pr, the areas under the ROC and the precision-recall curve of labels 0 and 1 by a score, exactly; rows without label or score don't count.

    A point for each distinct score, straight lines between them; the precision-recall curve begins at recall 0 with its first point's precision. Rows
    are counted by score, the counts put in order over range partitions, and the areas are sums of the pieces between
    neighbouring points: no curve is gathered anywhere. roc is null without both labels, pr without a 1."""
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull())
    counts = rows.groupBy(F.col(score).cast("double").alias("_score")).agg(_n_where(F.col(label) == 1, weight).alias("_p"), _n_where(F.col(label) != 1, weight).alias("_n"))
    placed = running_totals(counts, F.col("_score").desc(), totals={"_tp": "_p", "_fp": "_n"}, alls={"_pos": "_p", "_neg": "_n"})
    p, n, tp, fp = (F.col(c).cast("double") for c in ("_p", "_n", "_tp", "_fp"))
    after, first = (tp + p) / (tp + p + n + fp), tp + fp == 0
    before = F.when(first, after).otherwise(F.try_divide(tp, tp + fp))
    return placed.agg(F.try_divide(F.sum(n * (tp + p / 2)), F.max("_pos") * F.max("_neg").cast("double")).alias("roc"), F.try_divide(F.sum(p * (before + after) / 2), F.max("_pos").cast("double")).alias("pr"))


def per_class_metrics(df: DataFrame, label: str, prediction: str, keys: list[str] = ()) -> DataFrame:
    """(keys, class, support, predicted, correct, precision, recall, f1) for each class that occurs or is predicted; a class never predicted scores 0.

    The pairs of label and prediction are counted, and each count goes to both of its classes: no join, and no second pass."""
    cells = df.groupBy(*keys, F.col(label).alias("_actual"), F.col(prediction).alias("_guess")).agg(F.count("*").alias("_n"))
    none, right = F.lit(0).cast("long"), F.when(F.col("_actual") == F.col("_guess"), F.col("_n")).otherwise(0)
    sides = F.array(F.struct(F.col("_actual").alias("class"), F.col("_n").alias("support"), none.alias("predicted"), right.alias("correct")), F.struct(F.col("_guess").alias("class"), none.alias("support"), F.col("_n").alias("predicted"), none.alias("correct")))
    both = cells.select(*keys, F.explode(sides).alias("_side")).groupBy(*keys, F.col("_side.class").alias("class")).agg(*[F.sum(f"_side.{c}").alias(c) for c in ("support", "predicted", "correct")])
    rated = both.withColumns({"precision": F.coalesce(F.try_divide("correct", "predicted"), F.lit(0.0)), "recall": F.coalesce(F.try_divide("correct", "support"), F.lit(0.0))})
    return rated.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def class_scores(df: DataFrame, label: str, prediction: str, keys: list[str] = ()) -> DataFrame:
    """Per key, or in one row: accuracy, macro_f1 over the classes that occur, weighted_f1."""
    rated = per_class_metrics(df, label, prediction, keys).where("support > 0")
    return rated.groupBy(*keys).agg((F.sum("correct") / F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"))


def regression_metrics(df: DataFrame, actual: str, predicted: str, keys: list[str] = ()) -> DataFrame:
    """mae, rmse, mape over actuals other than 0, r2 (null if actuals don't vary), n and n_zero, per key or in one row."""
    a, error = F.col(actual), F.col(predicted) - F.col(actual)
    squares = F.sum(error * error)
    return df.groupBy(*keys).agg(
        F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.when(a != 0, F.abs(error / F.nullif(a, F.lit(0.0))))).alias("mape"),
        (1 - F.try_divide(squares, F.var_pop(a) * F.count(a))).alias("r2"), F.count("*").alias("n"), F.count_if(a == 0).alias("n_zero"),
    )
