"""Customer segmentation: RFM scores, clusters and their labels, rules, and the agreement of two results."""

from __future__ import annotations


from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.functions.ranks import first_of, tertile, with_mean_rank_shares, with_ntile
from ladle.functions.scalar import held_out
from ladle.functions.stats import medians, share_of_total

R, FREQ, M = "customer_recency", "customer_frequency", "customer_monetary_value"
INPUTS = [R, "log_frequency", "log_monetary", "promo_order_share", "tenure_days"]
#: Labels of clusters, each for the cluster that is extreme in a measure and has no label yet: (label, measure, largest).
LABELS = (("High-Value Loyal", M, True), ("Promotion-Driven", "promo_order_share", True), ("At-Risk", R, True), ("New", "tenure_days", False), ("Frequent", FREQ, True))
OTHER = "Occasional"


def rfm_scores(df: DataFrame, key: str = "customer_id") -> DataFrame:
    """Adds r_score, f_score, m_score from 1 to 5 (5 is best), rfm_code and rfm_score, their sum."""
    scored = with_ntile(with_ntile(with_ntile(df, R, key, "r_score", descending=True), FREQ, key, "f_score"), M, key, "m_score")
    return scored.withColumns({"rfm_code": F.concat_ws("", "r_score", "f_score", "m_score"), "rfm_score": F.col("r_score") + F.col("f_score") + F.col("m_score")})


def with_cluster_inputs(df: DataFrame) -> DataFrame:
    return df.withColumns({"log_frequency": F.log1p(F.col(FREQ).cast("double")), "log_monetary": F.log1p(F.greatest(F.col(M), F.lit(0.0)))})


def fit_clusters(train: DataFrame, k: int = 6, seed: int = 42, inputs: list[str] = INPUTS) -> PipelineModel:
    stages = [VectorAssembler(inputCols=inputs, outputCol="features"), StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True), KMeans(k=k, seed=seed, featuresCol="scaled", predictionCol="cluster")]
    return Pipeline(stages=stages).fit(train)


def with_distances(df: DataFrame, centers: list[list[float]], features: str = "scaled") -> DataFrame:
    """Adds the distance to the own center (the nearest), and margin: how much farther the second nearest is."""
    x = vector_to_array(features)
    distances = F.array(*[F.sqrt(F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)) for c in centers])
    return df.withColumn("_d", F.array_sort(distances)).withColumns({"distance": F.get("_d", F.lit(0)), "margin": F.get("_d", F.lit(1)) - F.get("_d", F.lit(0))}).drop("_d")


def cluster_profiles(df: DataFrame, cluster: str = "cluster") -> DataFrame:
    return df.groupBy(cluster).agg(F.count("*").alias("n_customers"), *[F.avg(c).alias(c) for c in (R, FREQ, M, "promo_order_share", "tenure_days")])


def label_clusters(profiles: DataFrame, promo_share: float = 0.4) -> dict[int, str]:
    """A label for each cluster from the table of profiles, a row per cluster: rows are few by the choice of k.

    Promotion-Driven is given only if the share exceeds promo_share. What is left is Occasional."""
    rows = [r.asDict() for r in profiles.orderBy("cluster").collect()]
    labels: dict[int, str] = {}
    for label, measure, largest in LABELS:
        free = [r for r in rows if r["cluster"] not in labels]
        if not free:
            break
        best = (max if largest else min)(free, key=lambda r: r[measure])
        if label != "Promotion-Driven" or best[measure] > promo_share:
            labels[best["cluster"]] = label
    return {r["cluster"]: labels.get(r["cluster"], OTHER) for r in rows}


def segment(customers: DataFrame, k: int = 6, seed: int = 42, holdout: int = 5, promo_share: float = 0.4) -> DataFrame:
    """Customers with cluster, segment, distance and margin. The clusters are fitted on customers that aren't held out."""
    marked = with_cluster_inputs(customers).withColumn("held_out", held_out(F.col("customer_id"), holdout)).fillna(0, INPUTS)
    model = fit_clusters(marked.where("not held_out"), k, seed)
    assigned = model.transform(marked)
    labels = label_clusters(cluster_profiles(assigned.where("not held_out")), promo_share)
    name = F.element_at(F.create_map(*[F.lit(x) for pair in labels.items() for x in pair]), F.col("cluster"))
    centers = [c.tolist() for c in model.stages[-1].clusterCenters()]
    return with_distances(assigned.withColumn("segment", name), centers).drop("features", "scaled")


def rule_segments(df: DataFrame, new_days: int = 90, new_orders: int = 2, promo_share: float = 0.5) -> DataFrame:
    """Adds tertiles r, f, m (3 is best) and rule_segment by the first rule that fits."""
    # a low recency is good: its tertile counts from the other end
    shares = with_mean_rank_shares(df, {"_r": R, "_f": FREQ, "_m": M})
    scored = shares.withColumns({"r": 4 - tertile(F.col("_r")), "f": tertile(F.col("_f")), "m": tertile(F.col("_m"))}).drop("_r", "_f", "_m")
    rule = (
        F.when((F.col("r") == 3) & (F.col("f") == 3) & (F.col("m") == 3), "High-Value Loyal").when((F.col("signup_days") <= new_days) & (F.col(FREQ) <= new_orders), "New")
        .when((F.col("r") == 1) & (F.col("f") >= 2), "At-Risk").when(F.col("promo_order_share") >= promo_share, "Promotion-Driven").when(F.col("f") == 3, "Frequent").otherwise(OTHER)
    )
    return scored.withColumn("rule_segment", rule)


def majority_label(df: DataFrame, cluster: str, label: str) -> DataFrame:
    """(cluster, label): the most frequent label of a cluster, in a tie the first by name."""
    counts = df.groupBy(cluster, label).agg(F.count("*").alias("_n"))
    return first_of(counts, [cluster], F.col("_n").desc(), F.col(label)).select(cluster, label)


# Comparing two results for the same ids


def consistency(actual: Column, first: Column, second: Column, names: tuple[str, str] = ("Spark", "Python")) -> Column:
    a, b = first.eqNullSafe(actual), second.eqNullSafe(actual)
    return F.when(a & b, "Both correct").when(a, f"{names[0]} correct").when(b, f"{names[1]} correct").when(first.eqNullSafe(second), "Both wrong").otherwise("Inconsistent, both wrong")


def compared(actual: DataFrame, first: DataFrame, second: DataFrame, key: str, label: str) -> DataFrame:
    """(key, actual, first, second, match, status) for the keys that all three have."""
    rows = actual.select(key, F.col(label).alias("actual")).join(first.select(key, F.col(label).alias("first")), key).join(second.select(key, F.col(label).alias("second")), key)
    return rows.withColumns({"match": F.col("first").eqNullSafe(F.col("second")), "status": consistency(F.col("actual"), F.col("first"), F.col("second"))})


def agreement(rows: DataFrame, by: str | None = None) -> DataFrame:
    """n, and the shares of rows on which the results agree with each other and with the truth; overall or per class."""

    def share(c: Column) -> Column:
        return F.avg(c.cast("double"))

    return rows.groupBy(*([by] if by else [])).agg(F.count("*").alias("n"), share(F.col("match")).alias("agreement"), share(F.col("first").eqNullSafe(F.col("actual"))).alias("first_accuracy"), share(F.col("second").eqNullSafe(F.col("actual"))).alias("second_accuracy"))


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count("*").alias("n"))


def feature_parity(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column_name, null_mismatches, max_abs_diff, max_rel_diff) of two feature tables, in one pass over their join."""
    both = first.select(key, *[F.col(c).alias(f"a_{c}") for c in columns]).join(second.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]), key)

    def measures(c: str) -> Column:
        a, b = F.col(f"a_{c}").cast("double"), F.col(f"b_{c}").cast("double")
        gap = F.abs(a - b)
        relative = F.when(gap == 0, 0.0).otherwise(F.try_divide(gap, F.greatest(F.abs(a), F.abs(b))))
        return F.struct(F.lit(c).alias("column_name"), F.count_if(a.isNull() != b.isNull()).alias("null_mismatches"), F.max(gap).alias("max_abs_diff"), F.max(relative).alias("max_rel_diff"))

    return both.agg(F.array(*[measures(c) for c in columns]).alias("rows")).select(F.explode("rows").alias("x")).select("x.*")


def cutoff_distance(df: DataFrame, percentiles: list[str], cutoffs: tuple[float, ...] = (0.33, 0.67)) -> DataFrame:
    """Adds nearest_cutoff: how close any of the percentiles is to a cut-off."""
    return df.withColumn("nearest_cutoff", F.array_min(F.array(*[F.abs(F.col(p) - c) for p in percentiles for c in cutoffs])))


def set_differences(first: DataFrame, second: DataFrame, key: str, split: str | None = None) -> DataFrame:
    """One row: ids only in the first, only in the second, in both, and in both with another split."""
    a = first.select(key, *([F.col(split).alias("_a")] if split else [F.lit(0).alias("_a")])).withColumn("_in_a", F.lit(True))
    b = second.select(key, *([F.col(split).alias("_b")] if split else [F.lit(0).alias("_b")])).withColumn("_in_b", F.lit(True))
    both = a.join(b, key, "full")
    inside = F.col("_in_a").isNotNull() & F.col("_in_b").isNotNull()
    return both.agg(F.count_if(F.col("_in_b").isNull()).alias("only_first"), F.count_if(F.col("_in_a").isNull()).alias("only_second"), F.count_if(inside).alias("in_both"), F.count_if(inside & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("other_split"))


def landing(df: DataFrame, actual: str, value: str, predicted: str) -> DataFrame:
    """(predicted, n, share): where the rows of one actual label ended up."""
    counts = df.where(F.col(actual) == value).groupBy(predicted).agg(F.count("*").alias("n"))
    return counts.withColumn("share", share_of_total(F.col("n")))


def margins_by_agreement(df: DataFrame, match: str = "match", margin: str = "margin") -> DataFrame:
    """(match, n, median_margin)."""
    middle = medians(df, [margin], [match]).select(F.col(match).alias("_match"), F.col(margin).alias("median_margin"))
    return df.groupBy(match).agg(F.count("*").alias("n")).join(middle, F.col(match).eqNullSafe(F.col("_match")), "left").drop("_match")
