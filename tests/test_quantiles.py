"""Exact quantiles, sketches of distinct counts, and rules of itemsets, against Spark's own aggregates and plain loops."""

from itertools import combinations

import pytest
from pyspark.sql import functions as F

from ladle.functions import stats
from ladle.operators import basket

POINTS = (0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0)


@pytest.mark.parametrize("rows", [0, 1, 2, 3, 4_001])
def test_quantiles_equal_percentile(spark, rows):
    """Ties, nulls, a key that is null and one with most rows."""
    df = spark.range(rows).select("id", F.when(F.col("id") % 7 != 0, F.col("id") * 31 % 50).alias("a"), (F.col("id") * 7919 % 4_001 / 3).alias("b"), F.when(F.col("id") % 5 != 0, F.lit("most")).when(F.col("id") % 3 == 0, "few").alias("k"))
    for keys in ([], ["k"]):
        found = {(*[r[c] for c in keys], r["feature"], r["point"]): r["value"] for r in stats.exact_quantiles(df, ["a", "b"], POINTS, keys).collect()}
        expected = {}
        for r in df.groupBy(*keys).agg(*[F.percentile(c, F.array(*map(F.lit, POINTS))).alias(c) for c in ("a", "b")]).collect():
            for c in ("a", "b"):
                expected |= {(*[r[k] for k in keys], c, p): v for p, v in zip(POINTS, r[c] or [])}
        assert found.keys() == expected.keys() and all(found[k] == pytest.approx(expected[k]) for k in found)


def test_quantiles_of_a_million_distinct_values(spark):
    df = spark.range(1_000_000).select(((F.col("id") * 7_368_787) % 1_000_000 / 7.0).alias("v"))
    row = stats.upper_fence(df, "v", 1.5).first()
    assert (row["q1"], row["q3"]) == (pytest.approx(999_999 * 0.25 / 7), pytest.approx(999_999 * 0.75 / 7))
    near = stats.upper_fence(df, "v", 1.5, exact=False).first()
    assert near["q1"] == pytest.approx(row["q1"], rel=1e-3) and near["fence"] == pytest.approx(row["fence"], rel=1e-3)
    assert stats.summary(df, ["v"]).first()["p99"] == pytest.approx(999_999 * 0.99 / 7)


def test_sketches_unite_without_the_rows(spark):
    df = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") % 7).alias("place"), F.pmod(F.xxhash64("id"), F.lit(20_000)).alias("customer"))
    fine = stats.distinct_sketches(df, ["day", "place"], {"customers": "customer"})
    for keys in (["place"], []):
        guess = stats.distinct_estimates(stats.united_sketches(fine, keys, ["customers"]), ["customers"]).collect()
        exact = {tuple(r[k] for k in keys): r["n"] for r in df.groupBy(*keys).agg(F.countDistinct("customer").alias("n")).collect()}
        assert len(guess) == len(exact) and all(r["customers"] == pytest.approx(exact[tuple(r[k] for k in keys)], rel=0.04) for r in guess)


def test_rules_of_larger_sets_equal_counting(spark):
    baskets = [["a", "b", "c", "d"]] * 5 + [["a", "b", "c"]] * 3 + [["a", "b"]] * 4 + [["b", "d"]] * 2 + [["e"]] * 6 + [[]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "order_id int, items array<string>")
    found = basket.rules_of(basket.mine(df, 0.1, 0.1).freqItemsets, df.agg(F.count("*").cast("double").alias("total")), 0.5)
    count = lambda s: sum(set(s) <= set(b) for b in baskets)
    expected = set()
    for size in (2, 3, 4):
        for s in combinations("abcde", size):
            if count(s) >= 0.1 * len(baskets):
                for c in s:
                    rest = [x for x in s if x != c]
                    if count(s) / count(rest) >= 0.5:
                        expected.add((tuple(rest), c, count(s), round(count(s) / count(rest), 9), round(count(s) * len(baskets) / count(rest) / count([c]), 9)))
    assert {(tuple(r["antecedent"]), r["consequent"], r["n"], round(r["confidence"], 9), round(r["lift"], 9)) for r in found.collect()} == expected
    assert max(len(e[0]) for e in expected) == 3


def test_frequent_sets_equal_counting(spark):
    baskets = [["a", "b", "c", "d"]] * 3 + [["a", "b", "c"]] * 2 + [["a", "c", "e"]] * 2 + [["a", "d", "e"]] + [["f"]] * 2 + [[]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(baskets)], "order_id int, items array<string>")
    for least in (1, 3, 6, 99):
        found = {tuple(r["items"]): r["freq"] for r in basket.frequent_sets(df, least).collect()}
        counted = {s: sum(set(s) <= set(b) for b in baskets) for size in range(1, 6) for s in combinations("abcdef", size)}
        assert found == {s: n for s, n in counted.items() if n >= least}
