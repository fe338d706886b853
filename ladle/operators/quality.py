"""Data-quality checks. Each makes rows of one issue table; a table is read once for all its column checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = ("table_name", "column_name", "rule", "n_rows", "table_rows", "pct", "note")


def issue_rows(df: DataFrame, table: str, checks: list[tuple[str, str, Column]], notes: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """An issue row for each (column, rule, condition): how many rows of df meet the condition. One pass."""
    counts = df.agg(F.count("*").alias("n"), *[F.count_if(F.coalesce(condition, F.lit(False))).alias(f"c{i}") for i, (_, _, condition) in enumerate(checks)])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(rule).alias("rule"), F.col(f"c{i}").alias("n_rows"), F.lit(notes.get(rule, "")).alias("note")) for i, (c, rule, _) in enumerate(checks)]
    long = counts.select("n", F.explode(F.array(*rows)).alias("x"))
    return long.select(F.lit(table).alias("table_name"), "x.column_name", "x.rule", "x.n_rows", F.col("n").alias("table_rows"), F.round(F.try_divide(100 * F.col("x.n_rows"), F.col("n")), 4).alias("pct"), "x.note")


def issues(*tables: DataFrame, only_found: bool = False) -> DataFrame:
    """One issue table of several; only_found leaves out rules that no row breaks."""
    all_ = reduce(DataFrame.unionByName, tables)
    return all_.where("n_rows > 0") if only_found else all_


def missing(columns: list[str]) -> list[tuple[str, str, Column]]:
    return [(c, "missing_value", F.col(c).isNull()) for c in columns]


def not_positive(columns: list[str], rule: str = "invalid_price") -> list[tuple[str, str, Column]]:
    return [(c, rule, F.col(c) <= 0) for c in columns]


def negative(columns: list[str], rule: str = "negative_quantity") -> list[tuple[str, str, Column]]:
    return [(c, rule, F.col(c) < 0) for c in columns]


def outside(column: str, low, high, rule: str) -> list[tuple[str, str, Column]]:
    """Values outside of [low, high]; nulls are not judged."""
    return [(column, rule, (F.col(column) < F.lit(low)) | (F.col(column) > F.lit(high)))]


def exceeds(column: str, other: str, rule: str) -> list[tuple[str, str, Column]]:
    return [(column, rule, F.col(column) > F.col(other))]


def not_among(column: str, allowed: tuple[str, ...], rule: str) -> list[tuple[str, str, Column]]:
    return [(column, rule, ~F.col(column).isin(*allowed))]


def duplicates(df: DataFrame, table: str, keys: list[str], rule: str) -> DataFrame:
    """Rows beyond one for each key, as an issue row; null keys are keys like others."""
    counts = df.groupBy(*keys).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("n_rows"), F.coalesce(F.sum("count"), F.lit(0)).alias("table_rows"))
    return counts.select(F.lit(table).alias("table_name"), F.lit("+".join(keys)).alias("column_name"), F.lit(rule).alias("rule"), "n_rows", "table_rows", F.round(F.try_divide(100 * F.col("n_rows"), F.col("table_rows")), 4).alias("pct"), F.lit("").alias("note"))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of the child whose column is set and has no parent."""
    keys = parent.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    return child.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def orphan_issues(tables: dict[str, DataFrame], references: tuple[tuple[str, str, str, str], ...], rules: dict[tuple[str, str], str] = {}) -> DataFrame:  # noqa: B006
    """An issue row for each (child, column, parent, key) reference; rules names some otherwise than orphan_foreign_key."""

    def count(child: str, column: str, parent: str, key: str) -> DataFrame:
        keys = tables[parent].select(F.col(key).alias("_key")).where("_key is not null").distinct().withColumn("_known", F.lit(True))
        marked = tables[child].select(F.col(column).alias("_value")).join(keys, F.col("_value") == F.col("_key"), "left")
        return issue_rows(marked, child, [(column, rules.get((child, column), "orphan_foreign_key"), F.col("_value").isNotNull() & F.col("_known").isNull())])

    return issues(*[count(*r) for r in references])


def unparsed(typed: DataFrame, raw: DataFrame, keys: list[str]) -> DataFrame:
    """(column_name, blank, unparseable) of each column but the keys: nulls of the typed twin that are blank in the raw one, and those that are not.

    The twins are two readings of one file, with unique keys; they are joined once."""
    columns = [c for c in typed.columns if c not in keys]
    both = raw.select(*[F.col(k).cast("string").alias(k) for k in keys], *[F.col(c).alias(f"raw_{c}") for c in columns]).join(typed.select(*[F.col(k).cast("string").alias(k) for k in keys], *columns), keys)

    def blank(c: str) -> Column:
        return F.coalesce(F.trim(F.col(f"raw_{c}")) == "", F.lit(True))

    counts = both.agg(*[F.struct(F.count_if(blank(c)).alias("b"), F.count_if(~blank(c) & F.col(c).isNull()).alias("u")).alias(c) for c in columns])
    rows = counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"{c}.b").alias("blank"), F.col(f"{c}.u").alias("unparseable")) for c in columns])).alias("x"))
    return rows.select("x.*")


def impossible_waste(waste: DataFrame, stock: DataFrame, keys: list[str], wasted: str, prepared: str, consumed: str, table: str = "Wastage") -> DataFrame:
    """An issue row: waste of more than was prepared and not consumed, where both tables have the key."""
    both = waste.join(stock.select(*keys, prepared, consumed), keys)
    return issue_rows(both, table, [(wasted, "impossible_wastage_quantity", F.col(wasted) > F.col(prepared) - F.col(consumed))])


def reconcile(injected: DataFrame, found: DataFrame, aliases: dict[str, str] = {}) -> DataFrame:  # noqa: B006
    """(table_name, rule, injected, found, gap) of both sides' (table_name, rule, n_rows); aliases maps names of rules found to those injected."""
    named = found.replace(aliases, subset=["rule"]) if aliases else found
    left = injected.groupBy("table_name", "rule").agg(F.sum("n_rows").alias("injected"))
    right = named.groupBy("table_name", "rule").agg(F.sum("n_rows").alias("found"))
    return left.join(right, ["table_name", "rule"], "full").fillna(0, ["injected", "found"]).withColumn("gap", F.col("found") - F.col("injected"))
