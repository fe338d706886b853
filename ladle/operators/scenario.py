"""What-if scenarios for every item at once.

A baseline row: item_id, price, unit_cost, quantity, wastage_pct, discount_pct, promotion_dependency,
elasticity, promo_margin_effect, period_days, forecast_daily_demand.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ladle.functions.scalar import safe_div

# Elasticities of price classes, of items without one, and the cap.
CLASS_ELASTICITY = {"High": -1.5, "Moderate": -0.7, "Low": -0.2}
DEFAULT_ELASTICITY, MOST_ELASTIC = -0.7, 3.0
MEASURES = ("revenue", "contribution_margin", "demand", "wastage_units", "wastage_cost", "wastage_pct", "profitability", "net_margin_after_wastage")


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def waste_units() -> Column:
    w = F.col("wastage_pct")
    return F.when(w < 1, _or_zero(safe_div(F.col("quantity") * w, 1 - w))).otherwise(0.0)


def metrics(price: Column, unit_cost: Column, quantity: Column, waste: Column, revenue: Column | None = None, margin: Column | None = None) -> Column:
    """A struct of MEASURES."""
    revenue = price * quantity if revenue is None else revenue
    margin = (price - unit_cost) * quantity if margin is None else margin
    cost = waste * unit_cost
    values = (revenue, margin, quantity, waste, cost, _or_zero(safe_div(waste, waste + quantity)), _or_zero(safe_div(margin, revenue)), margin - cost)
    return F.struct(*[v.alias(n) for n, v in zip(MEASURES, values)])


def baseline_metrics() -> Column:
    return metrics(F.col("price"), F.col("unit_cost"), F.col("quantity"), waste_units())


def price_change(pct: Column) -> Column:
    """Demand follows the elasticity, not below 0; waste keeps its share."""
    q = F.greatest(F.lit(0.0), F.col("quantity") * (1 + F.col("elasticity") * pct))
    return metrics(F.col("price") * (1 + pct), F.col("unit_cost"), q, waste_units() * _or_zero(safe_div(q, F.col("quantity"))))


def discount_change(discount: Column) -> Column:
    """A price change from the present discount to another."""
    return price_change(safe_div(1 - discount, 1 - F.col("discount_pct")) - 1)


def promotion_frequency(factor: Column) -> Column:
    """Promoted sales scale by factor; the extra revenue earns the margin rate of promotions."""
    extra = F.col("promotion_dependency") * (factor - 1)
    revenue, margin = F.col("price") * F.col("quantity"), (F.col("price") - F.col("unit_cost")) * F.col("quantity")
    rate = _or_zero(safe_div(margin, revenue)) + F.col("promo_margin_effect")
    return metrics(F.col("price"), F.col("unit_cost"), F.col("quantity") * (1 + extra), waste_units() * (1 + extra), revenue * (1 + extra), margin + revenue * extra * rate)


def remove_item() -> Column:
    return metrics(F.col("price"), F.col("unit_cost"), F.lit(0.0), F.lit(0.0))


def _cut(pct: Column) -> tuple[Column, Column]:
    prepared = F.col("quantity") + waste_units()
    return prepared, prepared * pct


def reduce_prep(pct: Column) -> Column:
    """The cut comes out of waste first, then out of sales."""
    _, cut = _cut(pct)
    lost = F.greatest(F.lit(0.0), cut - waste_units())
    return metrics(F.col("price"), F.col("unit_cost"), F.col("quantity") - lost, F.greatest(F.lit(0.0), waste_units() - cut))


def demand_change(pct: Column) -> Column:
    scale = F.greatest(F.lit(0.0), 1 + pct)
    return metrics(F.col("price"), F.col("unit_cost"), F.col("quantity") * scale, waste_units() * scale)


def wastage_assumption(share: Column) -> Column:
    return metrics(F.col("price"), F.col("unit_cost"), F.col("quantity"), _or_zero(safe_div(F.col("quantity") * share, 1 - share)))


SCENARIOS = {
    "price_change": price_change, "discount_change": discount_change, "promotion_frequency": promotion_frequency, "remove_item": lambda _: remove_item(),
    "reduce_prep": reduce_prep, "demand_change": demand_change, "wastage_assumption": wastage_assumption,
}


def flags(scenario: Column, value: Column) -> Column:
    """What a scenario's result should be read with."""
    prepared, cut = _cut(value)
    cases = [
        ((scenario == "price_change") & (F.col("quantity") * (1 + F.col("elasticity") * value) <= 0), "demand falls to zero"),
        ((scenario == "promotion_frequency") & (F.col("promotion_dependency") == 0), "no promoted revenue"),
        ((scenario == "reduce_prep") & (cut > waste_units()), "stock-out: the cut exceeds waste"),
        ((scenario == "reduce_prep") & (safe_div(prepared * (1 - value), F.col("period_days")) < F.col("forecast_daily_demand")), "stock-out risk: below forecast demand"),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(t)) for c, t in cases]), lambda x: x.isNotNull())


def simulate(baseline: DataFrame, scenarios: list[tuple[str, float | None]]) -> DataFrame:
    """(item_id, scenario, value, the measures, their changes, flags): every item under every scenario. The scenarios are a short list."""
    grid = F.explode(F.array(*[F.struct(F.lit(name).alias("scenario"), F.lit(value).cast("double").alias("value")) for name, value in scenarios]))
    rows = baseline.withColumn("_s", grid).withColumns({"scenario": F.col("_s.scenario"), "value": F.col("_s.value")}).drop("_s")
    result = None
    for name in dict.fromkeys(n for n, _ in scenarios):
        made = SCENARIOS[name](F.col("value"))
        result = F.when(F.col("scenario") == name, made) if result is None else result.when(F.col("scenario") == name, made)
    both = rows.select("item_id", "scenario", "value", result.alias("after"), baseline_metrics().alias("before"), flags(F.col("scenario"), F.col("value")).alias("flags"))
    return both.select("item_id", "scenario", "value", *[f"after.{m}" for m in MEASURES], *[(F.col(f"after.{m}") - F.col(f"before.{m}")).alias(f"{m}_change") for m in MEASURES], "flags")


def baseline_rows(items: DataFrame, sensitivity: DataFrame, promotions: DataFrame, forecast: DataFrame, as_of: date) -> DataFrame:
    """Baselines from item features, sensitivity classes, compared promotions, and item-day forecasts.

    A measured elasticity counts if it is negative and its class is one that has a default; it is capped. Others take DEFAULT_ELASTICITY.
    period_days: from the later of launch and 1 January to as_of, both included. promo_margin_effect: the median change of the margin rate from before to during a promotion."""
    effect = promotions.where("pre_margin_pct is not null and during_margin_pct is not null").agg(F.coalesce(F.percentile(F.col("during_margin_pct") - F.col("pre_margin_pct"), F.lit(0.5)), F.lit(0.0)).alias("promo_margin_effect"))
    expected = forecast.groupBy("item_id").agg(F.avg("forecast").alias("forecast_daily_demand"))
    rows = items.join(sensitivity.select("item_id", "elasticity", "sensitivity"), "item_id", "left").join(expected, "item_id", "left").join(F.broadcast(effect))
    measured = F.col("sensitivity").isin(*CLASS_ELASTICITY) & (F.col("elasticity") < 0)
    sold = F.col("total_quantity_sold")
    return rows.select(
        "item_id", _or_zero(safe_div(F.col("total_revenue"), sold)).alias("price"), _or_zero(safe_div(F.col("total_cost"), sold)).alias("unit_cost"), sold.alias("quantity"), _or_zero(F.col("wastage_percentage")).alias("wastage_pct"), _or_zero(F.col("discount_rate")).alias("discount_pct"),
        _or_zero(F.col("promotion_dependency")).alias("promotion_dependency"), F.when(measured, F.greatest(F.lit(-MOST_ELASTIC), F.col("elasticity"))).otherwise(DEFAULT_ELASTICITY).alias("elasticity"), "promo_margin_effect",
        (F.least(F.col("days_since_launch"), F.lit((as_of - date(as_of.year, 1, 1)).days)) + 1).alias("period_days"), "forecast_daily_demand",
    )
