"""Freight, quality and emissions, each present only where the data supports it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions.numeric import mean_of, money, money_or_zero, percent, ratio, rounded
from lanewise.operators.measures import DATASET, join_datasets, measures, rollup

# Report name of an optional column -> the fact column that shows it is there.
COVERAGE_PROBES = {
    "carrier": "carrier",
    "transport_mode": "transport_mode",
    "service_level": "service_level",
    "category": "category",
    "freight_cost": "freight_cost",
    "weight": "weight_kg",
    "co2": "co2_kg",
    "damage": "damaged",
    "returns": "returned",
    "fill_rate": "quantity_delivered",
}


def operation_measures() -> list[Column]:
    """Additive measures behind the three summaries and the coverage list."""
    carried = F.col("freight_cost").isNotNull()
    weighed = carried & F.col("weight_kg").isNotNull() & (F.col("weight_kg") != 0)
    wrong = (
        F.col("is_late")
        | F.coalesce("damaged", F.lit(False))
        | F.coalesce("returned", F.lit(False))
        | F.coalesce(F.col("fill_rate") < 100.0, F.lit(False))
    )
    return [
        F.sum(F.when(carried, F.col("value"))).alias("carried_value_sum"),
        F.sum(F.when(carried, F.col("quantity").cast("long"))).alias("carried_units"),
        F.sum(F.when(weighed, F.col("weight_kg"))).alias("carried_weight_sum"),
        F.count_if(weighed).alias("weighed_count"),
        F.sum(F.when(F.col("is_late"), F.col("freight_cost"))).alias("late_freight_sum"),
        F.sum("total_cost").alias("landed_sum"),
        F.count("total_cost").alias("landed_count"),
        F.count_if("damaged").alias("damaged_count"),
        F.count_if("returned").alias("returned_count"),
        F.sum(F.col("fill_rate").cast("decimal(28,8)")).alias("fill_sum"),
        F.count("fill_rate").alias("fill_count"),
        F.count_if(~wrong).alias("perfect_count"),
        F.count_if(F.col("damaged").isNotNull() | F.col("returned").isNotNull()).alias(
            "checked_count"
        ),
        *(F.count(column).alias(f"has_{name}") for name, column in COVERAGE_PROBES.items()),
    ]


TOTAL_COLUMNS = tuple(
    "shipment_count late_count value_sum freight_sum freight_count co2_sum co2_count"
    " carried_value_sum carried_units carried_weight_sum weighed_count late_freight_sum"
    " landed_sum landed_count damaged_count returned_count fill_sum fill_count perfect_count"
    " checked_count".split()
) + tuple(f"has_{name}" for name in COVERAGE_PROBES)


def dataset_totals(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return facts.groupBy(*by).agg(*measures(), *operation_measures())


def enough(count: Column, total: Column) -> Column:
    """At least three rows and a fifth of the dataset."""
    return (count >= schema.MIN_ROWS) & (ratio(count, total) * 100.0 >= schema.MIN_COVERAGE_PCT)


def _all() -> Column:
    return F.col("shipment_count")


def has_cost() -> Column:
    return enough(F.col("freight_count"), _all())


def cost_fields() -> dict[str, Column]:
    freight = F.col("freight_sum")
    return {
        "coverage_pct": percent(F.col("freight_count"), _all()),
        "total_freight_cost": money(freight),
        "avg_freight_cost": mean_of(freight, F.col("freight_count")),
        "freight_per_unit": F.when(
            F.col("carried_units") != 0, rounded(ratio(freight, F.col("carried_units")))
        ),
        "freight_per_kg": F.when(
            F.col("weighed_count") > 0, rounded(ratio(freight, F.col("carried_weight_sum")))
        ),
        "freight_pct_of_goods": F.when(
            F.col("carried_value_sum") > 0, percent(freight, F.col("carried_value_sum"))
        ),
        "total_landed_cost": F.when(F.col("landed_count") > 0, money(F.col("landed_sum"))),
        "freight_spent_on_late_shipments": money_or_zero(F.col("late_freight_sum")),
    }


def freight_cost(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Freight economics of the datasets that report enough freight costs."""
    return (
        dataset_totals(facts, by)
        .where(has_cost())
        .select(*by, *(c.alias(n) for n, c in cost_fields().items()))
    )


def has_quality() -> Column:
    return (
        enough(F.col("has_damage"), _all())
        | enough(F.col("has_returns"), _all())
        | enough(F.col("fill_count"), _all())
    )


def quality_fields() -> dict[str, Column]:
    damage, returns = enough(F.col("has_damage"), _all()), enough(F.col("has_returns"), _all())
    return {
        "damage_rate_pct": F.when(damage, percent(F.col("damaged_count"), F.col("has_damage"))),
        "damaged_count": F.when(damage, F.col("damaged_count")),
        "return_rate_pct": F.when(
            returns, percent(F.col("returned_count"), F.col("has_returns"))
        ),
        "returned_count": F.when(returns, F.col("returned_count")),
        "avg_fill_rate_pct": F.when(
            enough(F.col("fill_count"), _all()), mean_of(F.col("fill_sum"), F.col("fill_count"))
        ),
        "perfect_order_rate_pct": percent(F.col("perfect_count"), _all()),
        "coverage_pct": percent(F.col("checked_count"), _all()),
    }


def order_quality(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Damage, returns and fill rate, each only where enough rows report it."""
    return (
        dataset_totals(facts, by)
        .where(has_quality())
        .select(*by, *(c.alias(n) for n, c in quality_fields().items()))
    )


def perfect_order(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Share of shipments with nothing known to be wrong, over all rows."""
    return dataset_totals(facts, by).select(
        *by, percent(F.col("perfect_count"), _all()).alias("perfect_order_rate_pct")
    )


def has_emissions() -> Column:
    return enough(F.col("co2_count"), _all())


def emissions_fields() -> dict[str, Column]:
    return {
        "coverage_pct": percent(F.col("co2_count"), _all()),
        "total_co2_kg": money(F.col("co2_sum")),
        "avg_co2_per_shipment_kg": mean_of(F.col("co2_sum"), F.col("co2_count")),
    }


def emissions(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return (
        dataset_totals(facts, by)
        .where(has_emissions())
        .select(*by, *(c.alias(n) for n, c in emissions_fields().items()))
    )


def emissions_by_mode(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """CO2e per transport mode, for datasets that have an emissions section."""
    return emissions_from(rollup(facts, [*by, "transport_mode"]), by)


def emissions_from(rollup_by_mode: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """``emissions_by_mode`` from a rollup by mode.

    Every mode of a dataset is needed to decide whether it has the section, so
    one rollup by mode, the NULL mode included, serves for both.
    """
    rolled = rollup_by_mode.select(*by, "transport_mode", "shipment_count", "co2_sum", "co2_count")
    totals = rolled.groupBy(*by).agg(
        F.sum("shipment_count").alias("all_count"), F.sum("co2_count").alias("all_co2")
    )
    supported = totals.where(enough(F.col("all_co2"), F.col("all_count")))
    return (
        join_datasets(rolled.where("transport_mode <> '' and co2_count > 0"), supported, by)
        .select(*by, "transport_mode", money(F.col("co2_sum")).alias("co2_kg"))
    )


def covered() -> Column:
    """Names of the optional columns that at least a fifth of the rows fill, as an array."""
    threshold = _all().cast("double") * schema.MIN_COVERAGE_SHARE
    return F.array_compact(
        F.array(
            *(F.when(F.col(f"has_{name}") >= threshold, F.lit(name)) for name in COVERAGE_PROBES)
        )
    )


def coverage(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """One row per dataset and optional column that it carries, in a fixed order."""
    order = F.array(*(F.lit(name) for name in COVERAGE_PROBES))
    return (
        dataset_totals(facts, by)
        .select(*by, F.explode(covered()).alias("dimension"))
        .withColumn("position", F.array_position(order, F.col("dimension")).cast("int"))
    )
