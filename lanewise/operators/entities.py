"""Vendors and origin countries: scores, shares and concentration."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions.labels import risk_level
from lanewise.functions.numeric import (
    clamp,
    mean_of,
    money,
    money_or_zero,
    percent,
    ratio,
    rounded,
)
from lanewise.operators.measures import DATASET, join_datasets, rollup

# Worst first; the label settles ties.
VENDOR_ORDER = ("health_score", "-value_at_risk", "vendor")
COUNTRY_ORDER = ("-risk_score", "-total_value", "country")


def order_columns(order: Sequence[str]) -> list[Column]:
    return [F.col(c[1:]).desc() if c.startswith("-") else F.col(c).asc() for c in order]


def health_score(late_pct: Column, avg_delay: Column, avg_lead_time: Column) -> Column:
    """100 is best. Reads the already rounded figures that are shown."""
    weights = schema.HEALTH_WEIGHTS
    return rounded(
        (
            clamp(1.0 - late_pct / 100.0) * weights["punctuality"]
            + clamp(1.0 - avg_delay / schema.DELAY_CAP_DAYS) * weights["delay_severity"]
            + clamp(1.0 - avg_lead_time / schema.LEAD_TIME_CAP_DAYS) * weights["lead_time"]
        )
        * 100.0
    )


def vendor_fields() -> dict[str, Column]:
    """Shown figures of one vendor, over the measures of a rollup."""
    late_pct = percent(F.col("late_count"), F.col("shipment_count"))
    avg_delay = mean_of(F.col("delay_sum"), F.col("shipment_count"))
    avg_lead = mean_of(F.col("lead_sum"), F.col("lead_count"))
    health = health_score(late_pct, avg_delay, avg_lead)
    return {
        "shipment_count": F.col("shipment_count"),
        "late_count": F.col("late_count"),
        "late_pct": late_pct,
        "avg_delay_days": avg_delay,
        "avg_lead_time_days": avg_lead,
        "total_value": money(F.col("value_sum")),
        "value_at_risk": money_or_zero(F.col("risk_value_sum")),
        "health_score": health,
        "risk_level": risk_level(100 - health),
    }


def score_vendors(rolled: DataFrame, by: Sequence[str], min_shipments: int = 1) -> DataFrame:
    """Scores from a rollup that carries a ``vendor`` column."""
    shown = rolled.where(F.col("shipment_count") >= min_shipments)
    return shown.select(*by, "vendor", *(c.alias(n) for n, c in vendor_fields().items()))


VENDOR_COLUMNS = (
    "vendor shipment_count late_count late_pct avg_delay_days avg_lead_time_days total_value"
    " value_at_risk health_score risk_level"
).split()


def vendor_health(
    facts: DataFrame, by: Sequence[str] = DATASET, min_shipments: int = 1
) -> DataFrame:
    """Vendor scores. ``VENDOR_ORDER`` ranks them, worst first."""
    return score_vendors(rollup(facts, [*by, "vendor"]), by, min_shipments)


def country_fields() -> dict[str, Column]:
    """Shown figures of one origin country, over the measures of a rollup."""
    weights = schema.COUNTRY_WEIGHTS
    late_pct = percent(F.col("late_count"), F.col("shipment_count"))
    avg_delay = mean_of(F.col("delay_sum"), F.col("shipment_count"))
    severity = clamp(avg_delay / schema.DELAY_CAP_DAYS)
    score = rounded(
        (late_pct / 100.0 * weights["late_rate"] + severity * weights["delay_severity"]) * 100.0
    )
    return {
        "shipment_count": F.col("shipment_count"),
        "late_count": F.col("late_count"),
        "late_pct": late_pct,
        "avg_delay_days": avg_delay,
        "total_value": money(F.col("value_sum")),
        "risk_score": score,
        "risk_level": risk_level(score),
    }


def score_countries(rolled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Scores from a rollup that carries a ``country`` column."""
    return rolled.select(*by, "country", *(c.alias(n) for n, c in country_fields().items()))


COUNTRY_COLUMNS = (
    "country shipment_count late_count late_pct avg_delay_days total_value risk_score risk_level"
).split()


def country_risk(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Origin-country scores. ``COUNTRY_ORDER`` ranks them, worst first."""
    rolled = rollup(facts, [*by, "origin_country"]).withColumnRenamed("origin_country", "country")
    return score_countries(rolled, by)


def _totals(rolled: DataFrame, by: Sequence[str]) -> DataFrame:
    return rolled.groupBy(*by).agg(
        F.sum("shipment_count").alias("all_shipments"), F.sum("value_sum").alias("all_value")
    )


def vendor_shares(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Share of spend per vendor; of shipments where nothing is priced.

    Dataset totals are joined back rather than taken from a window, which would
    gather every vendor of a dataset in one task.
    """
    rolled = rollup(facts, [*by, "vendor"]).select(*by, "vendor", "shipment_count", "value_sum")
    both = join_datasets(rolled, _totals(rolled, by), by)
    share = F.when(
        F.col("all_value") > 0, ratio(F.col("value_sum"), F.col("all_value"))
    ).otherwise(ratio(F.col("shipment_count"), F.col("all_shipments")))
    return both.select(*by, "vendor", share.alias("share"))


def country_shares(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Share of shipments per origin country."""
    rolled = (
        rollup(facts, [*by, "origin_country"])
        .withColumnRenamed("origin_country", "country")
        .select(*by, "country", "shipment_count", "value_sum")
    )
    both = join_datasets(rolled, _totals(rolled, by), by)
    return both.select(
        *by, "country", ratio(F.col("shipment_count"), F.col("all_shipments")).alias("share")
    )


def country_exposure(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Each country's percentage of all shipments, next to its risk."""
    rolled = rollup(facts, [*by, "origin_country"]).withColumnRenamed("origin_country", "country")
    both = join_datasets(score_countries(rolled, by), _totals(rolled, by), by)
    return both.select(
        *by,
        "country",
        "risk_score",
        "risk_level",
        percent(F.col("shipment_count"), F.col("all_shipments")).alias("share_pct"),
    )


def herfindahl(share: Column) -> Column:
    """Sum of squared normalised shares as an aggregate; 0 without positive shares."""
    total = F.sum(share)
    return F.when(total > 0, F.sum(share * share) / (total * total)).otherwise(0.0)


def concentration_measures() -> list[Column]:
    """Distinct counts and concentration, aggregated from a (by, section, label) rollup.

    The index is computed from plain sums, so no total has to be known first.
    """
    vendor, country = F.col("section") == "vendors", F.col("section") == "countries"
    spend = F.when(vendor, F.col("value_sum").cast("double"))
    vendor_rows = F.when(vendor, F.col("shipment_count").cast("double"))
    country_rows = F.when(country, F.col("shipment_count").cast("double"))
    return [
        F.count_if(vendor).alias("distinct_vendors"),
        F.count_if(country).alias("distinct_countries"),
        F.when(F.sum(spend) > 0, herfindahl(spend))
        .otherwise(herfindahl(vendor_rows))
        .alias("vendor_concentration"),
        herfindahl(country_rows).alias("country_concentration"),
    ]


def concentration_from(rolled: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return rolled.groupBy(*by).agg(*concentration_measures())


def vendor_rollup(shipments: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Unrounded aggregates per vendor, shipments without a vendor included."""
    return shipments.groupBy(*by, "vendor").agg(
        F.count(F.lit(1)).alias("shipment_count"),
        F.count_if(F.col("delay_days") > 0).alias("late_count"),
        F.avg("delay_days").alias("avg_delay_days"),
        F.avg("lead_time_days").alias("avg_lead_time_days"),
    )


def distinct_vendors(shipments: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return shipments.where("vendor <> ''").select(*by, "vendor").distinct()
