"""Headline figures of a dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.functions.labels import exposure_band, late_band, success_band
from lanewise.functions.numeric import mean_of, money_or_zero, percent, rounded
from lanewise.operators.measures import DATASET, join_datasets, measures


def delay_histogram(facts: DataFrame, by: Sequence[str] = DATASET, *extra: Column) -> DataFrame:
    """One row per dataset and number of days late.

    Everything about a whole dataset is computed from these few rows. The first
    pass stays a plain hash aggregate in generated code, is combined on the map
    side, and splits a dominating dataset by its delays instead of sending it
    to one task. Its size is the number of distinct whole-day delays.
    """
    return facts.groupBy(*by, "delay_days").agg(*measures(), *extra)


def _exact_percentile(p: float) -> Column:
    """Linear interpolation between the two nearest ranks, 0 without rows."""
    value = F.percentile("delay_days", F.lit(p), F.col("shipment_count"))
    return rounded(F.coalesce(value, F.lit(0.0)))


def percentiles_from(histogram: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return histogram.groupBy(*by).agg(
        _exact_percentile(0.5).alias("median_delay_days"),
        _exact_percentile(0.9).alias("p90_delay_days"),
    )


def delay_percentiles(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return percentiles_from(delay_histogram(facts, by), by)


def headline_from(histogram: DataFrame, by: Sequence[str] = DATASET, *extra: Column) -> DataFrame:
    """All headline figures but the distinct counts, plus ``extra`` aggregates."""
    total = F.sum("shipment_count")
    late = F.sum("late_count")
    late_delay = F.sum(F.when(F.col("delay_days") > 0, F.col("delay_sum")))
    return histogram.groupBy(*by).agg(
        F.coalesce(total, F.lit(0)).alias("total_shipments"),
        F.coalesce(late, F.lit(0)).alias("late_shipments"),
        percent(late, total).alias("late_shipment_pct"),
        mean_of(F.sum("delay_sum"), total).alias("avg_delay_days"),
        mean_of(late_delay, late).alias("avg_delay_days_when_late"),
        _exact_percentile(0.5).alias("median_delay_days"),
        _exact_percentile(0.9).alias("p90_delay_days"),
        mean_of(F.sum("lead_sum"), F.sum("lead_count")).alias("avg_lead_time_days"),
        percent(F.sum("success_count"), total).alias("delivery_success_rate"),
        money_or_zero(F.sum("value_sum")).alias("total_value"),
        money_or_zero(F.sum("risk_value_sum")).alias("value_at_risk"),
        *extra,
    )


def label_counts(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Distinct vendors and origin countries, the default labels included."""
    long = facts.select(*by, "vendor", "origin_country").unpivot(
        list(by), ["vendor", "origin_country"], "section", "label"
    )
    return (
        long.groupBy(*by, "section", "label")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*by)
        .agg(
            F.count_if(F.col("section") == "vendor").alias("distinct_vendors"),
            F.count_if(F.col("section") == "origin_country").alias("distinct_countries"),
        )
    )


def kpis(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """The 13 headline figures, one row per dataset."""
    headline = headline_from(delay_histogram(facts, by), by)
    return join_datasets(headline, label_counts(facts, by), by)


def with_bands(kpi_rows: DataFrame) -> DataFrame:
    """Add the display bands of the headline figures."""
    return kpi_rows.withColumns(
        {
            "late_band": late_band(F.col("late_shipment_pct")),
            "success_band": success_band(F.col("delivery_success_rate")),
            "value_at_risk_band": exposure_band(F.col("value_at_risk"), F.col("total_value")),
        }
    )


def count_shipments(shipments: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return shipments.groupBy(*by).agg(F.count(F.lit(1)).alias("shipment_count"))
