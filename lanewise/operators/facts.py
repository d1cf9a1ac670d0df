"""Shipments -> facts: defaults for missing labels and computed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.operators.measures import DATASET

UNKNOWN = "Unknown"
UNKNOWN_VENDOR = "Unknown vendor"

_OPTIONAL = (
    "carrier",
    "transport_mode",
    "service_level",
    "category",
    "freight_cost",
    "total_cost",
    "weight_kg",
    "co2_kg",
    "damaged",
    "returned",
    "quantity_delivered",
    "lead_time_days",
)


def _field(shipments: DataFrame, name: str) -> Column:
    """The canonical column, or a typed NULL where the dataset lacks it."""
    source = F.col(name) if name in shipments.columns else F.lit(None)
    return source.cast(schema.FIELD_TYPES[name])


def _label(shipments: DataFrame, name: str, default: str) -> Column:
    return F.coalesce(F.nullif(_field(shipments, name), F.lit("")), F.lit(default))


def facts(shipments: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Project shipments onto the columns that analytics read.

    Vendor, country, destination and product get a default label, quantity and
    cost a zero. Every other missing value stays NULL so that a column the file
    never had cannot look like a measurement.
    """
    base = shipments.select(
        *by,
        _label(shipments, "vendor", UNKNOWN_VENDOR).alias("vendor"),
        _label(shipments, "origin_country", UNKNOWN).alias("origin_country"),
        _label(shipments, "destination", UNKNOWN).alias("destination"),
        _label(shipments, "product", UNKNOWN).alias("product"),
        F.coalesce(_field(shipments, "quantity"), F.lit(0)).alias("quantity"),
        F.coalesce(_field(shipments, "unit_cost"), F.lit(0).cast("decimal(14,4)")).alias(
            "unit_cost"
        ),
        F.coalesce(_field(shipments, "delay_days"), F.lit(0)).alias("delay_days"),
        _field(shipments, "status").alias("status"),
        F.coalesce(_field(shipments, "shipped_on"), _field(shipments, "last_updated")).alias(
            "occurred_on"
        ),
        *(_field(shipments, name).alias(name) for name in _OPTIONAL),
    )
    return with_computed(base)


def with_computed(base: DataFrame) -> DataFrame:
    late = F.col("delay_days") > 0
    unhealthy = F.coalesce(F.col("status").isin(*schema.UNHEALTHY_STATUSES), F.lit(False))
    delivered_share = F.col("quantity_delivered").cast("double") / F.col("quantity").cast("double")
    return base.withColumns(
        {
            "value": F.col("quantity") * F.col("unit_cost"),
            "is_late": late,
            "is_at_risk": late | unhealthy,
            "is_successful": ~(late | unhealthy),
            "fill_rate": F.when(
                (F.col("quantity") != 0) & F.col("quantity_delivered").isNotNull(),
                F.least(delivered_share, F.lit(1.0)) * 100.0,
            ),
            "lane": F.concat("origin_country", F.lit(" → "), "destination"),
            # A trade route needs two real ends; "Unknown" is not a place.
            "route": F.when(
                (F.col("origin_country") != UNKNOWN) & (F.col("destination") != UNKNOWN),
                F.concat("origin_country", F.lit(" → "), "destination"),
            ),
            "period": F.date_format("occurred_on", "yyyy-MM"),
        }
    )
