"""Performance by carrier, mode, service level, category, lane or any other label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.numeric import mean_of, money, percent
from lanewise.operators.entities import order_columns
from lanewise.operators.measures import (
    DATASET,
    SECTION_LABELS,
    join_datasets,
    rollup,
    section_rollup,
)

DIMENSIONS = ("carriers", "transport_modes", "service_levels", "categories", "lanes")
DIMENSION_ORDER = ("-late_pct", "-avg_delay_days", "label")
DIMENSION_COLUMNS = (
    "label shipment_count share_pct late_count late_pct avg_delay_days avg_transit_days"
    " total_value avg_freight_cost"
).split()
LANE_LIMIT = 12


def score_labels(
    rolled: DataFrame, groups: Sequence[str], min_shipments: int = 2, min_distinct: int = 2
) -> DataFrame:
    """Score the labels of each group from a rollup with a ``label`` column.

    Labels seen fewer than ``min_shipments`` times are left out, and a group
    left with fewer than ``min_distinct`` labels is left out altogether: there
    is nothing to compare. Shares are of the labels that remain.
    """
    eligible = rolled.where(F.col("shipment_count") >= min_shipments)
    totals = eligible.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("label_count"), F.sum("shipment_count").alias("all_shipments")
    )
    both = join_datasets(eligible, totals.where(F.col("label_count") >= min_distinct), groups)

    fields = label_fields(F.col("all_shipments"))
    return both.select(*groups, "label", *(c.alias(n) for n, c in fields.items()))


def label_fields(all_shipments: Column) -> dict[str, Column]:
    """Shown figures of one label, over the measures of a rollup."""

    def known(count: str, value: Column) -> Column:
        return F.when(F.col(count) > 0, value)

    shipments = F.col("shipment_count")
    return {
        "shipment_count": shipments,
        "share_pct": percent(shipments, all_shipments),
        "late_count": F.col("late_count"),
        "late_pct": percent(F.col("late_count"), shipments),
        "avg_delay_days": mean_of(F.col("delay_sum"), shipments),
        "avg_transit_days": known("lead_count", mean_of(F.col("lead_sum"), F.col("lead_count"))),
        "total_value": money(F.col("value_sum")),
        "avg_freight_cost": known(
            "freight_count", mean_of(F.col("freight_sum"), F.col("freight_count"))
        ),
    }


def dimension_score(
    facts: DataFrame,
    key: Column | str,
    by: Sequence[str] = DATASET,
    min_shipments: int = 2,
    min_distinct: int = 2,
) -> DataFrame:
    """Break a dataset down by any column expression; ``DIMENSION_ORDER`` ranks the labels.

    Rows for which ``key`` is NULL or empty are left out, not pooled.
    """
    label = F.col(key) if isinstance(key, str) else key
    labelled = facts.withColumn("label", label).where("label <> ''")
    return score_labels(rollup(labelled, [*by, "label"]), by, min_shipments, min_distinct)


def top_lanes(scored: DataFrame, groups: Sequence[str], limit: int = LANE_LIMIT) -> DataFrame:
    """The worst lanes of each dataset; tasks keep only ``limit`` rows before the shuffle."""
    ranking = Window.partitionBy(*groups).orderBy(*order_columns(DIMENSION_ORDER))
    ranked = scored.withColumn("_rank", F.row_number().over(ranking))
    return ranked.where(F.col("_rank") <= limit).drop("_rank")


def named_dimension(
    facts: DataFrame, dimension: str, by: Sequence[str] = DATASET, lane_limit: int = LANE_LIMIT
) -> DataFrame:
    """One of ``DIMENSIONS``; an unknown name lists the choices."""
    if dimension not in DIMENSIONS:
        raise ValueError(
            f"Unknown dimension {dimension!r}. Choose one of: {', '.join(DIMENSIONS)}."
        )
    scored = dimension_score(facts, SECTION_LABELS[dimension], by)
    return top_lanes(scored, by, lane_limit) if dimension == "lanes" else scored


def carriers(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return named_dimension(facts, "carriers", by)


def transport_modes(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return named_dimension(facts, "transport_modes", by)


def service_levels(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return named_dimension(facts, "service_levels", by)


def categories(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    return named_dimension(facts, "categories", by)


def lanes(facts: DataFrame, by: Sequence[str] = DATASET, limit: int = LANE_LIMIT) -> DataFrame:
    return named_dimension(facts, "lanes", by, limit)


def all_dimensions(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """All five breakdowns from one scan, told apart by ``section``.

    Lanes are not cut to the worst twelve here.
    """
    return score_labels(section_rollup(facts, by, DIMENSIONS), [*by, "section"])
