"""Text labels mapped onto fixed vocabularies, and score bands."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions.cells import trimmed


def _label(raw: Column, labels: dict[str, str]) -> Column:
    word = F.translate(F.lower(trimmed(raw)), "- ", "__")
    table = F.create_map(*(F.lit(x) for x in chain.from_iterable(labels.items())))
    return F.coalesce(F.try_element_at(table, word), F.lit("unknown"))


def parse_status(raw: Column) -> Column:
    """Free-text delivery status -> canonical status, ``unknown`` when unheard of."""
    return _label(raw, schema.STATUS_WORDS)


def parse_mode(raw: Column) -> Column:
    """Free-text transport mode -> canonical mode, ``unknown`` when unheard of."""
    return _label(raw, schema.MODE_WORDS)


def stored_mode(raw: Column) -> Column:
    """As kept in the shipment record, where an unheard-of mode is NULL."""
    return F.nullif(parse_mode(raw), F.lit("unknown"))


def risk_level(score: Column) -> Column:
    return (
        F.when(score >= schema.HIGH_RISK_SCORE, "HIGH")
        .when(score >= schema.MEDIUM_RISK_SCORE, "MEDIUM")
        .otherwise("LOW")
    )


# Display bands of the headline figures.


def late_band(late_pct: Column) -> Column:
    return F.when(late_pct >= 40, "high").when(late_pct >= 15, "medium").otherwise("low")


def success_band(success_pct: Column) -> Column:
    return F.when(success_pct >= 85, "low").when(success_pct >= 60, "medium").otherwise("high")


def exposure_band(value_at_risk: Column, total_value: Column) -> Column:
    """``high`` when more than 30 % of a priced dataset is at risk, else NULL."""
    return F.when((total_value > 0) & (value_at_risk > total_value * 0.3), "high")
