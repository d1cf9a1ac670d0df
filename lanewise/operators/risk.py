"""Composite risk score and what drives it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions.labels import risk_level
from lanewise.functions.numeric import clamp, ratio, rounded, text1
from lanewise.operators.entities import concentration_from
from lanewise.operators.kpis import headline_from
from lanewise.operators.measures import DATASET, DELAYS, join_datasets, section_rollup
from lanewise.sources import store

COMPONENTS = tuple(schema.RISK_WEIGHTS)
# Order in which equal contributions are listed.
_TIE_ORDER = (
    "late_rate",
    "delay_severity",
    "vendor_concentration",
    "country_concentration",
    "value_at_risk",
)


def headline_and_concentration(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Headline figures, distinct counts and concentration from one scan."""
    return headline_of(headline_rollup(facts, by), by)


def headline_rollup(facts: DataFrame, by: Sequence[str] = DATASET, *more: str) -> DataFrame:
    """The sections behind the headline and ``more`` of them, written once, as several steps read them."""
    return store.kept(section_rollup(facts, by, ("vendors", "countries", DELAYS, *more)), "headline-rollup")


def headline_of(rolled: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Headline figures and concentration from ``headline_rollup``."""
    delays = rolled.where(F.col("section") == DELAYS).withColumn("delay_days", F.col("label").cast("int"))
    entities = rolled.where(F.col("section").isin("vendors", "countries"))
    return join_datasets(headline_from(delays, by), concentration_from(entities, by), by)


def score_risk(summary: DataFrame) -> DataFrame:
    """Add ``score``, ``level`` and the component and weight columns.

    Value at risk counts only where something is priced; otherwise its weight
    is spread over the other components and its columns are NULL. A dataset
    without rows scores 0.
    """
    filled = F.col("total_shipments") > 0
    priced = F.col("total_value") > 0
    raw: dict[str, Column] = {
        "late_rate": clamp(F.col("late_shipment_pct") / 100.0),
        "delay_severity": clamp(F.col("avg_delay_days") / schema.DELAY_CAP_DAYS),
        "value_at_risk": clamp(ratio(F.col("value_at_risk"), F.col("total_value"))),
        "vendor_concentration": clamp(F.col("vendor_concentration")),
        "country_concentration": clamp(F.col("country_concentration")),
    }
    unpriced_total = 1.0 - schema.RISK_WEIGHTS["value_at_risk"]
    weights = {
        name: (
            F.when(priced | ~filled, weight)
            if name == "value_at_risk"
            else F.when(priced | ~filled, weight).otherwise(weight / unpriced_total)
        )
        for name, weight in schema.RISK_WEIGHTS.items()
    }
    zero = F.lit(0.0)
    score = sum(
        (raw[n] * F.coalesce(weights[n], zero) for n in COMPONENTS[1:]),
        raw[COMPONENTS[0]] * F.coalesce(weights[COMPONENTS[0]], zero),
    )
    measured = {
        f"component_{n}": F.when(
            priced | ~filled if n == "value_at_risk" else F.lit(True), rounded(raw[n], 4)
        )
        for n in COMPONENTS
    }
    shown_weights = {f"weight_{n}": rounded(weights[n], 4) for n in COMPONENTS}
    return summary.withColumns(
        {"score": F.when(filled, rounded(score * 100.0)).otherwise(0.0), **measured, **shown_weights}
    ).withColumn("level", risk_level(F.col("score")))


RISK_COLUMNS = (
    "score",
    "level",
    *(f"component_{n}" for n in COMPONENTS),
    *(f"weight_{n}" for n in COMPONENTS),
)


def composite_risk(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Score, level, components and weights, one row per dataset."""
    return score_risk(headline_and_concentration(facts, by)).select(*by, *RISK_COLUMNS)


def concentration(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    entities = section_rollup(facts, by, ("vendors", "countries"))
    found = concentration_from(entities, by)
    return found.select(
        *by,
        rounded(F.col("vendor_concentration"), 4).alias("vendor_concentration"),
        rounded(F.col("country_concentration"), 4).alias("country_concentration"),
    )


def as_map(prefix: str) -> Column:
    """The ``prefix_*`` columns as a map, unmeasured components left out."""
    entries = F.array(
        *(F.struct(F.lit(n).alias("k"), F.col(f"{prefix}_{n}").alias("v")) for n in COMPONENTS)
    )
    return F.map_from_entries(F.filter(entries, lambda e: e["v"].isNotNull()))


def risk_drivers(risk: DataFrame, by: Sequence[str] = DATASET, top_n: int = 3) -> DataFrame:
    """The components that contribute most to each score, largest first.

    Ranks at most five rows per dataset.
    """
    entries = F.array(
        *(
            F.struct(
                F.lit(name).alias("component"),
                F.lit(schema.RISK_LABELS[name]).alias("label"),
                F.lit(position).alias("tie"),
                (F.col(f"component_{name}") * F.col(f"weight_{name}")).alias("contribution"),
            )
            for position, name in enumerate(_TIE_ORDER)
        )
    )
    long = risk.select(*by, "score", F.explode(entries).alias("d")).select(*by, "score", "d.*")
    ranking = Window.partitionBy(*by).orderBy(F.desc("contribution"), "tie")
    ranked = (
        long.where("contribution is not null")
        .withColumn("rank", F.row_number().over(ranking))
        .where((F.col("rank") <= top_n) & (F.col("contribution") > 0))
    )
    points = F.col("contribution") * 100.0
    return ranked.select(
        *by,
        "rank",
        "component",
        rounded(points, 4).alias("contribution_points"),
        F.concat(
            "label",
            F.lit(" (contributes "),
            text1(points),
            F.lit(" of "),
            text1(F.col("score")),
            F.lit(")"),
        ).alias("driver"),
    )


def unmeasured_components(risk: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Components that the dataset gives no basis for, in alphabetical order."""
    every = F.array(*(F.lit(n) for n in COMPONENTS))
    known = F.map_keys(as_map("weight"))
    return risk.select(
        *by, F.array_sort(F.array_except(every, known)).alias("components_not_measurable")
    )
