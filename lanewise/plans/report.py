"""The whole report of every dataset from two scans of the facts.

A report has the same shape at every size: one head row per dataset, and a flat
table of ranked items that grows with the labels. The nested document is made
from both.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.functions.labels import risk_level
from lanewise.operators import dimensions, entities, healthy, operations, trends
from lanewise.operators.kpis import delay_histogram, headline_from
from lanewise.operators.measures import DATASET, join_datasets, section_rollup
from lanewise.operators.risk import as_map, score_risk
from lanewise.sources import store

KPI_COLUMNS = (
    "total_shipments late_shipments late_shipment_pct avg_delay_days avg_delay_days_when_late"
    " median_delay_days p90_delay_days avg_lead_time_days delivery_success_rate total_value"
    " value_at_risk distinct_vendors distinct_countries"
).split()
MIN_SHIPMENTS = 2
MIN_LABELS = 2

# List sections and the order their items are listed in.
LIST_ORDERS: dict[str, Sequence[str]] = {
    "vendors": entities.VENDOR_ORDER,
    "countries": entities.COUNTRY_ORDER,
    **dict.fromkeys(dimensions.DIMENSIONS, dimensions.DIMENSION_ORDER),
}

@dataclass(frozen=True)
class Report:
    """Sections of the report of every dataset.

    ``rollup`` has one row per (dataset, section, label) and is a written table,
    since all list sections read it.
    """

    by: tuple[str, ...]
    rollup: DataFrame
    headline: DataFrame
    stats: DataFrame

    def section(self, name: str) -> DataFrame:
        """One list section, or ``months``, as a frame of its own."""
        by, found = self.by, self.rollup.where(F.col("section") == name).drop("section")
        if name == "vendors":
            rows = found.withColumnRenamed("label", "vendor")
            return entities.score_vendors(rows, by, MIN_SHIPMENTS)
        if name == "countries":
            return entities.score_countries(found.withColumnRenamed("label", "country"), by)
        if name == "months":
            return trends.trend_points(found.withColumnRenamed("label", "period"), by)
        scored = dimensions.score_labels(found, by, MIN_SHIPMENTS, MIN_LABELS)
        return dimensions.top_lanes(scored, by) if name == "lanes" else scored

    def head(self) -> DataFrame:
        return head(self)

    def items(self) -> DataFrame:
        return items(self)

    def document(self) -> DataFrame:
        return document(self)


def report(facts: DataFrame, by: Sequence[str] = DATASET) -> Report:
    """Every section of every dataset.

    One scan gives the delay histogram, from which all figures about a whole
    dataset follow, and one scan gives the rollup by vendor, country, carrier,
    mode, service level, category, lane and month.
    """
    by = tuple(by)
    rolled = store.kept(section_rollup(facts, by), "report-rollup")
    totals = [F.sum(c).alias(c) for c in operations.TOTAL_COLUMNS]
    histogram = delay_histogram(facts, by, *operations.operation_measures())
    headline = headline_from(histogram, by, *totals)
    return Report(by=by, rollup=rolled, headline=headline, stats=_stats(rolled, by))


def _eligible(section: str) -> str:
    return f"section = '{section}' AND shipment_count >= {MIN_SHIPMENTS}"


def _stats(rolled: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per dataset: concentration, and the totals that shares refer to."""
    sizes = []
    for name in dimensions.DIMENSIONS:
        eligible = _eligible(name)
        sizes += [
            F.expr(f"count_if({eligible}) AS labels_{name}"),
            F.expr(f"sum(CASE WHEN {eligible} THEN shipment_count END) AS shipments_{name}"),
        ]
    return rolled.groupBy(*by).agg(*entities.concentration_measures(), *sizes)


# Columns of one listed item: name in the report -> column of the scored rows.
_LABEL_ITEM = {
    "label": "label",
    "shipment_count": "shipment_count",
    "share_pct": "share_pct",
    "late_count": "late_count",
    "late_pct": "late_pct",
    "avg_delay_days": "avg_delay_days",
    "avg_transit_days": "avg_transit_days",
    "total_value": "total_value",
    "avg_freight_cost": "avg_freight_cost",
}
_ITEMS: dict[str, dict[str, str]] = {
    "vendors": {
        "vendor": "label",
        **{c: c for c in entities.VENDOR_COLUMNS if c not in ("vendor", "risk_level")},
        "risk_level": "vendor_level",
    },
    "countries": {
        "country": "label",
        **{c: c for c in entities.COUNTRY_COLUMNS if c not in ("country", "risk_level")},
        "risk_level": "country_level",
    },
    **dict.fromkeys(dimensions.DIMENSIONS, _LABEL_ITEM),
}


def _scored(items: DataFrame) -> DataFrame:
    """Every figure that any list section shows, computed once per row."""
    branches = " ".join(f"WHEN '{n}' THEN shipments_{n}" for n in dimensions.DIMENSIONS)
    shares = F.expr(f"CASE section {branches} END")
    vendor, country = entities.vendor_fields(), entities.country_fields()
    label = dimensions.label_fields(shares)
    plain = items.withColumns(
        {
            **{n: label[n] for n in _LABEL_ITEM if n not in ("label", *items.columns)},
            **{n: vendor[n] for n in ("avg_lead_time_days", "value_at_risk", "health_score")},
            "risk_score": country["risk_score"],
        }
    )
    return plain.withColumns(
        {
            "vendor_level": risk_level(100 - F.col("health_score")),
            "country_level": risk_level(F.col("risk_score")),
        }
    )


def _is_listed(name: str) -> str:
    if name == "countries":
        return f"section = '{name}'"
    if name == "vendors":
        return _eligible(name)
    return f"{_eligible(name)} AND labels_{name} >= {MIN_LABELS}"


# Figures of a flat item; NULL where its section does not show them.
ITEM_FIGURES = (
    "shipment_count share_pct late_count late_pct avg_delay_days avg_lead_time_days"
    " avg_transit_days total_value value_at_risk avg_freight_cost health_score risk_score risk_level"
).split()


def _rank_key() -> Column:
    """What an item of any section is ranked by, as one struct of two figures and the label."""
    cases = []
    for name, order in LIST_ORDERS.items():
        columns = _ITEMS[name]
        keys = [f"-{columns[c[1:]]}" if c.startswith("-") else columns[c] for c in order]
        cases.append(f"WHEN '{name}' THEN struct({keys[0]} AS a, {keys[1]} AS b, {keys[2]} AS c)")
    return F.expr(
        f"CASE section {' '.join(cases)} ELSE struct(0.0D AS a, 0.0D AS b, label AS c) END"
    )


def _shown(figure: str) -> Column:
    """A figure where the section shows it."""
    branches = []
    for name in LIST_ORDERS:
        if figure in _ITEMS[name]:
            branches.append(f"WHEN '{name}' THEN {_ITEMS[name][figure]}")
    if figure in trends.POINT_COLUMNS:
        branches.append(f"WHEN 'months' THEN {figure}")
    return F.expr(f"CASE section {' '.join(branches)} END").alias(figure)


def items(parts: Report) -> DataFrame:
    """Every listed item: dataset, section, position in its section, label, figures.

    Months come in their order, other sections worst first, lanes only the
    twelve worst. Sections without data have no rows.
    """
    scored = _scored(join_datasets(parts.rollup, parts.stats, parts.by))
    listed = " OR ".join(f"(section = '{name}' AND {_is_listed(name)})" for name in LIST_ORDERS)
    place = Window.partitionBy(*parts.by, "section").orderBy(_rank_key())
    found = scored.where(f"section = 'months' OR {listed}").withColumn(
        "position", F.row_number().over(place).cast("long")
    )
    return found.where(f"section <> 'lanes' OR position <= {dimensions.LANE_LIMIT}").select(
        *parts.by, "section", "position", "label", *map(_shown, ITEM_FIGURES)
    )


def _section_sizes(parts: Report) -> list[Column]:
    """How many items each list section of a dataset has."""

    def size(name: str) -> str:
        if name == "vendors":
            return f"count_if({_eligible(name)})"
        if name == "countries":
            return f"count_if(section = '{name}')"
        listed = f"count_if({_eligible(name)})"
        shown = f"least({listed}, {dimensions.LANE_LIMIT})" if name == "lanes" else listed
        return f"CASE WHEN {listed} >= {MIN_LABELS} THEN {shown} ELSE 0 END"

    return [F.expr(f"{size(name)} AS {name}_count") for name in LIST_ORDERS]


def _summaries(parts: Report) -> DataFrame:
    """Monthly points, emissions by mode and named vendors of each dataset.

    Months and modes are few by nature, and three vendors are named at most.
    """
    by = parts.by
    point = F.struct(
        F.col("label").alias("period"),
        *(c.alias(n) for n, c in trends.point_fields().items()),
    )
    points = F.array_sort(F.collect_list(F.when(F.col("section") == "months", point)))
    emitting = (F.col("section") == "transport_modes") & (F.col("co2_count") > 0)
    emitted = F.struct("label", F.round("co2_sum", 2).cast("double").alias("co2_kg"))
    modes = F.map_from_entries(F.array_sort(F.collect_list(F.when(emitting, emitted))))
    rows = parts.rollup.groupBy(*by).agg(
        points.alias("points"), modes.alias("co2_by_mode_kg"), *_section_sizes(parts)
    )
    strong = healthy.strongest_named(parts.section("vendors"), by)
    names = strong.groupBy(*by).agg(healthy.joined_names().alias("strong_vendor_names"))
    return join_datasets(rows, names, by, "left")


def _with_trend(rows: DataFrame) -> DataFrame:
    """Direction of the monthly points held in each row."""
    delays = F.transform("points", lambda p: p["avg_delay_days"])
    halves = rows.withColumn("period_count", F.size("points").cast("long")).withColumns(
        {
            "first_half": _mean(F.slice(delays, 1, F.floor(F.col("period_count") / 2).cast("int"))),
            "second_half": _mean(
                F.slice(delays, (F.floor(F.col("period_count") / 2) + 1).cast("int"), F.size("points"))
            ),
        }
    )
    return trends.describe_direction(halves)


def _mean(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v)
    return F.coalesce(F.try_divide(total, F.size(values).cast("double")), F.lit(0.0))


def _optional(present: Column, fields: Mapping[str, Column]) -> Column:
    return F.when(present, F.struct(*(c.alias(n) for n, c in fields.items())))


def head(parts: Report) -> DataFrame:
    """One row per dataset: everything but the listed items, of which it has the counts."""
    by = list(parts.by)
    whole = join_datasets(parts.headline, parts.stats, by, "left")
    whole = score_risk(
        whole.fillna(0, ["distinct_vendors", "distinct_countries"]).fillna(
            0.0, ["vendor_concentration", "country_concentration"]
        )
    )
    summaries = _summaries(parts)
    whole = join_datasets(whole, summaries, by, "left").withColumn(
        "points", F.coalesce("points", F.array().cast(summaries.schema["points"].dataType))
    )
    whole = healthy.with_signals(_with_trend(whole))
    no_modes = F.create_map().cast("map<string,double>")
    emissions = {
        **operations.emissions_fields(),
        "co2_by_mode_kg": F.coalesce(F.col("co2_by_mode_kg"), no_modes),
    }
    sections = {
        "kpis": F.struct(*KPI_COLUMNS),
        "risk": F.struct(
            "score",
            "level",
            as_map("component").alias("components"),
            as_map("weight").alias("weights"),
        ),
        "trend": F.struct("points", "direction", "delay_change_pct", "commentary"),
        "healthy_signals": F.col("healthy_signals"),
        "cost": _optional(operations.has_cost(), operations.cost_fields()),
        "quality": _optional(operations.has_quality(), operations.quality_fields()),
        "emissions": _optional(operations.has_emissions(), emissions),
        "available_dimensions": operations.covered(),
    }
    return whole.select(
        *by,
        *(c.alias(n) for n, c in sections.items()),
        *(F.coalesce(f"{name}_count", F.lit(0)).alias(f"{name}_count") for name in LIST_ORDERS),
    )


def document(parts: Report) -> DataFrame:
    """The nested report: one row per dataset, each section a list in rank order.

    All items of a dataset meet in one row, so this suits datasets with labels
    that fit in memory; ``head`` and ``items`` say the same at any size.
    """
    by = list(parts.by)
    lists = []
    for name in LIST_ORDERS:
        item = F.struct(*(F.col(_flat_name(c)).alias(c) for c in _ITEMS[name]))
        entry = F.when(F.col("section") == name, F.struct("position", item.alias("item")))
        ordered = F.array_sort(F.collect_list(entry))
        lists.append(F.transform(ordered, lambda e: e["item"]).alias(name))
    nested = items(parts).groupBy(*by).agg(*lists)
    whole = join_datasets(head(parts), nested, by, "left")
    counts = [f"{name}_count" for name in LIST_ORDERS]
    return whole.select(
        *by,
        *(c for c in whole.columns if c not in (*by, *counts, *LIST_ORDERS)),
        *(
            F.coalesce(name, F.array().cast(nested.schema[name].dataType)).alias(name)
            for name in LIST_ORDERS
        ),
    )


def _flat_name(column: str) -> str:
    return "label" if column in ("vendor", "country") else column


def shareable(whole: DataFrame) -> DataFrame:
    """The nested report without lane labels, which may name customers; their count stays."""
    return whole.withColumn("lane_count", F.size("lanes")).drop("lanes")


def as_json(whole: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """One JSON document per dataset."""
    body = [c for c in whole.columns if c not in by]
    return whole.select(*by, F.to_json(F.struct(*body)).alias("document"))
