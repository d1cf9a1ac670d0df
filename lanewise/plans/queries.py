"""One registered query per operator, each over the whole of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.numeric import rounded
from lanewise.operators import (
    catalog,
    dimensions,
    entities,
    healthy,
    history,
    kpis,
    operations,
    risk,
    trends,
    views,
)
from lanewise.operators.facts import facts as facts_of
from lanewise.plans import report as reports
from lanewise.plans import tables
from lanewise.plans.ingest_queries import INGEST
from lanewise.sources import store, tpch

Query = Callable[[SparkSession, str], DataFrame]

PAGE_ORDER = (
    "upload_id l_orderkey l_linenumber vendor product destination shipped_on quantity"
).split()


def _on_shipments(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: op(tpch.shipments(spark, folder))


def _on_facts(op: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, folder: op(facts_of(tpch.shipments(spark, folder)))


def _ranked(rows: DataFrame) -> DataFrame:
    return rows.withColumn("rank", F.col("rank").cast("long"))


def _facts_shown(facts: DataFrame) -> DataFrame:
    return facts.select(
        "upload_id",
        "vendor",
        "origin_country",
        "destination",
        "product",
        "quantity",
        F.col("unit_cost").cast("double").alias("unit_cost"),
        "lead_time_days",
        "delay_days",
        "status",
        "occurred_on",
        F.col("value").cast("double").alias("value"),
        "is_late",
        "is_at_risk",
        "is_successful",
        rounded(F.col("fill_rate"), 4).alias("fill_rate"),
        "lane",
        "period",
    )


def _bands(facts: DataFrame) -> DataFrame:
    return kpis.with_bands(kpis.kpis(facts)).select(
        "upload_id",
        "late_shipment_pct",
        "delivery_success_rate",
        "late_band",
        "success_band",
        "value_at_risk_band",
    )


def _rounded_share(shares: DataFrame) -> DataFrame:
    return shares.withColumn("share", rounded(F.col("share"), 6))


def _unmeasured(facts: DataFrame) -> DataFrame:
    missing = risk.unmeasured_components(risk.composite_risk(facts))
    return missing.withColumn(
        "components_not_measurable", F.array_join("components_not_measurable", ",")
    )


def _vendor_rollup(shipments: DataFrame) -> DataFrame:
    rolled = entities.vendor_rollup(shipments)
    return rolled.withColumns(
        {c: rounded(F.col(c), 6) for c in ("avg_delay_days", "avg_lead_time_days")}
    )


def _signals(facts: DataFrame) -> DataFrame:
    found = healthy.healthy_signals(facts)
    return found.withColumn("signals", F.array_join("healthy_signals", "|")).drop(
        "healthy_signals"
    )


def _history_points(shipments: DataFrame) -> DataFrame:
    uploads = tables.yearly_uploads(shipments)
    return history.history_points(uploads, tables.yearly_snapshots(facts_of(shipments)))


def _latest(facts: DataFrame) -> DataFrame:
    return history.latest_snapshot(tables.yearly_snapshots(facts)).select(
        "upload_id",
        "id",
        "status",
        "created_at",
        "risk_score",
        F.col("total_shipments").cast("double").alias("total_shipments"),
        "late_shipment_pct",
    )


def _compared(shipments: DataFrame) -> DataFrame:
    figures = store.kept(tables.figures(facts_of(shipments)), "figures")
    return history.compare_metrics(figures, tables.consecutive_pairs(figures))


def _analyses(shipments: DataFrame) -> DataFrame:
    found = catalog.analyses_for_user(
        tables.yearly_snapshots(facts_of(shipments)), tables.yearly_uploads(shipments), "owner-1"
    )
    return found.select(
        "upload_id", "id", "status", "created_at", "risk_score", "user_id", "label"
    )


_ROW = ("upload_id", "l_orderkey", "l_linenumber", "vendor", "delay_days")


def _owned(shipments: DataFrame) -> DataFrame:
    uploads = tables.yearly_uploads(shipments)
    return catalog.scope_to_owner(shipments, uploads, "owner-1").select(*_ROW)


def _deleted(shipments: DataFrame) -> DataFrame:
    failed = tables.yearly_uploads(shipments).where("status = 'failed'")
    return catalog.without_uploads(shipments, failed).select(*_ROW)


def _resolved(shipments: DataFrame) -> DataFrame:
    uploads = tables.yearly_uploads(shipments)
    return catalog.resolve_dataset(uploads, tables.lookup_requests(uploads))


def _page(shipments: DataFrame) -> DataFrame:
    rows = views.shipment_rows(shipments, PAGE_ORDER, limit=500, offset=1000)
    return rows.withColumn("unit_cost", F.col("unit_cost").cast("double"))


def _risk_view(facts: DataFrame) -> DataFrame:
    seen = views.risk_view(facts)
    return seen.select(
        "upload_id",
        "score",
        "level",
        *(
            F.try_element_at(f"{part}s", F.lit(name)).alias(f"{part}_{name}")
            for part in ("component", "weight")
            for name in risk.COMPONENTS
        ),
        F.size("components_not_measurable").alias("missing"),
    )


def _whole_report(facts: DataFrame) -> DataFrame:
    return reports.report(facts).document()


def _report_outline(facts: DataFrame) -> DataFrame:
    """What each nested report says first in every section, as flat columns."""
    return _outline(_whole_report(facts))


def _outline(whole: DataFrame) -> DataFrame:
    return whole.select(
        "upload_id",
        "kpis.total_shipments",
        "kpis.late_shipment_pct",
        "kpis.p90_delay_days",
        "risk.score",
        "risk.level",
        "trend.direction",
        "trend.delay_change_pct",
        F.size("trend.points").cast("long").alias("months"),
        F.array_join("healthy_signals", "|").alias("signals"),
        F.col("cost.total_freight_cost"),
        F.col("cost.freight_pct_of_goods"),
        F.col("quality.perfect_order_rate_pct"),
        F.col("emissions.total_co2_kg"),
        F.try_element_at("emissions.co2_by_mode_kg", F.lit("air")).alias("air_co2_kg"),
        F.array_join("available_dimensions", ",").alias("available"),
        F.size("vendors").cast("long").alias("vendors"),
        F.size("countries").cast("long").alias("countries"),
        F.size("lanes").cast("long").alias("lanes"),
        F.try_element_at("vendors", F.lit(1))["vendor"].alias("worst_vendor"),
        F.try_element_at("vendors", F.lit(1))["health_score"].alias("worst_health"),
        F.try_element_at("lanes", F.lit(1))["label"].alias("worst_lane"),
        F.try_element_at("lanes", F.lit(1))["share_pct"].alias("worst_lane_share"),
    )


def _dimension_views(facts: DataFrame) -> DataFrame:
    return _ranked(views.dimension_views(facts))


def _operations_view(facts: DataFrame) -> DataFrame:
    seen = views.operations_view(facts)
    return seen.select(
        "upload_id",
        "cost.total_freight_cost",
        "cost.freight_per_kg",
        "quality.damage_rate_pct",
        "quality.perfect_order_rate_pct",
        "emissions.total_co2_kg",
        F.try_element_at("emissions.co2_by_mode_kg", F.lit("air")).alias("air_co2_kg"),
        F.array_join("available_dimensions", ",").alias("available"),
    )


def _report_items(facts: DataFrame) -> DataFrame:
    return reports.report(facts).items()


def _report_head(facts: DataFrame) -> DataFrame:
    """The head of every report, as flat columns."""
    return reports.report(facts).head().select(
        "upload_id",
        "kpis.*",
        "risk.score",
        "risk.level",
        "trend.direction",
        "trend.delay_change_pct",
        "trend.commentary",
        F.array_join("healthy_signals", "|").alias("signals"),
        *(f"{name}_count" for name in reports.LIST_ORDERS),
    )


def _json_report(facts: DataFrame) -> DataFrame:
    """Reports stored as JSON documents, read again and outlined."""
    whole = _whole_report(facts)
    stored = store.kept(reports.as_json(whole), "report-documents")
    ddl = whole.drop("upload_id").schema
    return _outline(stored.select("upload_id", F.from_json("document", ddl).alias("d")).select("upload_id", "d.*"))


def _shareable(facts: DataFrame) -> DataFrame:
    """What a shareable document says, and that it names no lane."""
    shared = reports.as_json(reports.shareable(_whole_report(facts)))
    get = lambda path, kind: F.get_json_object("document", f"$.{path}").cast(kind)
    return shared.select(
        "upload_id",
        get("kpis.total_shipments", "long").alias("total_shipments"),
        get("risk.score", "double").alias("score"),
        get("lane_count", "long").alias("lanes"),
        get("vendors[0].vendor", "string").alias("worst_vendor"),
        get("lanes", "string").isNotNull().alias("names_lanes"),
    )


ANALYTICS: dict[str, Query] = {
    "facts": _on_facts(_facts_shown),
    "kpis": _on_facts(kpis.kpis),
    "kpis_overall": _on_facts(lambda f: kpis.kpis(f, ())),
    "kpi_bands": _on_facts(_bands),
    "delay_percentiles": _on_facts(kpis.delay_percentiles),
    "vendor_health": _on_facts(lambda f: entities.vendor_health(f, min_shipments=2)),
    "country_risk": _on_facts(entities.country_risk),
    "vendor_shares": _on_facts(lambda f: _rounded_share(entities.vendor_shares(f))),
    "country_shares": _on_facts(lambda f: _rounded_share(entities.country_shares(f))),
    "concentration": _on_facts(risk.concentration),
    "composite_risk": _on_facts(risk.composite_risk),
    "risk_drivers": _on_facts(lambda f: _ranked(risk.risk_drivers(risk.composite_risk(f)))),
    "risk_unmeasured": _on_facts(_unmeasured),
    "dimension_score": _on_facts(lambda f: dimensions.dimension_score(f, "destination")),
    "dim_carriers": _on_facts(dimensions.carriers),
    "dim_transport_modes": _on_facts(dimensions.transport_modes),
    "dim_service_levels": _on_facts(dimensions.service_levels),
    "dim_categories": _on_facts(dimensions.categories),
    "dim_lanes": _on_facts(dimensions.lanes),
    "freight_cost": _on_facts(operations.freight_cost),
    "order_quality": _on_facts(operations.order_quality),
    "perfect_order": _on_facts(operations.perfect_order),
    "emissions": _on_facts(operations.emissions),
    "emissions_by_mode": _on_facts(operations.emissions_by_mode),
    "coverage": _on_facts(operations.coverage),
    "vendor_rollup": _on_shipments(_vendor_rollup),
    "distinct_vendors": _on_shipments(entities.distinct_vendors),
    "count_shipments": _on_shipments(kpis.count_shipments),
    "country_exposure": _on_facts(entities.country_exposure),
    "monthly_trend": _on_facts(trends.monthly_trend),
    "trend_direction": _on_facts(trends.trend_direction),
    "trend_last_12": _on_facts(lambda f: trends.last_periods(trends.monthly_trend(f))),
    "healthy_signals": _on_facts(_signals),
    "latest_snapshot": _on_facts(_latest),
    "history_points": _on_shipments(_history_points),
    "history_direction": _on_shipments(lambda s: history.history_direction(_history_points(s))),
    "compare_metrics": _on_shipments(_compared),
    "analyses_for_user": _on_shipments(_analyses),
    "scope_to_owner": _on_shipments(_owned),
    "delete_upload": _on_shipments(_deleted),
    "scan_upload": _on_shipments(
        lambda s: catalog.scan_upload(s, "1996").select(*_ROW, "status")
    ),
    "resolve_dataset": _on_shipments(_resolved),
    "page_shipments": _on_shipments(_page),
    "top_vendors": _on_facts(
        lambda f: _ranked(catalog.top_vendors(entities.vendor_health(f, min_shipments=2)))
    ),
    "top_countries": _on_facts(
        lambda f: _ranked(catalog.top_countries(entities.country_risk(f)))
    ),
    "list_datasets": _on_shipments(
        lambda s: _ranked(views.list_datasets(tables.yearly_uploads(s)))
    ),
    "kpi_view": _on_facts(views.kpi_view),
    "vendor_view": _on_facts(lambda f: _ranked(views.vendor_view(f))),
    "country_view": _on_facts(lambda f: _ranked(views.country_view(f))),
    "trend_view": _on_facts(views.trend_view),
    "dimension_view": _on_facts(_dimension_views),
    "operations_view": _on_facts(_operations_view),
    "history_view": _on_shipments(lambda s: views.history_view(_history_points(s))),
    "risk_view": _on_facts(_risk_view),
    "report": _on_facts(_report_head),
    "report_items": _on_facts(_report_items),
    "report_outline": _on_facts(_report_outline),
    "snapshot_report": _on_facts(_json_report),
    "report_shareable": _on_facts(_shareable),
}


def queries() -> dict[str, Query]:
    return {**ANALYTICS, **INGEST}
