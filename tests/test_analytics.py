from __future__ import annotations

from datetime import date

import pytest
from factories import shipment
from pyspark.sql import functions as F

from lanewise.operators import entities, healthy, kpis, risk, trends
from lanewise.operators.facts import facts as facts_of

NONE = "delay_days lead_time_days quantity unit_cost"


def by_upload(frame):
    return {r.upload_id: r for r in frame.collect()}


def test_facts_default_labels_but_not_measurements(make_shipments):
    row = facts_of(
        make_shipments(
            [
                shipment(
                    vendor=None, origin_country="", destination=None, product=None, quantity=None,
                    unit_cost=None, lead_time_days=None, carrier=None, shipped_on=None,
                )
            ]
        )
    ).first()
    assert (row.vendor, row.origin_country, row.destination) == ("Unknown vendor", "Unknown", "Unknown")
    assert (row.quantity, float(row.value), row.lead_time_days, row.carrier) == (0, 0.0, None, None)
    assert (row.period, row.fill_rate, row.route, row.lane) == (None, None, None, "Unknown → Unknown")


def test_facts_of_a_frame_without_optional_columns(spark):
    frame = spark.sql("SELECT 'u' AS upload_id, 'Lofoten' AS vendor, 3 AS delay_days, 'delayed' AS status")
    row = facts_of(frame).first()
    assert row.freight_cost is None and row.damaged is None and row.is_late and row.is_at_risk


def test_kpis(make_facts):
    rows = [shipment(delay_days=d, lead_time_days=5 if d else None) for d in (0, 0, 4, 10)]
    rows.append(shipment(status="cancelled", vendor=None))
    k = kpis.kpis(make_facts(rows)).first()
    assert (k.total_shipments, k.late_shipments, k.late_shipment_pct) == (5, 2, 40.0)
    assert (k.avg_delay_days, k.avg_delay_days_when_late, k.avg_lead_time_days) == (2.8, 7.0, 6.67)
    assert (k.median_delay_days, k.p90_delay_days) == (0.0, 7.6)
    # A cancelled shipment is at risk though it is not late.
    assert (k.delivery_success_rate, k.total_value, k.value_at_risk) == (40.0, 5000.0, 3000.0)
    assert (k.distinct_vendors, k.distinct_countries) == (2, 1)


def test_empty_input_is_all_zeros(make_facts):
    none = make_facts([shipment()]).where("false")
    k = kpis.kpis(none, ()).first()
    assert set(k.asDict().values()) == {0}
    r = risk.composite_risk(none, ()).first()
    assert (r.score, r.level, r.component_late_rate, r.weight_value_at_risk) == (0.0, "LOW", 0.0, 0.2)
    assert kpis.kpis(none).count() == 0


def test_percentiles_interpolate(make_facts):
    series = {
        # delays, median, ninetieth percentile
        "ten": (list(range(1, 11)), 5.5, 9.1),
        "four": ([4, 1, 3, 2], 2.5, 3.7),
        "one": ([7], 7.0, 7.0),
        "ties": ([0] * 9 + [30], 0.0, 3.0),
        "two": ([2, 12], 7.0, 11.0),
        "eleven": ([5, 0, 40, 3, 3, 8, 1, 0, 22, 6, 2], 3.0, 22.0),
    }
    rows = [shipment(upload_id=u, delay_days=d) for u, (ds, *_) in series.items() for d in ds]
    got = by_upload(kpis.delay_percentiles(make_facts(rows)))
    for name, (_, median, ninety) in series.items():
        assert (got[name].median_delay_days, got[name].p90_delay_days) == (median, ninety)


def test_vendor_health(make_facts):
    rows = [shipment(vendor="Good") for _ in range(3)]
    rows += [shipment(vendor="Bad", delay_days=30, lead_time_days=60) for _ in range(3)]
    rows += [shipment(vendor="Once", delay_days=5), shipment(vendor=None, lead_time_days=None)]
    rows += [shipment(vendor=None, lead_time_days=None)]
    worst = entities.order_columns(entities.VENDOR_ORDER)
    got = entities.vendor_health(make_facts(rows), min_shipments=2).orderBy(*worst).collect()
    assert [r.vendor for r in got] == ["Bad", "Good", "Unknown vendor"]
    bad, good, unknown = got
    assert (bad.health_score, bad.risk_level, bad.late_pct) == (0.0, "HIGH", 100.0)
    assert good.health_score == pytest.approx(100 * (0.5 + 0.3 + 0.2 * (1 - 10 / 45)), abs=0.01)
    # No lead time at all earns full marks for lead time.
    assert (unknown.avg_lead_time_days, unknown.health_score, unknown.risk_level) == (0.0, 100.0, "LOW")


def test_country_risk_and_exposure(make_facts):
    rows = [shipment(origin_country="Malta", delay_days=21)] * 3 + [shipment(origin_country="Togo")]
    facts = make_facts(rows)
    got = entities.country_risk(facts).orderBy(*entities.order_columns(entities.COUNTRY_ORDER)).collect()
    assert [(r.country, r.risk_score, r.risk_level) for r in got] == [
        ("Malta", 100.0, "HIGH"),
        ("Togo", 0.0, "LOW"),
    ]
    shares = {r.country: r.share_pct for r in entities.country_exposure(facts).collect()}
    assert shares == {"Malta": 75.0, "Togo": 25.0}


def test_shares_fall_back_to_counts(make_facts):
    rows = [shipment(upload_id="p", vendor="A", quantity=3), shipment(upload_id="p", vendor="B", quantity=1)]
    rows += [shipment(upload_id="n", vendor=v, unit_cost=None) for v in "AAAB"]
    got = {(r.upload_id, r.vendor): r.share for r in entities.vendor_shares(make_facts(rows)).collect()}
    assert got == {("p", "A"): 0.75, ("p", "B"): 0.25, ("n", "A"): 0.75, ("n", "B"): 0.25}
    indexes = by_upload(risk.concentration(make_facts(rows)))
    assert indexes["p"].vendor_concentration == indexes["n"].vendor_concentration == 0.625
    assert indexes["p"].country_concentration == 1.0


def test_unpriced_datasets_are_scored_over_what_is_known(make_facts):
    rows = [
        shipment(upload_id=u, delay_days=d, vendor=f"V{i % 4}", unit_cost=c)
        for u, c in (("priced", 10), ("unpriced", None))
        for i, d in enumerate((0, 0, 7, 14, 0, 21, 3, 0))
    ]
    got = by_upload(risk.composite_risk(make_facts(rows)))
    weights = {
        u: [r[f"weight_{n}"] for n in risk.COMPONENTS if r[f"weight_{n}"] is not None]
        for u, r in got.items()
    }
    assert [len(w) for _, w in sorted(weights.items())] == [5, 4]
    assert all(sum(w) == pytest.approx(1.0, abs=1e-3) for w in weights.values())
    assert got["unpriced"].component_value_at_risk is None
    assert all(0 <= r.score <= 100 for r in got.values())
    # Half of the value is at risk, as much as the other components say on average or more.
    assert got["unpriced"].score < got["priced"].score
    missing = by_upload(risk.unmeasured_components(risk.composite_risk(make_facts(rows))))
    assert missing["unpriced"].components_not_measurable == ["value_at_risk"]
    assert missing["priced"].components_not_measurable == []


def test_drivers_are_ranked_by_contribution(make_facts):
    rows = [shipment(delay_days=21)] * 3 + [shipment()]
    drivers = risk.risk_drivers(risk.composite_risk(make_facts(rows))).collect()
    assert [r.component for r in drivers] == ["late_rate", "delay_severity", "value_at_risk"]
    assert drivers[0].driver.startswith("share of shipments running late (contributes 22.5 of ")
    none = risk.composite_risk(make_facts([shipment(delay_days=0)]))
    assert all(r.contribution_points > 0 for r in risk.risk_drivers(none).collect())


def months(delays, upload="u"):
    return [
        shipment(upload_id=upload, delay_days=d, shipped_on=date(2024, m, 1))
        for m, d in enumerate(delays, 1)
    ]


def test_trend_directions(make_facts):
    series = {
        "worse": [1, 1, 5, 5],
        "better": [5, 5, 1, 1],
        "flat": [4, 4, 4],
        "short": [1, 9],
        "from zero": [0, 0, 3],
        "all zero": [0, 0, 0],
        "odd": [2, 2, 2, 2, 3],
    }
    rows = [r for u, ds in series.items() for r in months(ds, u)]
    rows.append(shipment(upload_id="undated", shipped_on=None))
    got = by_upload(trends.trend_direction(make_facts(rows)))
    assert {u: r.direction for u, r in got.items()} == {
        "worse": "worsening",
        "better": "improving",
        "flat": "stable",
        "short": "insufficient_data",
        "from zero": "worsening",
        "all zero": "stable",
        "odd": "worsening",
        "undated": "insufficient_data",
    }
    assert got["from zero"].delay_change_pct == 100.0 and got["short"].delay_change_pct is None
    assert got["odd"].delay_change_pct == pytest.approx(100 * (7 / 3 - 2) / 2, abs=0.01)
    assert got["short"].commentary == (
        "Only 2 dated period(s) available; at least 3 are needed to call a direction."
    )
    assert got["flat"].commentary == "Average delay held roughly flat at 4.0 days (+0.0% change)."
    assert "rose 400.0%" in got["worse"].commentary and "(1.0 → 5.0 days)" in got["worse"].commentary
    assert got["undated"].period_count == 0


def test_months_are_not_filled_and_undated_rows_left_out(make_facts):
    rows = [shipment(shipped_on=date(2024, m, 9), delay_days=m) for m in (1, 1, 3)]
    rows.append(shipment(shipped_on=None))
    points = trends.monthly_trend(make_facts(rows)).orderBy("period").collect()
    assert [(p.period, p.shipment_count, p.late_pct) for p in points] == [
        ("2024-01", 2, 100.0),
        ("2024-03", 1, 100.0),
    ]


def test_healthy_signals(make_facts):
    rows = [
        shipment(vendor=f"V{i % 5}", origin_country=f"C{i % 3}", lead_time_days=1 + i % 5)
        for i in range(20)
    ]
    rows += [shipment(upload_id="bad", delay_days=20)] * 2
    got = by_upload(healthy.healthy_signals(make_facts(rows)))
    assert got["u"].healthy_signals == [
        "100.0% of shipments arrived without a delay flag.",
        "Only 0.0% of shipments ran late.",
        "Average delay is 0.0 days across the book.",
        "Supply is spread across 5 vendors, limiting single-supplier exposure.",
        "Sourcing spans 3 origin countries.",
        "Consistently reliable vendors: V4, V3, V2.",
    ]
    assert got["bad"].healthy_signals == []


def test_vendor_rollup_and_distinct_vendors(make_shipments):
    rows = [shipment(vendor="A", delay_days=2), shipment(vendor="A"), shipment(vendor=None)]
    rolled = entities.vendor_rollup(make_shipments(rows)).orderBy(F.desc("shipment_count"), "vendor").collect()
    assert [(r.vendor, r.shipment_count, r.late_count) for r in rolled] == [("A", 2, 1), (None, 1, 0)]
    assert [r.vendor for r in entities.distinct_vendors(make_shipments(rows)).collect()] == ["A"]
