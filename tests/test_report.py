from __future__ import annotations

import json
from datetime import date

import pytest
from factories import shipment

from lanewise.operators import dimensions, entities, healthy, kpis, operations, risk, trends, views
from lanewise.plans import report as reports


def rich_rows():
    rows = []
    for u in ("one", "two"):
        for i in range(40):
            rows.append(
                shipment(
                    upload_id=u,
                    vendor=f"V{i % 6}",
                    origin_country=f"C{i % 4}",
                    destination=f"D{i % 5}",
                    delay_days=(i * 7) % 11 if i % 3 else 0,
                    shipped_on=date(2024, 1 + i % 5, 1),
                    carrier="AB"[i % 2],
                    transport_mode=["air", "road"][i % 2],
                    category="X",
                    freight_cost=20 if u == "one" else None,
                    co2_kg=5 if u == "one" else None,
                    damaged=i % 9 == 0 if u == "one" else None,
                    quantity_delivered=100 if u == "one" else None,
                    unit_cost=10 if u == "one" else None,
                )
            )
    rows.append(shipment(upload_id="undated", shipped_on=None))
    return rows


@pytest.fixture(scope="module")
def facts(make_facts):
    return make_facts(rich_rows()).cache()


@pytest.fixture(scope="module")
def found(facts):
    return reports.report(facts)


@pytest.fixture(scope="module")
def documents(found):
    return {r.upload_id: r for r in found.document().collect()}


def ranked(frame, upload, columns, order):
    rows = frame.where(f"upload_id = '{upload}'").orderBy(*entities.order_columns(order))
    return [tuple(r) for r in rows.select(*columns).collect()]


def test_nested_report_equals_its_sections(facts, documents):
    assert set(documents) == {"one", "two", "undated"}
    whole_kpis = {r.upload_id: r for r in kpis.kpis(facts).collect()}
    whole_risk = {r.upload_id: r for r in risk.composite_risk(facts).collect()}
    trend = {r.upload_id: r for r in trends.trend_direction(facts).collect()}
    signals = {r.upload_id: r for r in healthy.healthy_signals(facts).collect()}
    for u, doc in documents.items():
        assert doc.kpis.asDict() == {k: whole_kpis[u][k] for k in reports.KPI_COLUMNS}
        assert (doc.risk.score, doc.risk.level) == (whole_risk[u].score, whole_risk[u].level)
        assert doc.trend.direction == trend[u].direction
        assert doc.trend.commentary == trend[u].commentary
        assert doc.trend.delay_change_pct == trend[u].delay_change_pct
        assert doc.healthy_signals == signals[u].healthy_signals
    vendors = entities.vendor_health(facts, min_shipments=2)
    countries = entities.country_risk(facts)
    months = trends.monthly_trend(facts)
    for u in ("one", "two"):
        doc = documents[u]
        assert [tuple(v) for v in doc.vendors] == ranked(vendors, u, entities.VENDOR_COLUMNS, entities.VENDOR_ORDER)
        assert [tuple(c) for c in doc.countries] == ranked(countries, u, entities.COUNTRY_COLUMNS, entities.COUNTRY_ORDER)
        assert [tuple(p) for p in doc.trend.points] == ranked(months, u, trends.POINT_COLUMNS, ["period"])
        for name in ("carriers", "transport_modes", "lanes"):
            alone = dimensions.named_dimension(facts, name)
            worst = ranked(alone, u, dimensions.DIMENSION_COLUMNS, dimensions.DIMENSION_ORDER)
            assert [tuple(i) for i in doc[name]] == worst


def test_sections_without_data_are_absent(documents, facts):
    one, two = documents["one"], documents["two"]
    freight = operations.freight_cost(facts).collect()
    assert [r.upload_id for r in freight] == ["one"]
    assert tuple(one.cost) == tuple(freight[0])[1:]
    assert one.emissions.co2_by_mode_kg == {"air": 100.0, "road": 100.0}
    assert one.quality.damaged_count == 5
    assert (two.cost, two.quality, two.emissions) == (None, None, None)
    assert two.available_dimensions == ["carrier", "transport_mode", "category"]
    assert one.categories == [] and one.service_levels == []
    assert set(two.risk.components) == set(risk.COMPONENTS) - {"value_at_risk"}
    assert documents["undated"].vendors == [] and documents["undated"].trend.points == []


def test_sections_as_frames(found, facts):
    for name, direct in (
        ("vendors", entities.vendor_health(facts, min_shipments=2)),
        ("countries", entities.country_risk(facts)),
        ("months", trends.monthly_trend(facts)),
        ("lanes", dimensions.lanes(facts)),
    ):
        assert sorted(map(tuple, found.section(name).collect())) == sorted(map(tuple, direct.collect()))


def test_items_are_ranked_alike_in_the_flat_and_the_nested_form(found, documents):
    flat: dict = {}
    for r in found.items().orderBy("upload_id", "section", "position").collect():
        flat.setdefault((r.upload_id, r.section), []).append(r)
    for (upload, section), items in flat.items():
        assert [r.position for r in items] == list(range(1, len(items) + 1))
        if section == "months":
            assert [r.label for r in items] == [p.period for p in documents[upload].trend.points]
            continue
        nested = documents[upload][section]
        assert [r.label for r in items] == [i[0] for i in nested]
        for flat_item, item in zip(items, nested, strict=True):
            for name, value in item.asDict().items():
                assert name in ("vendor", "country", "label") or flat_item[name] == value
    heads = {r.upload_id: r for r in found.head().collect()}
    for upload, doc in documents.items():
        assert heads[upload].kpis == doc.kpis
        for name in reports.LIST_ORDERS:
            assert heads[upload][f"{name}_count"] == len(doc[name])
            assert len(flat.get((upload, name), [])) == len(doc[name])


def test_json_and_shareable_forms(found):
    whole = found.document()
    docs = {r.upload_id: json.loads(r.document) for r in reports.as_json(whole).collect()}
    assert docs["one"]["kpis"]["total_shipments"] == 40 and "cost" not in docs["two"]
    shared = {r.upload_id: r.document for r in reports.as_json(reports.shareable(whole)).collect()}
    assert "→ D" not in shared["one"]
    assert json.loads(shared["one"])["lane_count"] == len(docs["one"]["lanes"])


def test_global_report(facts):
    doc = reports.report(facts, ()).document().collect()
    assert len(doc) == 1 and doc[0].kpis.total_shipments == 81


def test_views(facts):
    rows = views.vendor_view(facts, limit=2).where("upload_id = 'one'").orderBy("rank").collect()
    assert [r.rank for r in rows] == [1, 2] and {r.vendors_scored for r in rows} == {6}
    assert views.vendor_view(facts, limit=99).where("upload_id = 'one'").count() == 6
    absent = views.dimension_view(facts, "service_levels").collect()
    assert {(r.upload_id, r.label) for r in absent} == {("one", None), ("two", None), ("undated", None)}
    assert all(r.note for r in absent)
    assert views.dimension_view(facts, "carriers").where("note is null").count() == 4
    operations_rows = {r.upload_id: r for r in views.operations_view(facts).collect()}
    assert operations_rows["two"].cost is None and operations_rows["one"].quality.damaged_count == 5
    assert operations_rows["one"].emissions.co2_by_mode_kg == {"air": 100.0, "road": 100.0}
    risks = {r.upload_id: r for r in views.risk_view(facts).collect()}
    assert risks["two"].components_not_measurable == ["value_at_risk"]
    assert sum(risks["two"].weights.values()) == pytest.approx(1.0, abs=1e-3)
