from __future__ import annotations

import pytest
from factories import shipment
from pyspark.sql import functions as F

from lanewise.operators import dimensions, operations
from lanewise.operators.entities import order_columns


def test_dimension_drops_missing_labels_and_small_groups(make_facts):
    rows = [shipment(carrier="A", delay_days=3, lead_time_days=None)] * 2
    rows += [shipment(carrier="B", freight_cost=50)] * 6 + [shipment(carrier="C")]
    rows += [shipment(carrier=None)] * 5 + [shipment(carrier="")] * 3
    got = dimensions.carriers(make_facts(rows)).orderBy("label").collect()
    assert [(r.label, r.shipment_count, r.share_pct, r.late_pct) for r in got] == [
        ("A", 2, 25.0, 100.0),
        ("B", 6, 75.0, 0.0),
    ]
    assert (got[0].avg_transit_days, got[0].avg_freight_cost) == (None, None)
    assert (got[1].avg_transit_days, got[1].avg_freight_cost) == (10.0, 50.0)


def test_a_dimension_with_nothing_to_compare_is_empty(make_facts):
    rows = [shipment(carrier="A")] * 3 + [shipment(carrier="B")]
    rows += [shipment(upload_id="two", carrier=c) for c in "AABB"]
    got = dimensions.carriers(make_facts(rows)).collect()
    assert {r.upload_id for r in got} == {"two"}
    assert dimensions.transport_modes(make_facts(rows)).count() == 0


def test_any_expression_can_be_the_key(make_facts):
    rows = [shipment(quantity=q) for q in (1, 2, 1, 2, 3)]
    size = F.when(F.col("quantity") > 1, "big").otherwise("small")
    got = {r.label: r.shipment_count for r in dimensions.dimension_score(make_facts(rows), size).collect()}
    assert got == {"big": 3, "small": 2}


def test_lanes_need_two_ends_and_are_cut_to_the_worst_twelve(make_facts):
    rows = [shipment(destination=f"D{i:02}", delay_days=i) for i in range(15) for _ in range(2)]
    rows += [shipment(destination=None)] * 4 + [shipment(origin_country=None)] * 4
    worst = order_columns(dimensions.DIMENSION_ORDER)
    got = dimensions.lanes(make_facts(rows)).orderBy(*worst).collect()
    assert [r.label for r in got] == [f"Norway → D{i:02}" for i in range(14, 2, -1)]
    assert sum(r.share_pct for r in got) == pytest.approx(12 * 2 / 30 * 100, abs=0.1)


def test_all_dimensions_agree_with_each_alone(make_facts):
    rows = [
        shipment(carrier="AB"[i % 2], transport_mode=["air", "road", None][i % 3], category="X",
                 service_level="SML"[i % 3], destination=f"D{i % 4}", delay_days=i % 5)
        for i in range(24)
    ]
    facts = make_facts(rows)
    together: dict = {}
    for r in dimensions.all_dimensions(facts).drop("upload_id").collect():
        values = r.asDict()
        together.setdefault(values.pop("section"), []).append(tuple(values.values()))
    assert set(together) == {"carriers", "transport_modes", "service_levels", "lanes"}
    for name, found in together.items():
        alone = dimensions.named_dimension(facts, name).drop("upload_id").collect()
        assert sorted(found) == sorted(tuple(r) for r in alone)


def test_unknown_dimension_lists_the_choices(make_facts):
    with pytest.raises(ValueError, match="carriers, transport_modes"):
        dimensions.named_dimension(make_facts([shipment()]), "colour")


def test_freight(make_facts):
    rows = [shipment(freight_cost=200, total_cost=1200, weight_kg=w) for w in (10, 10, 0, None, 20)]
    c = operations.freight_cost(make_facts(rows)).first()
    assert (c.total_freight_cost, c.avg_freight_cost, c.freight_per_unit) == (1000.0, 200.0, 2.0)
    assert (c.freight_pct_of_goods, c.freight_per_kg, c.total_landed_cost) == (20.0, 25.0, 6000.0)
    assert (c.coverage_pct, c.freight_spent_on_late_shipments) == (100.0, 0.0)


def test_freight_parts_that_cannot_be_computed_are_missing(make_facts):
    rows = [shipment(freight_cost=10, quantity=None, unit_cost=None, delay_days=1)] * 3
    c = operations.freight_cost(make_facts(rows)).first()
    assert (c.freight_per_unit, c.freight_per_kg, c.freight_pct_of_goods) == (None, None, None)
    assert (c.total_landed_cost, c.freight_spent_on_late_shipments) == (None, 30.0)


@pytest.mark.parametrize(
    ("filled", "total", "present"), [(2, 3, False), (3, 3, True), (3, 15, True), (19, 100, False), (20, 100, True)]
)
def test_sections_need_three_rows_and_a_fifth(make_facts, filled, total, present):
    rows = [shipment(freight_cost=5, damaged=False, co2_kg=1, transport_mode="air")] * filled
    facts = make_facts(rows + [shipment()] * (total - filled))
    assert (operations.freight_cost(facts).count() == 1) is present
    assert (operations.emissions(facts).count() == 1) is present
    assert (operations.emissions_by_mode(facts).count() == 1) is present
    quality = operations.order_quality(facts).first()
    assert (quality is not None) is present


def test_quality(make_facts):
    rows = [shipment(damaged=i < 2, returned=False) for i in range(10)]
    q = operations.order_quality(make_facts(rows)).first()
    assert (q.damage_rate_pct, q.damaged_count, q.return_rate_pct, q.coverage_pct) == (20.0, 2, 0.0, 100.0)
    assert q.avg_fill_rate_pct is None


def test_perfect_orders_and_fill_rate(make_facts):
    rows = [
        shipment(quantity_delivered=100, damaged=False),
        shipment(quantity_delivered=90, damaged=False),
        shipment(quantity_delivered=100, damaged=True),
        shipment(quantity_delivered=120, damaged=False, delay_days=1),
    ]
    facts = make_facts(rows)
    q = operations.order_quality(facts).first()
    assert (q.perfect_order_rate_pct, q.avg_fill_rate_pct) == (25.0, 97.5)
    assert operations.perfect_order(facts).first().perfect_order_rate_pct == 25.0


def test_fill_alone_makes_a_section_but_is_not_coverage(make_facts):
    q = operations.order_quality(make_facts([shipment(quantity_delivered=50)] * 3)).first()
    assert (q.avg_fill_rate_pct, q.damage_rate_pct, q.coverage_pct) == (50.0, None, 0.0)


def test_emissions(make_facts):
    rows = [shipment(transport_mode="air", co2_kg=100)] * 2 + [shipment(transport_mode="ocean", co2_kg=10)] * 2
    rows += [shipment(co2_kg=5)]
    facts = make_facts(rows)
    e = operations.emissions(facts).first()
    assert (e.total_co2_kg, e.avg_co2_per_shipment_kg, e.coverage_pct) == (225.0, 45.0, 100.0)
    modes = {r.transport_mode: r.co2_kg for r in operations.emissions_by_mode(facts).collect()}
    assert modes == {"air": 200.0, "ocean": 20.0}


def test_coverage_is_in_a_fixed_order(make_facts):
    rows = [shipment(returned=False, carrier="A", weight_kg=1)] + [shipment()] * 4
    rows += [shipment(upload_id="sparse", carrier="A")] + [shipment(upload_id="sparse")] * 5
    got = operations.coverage(make_facts(rows)).orderBy("upload_id", "position").collect()
    assert [(r.upload_id, r.dimension, r.position) for r in got] == [
        ("u", "carrier", 1),
        ("u", "weight", 6),
        ("u", "returns", 9),
    ]
