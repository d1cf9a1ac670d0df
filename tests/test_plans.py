"""The shape of physical plans: what is read, what is shuffled, what is broadcast."""

from __future__ import annotations

import re

import pytest
from factories import FACT_DDL, shipment

from lanewise.operators import dimensions, entities, kpis, risk, trends
from lanewise.operators.facts import facts as facts_of
from lanewise.operators.measures import section_rollup
from lanewise.plans import report as reports
from lanewise.sources import exports, store


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory, make_shipments):
    path = str(tmp_path_factory.mktemp("plans") / "table")
    store.append(make_shipments([shipment(upload_id=u) for u in "ab"]), path)
    return facts_of(store.read(spark, path, FACT_DDL))


def leaves(frame):
    found = frame._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [found.apply(i).getClass().getSimpleName() for i in range(found.size())]


def scans(text):
    return len(re.findall(r"FileScan parquet", text))


def read_columns(text):
    return [set(re.findall(r"(\w+):", m)) for m in re.findall(r"ReadSchema: struct<(.*?)>(?:\n|$)", text)]


def test_headline_figures_read_the_facts_twice_and_only_what_they_need(stored):
    text = plan(kpis.kpis(stored))
    assert scans(text) == 2
    wanted = {"delay_days", "lead_time_days", "quantity", "unit_cost", "status"}
    assert sorted(read_columns(text), key=len) == [{"vendor", "origin_country"}, wanted]


def test_aggregations_combine_before_they_shuffle(stored):
    for frame in (
        kpis.delay_histogram(stored),
        section_rollup(stored),
        entities.vendor_health(stored),
        trends.monthly_trend(stored),
    ):
        text = plan(frame)
        assert "partial_" in text and text.index("partial_") > text.index("Exchange")


def test_all_grouped_sections_take_one_scan_and_one_shuffle(stored):
    text = plan(section_rollup(stored))
    assert scans(text) == 1 and text.count("Exchange hashpartitioning") == 1


def test_a_report_scans_the_facts_twice(stored):
    found = reports.report(stored)
    assert scans(plan(found.headline)) == 1
    # Everything but the headline figures comes from the written rollup.
    assert plan(found.head()).count("delay_days:") == 1
    assert "delay_days:" not in plan(found.items())
    assert set(leaves(found.document())) == {"LogicalRelation"}


def test_rankings_sort_once(stored):
    for frame in (dimensions.lanes(stored), trends.last_periods(trends.monthly_trend(stored))):
        assert "rangepartitioning" not in plan(frame)


def test_nothing_is_collected_in_one_task(stored):
    """No window over a whole dataset's labels, no single-partition exchange, no cross join."""
    frames = [
        kpis.kpis(stored),
        entities.vendor_shares(stored),
        entities.country_exposure(stored),
        risk.composite_risk(stored),
        dimensions.carriers(stored),
    ]
    for frame in frames:
        text = plan(frame)
        assert "Window" not in text and "SinglePartition" not in text
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text


def test_worst_lanes_are_cut_before_the_shuffle(stored):
    text = plan(dimensions.lanes(stored))
    assert re.search(r"WindowGroupLimit .*Partial", text)


def test_ingest_is_one_narrow_stage_that_reads_the_mapped_columns(spark, tmp_path):
    (tmp_path / "a.csv").write_text("vendor,notes,delay_days,ship date\nLofoten,x,1,2024-01-01\n")
    planned = exports.plan_ingest(spark, str(tmp_path))
    text = plan(planned.shipments)
    assert "Exchange" not in text and "Python" not in text
    assert read_columns(text) == [{"_c0", "_c2", "_c3"}]
