"""Work is done once: facts are scanned once by a view, files are split natively, limits stop reading."""

from __future__ import annotations

import pytest
from factories import FACT_DDL, shipment

from lanewise.operators import healthy, views
from lanewise.operators.facts import facts as facts_of
from lanewise.plans import ingest_queries
from lanewise.sources import exports, headers, store, yearly_exports


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "view", [views.risk_view, views.operations_view, views.dimension_views, healthy.healthy_signals]
)
def test_a_view_scans_the_facts_once(spark, tmp_path, make_shipments, monkeypatch, view):
    path = str(tmp_path / "table")
    store.append(make_shipments([shipment(upload_id=u) for u in "ab"]), path)
    kept, real = [], store.kept
    monkeypatch.setattr(store, "kept", lambda rows, name: kept.append(rows) or real(rows, name))
    shown = view(facts_of(store.read(spark, path, FACT_DDL)))
    assert len(kept) == 1 and plan(kept[0]).count("FileScan parquet") == 1
    assert set(shown.inputFiles()).isdisjoint(store.read(spark, path, FACT_DDL).inputFiles())
    assert {r.upload_id for r in shown.collect()} == {"a", "b"}


def test_all_dimensions_as_one_by_one(make_facts):
    rows = [shipment(carrier=c, category=None, delay_days=d) for c in "AB" for d in (0, 2, 3)]
    facts = make_facts([*rows, shipment(upload_id="bare", carrier=None)])
    every = views.dimension_views(facts)
    single = [views.dimension_view(facts, name) for name in ("carriers", "categories", "lanes")]
    for seen in single:
        name = seen.first().dimension
        assert sorted(map(str, every.where(f"dimension = '{name}'").collect())) == sorted(map(str, seen.collect()))


def test_closed_quotes_and_blank_rows_between_tabs_need_no_record_reader(spark, tmp_path):
    (tmp_path / "a.csv").write_text('vendor,delay days,unit price\nV0,1,"$1,200"\nV1,2,"5"" pipe, x"\n')
    (tmp_path / "b.csv").write_text("vendor\tdelay days\nV2\t3\n\t\nV3\t4\n")
    (tmp_path / "c.csv").write_text('vendor;delay days;product\nV4;5;"two\nlines"\n')
    planned = exports.plan_ingest(spark, str(tmp_path))
    found = {layout.delimiter: (layout.special, layout.crossing) for layout in planned.layouts}
    assert found == {",": (False, False), "\t": (True, False), ";": (True, True)}
    rows = planned.staging.select("vendor", "delay_days", "_accepted").collect()
    assert sorted((r.vendor, r.delay_days) for r in rows if r._accepted) == [(f"V{i}", i + 1) for i in range(5)]
    assert sum(not r._accepted for r in rows) == 1


def test_a_limit_reads_only_the_files_that_it_reaches(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.csv").write_text("vendor,delay days\n" + f"{name},1\n" * 20)
    planned = exports.plan_ingest(spark, str(tmp_path), "one", max_rows=25)
    names = [p[-5:] for layout in planned._within_limit().layouts for p in layout.paths]
    assert sorted(names) == ["a.csv", "b.csv"]
    assert sorted(r.vendor for r in planned.shipments.collect()) == ["a"] * 20 + ["b"] * 5


def test_a_report_alone_stages_nothing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("vendor,delay days\nV,1\n,\n")
    planned = exports.plan_ingest(spark, str(tmp_path))
    found = planned.report().first()
    assert (found.accepted_rows, found.rejected_rows) == (1, 1) and "_staged" not in planned.__dict__


def test_an_export_is_one_file_a_year_however_its_rows_are_dealt(spark, tmp_path):
    day = "date'2020-01-01'"
    base = spark.range(0, 60, 1, 6).selectExpr(
        "string(1996 + id % 3) AS upload_id", "id AS l_orderkey", "1 AS l_linenumber", "'V' AS vendor",
        "'A' AS origin_country", "'B' AS destination", "'P' AS product", "'C' AS category", "'S' AS service_level",
        "5 AS quantity", "1.5BD AS unit_cost", f"{day} AS shipped_on", f"{day} AS scheduled_delivery",
        f"{day} AS actual_delivery", "0 AS delay_days", "3 AS lead_time_days", "'on_time' AS status", "'X' AS carrier",
        "'air' AS transport_mode", "2.5BD AS freight_cost", "1BD AS weight_kg", "1BD AS distance_km", "true AS damaged",
        "false AS returned", "5 AS quantity_delivered",
    )
    folder = yearly_exports.write_exports(base, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").rglob("*.csv"))
    assert len(files) == 3
    planned = exports.plan_ingest(spark, folder, exports.hive_folder)
    counts = {r.upload_id: (r.accepted_rows, r.rejected_rows) for r in planned.report().collect()}
    assert counts == {"1996": (20, 1), "1997": (20, 0), "1998": (20, 1)}


def test_header_cells_are_dealt_once(spark, tmp_path):
    spark.range(40).selectExpr("id % 30 AS o_orderkey").write.parquet(str(tmp_path / "orders.parquet"))
    mapped = ingest_queries.map_headers(spark, str(tmp_path))
    assert plan(mapped).count("Exchange hashpartitioning") == 1
    assert mapped.select("file").distinct().count() == 30


def test_equal_headers_at_other_places_keep_their_places(spark):
    rows = [("a", 0, "Vendor"), ("a", 1, "Qty"), ("b", 3, "Vendor"), ("b", 5, "Qty"), ("c", 0, "Vendor"), ("c", 1, "Qty")]
    found = headers.map_headers(spark.createDataFrame(rows, "file string, position int, header string")).collect()
    assert sorted((r.file, r.column, r.field) for r in found) == [
        (f, p, "vendor" if h == "Vendor" else "quantity") for f, p, h in rows
    ]
