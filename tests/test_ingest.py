from __future__ import annotations

from datetime import date

import pytest

from lanewise.sources import exports, store

FILES = {
    "plain.csv": b"ref,seller,item,source country,consignee,units,unit value,transit days,state,delay,dispatch date\n"
    b"K-17,Lofoten,Buoy,Norway,Oulu,40,12.25,6,late,3,2021-11-05\n"
    b"K-18,Kvass,Anchor,Latvia,Turku,7,310.00,9,early,0,2021-11-06\n",
    "two dates.csv": b"Record ID,Partner,Required Date,Goods Receipt Date,Pack Price,Pack\n"
    b"11,Lofoten,2021-05-01,2021-05-12,2.5,8\n"
    b"12,Kvass,2021-06-01,2021-06-01,3.5,4\n"
    b"13,Lofoten,2021-07-01,2021-07-29,4.5,2\n",
    "us times.csv": b"Order Num,Days for Shipping (real),Days for Shipment (scheduled),Fulfilment Status,order date (DateOrders)\n"
    b"90,5,3,Late delivery,7/19/2021 18:05\n91,1,3,Advance shipping,8/3/2021 4:30\n",
    "tabs.csv": b"seller\tdelay\nLofoten\t4\nKvass\t1\n",
    "pipes.csv": b"seller|delay\nLofoten|6\n",
    "semicolons.csv": b"seller;delay;origin\nLofoten;2;Norway\nKvass;0;Latvia\n",
    "blank.csv": b"seller,delay\nLofoten,4\n\n,\n   \n,\n",
    "tokens.csv": b"seller,delay,units\nLofoten,4,70\n#N/A,nil,--\n",
    "titled.csv": b"Harbour log of the week,,\nprinted on Monday,,\n\nseller,delay,origin\n"
    b"Lofoten,2,Norway\nKvass,0,Latvia\nseller,delay,origin\n",
    "values.csv": b'seller,unit value,units,dispatch date\nLofoten,"$2,310.25","3,400","Nov 05, 2021"\nKvass,"(75.50)",many,soon\n',
    "bom.csv": "﻿seller,delay\nTromsø,4\n".encode(),
    "windows.csv": "seller,delay\nKöln – Ost €,5\n".encode("cp1252"),
    "latin.csv": b"seller,delay\nK\xf6ln\x81,5\n",
    "lines.csv": b'seller,delay,remark\n"Upper\ndeck",2,"he said ""aye"" twice"\nLofoten,1\nKvass,2,p,q,r\n',
    "inches.csv": b'item,delay,seller\n5" pipe,1,Lofoten\n7" pipe,2,Kvass\nrope,3,Kvass\n',
    "parts.csv": b"seller,consignee city,receiving country,gross weight,route distance,transport mode,haulage cost\n"
    b"Lofoten,Gdynia,PL,2000,250,Sea,7.5\nKvass,,PL,,250,Sea,\n",
    "early.csv": b"seller,delay\nLofoten,-6\n",
    "sellers only.csv": b"seller,item\nLofoten,Buoy\n",
    "guess.csv": b"Manufactrer,Unts Sold,Ledger\nLofoten,9,x\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("exports")
    for name, content in FILES.items():
        (path / name).write_bytes(content)
    return str(path)


@pytest.fixture(scope="module")
def planned(spark, folder):
    return exports.plan_ingest(spark, folder)


@pytest.fixture(scope="module")
def rows(planned):
    found: dict = {}
    for row in planned.shipments.collect():
        found.setdefault(row.upload_id, []).append(row)
    return found


@pytest.fixture(scope="module")
def reports(planned):
    return {r.upload_id: r for r in planned.report().collect()}


def values(rows, name, *columns):
    return sorted(tuple(r[c] for c in columns) for r in rows[name])


def test_plain_file(rows, reports):
    assert values(rows, "plain", "shipment_ref", "vendor", "delay_days", "status") == [
        ("K-17", "Lofoten", 3, "delayed"),
        ("K-18", "Kvass", 0, "on_time"),
    ]
    assert sorted(float(r.unit_cost) for r in rows["plain"]) == [12.25, 310.0]
    assert (reports["plain"].accepted_rows, reports["plain"].rejected_rows) == (2, 0)


def test_delays_are_derived_and_counted(rows, reports):
    assert values(rows, "two dates", "shipment_ref", "delay_days", "status", "shipped_on") == [
        ("11", 11, "delayed", date(2021, 5, 12)),
        ("12", 0, "on_time", date(2021, 6, 1)),
        ("13", 28, "delayed", date(2021, 7, 29)),
    ]
    assert reports["two dates"].derived_delays == 3
    assert reports["two dates"].detected_columns["actual_delivery"] == "Goods Receipt Date"


def test_headers_in_brackets_and_times_of_day(rows, reports):
    detected = reports["us times"].detected_columns
    assert detected["lead_time_days"] == "Days for Shipment (scheduled)"
    assert detected["transit_days"] == "Days for Shipping (real)"
    assert values(rows, "us times", "shipped_on", "status", "lead_time_days", "transit_days") == [
        (date(2021, 7, 19), "delayed", 3, 5),
        (date(2021, 8, 3), "on_time", 3, 1),
    ]


def test_separators(rows):
    assert values(rows, "tabs", "vendor", "delay_days") == [("Kvass", 1), ("Lofoten", 4)]
    assert values(rows, "pipes", "vendor", "delay_days") == [("Lofoten", 6)]
    assert values(rows, "semicolons", "vendor", "origin_country") == [("Kvass", "Latvia"), ("Lofoten", "Norway")]


def test_blank_lines_are_skipped_and_blank_records_rejected(reports):
    assert (reports["blank"].accepted_rows, reports["blank"].rejected_rows) == (1, 3)
    assert (reports["tokens"].accepted_rows, reports["tokens"].rejected_rows) == (1, 1)


def test_lines_above_the_header(rows, reports):
    # A header that occurs again further down is a row like any other.
    assert values(rows, "titled", "vendor") == [("Kvass",), ("Lofoten",), ("seller",)]
    assert any("3 line(s) above the header" in w for w in reports["titled"].warnings)
    assert not any("above the header" in w for w in reports["plain"].warnings)


def test_values(rows):
    got = {r.vendor: r for r in rows["values"]}
    assert (float(got["Lofoten"].unit_cost), got["Lofoten"].quantity) == (2310.25, 3400)
    assert got["Lofoten"].shipped_on == date(2021, 11, 5)
    assert float(got["Kvass"].unit_cost) == -75.5
    assert got["Kvass"].quantity is None and got["Kvass"].shipped_on is None


def test_encodings(rows):
    assert rows["bom"][0].vendor == "Tromsø"
    assert rows["windows"][0].vendor == "Köln – Ost €"
    assert rows["latin"][0].vendor == "Köln\x81"


def test_quoted_line_breaks_short_and_long_records(rows):
    assert values(rows, "lines", "vendor", "delay_days") == [("Kvass", 2), ("Lofoten", 1), ("Upper\ndeck", 2)]
    assert values(rows, "inches", "product", "delay_days") == [('5" pipe', 1), ('7" pipe', 2), ("rope", 3)]


def test_derived_columns(rows):
    got = {r.vendor: r for r in rows["parts"]}
    assert (got["Lofoten"].destination, got["Kvass"].destination) == ("Gdynia, PL", "PL")
    assert float(got["Lofoten"].co2_kg) == 6.0 and got["Kvass"].co2_kg is None
    assert float(got["Lofoten"].total_cost) == 7.5 and got["Kvass"].total_cost is None
    assert rows["early"][0].delay_days == 0


def test_advice(reports):
    advice = " ".join(reports["sellers only"].warnings).lower()
    assert "delay" in advice and "date" in advice and "vendor column" not in advice
    assert any("vendor" in w for w in reports["us times"].warnings)


def test_guesses_are_reported(reports):
    assert set(reports["guess"].fuzzy_columns) == {"Manufactrer", "Unts Sold"}
    assert reports["guess"].unmapped_columns == ["Ledger"]


def test_result_has_the_canonical_schema(planned, spark):
    from lanewise import schema

    got = [(f.name, f.dataType.simpleString()) for f in planned.shipments.schema]
    assert got == [("upload_id", "string")] + [
        (name, kind) for name, kind, _ in schema.SHIPMENT_FIELDS
    ]


def test_row_cap(spark, tmp_path):
    body = "".join(f"V{i},1\n" + (",\n" if i == 3 else "") for i in range(60))
    (tmp_path / "long.csv").write_text("seller,delay\n" + body)
    (tmp_path / "short.csv").write_text("seller,delay\nA,1\n")
    capped = exports.plan_ingest(spark, str(tmp_path), max_rows=5)
    report = {r.upload_id: r for r in capped.report().collect()}
    assert (report["long"].accepted_rows, report["long"].rejected_rows) == (5, 1)
    assert report["long"].truncated and any("beyond the limit" in w for w in report["long"].warnings)
    assert not report["short"].truncated
    kept = capped.shipments.where("upload_id = 'long'").collect()
    assert sorted(r.vendor for r in kept) == ["V0", "V1", "V2", "V3", "V4"]


def test_files_are_read_alike_whatever_their_size(spark, tmp_path):
    """Blank lines, quoted breaks, inch marks, and a path with a blank, a percent sign and a plus."""
    body = "".join(f'V{i},{i % 7},5" pipe\n' + ("   \n" if i % 5 == 0 else "") for i in range(900))
    place = tmp_path / "a b%20c+d"
    place.mkdir()
    (place / "some file.csv").write_text("seller,delay,item\n" + body + '"one\nseller",1,x\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    seen = []
    try:
        for size in (before, "4096b"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            planned = exports.plan_ingest(spark, str(place))
            counts = planned.counts().collect()
            seen.append((counts, sorted(r.vendor for r in planned.shipments.collect())))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert seen[0] == seen[1]
    (counts,), vendors = seen[0]
    assert (counts.accepted_rows, counts.rejected_rows, len(vendors)) == (901, 180, 901)


def test_files_without_line_breaks_in_cells_can_be_split(spark, tmp_path):
    (tmp_path / "long.csv").write_text("seller,delay\n" + "".join(f"V{i},{i % 7}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096b")
    try:
        planned = exports.plan_ingest(spark, str(tmp_path))
        assert planned.shipments.rdd.getNumPartitions() > 1
        assert planned.shipments.count() == 3000
        capped = exports.plan_ingest(spark, str(tmp_path), max_rows=1234).shipments
        assert {r.vendor for r in capped.collect()} == {f"V{i}" for i in range(1234)}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_nothing_is_lost_in_silence(spark, tmp_path):
    (tmp_path / "full.csv").write_text("seller,delay\nLofoten,1\n")
    (tmp_path / "header.csv").write_text("seller,delay\n")
    (tmp_path / "zero.csv").write_bytes(b"")
    (tmp_path / "late.csv").write_bytes(b"seller,delay\n" + b"Lofoten,1\n" * 8000 + "Köln,2\n".encode("cp1252") * 3)
    mixed = "Øre,1\n".encode() * 9 + "Köln,2\n".encode("cp1252") * 3 + "true \ufffd,1\n".encode()
    (tmp_path / "mixed.csv").write_bytes(b"seller,delay\n" + mixed)
    lenient = exports.plan_ingest(spark, str(tmp_path), strict=False)
    report = {r.upload_id: r for r in lenient.report().collect()}
    names = ("full", "header", "zero", "late", "mixed")
    assert set(report) == set(names)
    assert [report[u].accepted_rows for u in names] == [1, 0, 0, 8003, 13]
    assert [report[u].damaged_rows for u in names] == [0, 0, 0, 0, 3]
    vendors = {r.vendor for r in lenient.shipments.where("upload_id <> 'mixed'").collect()}
    assert vendors == {"Lofoten", "Köln"}
    assert any("No usable rows" in w for w in report["header"].warnings)
    assert any("no header" in w for w in report["zero"].warnings)
    assert any("encoding" in w for w in report["mixed"].warnings)
    for name, message in (("header", "No usable rows"), ("zero", "No usable rows"), ("mixed", "encoding")):
        with pytest.raises(ValueError, match=message):
            exports.plan_ingest(spark, [str(tmp_path / f"{name}.csv"), str(tmp_path / "full.csv")]).report()


def test_very_many_layouts_are_one_commit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exports, "LAYOUTS_PER_JOB", 3)
    for i in range(7):
        (tmp_path / f"f{i}.csv").write_text(f"seller,extra {i}\nV{i},1\n")
    planned = exports.plan_ingest(spark, str(tmp_path))
    assert len(planned.layouts) == 7
    table = str(tmp_path / "table")
    assert planned.append_to(table).where("accepted_rows = 1").count() == 7
    stored = store.read(spark, table)
    assert sorted(r.vendor for r in stored.collect()) == [f"V{i}" for i in range(7)]
    assert sorted(stored.columns) == sorted(planned.shipments.columns)


def test_failures(spark, tmp_path):
    def write(name, content):
        (tmp_path / name).write_bytes(content)
        return str(tmp_path / name)

    unknown = write("unknown.csv", b"north,south,east\n1,2,3\n")
    with pytest.raises(ValueError, match="No recognisable") as caught:
        exports.plan_ingest(spark, unknown)
    assert caught.value.details["found_headers"] == ["north", "south", "east"]
    with pytest.raises(ValueError, match="no header"):
        exports.plan_ingest(spark, write("empty.csv", b""))
    with pytest.raises(ValueError, match="No usable rows"):
        exports.plan_ingest(spark, write("header.csv", b"seller,delay\n")).report()
    with pytest.raises(ValueError, match="limit"):
        exports.plan_ingest(spark, unknown, max_bytes=10)
    with pytest.raises(ValueError, match=r"\.csv"):
        exports.plan_ingest(spark, write("shipments.xlsx", b"x"))
    lenient = exports.plan_ingest(spark, [unknown, write("fine.csv", b"seller\nLofoten\n")], strict=False)
    assert [len(lenient.layouts), len(lenient.problems)] == [1, 1]


@pytest.mark.parametrize(
    "header", ["Agreed Delivery Date", "Planned Arrival", "Target Date", "Order Estimated Delivery Date"]
)
def test_promised_dates(header):
    from lanewise.sources.headers import plain_name
    from lanewise.vocabulary import header_names

    assert plain_name(header) in header_names()["scheduled_delivery"]
