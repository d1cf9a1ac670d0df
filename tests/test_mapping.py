from lanewise.sources.headers import map_headers, mapper

FILES = {
    "plain": ["Unit Value", "TRANSIT_DAYS", "Source Region", "Shipper", "Lateness Days", "SKU Code"],
    "neighbours": ["Seller", "Haulier", "Molecule", "Label", "Segment", "Order Num"],
    "two ends": ["Waybill", "Consignee City", "Receiving Country"],
    "misspelt": ["Manufcturer", "Haulage Csot", "Transportr", "Unts Sold"],
    "foreign": ["Approved by", "Ledger", "Remarks", "Cost centre 4711", "Zz", "Ab"],
    "known first": ["Manufactrer", "Manufacturer"],
    "repeated": ["ref", "asn number", "partner", "partner", ""],
    "one each": ["Manufactrer", "Manufacturr"],
}


def mapped(spark, fuzzy=True, extra=None):
    rows = [(f, i, h) for f, names in FILES.items() for i, h in enumerate(names)]
    frame = spark.createDataFrame(rows, "file string, position int, header string")
    found: dict = {f: {} for f in FILES}
    for row in map_headers(frame, extra, fuzzy).collect():
        found[row.file][row.header] = (row.field, row.score, row.column)
    return found


def test_mapping(spark):
    found = mapped(spark)
    fields = {f: {h: m[0] for h, m in heads.items()} for f, heads in found.items()}
    assert list(fields["plain"].values()) == [
        "unit_cost", "lead_time_days", "origin_country", "vendor", "delay_days", "sku",
    ]
    assert list(fields["neighbours"].values()) == [
        "vendor", "carrier", "product", "brand", "category", "shipment_ref",
    ]
    assert fields["two ends"] == {
        "Waybill": "tracking_number",
        "Consignee City": "destination_city",
        "Receiving Country": "destination_country",
    }
    assert list(fields["misspelt"].values()) == ["vendor", "freight_cost", "carrier", "quantity"]
    assert all(0.87 < score < 1 for _, score, _ in found["misspelt"].values())
    assert set(fields["foreign"].values()) == {None}
    assert fields["known first"] == {"Manufactrer": None, "Manufacturer": "vendor"}
    assert found["known first"]["Manufacturer"][1] is None
    assert fields["repeated"] == {"ref": "shipment_ref", "asn number": None, "partner": "vendor"}
    assert found["repeated"]["partner"][2] == 3
    assert fields["one each"] == {"Manufactrer": "vendor", "Manufacturr": None}


def test_guessing_can_be_turned_off_and_names_added(spark):
    found = mapped(spark, fuzzy=False, extra={"priority": ["ledger"]})
    assert {m[0] for m in found["misspelt"].values()} == {None}
    assert found["foreign"]["Ledger"][0] == "priority"


def test_a_line_of_headers_is_mapped_without_spark():
    cells = mapper()(["Seller", "", "Seller", "Ledger"])
    assert [(c.header, c.position, c.column, c.field) for c in cells] == [
        ("Seller", 0, 2, "vendor"),
        ("Ledger", 3, 3, None),
    ]
