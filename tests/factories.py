"""Plain shipments for tests."""

from __future__ import annotations

from datetime import date

FACT_DDL = (
    "upload_id string, vendor string, origin_country string, destination string, product string,"
    " quantity int, unit_cost decimal(14,4), lead_time_days int, delay_days int, status string,"
    " shipped_on date, carrier string, transport_mode string, service_level string,"
    " category string, freight_cost decimal(14,4), total_cost decimal(14,4),"
    " weight_kg decimal(14,3), co2_kg decimal(14,3), damaged boolean, returned boolean,"
    " quantity_delivered int"
)
FACT_NAMES = [c.strip().split()[0] for c in FACT_DDL.replace("(14,4)", "").replace("(14,3)", "").split(",")]


def shipment(**changes):
    """A shipment as a plain dict, on time unless told otherwise."""
    row = {
        "upload_id": "u",
        "vendor": "Fjord Rope",
        "origin_country": "Norway",
        "destination": "Oulu quay",
        "product": "Mooring line",
        "quantity": 100,
        "unit_cost": 10,
        "lead_time_days": 10,
        "delay_days": 0,
        "shipped_on": date(2021, 11, 5),
    }
    row.update(changes)
    row.setdefault("status", "delayed" if (row["delay_days"] or 0) > 0 else "on_time")
    return row
