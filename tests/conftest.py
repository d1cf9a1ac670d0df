from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from factories import FACT_DDL, FACT_NAMES  # noqa: E402

from lanewise.operators.facts import facts as facts_of  # noqa: E402
from lanewise.session import local_session  # noqa: E402

@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "tests",
        4,
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_shipments(spark):
    from decimal import Decimal

    def make(rows):
        def cell(row, name):
            value = row.get(name)
            if name in ("unit_cost", "freight_cost", "total_cost", "weight_kg", "co2_kg"):
                return None if value is None else Decimal(str(value))
            return value

        data = [tuple(cell(r, n) for n in FACT_NAMES) for r in rows]
        return spark.createDataFrame(data, FACT_DDL)

    return make


@pytest.fixture(scope="session")
def make_facts(make_shipments):
    return lambda rows: facts_of(make_shipments(rows))
