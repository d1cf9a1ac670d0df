"""A few registered queries against their SQL at the smallest size.

``tests/oracle.py`` runs all of them at any size.
"""

from __future__ import annotations

from pathlib import Path

import oracle
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).is_dir(), reason="test tables not there")


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    missing = set(entry.queries()) - set(entry.oracle_sql())
    assert {n for n in missing if not n.startswith("op")} <= {"pipeline"}


@pytest.mark.parametrize(
    "name",
    ["kpis", "composite_risk", "dim_lanes", "trend_direction", "coerce_dates", "derive_status",
     "top_vendors", "risk_drivers"],
)
def test_query_equals_its_sql(spark, name):
    good, note = oracle.compare(spark, oracle.connect(FOLDER), name, FOLDER)
    assert good, note


def test_entry_gives_rows(spark):
    assert entry.entry(spark).columns[:2] == ["upload_id", "vendor"]
