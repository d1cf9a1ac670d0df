from __future__ import annotations

from datetime import datetime

import pytest
from factories import shipment

from lanewise.operators import catalog, history, views

UPLOAD_DDL = (
    "upload_id string, user_id string, filename string, label string, row_count long,"
    " status string, created_at timestamp"
)
SNAPSHOT_DDL = (
    "id string, upload_id string, risk_score double, late_shipment_pct double,"
    " avg_delay_days double, delivery_success_rate double, created_at timestamp"
)


def day(n):
    return datetime(2024, 1, 1 + n)


@pytest.fixture(scope="module")
def uploads(spark):
    rows = [
        ("a", "ann", "q1.csv", "First Quarter", 10, "completed", day(0)),
        ("b", "ann", "q2.csv", None, 10, "completed", day(1)),
        ("c", "ann", "q3.csv", "Third quarter", 10, "completed", day(2)),
        ("d", "ann", "q4.csv", "Fourth", 10, "parsing", day(3)),
        ("e", "bob", "q1.csv", "First Quarter", 10, "completed", day(4)),
    ]
    rows += [(f"m{i}", "many", f"f{i}.csv", None, 1, "completed", day(i)) for i in range(15)]
    return spark.createDataFrame(rows, UPLOAD_DDL)


@pytest.fixture(scope="module")
def snapshots(spark):
    rows = [
        ("a1", "a", 10.0, 5.0, 1.0, 95.0, day(5)),
        ("a2", "a", 20.0, 10.0, 2.0, 90.0, day(6)),
        ("b1", "b", 30.0, None, 3.0, 80.0, day(6)),
        ("c1", "c", 40.0, 20.0, 4.0, 70.0, day(6)),
        ("c2", "c", None, None, None, None, day(7)),
        ("d1", "d", 99.0, 1.0, 1.0, 1.0, day(6)),
        ("e1", "e", 50.0, 1.0, 1.0, 1.0, day(6)),
    ]
    return spark.createDataFrame(rows, SNAPSHOT_DDL)


def test_latest_snapshot(snapshots):
    got = {r.upload_id: r.id for r in history.latest_snapshot(snapshots).collect()}
    assert got == {"a": "a2", "b": "b1", "c": "c2", "d": "d1", "e": "e1"}


def test_history(uploads, snapshots):
    points = history.history_points(uploads, snapshots)
    got = [(r.user_id, r.label, r.risk_score, r.late_shipment_pct) for r in points.orderBy("uploaded_at").collect()]
    # c's newest snapshot has no score and d is not completed.
    assert got == [
        ("ann", "First Quarter", 20.0, 10.0),
        ("ann", "q2.csv", 30.0, 0.0),
        ("bob", "First Quarter", 50.0, 1.0),
    ]
    trend = {r.user_id: r for r in history.history_direction(points).collect()}
    assert (trend["ann"].direction, trend["ann"].risk_delta) == ("worsening", 10.0)
    assert trend["ann"].summary == (
        "Across 2 uploads, the composite risk score moved from 20.0 to 30.0 (+10.0 on average,"
        " worsening). Late-shipment rate went from 10.0% to 0.0%, and average delay from 2.0 to"
        " 3.0 days."
    )
    assert (trend["bob"].direction, trend["bob"].risk_delta) == ("insufficient_data", None)
    shown = {r.dataset: r for r in views.history_view(points).where("user_id = 'ann'").collect()}
    assert set(shown) == {"First Quarter", "q2.csv"}
    assert {(r.direction, r.summary) for r in shown.values()} == {("worsening", trend["ann"].summary)}
    limited = history.history_points(uploads, snapshots, limit=1)
    assert {r.upload_id for r in limited.collect()} == {"e"}
    limited = history.history_points(uploads, snapshots, limit=2)
    assert {r.upload_id for r in limited.collect()} == {"b", "e"}


def test_compare(spark):
    names = list(history.COMPARED)
    figures = spark.createDataFrame(
        [("x", 40.0, 50.0, 5.0, 9.0, 80.0, 100.0, 3.0), ("y", 30.0, 50.04, 7.0, 9.0, 70.0, 90.0, 4.0)],
        ["upload_id", *names],
    )
    pairs = spark.createDataFrame([("x", "y")], ["before_id", "after_id"])
    got = {r.metric: (r.change, r.assessment) for r in history.compare_metrics(figures, pairs).collect()}
    assert got == {
        "risk_score": (-10.0, "better"),
        "late_shipment_pct": (0.04, "neutral"),
        "avg_delay_days": (2.0, "worse"),
        "p90_delay_days": (0.0, "neutral"),
        "delivery_success_rate": (-10.0, "worse"),
        "value_at_risk": (-10.0, "better"),
        "distinct_vendors": (1.0, "better"),
    }


def test_ownership(uploads, snapshots, make_shipments):
    rows = make_shipments([shipment(upload_id=u) for u in "aabe"])
    assert catalog.scope_to_owner(rows, uploads, "ann").count() == 3
    assert catalog.scope_to_owner(rows, uploads, "nobody").count() == 0
    ids = [r.id for r in catalog.analyses_for_user(snapshots, uploads, "ann").collect()]
    assert ids == ["c2", "d1", "c1", "b1", "a2", "a1"]
    left = catalog.without_uploads(rows, uploads.where("upload_id = 'a'"))
    assert sorted(r.upload_id for r in left.collect()) == ["b", "e"]


def test_pages_are_disjoint_and_newest_first(uploads):
    many = uploads.where("user_id = 'many'")
    first, second = (
        [r.upload_id for r in catalog.newest_uploads(many, 5, offset).orderBy("rank").collect()]
        for offset in (0, 5)
    )
    assert first == [f"m{i}" for i in range(14, 9, -1)] and not set(first) & set(second)
    pages = [catalog.page(many, ["upload_id"], 4, o).collect() for o in (0, 4, 12)]
    assert [len(p) for p in pages] == [4, 4, 3]
    order, last, walked = ["created_at", "upload_id"], None, []
    while found := catalog.page_after(many, order, 4, last).collect():
        walked += [r.upload_id for r in found]
        last = [found[-1][c] for c in order]
    assert walked == [f"m{i}" for i in range(15)]
    assert views.list_datasets(uploads).where("user_id = 'many'").count() == 12


def test_datasets_are_found_by_name(spark, uploads):
    requests = [
        ("newest", "ann", "", None),
        ("missing name", "ann", None, None),
        ("exact", "ann", "  first QUARTER ", None),
        ("part, newest first", "ann", "quarter", None),
        ("file name", "ann", "q2", None),
        ("label hides file name", "ann", "q1.csv", None),
        ("pinned", "ann", "anything", "b"),
        ("pinned elsewhere", "ann", "", "e"),
        ("other owner's", "bob", "fourth", None),
        ("old", "many", "f0.csv", None),
        ("no uploads", "eve", "", None),
    ]
    frame = spark.createDataFrame(
        requests, "request_id string, user_id string, name string, pinned_id string"
    )
    recent = catalog.resolve_dataset(uploads, frame, newest=12)
    assert {r.request_id: r.upload_id for r in recent.collect()}["old"] is None
    got = {r.request_id: r.upload_id for r in catalog.resolve_dataset(uploads, frame).collect()}
    assert got == {
        "newest": "d",
        "missing name": "d",
        "exact": "a",
        "part, newest first": "c",
        "file name": "b",
        "label hides file name": None,
        "pinned": "b",
        "pinned elsewhere": None,
        "other owner's": None,
        "old": "m0",
        "no uploads": None,
    }
