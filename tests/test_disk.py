"""What large tables leave on disk: no scratch tables or shuffle files once they have served, no shuffles to lay out files."""

from __future__ import annotations

import time

import pytest

from lanewise.sources import exports, store, yearly_exports
from lanewise.streaming import uploads


@pytest.fixture
def scratch(tmp_path, monkeypatch):
    """The folder that tables of the ingest are kept in."""
    folder = tmp_path / "scratch"
    numbers = iter(range(1000))
    for module in (store, exports):
        monkeypatch.setattr(module, "scratch_path", lambda _spark, name: f"{folder}/{name}-{next(numbers)}")
    return folder


def kept(scratch, name):
    return [p for p in scratch.rglob("*.parquet") if p.relative_to(scratch).parts[0].startswith(name)]


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def base(spark):
    day = "date'2020-01-01'"
    return spark.range(0, 60, 1, 6).selectExpr(
        "nullif(string(1996 + id % 4), '1999') AS upload_id", "id AS l_orderkey", "1 AS l_linenumber", "'V' AS vendor",
        "'A' AS origin_country", "'B' AS destination", "'P' AS product", "'C' AS category", "'S' AS service_level",
        "5 AS quantity", "1.5BD AS unit_cost", f"{day} AS shipped_on", f"{day} AS scheduled_delivery",
        f"{day} AS actual_delivery", "0 AS delay_days", "3 AS lead_time_days", "'on_time' AS status", "'X' AS carrier",
        "'air' AS transport_mode", "2.5BD AS freight_cost", "1BD AS weight_kg", "1BD AS distance_km", "true AS damaged",
        "false AS returned", "5 AS quantity_delivered",
    )


@pytest.mark.parametrize(("file_bytes", "files"), [(yearly_exports.FILE_BYTES, 3), (1, 9)])
def test_exports_leave_no_rows_behind_and_shuffle_none(spark, tmp_path, scratch, monkeypatch, file_bytes, files):
    monkeypatch.setattr(yearly_exports, "FILE_BYTES", file_bytes)
    monkeypatch.setattr(store, "_gathered", None)
    folder = yearly_exports.write_exports(base(spark), str(tmp_path / "out"))
    assert kept(scratch, "export-rows") == []
    assert len(list((tmp_path / "out").rglob("*.csv"))) >= files
    styles = {p.parts[-3]: p.parts[-2] for p in (tmp_path / "out").rglob("*.csv")}
    assert styles == {"semicolon": "upload_id=1996", "tab": "upload_id=1997", "comma": "upload_id=1998"}
    counts = exports.plan_ingest(spark, folder, exports.hive_folder).report().collect()
    assert {r.upload_id: r.accepted_rows for r in counts} == dict.fromkeys(("1996", "1997", "1998"), 15)


def test_exports_of_no_rows_are_an_empty_folder(spark, tmp_path, scratch):
    folder = yearly_exports.write_exports(base(spark).where("l_orderkey < 0"), str(tmp_path / "out"))
    assert (tmp_path / "out").is_dir() and not list((tmp_path / "out").rglob("*.csv"))
    with pytest.raises(exports.IngestError):
        exports.plan_ingest(spark, folder, exports.hive_folder)


@pytest.mark.parametrize("least", [store.LEAST_FILE, 0])
def test_an_append_unstages_its_rows(spark, tmp_path, scratch, monkeypatch, least):
    monkeypatch.setattr(store, "LEAST_FILE", least)
    for name in "abc":
        (tmp_path / f"{name}.csv").write_text("vendor,delay days\n" + f"{name},1\n" * 20 + ",\n")
    planned = exports.plan_ingest(spark, str(tmp_path / "*.csv"))
    calls, real = [], store._gathered
    monkeypatch.setattr(store, "_gathered", lambda rows: calls.append(rows) or real(rows))
    for _ in range(2):
        report = planned.append_to(str(tmp_path / "table"))
        assert kept(scratch, "staged") == []
        assert {r.upload_id: (r.accepted_rows, r.rejected_rows) for r in report.collect()} == dict.fromkeys("abc", (20, 1))
        stored = store.read(spark, str(tmp_path / "table")).groupBy("upload_id", "vendor").count().collect()
        assert {(r[0], r[1], r[2]) for r in stored} == {(n, n, 20) for n in "abc"}
    assert len(calls) == (2 if least else 0)
    assert sum(r.accepted_rows for r in planned.counts().collect()) == 60


def test_a_refused_append_unstages_its_rows(spark, tmp_path, scratch):
    (tmp_path / "a.csv").write_text("vendor,delay days\n,\n")
    with pytest.raises(exports.IngestError):
        exports.plan_ingest(spark, str(tmp_path / "a.csv")).append_to(str(tmp_path / "table"))
    assert kept(scratch, "staged") == [] and not (tmp_path / "table").exists()


def test_a_stream_unstages_its_batches(spark, tmp_path, scratch):
    source = tmp_path / "in"
    source.mkdir()
    for name in "abc":
        (source / f"{name}.csv").write_text(f"vendor,delay days\n{name},1\n")
    paths = [str(tmp_path / n) for n in ("table", "rejects", "state")]
    query = uploads.stream_uploads(spark, str(source), *paths, files_per_batch=2)
    query.awaitTermination()
    assert query.exception() is None and kept(scratch, "staged") == []
    assert sorted(r.vendor for r in store.read(spark, paths[0]).collect()) == ["a", "b", "c"]


def test_writes_leave_no_shuffle_files(spark, tmp_path, scratch):
    settings = {key: spark.conf.get(key, None) for key in store.LEAN}
    before = shuffle_files(spark)
    rows = spark.range(3000).selectExpr("string(id % 3) AS upload_id", "id")
    store.kept(rows.groupBy("upload_id").count(), "counted")
    store.append(rows, str(tmp_path / "table"))
    store.replace(rows, str(tmp_path / "table"))
    until = time.time() + 20
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert {key: spark.conf.get(key, None) for key in store.LEAN} == settings
