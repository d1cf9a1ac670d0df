import csv
import io
import random

import pytest

from lanewise.sources import exports, store
from lanewise.streaming import uploads


@pytest.fixture
def split_size(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def content(rng, rows):
    cells = ["pipe 5\" wide", "plain", "", '"two\nlines"', '"a ""b"" c"', '"x, y"', '"one\n\n\nthree, ""z"""', "é"]
    lines = ["seller,delay,product,origin country\n"]
    for i in range(rows):
        lines.append(f"V{i},{i % 9},{rng.choice(cells)},{rng.choice(cells)}\n")
        lines += rng.choice([[], [], ["\n"], ["   \n"], [",,,\n"]])
    return "".join(lines)


def by_rule(text):
    rows = [r for r in csv.reader(io.StringIO(text, newline=""))][1:]
    rows = [r for r in rows if r]
    usable = [r for r in rows if any(c.strip() for c in r)]
    return sorted((r[0], int(r[1]), r[2].strip() or None) for r in usable), len(rows) - len(usable)


def test_records_at_any_split_size(spark, tmp_path, split_size):
    rng = random.Random(2)
    for name in ("one", "two"):
        (tmp_path / f"{name}.csv").write_text(content(rng, 60))
    expected = {n: by_rule((tmp_path / f"{n}.csv").read_text()) for n in ("one", "two")}
    for size in (1 << 20, 700, 97, 23):
        split_size(size)
        planned = exports.plan_ingest(spark, str(tmp_path))
        staged = planned.staging.select("upload_id", "vendor", "delay_days", "product", "_accepted").collect()
        for name, (rows, rejected) in expected.items():
            own = [r for r in staged if r.upload_id == name]
            assert sorted((r.vendor, r.delay_days, r.product) for r in own if r._accepted) == rows, size
            assert sum(not r._accepted for r in own) == rejected
    capped = exports.plan_ingest(spark, str(tmp_path), max_rows=31)
    assert {(r.upload_id, r.vendor) for r in capped.shipments.collect()} == {(n, f"V{i}") for n in expected for i in range(31)}


def test_a_cell_longer_than_splits_and_one_never_closed(spark, tmp_path, split_size):
    long = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "a.csv").write_text(f'seller,product\nV0,"{long}"\nV1,x\nV2,"open\nto the end\n')
    split_size(150)
    rows = exports.plan_ingest(spark, str(tmp_path)).shipments.orderBy("vendor").collect()
    assert [r.vendor for r in rows] == ["V0", "V1", "V2"]
    assert long.startswith(rows[0].product) and rows[2].product.startswith("open\nto")


def test_the_whole_file_settles_its_encoding(spark, tmp_path, split_size):
    (tmp_path / "late.csv").write_bytes(b"seller,delay\n" + b"Lofoten,1\n" * 120_000 + "Café,2\n".encode("cp1252"))
    (tmp_path / "latin.csv").write_bytes(b"seller,delay\nA\x81B,1\n")
    (tmp_path / "sign.csv").write_text("seller,delay\nA\ufffdB,1\n")
    split_size(100_000)
    planned = exports.plan_ingest(spark, str(tmp_path))
    assert planned.report().where("damaged_rows > 0").count() == 0
    assert {r.vendor for r in planned.shipments.distinct().collect()} == {"Lofoten", "Café", "A\x81B", "A\ufffdB"}


def test_strict_append_stores_all_or_nothing(spark, tmp_path, monkeypatch):
    source, table = tmp_path / "in", str(tmp_path / "table")
    source.mkdir()
    (source / "a.csv").write_text("seller,delay\nA,1\nB,2\n")
    (source / "b.csv").write_bytes("seller,delay\nØ,1\nÅ,1\n".encode() + b"K\xf6ln,1\n")
    with pytest.raises(ValueError, match="encoding"):
        exports.plan_ingest(spark, str(source)).append_to(table)
    assert not (tmp_path / "table").exists()
    (source / "b.csv").write_text("seller,delay\nØ,1\n")
    planned = exports.plan_ingest(spark, str(source))
    whole = store.replace

    def broken(rows, *rest):
        whole(rows.where("upload_id = 'a'"), *rest)
        raise OSError("lost")

    monkeypatch.setattr(store, "replace", broken)
    with pytest.raises(OSError):
        planned.append_to(table)
    monkeypatch.undo()
    for _ in range(2):
        report = {r.upload_id: r.accepted_rows for r in exports.plan_ingest(spark, str(source)).append_to(table).collect()}
        assert report == {"a": 2, "b": 1}
        assert sorted(r.vendor for r in store.read(spark, table).collect()) == ["A", "B", "Ø"]


def test_append_scans_the_files_once(spark, tmp_path, monkeypatch):
    (tmp_path / "a.csv").write_text("seller,delay\nA,1\n")
    planned = exports.plan_ingest(spark, str(tmp_path))
    reads = []
    once = exports.read_layout
    monkeypatch.setattr(exports, "read_layout", lambda *a: reads.append(1) or once(*a))
    report = planned.append_to(str(tmp_path / "t"))
    assert len(reads) == 1 and report.first().accepted_rows == 1
    assert "csv" not in report._jdf.queryExecution().executedPlan().toString().lower().replace("a.csv", "")


def test_files_that_come_again_leave_nothing_stale(spark, tmp_path):
    source, table, rejects = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "rejects")
    source.mkdir()

    def run(state):
        uploads.stream_uploads(spark, str(source), table, rejects, str(tmp_path / state)).awaitTermination()
        stored = sorted(r.vendor for r in store.read(spark, table).collect())
        ledger = {r.upload_id: (r.state, r.accepted, r.rejected, r.damaged) for r in spark.read.parquet(f"{table}-files").collect()}
        bad = [r.path for r in spark.read.schema("path string, problem string").parquet(rejects).collect()] if (tmp_path / "rejects").exists() else []
        return stored, ledger, len(bad)

    (source / "a.csv").write_text("seller,delay\nA,1\nB,2\n,\n")
    (source / "c.csv").write_text("north,south\n1,2\n")
    (source / "d.csv").write_bytes("seller,delay\nØ,1\nÅ,1\n".encode() + b"K\xf6ln,1\n")
    stored, ledger, bad = run("first")
    assert stored == ["A", "B", "K\ufffdln", "Å", "Ø"] and bad == 1
    assert ledger == {"a": ("stored", 2, 1, 0), "c": ("unreadable", 0, 0, 0), "d": ("stored", 3, 0, 1)}
    (source / "a.csv").write_text("seller,delay\n,\n,\n")
    (source / "c.csv").write_text("seller,delay\nC,2\n")
    stored, ledger, bad = run("again")  # a stream of its own, as one stream takes a path once
    assert stored == ["C", "K\ufffdln", "Å", "Ø"] and bad == 0
    assert ledger["a"] == ("empty", 0, 2, 0) and ledger["c"] == ("stored", 1, 0, 0)
