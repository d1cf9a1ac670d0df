from __future__ import annotations

import pytest
from factories import shipment

from lanewise.operators import trends
from lanewise.operators.facts import facts as facts_of
from lanewise.session import CHECKPOINT_DIR, scratch_path
from lanewise.sources import exports, store
from lanewise.streaming import uploads as streaming

FIRST = {
    "a.csv": "vendor,delay_days,shipped_on\nLofoten,3,2024-01-05\nKvass,0,2024-02-05\n",
    "b.csv": "Supplier;Days Late;Order Date\nLofoten;x;05/03/2024\n",
    "bad.csv": "alpha,beta\n1,2\n",
}
LATER = {"c.csv": "vendor\tdelay\nGamma\t9\n"}


def write(folder, files):
    for name, text in files.items():
        (folder / name).write_text(text)


def rows_of(frame):
    return sorted(map(str, frame.select(sorted(frame.columns)).collect()))


def test_streamed_and_batch_ingest_agree(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    paths = [str(tmp_path / n) for n in ("table", "rejects", "state")]
    write(source, FIRST)
    query = streaming.stream_uploads(spark, str(source), *paths, files_per_batch=1)
    query.awaitTermination()
    assert query.exception() is None
    write(source, LATER)
    streaming.stream_uploads(spark, str(source), *paths).awaitTermination()

    batch = exports.plan_ingest(spark, str(source), strict=False).shipments
    streamed = store.read(spark, paths[0])
    assert rows_of(streamed.select(batch.columns)) == rows_of(batch)
    rejected = store.read(spark, paths[1], streaming.PROBLEM_DDL).collect()
    assert [r.upload_id for r in rejected] == ["bad"]

    # Files that come again replace their datasets instead of adding to them.
    again = [*paths[:2], str(tmp_path / "other state")]
    streaming.stream_uploads(spark, str(source), *again).awaitTermination()
    assert rows_of(store.read(spark, paths[0]).select(batch.columns)) == rows_of(batch)


def test_datasets_that_batches_cut_through_stay_whole(spark, tmp_path):
    source = tmp_path / "in"
    for u in "xyz":
        (source / f"upload_id={u}").mkdir(parents=True)
        for i in range(3):
            text = "vendor,delay_days\n" + "".join(f"{u}{i}{j},{j}\n" for j in range(i + 1))
            (source / f"upload_id={u}" / f"part {i}.csv").write_text(text)
    whole = exports.plan_ingest(spark, str(source), exports.hive_folder).shipments
    for size in (1, 2, 100):
        paths = [str(tmp_path / f"{n}{size}") for n in ("table", "rejects", "state")]
        query = streaming.stream_uploads(
            spark, str(source), *paths, exports.hive_folder, files_per_batch=size
        )
        query.awaitTermination()
        streamed = store.read(spark, paths[0])
        assert rows_of(streamed.select(whole.columns)) == rows_of(whole)
    # A batch that runs again, here with another split into batches, changes nothing.
    again = [str(tmp_path / "table1"), str(tmp_path / "rejects1"), str(tmp_path / "state again")]
    streaming.stream_uploads(
        spark, str(source), *again, exports.hive_folder, files_per_batch=4
    ).awaitTermination()
    assert rows_of(store.read(spark, again[0]).select(whole.columns)) == rows_of(whole)


def test_fixed_layout_stream_keeps_a_running_monthly_series(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, {"a.csv": FIRST["a.csv"], "b.csv": FIRST["a.csv"].replace("Lofoten", "Zeta")})
    headers = ["vendor", "delay_days", "shipped_on"]
    stream = streaming.stream_fixed_layout(
        spark, str(source), headers, {h: i for i, h in enumerate(headers)},
        exports.file_stem(streaming.F.col("_file")),
    )
    query = (
        streaming.running_monthly_trend(stream)
        .writeStream.outputMode("complete").format("memory").queryName("months")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    batch = trends.monthly_trend(facts_of(exports.plan_ingest(spark, str(source)).shipments))
    assert rows_of(spark.table("months")) == rows_of(batch)


def test_append_replace_and_partition_pruning(spark, tmp_path, make_shipments):
    path = str(tmp_path / "table")
    rows = make_shipments([shipment(upload_id=u, vendor=f"V{i}") for i, u in enumerate("aab")])
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    store.append(rows, path)
    store.append(rows.where("upload_id = 'b'"), path)
    stored = store.read(spark, path, ddl)
    assert stored.count() == 4
    store.replace(rows.where("upload_id = 'b'"), path)
    assert sorted(r.upload_id for r in store.read(spark, path, ddl).collect()) == ["a", "a", "b"]
    plan = stored.where("upload_id = 'a'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(upload_id" in plan


def test_datasets_can_be_dropped_from_a_table(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write(source, {"a.csv": FIRST["a.csv"], "b.csv": FIRST["b.csv"]})
    path = str(tmp_path / "table")
    exports.plan_ingest(spark, str(source)).append_to(path)
    store.create_shipment_table(spark, "stored_shipments", path)
    assert spark.table("stored_shipments").count() == 3
    store.delete_upload(spark, "stored_shipments", ["a", "it's not there", "back\\slash"])
    assert {r.upload_id for r in spark.table("stored_shipments").collect()} == {"b"}
    spark.sql("DROP TABLE stored_shipments")


class Settings:
    def __init__(self, **values):
        self.conf = {k.replace("_", "."): v for k, v in values.items()}


def test_scratch_follows_the_session_setting():
    named = Settings(spark_checkpoint_dir="hdfs://shared/scratch/", spark_master="yarn")
    assert scratch_path(named, "x").startswith("hdfs://shared/scratch/x-")
    assert "lanewise-" in scratch_path(Settings(spark_master="local[4]"), "x")
    with pytest.raises(ValueError, match=CHECKPOINT_DIR):
        scratch_path(Settings(spark_master="yarn"), "x")
