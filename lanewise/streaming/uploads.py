"""Continuous ingest and a running monthly series."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lanewise.operators.facts import facts as facts_of
from lanewise.operators.measures import DATASET, rollup
from lanewise.operators.trends import trend_points
from lanewise.sources import store
from lanewise.sources.exports import accepted, file_digest, file_stem, plan_ingest, stage

PROBLEM_DDL = "upload_id string, path string, problem string"
FILE_COLUMNS = ("path", "modificationTime", "state", "accepted", "rejected", "damaged", "problem", store.PARTITION, store.SOURCE_FILE)


def stream_uploads(
    spark: SparkSession,
    folder: str,
    table: str,
    rejects: str,
    checkpoint: str,
    upload_id: Callable[[Column], Column] = file_stem,
    files_per_batch: int = 100,
    files: str | None = None,
    **options: object,
) -> StreamingQuery:
    """Ingest CSV files as they arrive, each with its own header.

    The stream carries file names only. Each micro-batch plans and reads its
    files exactly as a batch ingest does, so the two cannot differ. Files that
    cannot be mapped go to ``rejects``. A batch replaces the files it holds and
    nothing else: files of one dataset may arrive in any number of batches and
    add up, a file that comes again replaces its own rows, and a batch that is
    retried after a failure changes nothing. ``files_per_batch`` has no effect
    on the result.

    A ledger at ``files``, by default beside the table, has a row per file: path,
    time, state (stored, empty, unreadable) and counts. It decides what a batch
    removes: a file that comes again without a usable row leaves none, and one
    that was unreadable and is mended leaves the rejects.
    """
    parts = (store.PARTITION, store.SOURCE_FILE)
    ledger = files or f"{table.rstrip('/')}-files"
    counted = ("accepted", "rejected", "damaged")

    def ingest(batch: DataFrame, _batch_id: int) -> None:
        came = batch.select("path", "modificationTime").withColumn(store.SOURCE_FILE, file_digest(F.col("path")))
        came = store.kept(came.withColumn(store.PARTITION, upload_id(F.col("path"))), "came")
        paths = [row.path for row in came.select("path").collect()]
        if not paths:
            return
        planned = plan_ingest(spark, paths, upload_id, strict=False, **options)
        bad = spark.createDataFrame(
            [(p, layout.problem) for layout in planned.problems for p in layout.paths], "_path string, problem string"
        ).select(file_digest(F.col("_path")).alias("_of"), "problem")
        judged = came.join(bad, came[store.SOURCE_FILE] == bad["_of"], "left").drop("_of")
        if planned.layouts:
            staged = planned.staged_by_file()
            store.replace(accepted(staged), table, parts, not planned.lies_well(len(paths)))
            counts = staged.groupBy(store.SOURCE_FILE).agg(
                F.count_if("_accepted").alias("accepted"),
                F.count_if(~F.col("_accepted")).alias("rejected"),
                F.count_if("_damaged").alias("damaged"),
            )
            judged = judged.join(counts, store.SOURCE_FILE, "left").fillna(0, counted)
        else:
            judged = judged.withColumns({c: F.lit(0).cast("long") for c in counted})
        state = F.when(F.col("problem").isNotNull(), "unreadable").when(F.col("accepted") == 0, "empty").otherwise("stored")
        judged = store.kept(judged.withColumn("state", state), "judged")
        planned.unstage()
        store.replace(judged.select(*FILE_COLUMNS), ledger, parts)
        store.replace(judged.where("problem IS NOT NULL").select("path", "problem", *parts), rejects, parts)
        for path, gone in ((table, "accepted = 0"), (rejects, "problem IS NULL")):
            store.drop_parts(spark, path, [r[0] for r in judged.where(gone).select(store.SOURCE_FILE).collect()])

    arrivals = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(folder)
        .select("path", "length", "modificationTime")
    )
    return (
        arrivals.writeStream.foreachBatch(ingest)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_fixed_layout(
    spark: SparkSession,
    folder: str,
    headers: Sequence[str],
    columns: Mapping[str, int],
    upload_id: Column,
    sep: str = ",",
) -> DataFrame:
    """Shipments from a folder whose files all have one known header, as a stream."""
    rows = (
        spark.readStream.schema(", ".join(f"_c{i} string" for i in range(len(headers))))
        .option("sep", sep)
        .option("escape", '"')
        .option("header", True)
        .option("recursiveFileLookup", "true")
        .csv(folder)
        .select(
            *(F.col(f"_c{i}").alias(name) for name, i in columns.items()),
            F.col("_metadata.file_path").alias("_file"),
        )
        .withColumn("upload_id", upload_id)
        .drop("_file")
    )
    return accepted(stage(rows, columns))


def running_monthly_trend(shipments: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """The monthly series of a stream of shipments, for complete or update mode.

    A month stays open for late shipments, so there is no watermark; the state
    is one row per dataset and month.
    """
    dated = facts_of(shipments, by).where("period is not null")
    return trend_points(rollup(dated, [*by, "period"]), by)
