"""Stored tables: Parquet folders partitioned by dataset."""

from __future__ import annotations

from collections.abc import Collection, Iterator, Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.session import scratch_path

PARTITION = "upload_id"
# Second level of tables that files arrive in one by one.
SOURCE_FILE = "source_file"
#: Bytes that files should have on average, and bytes of a table that a task reads.
LEAST_FILE = 1 << 20
READ_BYTES = 128 << 20
#: Writes of a session with these remove their shuffle files at once, not when the driver happens to collect
#: garbage, and keep some files open rather than sort a task's rows by dataset.
LEAN = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "16"}


@contextmanager
def lean(spark: SparkSession) -> Iterator[None]:
    """Writes inside leave no shuffle files behind and spill none to sort by dataset."""
    before = {key: spark.conf.get(key, None) for key in LEAN}
    for key, value in LEAN.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def append(rows: DataFrame, path: str) -> None:
    """Add rows; each dataset is a partition.

    Rows are gathered by dataset before writing so that a dataset does not get
    a file from every task, and a dataset too big for one task is split.
    """
    with lean(rows.sparkSession):
        _gathered(rows).write.mode("append").partitionBy(PARTITION).parquet(path)


def replace(rows: DataFrame, path: str, parts: Sequence[str] = (PARTITION,), gather: bool = True) -> None:
    """Swap in all rows of the parts that occur in ``rows``; others stay.

    A part is a dataset, or with ``(PARTITION, SOURCE_FILE)`` one file of a
    dataset. Writing the same parts again has the same outcome, which makes a
    retried batch harmless. Unless told to ``gather``, tasks write rows as they
    lie, without a shuffle; see ``lies_well``.
    """
    with lean(rows.sparkSession):
        (
            (_gathered(rows) if gather else rows)
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*parts)
            .parquet(path)
        )


def lies_well(spark: SparkSession, path: str, parts: int) -> bool:
    """Whether rows kept at ``path`` make large enough files of so many parts even if every task holds rows of each."""
    size = _bytes(*_folder(spark, path))
    tasks = max(spark.sparkContext.defaultParallelism, size // READ_BYTES + 1)
    return size >= tasks * parts * LEAST_FILE


def drop_parts(spark: SparkSession, path: str, files: Sequence[str], but: Collection[str] = ()) -> None:
    """Remove the parts of these files from all datasets but some; what is not there is passed over."""
    system, folder = _folder(spark, path)
    for name in files:
        for found in system.globStatus(folder.suffix(f"/{PARTITION}=*/{SOURCE_FILE}={name}")) or ():
            part = found.getPath()
            if unquote(part.getParent().getName().removeprefix(f"{PARTITION}=")) not in but:
                system.delete(part, True)


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder that nothing reads any more; one that is not there is passed over."""
    system, folder = _folder(spark, path)
    system.delete(folder, True)


def made(spark: SparkSession, path: str) -> None:
    """Make a folder, which may be there already."""
    system, folder = _folder(spark, path)
    system.mkdirs(folder)


def datasets(spark: SparkSession, path: str) -> dict[str, int]:
    """The datasets of a stored table and their bytes; the driver lists a folder for each."""
    system, folder = _folder(spark, path)
    found = [one.getPath() for one in system.globStatus(folder.suffix(f"/{PARTITION}=*")) or ()]
    return {unquote(one.getName().removeprefix(f"{PARTITION}=")): _bytes(system, one) for one in found}


def _folder(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _bytes(system: JavaObject, folder: JavaObject) -> int:
    return system.getContentSummary(folder).getLength()


def _gathered(rows: DataFrame) -> DataFrame:
    return rows.hint("rebalance", F.col(PARTITION))


def read(spark: SparkSession, path: str, ddl: str = schema.SHIPMENT_DDL) -> DataFrame:
    """The stored rows; a filter on the dataset reads only its folder."""
    rows = spark.read.schema(ddl).parquet(path)
    return rows.drop(SOURCE_FILE)


def kept(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared scratch folder and read back.

    For what several steps read: it is computed once, survives lost executors,
    and leaves nothing registered in the session.
    """
    path = scratch_path(rows.sparkSession, name)
    with lean(rows.sparkSession):
        rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def parted(rows: DataFrame, name: str) -> str:
    """Rows written to the shared scratch folder as they lie, with a folder for each dataset; the path.

    A dataset gets a file from every task, so this is for large or short-lived tables.
    """
    path = scratch_path(rows.sparkSession, name)
    with lean(rows.sparkSession):
        rows.write.partitionBy(PARTITION).parquet(path)
    return path


def create_shipment_table(spark: SparkSession, name: str, path: str) -> None:
    """Register the shipments folder as a table, so that datasets can be dropped.

    Spark lists only the files that lie directly in a partition, so datasets that
    are stored in parts are partitions by part, with ``source_file`` as a column.
    """
    system, folder = _folder(spark, path)
    in_parts = len(system.globStatus(folder.suffix(f"/{PARTITION}=*/{SOURCE_FILE}=*")) or ()) > 0
    columns, parts = (f"{schema.SHIPMENT_DDL}, {SOURCE_FILE} string", f"{PARTITION}, {SOURCE_FILE}") if in_parts else (schema.SHIPMENT_DDL, PARTITION)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet PARTITIONED BY ({parts}) LOCATION '{path}'")
    spark.sql(f"MSCK REPAIR TABLE {name}")


def delete_upload(spark: SparkSession, name: str, upload_ids: Sequence[str]) -> None:
    """Delete datasets from a registered managed table by dropping their partitions."""

    def spec(values: dict[str, str]) -> str:
        texts = {key: value.replace("\\", "\\\\").replace("'", "\\'") for key, value in values.items()}
        return "PARTITION (" + ", ".join(f"{key} = '{text}'" for key, text in texts.items()) + ")"

    for upload_id in upload_ids:
        for row in spark.sql(f"SHOW PARTITIONS {name} {spec({PARTITION: upload_id})}").collect():
            found = dict(level.split("=", 1) for level in row[0].split("/"))
            whole = spec({key: unquote(value) for key, value in found.items()})
            spark.sql(f"ALTER TABLE {name} DROP IF EXISTS {whole}")
