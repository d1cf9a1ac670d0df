"""What the operators of this package share: tables, kept intermediate results, samples, text arrays."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.session import scratch_path

LONG, INT, DOUBLE, STRING, BOOL, BINARY = (
    T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType(), T.BinaryType(),
)

#: Words are runs of anything but the six ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def keep(rows: DataFrame, name: str) -> DataFrame:
    """Write rows to the shared scratch folder and read them back.

    This cuts lineage with a copy that outlives any executor, computes the rows
    once where several steps need them, and lets later joins split hot keys.
    """
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def released() -> None:
    """Give memory that a batch function no longer needs back to the system, as its worker stays for later ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


def crc(column: str) -> Column:
    """CRC-32 of the column's value written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


#: Rows at most of a table that every task gets whole.
SENT_ROWS = 1 << 18


def sent(rows: DataFrame) -> DataFrame:
    """Kept ``rows`` for a join: every task gets them if they are few by count, else both sides are sorted.

    Spark's own choice goes by sizes that it takes from files and columns. Rows
    in memory can be many times that, above all where a side was exploded.
    """
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows.hint("merge")


#: Bits of a map of hashes, as a power of two. 64 of them are a row.
MAP_BITS = 24


def _at(key: str) -> tuple[Column, Column]:
    """The row of a map of hashes that has the bit of the column's value, and this bit alone."""
    spot = F.xxhash64(F.col(key))
    row = F.shiftrightunsigned(spot, 64 - MAP_BITS + 6)
    return row, F.call_function("shiftleft", F.lit(1).cast("long"), spot.bitwiseAND(63).cast("int"))


def hash_map(keys: DataFrame, key: str) -> DataFrame:
    """A map of fixed size, (_row, _bits), in which the hash of each key has its bit."""
    row, bit = _at(key)
    return keep(keys.groupBy(row.alias("_row")).agg(F.bit_or(bit).alias("_bits")), "hash-map")


def mapped(rows: DataFrame, key: str, seen: DataFrame, there: bool) -> DataFrame:
    """Of ``rows`` those whose key may be in the map, or, unless ``there``, those whose key certainly is not.

    Every task gets the map, whatever its number of keys; a full one tells fewer
    rows apart, so who joins those that may be in it with the keys is right in any case.
    """
    row, bit = _at(key)
    found = F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False))
    return rows.join(F.broadcast(seen), row == F.col("_row"), "left").filter(found if there else ~found).drop("_row", "_bits")


#: Ranges of the hash that rows of a sample are counted in.
HASH_BITS = 12


def hash_sample(rows: DataFrame, by: str, key: str, most: int) -> DataFrame:
    """At most ``most`` rows of each value of ``by``, those of the smallest hash of ``key``, numbered (``nth``) by it.

    Rows are first counted per value and range of the hash, which map tasks combine;
    the counts say which ranges hold the sample. Only rows in these are ranked, and
    the join that finds them is dealt by value and range, so a value that most rows
    have is in no task of its own. Rows without a value are left out.
    """
    spot = F.xxhash64(F.col(key))
    placed = rows.withColumn("_range", F.shiftright(spot, 64 - HASH_BITS))
    counts = placed.groupBy(by, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("_rows").over(before), F.lit(0))
    wanted = counts.withColumn("_ahead", ahead).filter(F.col("_ahead") < most).select(by, "_range")
    order = Window.partitionBy(by).orderBy(spot, F.col(key))
    near = placed.join(wanted, [by, "_range"], "left_semi").drop("_range")
    return near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), dtype="<u4")


def byte_words(text: str | None) -> list[bytes]:
    """The words of a text as UTF-8; bytes split at exactly the six ASCII blanks."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def bridges(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a matrix of links between rows and columns: a column standing for each one's group.

    Rows and columns that are connected get the same column, the first of their
    group; rows without links get -1.
    """
    rows, columns = near.any(axis=1), near.any(axis=0)
    of_row = np.full(near.shape[0], -1, dtype=np.int64)
    of_column = np.arange(near.shape[1], dtype=np.int64)
    if not rows.any():
        return of_row, of_column
    near, none = near[np.ix_(rows, columns)], near.shape[1]
    label = np.flatnonzero(columns)
    while True:
        up = np.where(near, label[None, :], none).min(axis=1)
        down = np.minimum(label, np.where(near, up[:, None], none).min(axis=0))
        if (down == label).all():
            break
        label = down
    of_row[rows], of_column[columns] = up, label
    return of_row, of_column


def grouped(texts: list[str | None], size: int) -> Iterator[list[int]]:
    """Places of texts that are worked on together; a text longer than ``size`` is a group of its own."""
    group, filled = [], 0
    for i, text in enumerate(texts):
        if group and filled + len(text or "") > size:
            yield group
            group, filled = [], 0
        group.append(i)
        filled += len(text or "")
    if group:
        yield group


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one run after the other."""
    ahead = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) + np.repeat(starts - ahead, lengths)
