"""Records of delimited text files of any size, found by many tasks.

A quoted cell may hold line breaks, so whether a line begins a record depends on
all lines before it. Each line is taken as a function of two states, outside and
inside a quoted cell. Functions of lines compose, those of a split to one for the
split, and those of a file's splits give the state in which each split begins;
then every split can be read by itself. A quote counts only where a cell begins
with one, so that inch marks inside cells are text.

Lines are also where UTF-8 can be checked piece by piece, as no character spans
two of them: the whole file decides on its encoding.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes that Windows-1252 leaves undefined, as Latin-1 characters.
UNDEFINED = "[\x81\x8d\x8f\x90\x9d]"
RECORDS = "file string, block long, nth long, record string, damaged boolean, part int, piece long"
WHOLE, BEGUN, CONTINUED = 0, 1, 2


def plain_path(url: Column) -> Column:
    """Undo the percent-encoding of paths in file metadata."""
    decoded = F.url_decode(F.replace(url, F.lit("+"), F.lit("%2B")))
    return F.when(F.contains(url, F.lit("%")), decoded).otherwise(url)


def one_slash(path: Column) -> Column:
    """``file:///x`` and ``file:/x`` are the same file."""
    return F.regexp_replace(path, r"^(\w+):/+", "$1:/")


def lines(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Lines as they are, bytes that are not UTF-8 included, with file and start of the split."""
    return spark.read.text(list(paths)).select(
        F.col("value").alias("line"),
        plain_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
    )


def ends_inside(line: Column, delimiter: str, inside: bool) -> Column:
    """Whether a quoted cell is open at the end of a line that begins inside or outside of one."""

    def after(is_open: Column, cell: Column) -> Column:
        odd = F.regexp_count(cell, F.lit('"')) % 2 == 1
        return F.when(is_open, ~odd).otherwise(F.startswith(cell, F.lit('"')) & odd)

    folded = F.aggregate(F.split(line, re.escape(delimiter), -1), F.lit(inside), after)
    return F.when(F.contains(line, F.lit('"')), folded).otherwise(F.lit(inside))


def crosses(line: Column, delimiter: str) -> Column:
    """``ends_inside`` for a line that begins outside of a cell, by one pass over its text.

    A cell that begins with a quote ends at the first delimiter after an even number of quotes.
    """
    d = re.escape(delimiter)
    cell = rf'(?:"[^"]*+"(?:[^"{d}]*+"[^"]*+")*+[^"{d}]*+|(?!")[^{d}]*+)'
    return F.contains(line, F.lit('"')) & ~F.rlike(line, F.lit(rf"\A{cell}(?:{d}{cell})*+\z"))


def survey(spark: SparkSession, by_delimiter: dict[str, Sequence[str]]) -> DataFrame:
    """One row per file: path, encoding, and what its records take.

    UTF-8 is what has no invalid line, or more lines with valid characters beyond
    ASCII than invalid ones; else Windows-1252, or Latin-1 where that has no
    such character. ``special`` files have cells with line breaks, lines of
    nothing but blanks, which are rows, or invalid lines; ``crossing`` tells
    those with line breaks in cells. Where no line that begins outside of a cell
    ends inside one, all lines begin outside.
    """
    blanks = F.lit("".join(map(chr, range(1, 33))))
    surveyed = None
    for delimiter, paths in by_delimiter.items():
        line = F.col("line")
        valid = F.is_valid_utf8(line)
        blank = (line != "") & (F.ltrim(line, blanks) == "")
        as_latin = F.decode(line.cast("binary"), "ISO-8859-1")
        rows = spark.read.text(list(paths)).select(
            F.col("value").alias("line"), F.col("_metadata.file_path").alias("url")
        ).select(
            "url",
            valid.alias("valid"),
            (valid & (F.octet_length(line) > F.length(line))).alias("wide"),
            (~valid & F.rlike(as_latin, F.lit(UNDEFINED))).alias("undefined"),
            crosses(line, delimiter).alias("crossing"),
            blank.alias("blank"),
        )
        surveyed = rows if surveyed is None else surveyed.unionByName(rows)
    counts = surveyed.groupBy("url").agg(
        F.count_if(~F.col("valid")).alias("invalid"),
        F.count_if("wide").alias("wide"),
        F.max("undefined").alias("undefined"),
        F.max("crossing").alias("crossing"),
        F.max("blank").alias("blank"),
    )
    unicode = (F.col("invalid") == 0) | (F.col("wide") > F.col("invalid"))
    return counts.select(
        one_slash(plain_path(F.col("url"))).alias("path"),
        F.when(unicode, "utf-8").when(F.col("undefined"), "latin-1").otherwise("cp1252").alias("encoding"),
        (F.col("crossing") | F.col("blank") | (unicode & (F.col("invalid") > 0))).alias("special"),
        "crossing",
    )


def open_splits(marked: DataFrame) -> tuple[dict[tuple[str, int], int], bool]:
    """Splits that begin inside a quoted cell, with the split in which its record began, and whether any cell is open at the end of a split.

    The functions of a split's lines are composed in Spark, only lines that are
    not the identity are gathered, and those of one split at most. The driver
    sees one row per split, as it does in a listing.
    """
    acts = F.col("from_outside") | ~F.col("from_inside")
    step = F.struct("nth", "from_outside", "from_inside")
    numbered = marked.withColumn("nth", F.monotonically_increasing_id())
    splits = numbered.groupBy("file", "block").agg(F.sort_array(F.collect_list(F.when(acts, step))).alias("steps"))

    def through(start: int) -> Column:
        """0 outside, 1 inside and never left, 2 inside a cell that began here."""

        def step(s: Column, t: Column) -> Column:
            begins = F.when(t["from_outside"], 2).otherwise(0)
            return F.when(s == 0, begins).when(t["from_inside"], s).otherwise(0)

        return F.aggregate("steps", F.lit(start), step)

    found, unfinished = {}, False
    state, began, file = 0, 0, None
    rows = splits.select("file", "block", through(0).alias("outside"), through(1).alias("inside"))
    for row in sorted(rows.toLocalIterator(), key=lambda r: (r.file, r.block)):
        if row.file != file:
            state, file = 0, row.file
        if state:
            found[row.file, row.block] = began
        state = row.inside if state else row.outside
        if state == 2:
            began = row.block
        unfinished |= state > 0
    return found, unfinished


def texts(spark: SparkSession, paths: Sequence[str], encoding: str) -> DataFrame:
    """Lines as text: file, block, line, and ``damaged`` where that took replacing invalid bytes."""
    raw = lines(spark, paths)
    text = F.make_valid_utf8("line") if encoding == "utf-8" else F.decode(F.col("line").cast("binary"), "ISO-8859-1")
    damaged = ~F.is_valid_utf8("line") if encoding == "utf-8" else F.lit(False)
    return raw.select("file", "block", text.alias("line"), damaged.alias("damaged"))


def records(spark: SparkSession, paths: Sequence[str], encoding: str, delimiter: str, skipped: int) -> DataFrame:
    """Records of special files below the first ``skipped``: file, block and nth of their start, text, and ``damaged``.

    Wholly empty lines are no records. Ends of lines inside a record are line feeds.
    """
    marked = texts(spark, paths, encoding).select(
        "*",
        ends_inside(F.col("line"), delimiter, False).alias("from_outside"),
        ends_inside(F.col("line"), delimiter, True).alias("from_inside"),
    )
    inside, unfinished = open_splits(marked.select("file", "block", "from_outside", "from_inside"))
    shared = spark.sparkContext.broadcast(inside)

    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = shared.value
        at, pending, is_open, damaged, part, nth, dropped = None, [], False, False, WHOLE, 0, 0
        done: list[tuple] = []

        def finish(kind: int) -> None:
            nonlocal pending, damaged, part, nth, dropped
            record = "\n".join(pending)
            if kind == WHOLE and at[1] == 0 and dropped < skipped and record:
                dropped += 1
            elif record or kind != WHOLE:
                start = begins[at] if kind == CONTINUED else at[1]
                done.append((at[0], start, nth, record, damaged, kind, at[1]))
            pending, damaged, part, nth = [], False, WHOLE, nth + 1

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("file", "block", "line", "damaged", "from_outside", "from_inside")]
            for file, block, line, bad, from_outside, from_inside in zip(*columns):
                if (file, block) != at:
                    if pending:
                        finish(part if part == CONTINUED else BEGUN)
                    at, nth, dropped = (file, block), 0, 0
                    is_open = at in begins
                    part = CONTINUED if is_open else WHOLE
                pending.append(line)
                damaged |= bad
                is_open = from_inside if is_open else from_outside
                if not is_open:
                    finish(part)
            yield _batch(done)
            done.clear()
        if pending:
            finish(part if part == CONTINUED else BEGUN)
            yield _batch(done)

    found = marked.mapInArrow(joined, RECORDS)
    if not unfinished:
        return found.drop("part", "piece")
    piece = F.struct("piece", "nth", "record", "damaged")
    pieces = found.where(F.col("part") != WHOLE)
    stitched = pieces.groupBy("file", "block").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    whole = stitched.select(
        "file",
        "block",
        F.element_at("p", 1)["nth"].alias("nth"),
        F.array_join(F.transform("p", lambda p: p["record"]), "\n").alias("record"),
        F.exists("p", lambda p: p["damaged"]).alias("damaged"),
    )
    return found.where(F.col("part") == WHOLE).drop("part", "piece").unionByName(whole)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.int64())
    columns = list(zip(*rows)) or [()] * len(kinds)
    names = [c.split()[0] for c in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=names)
