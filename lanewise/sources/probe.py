"""What each CSV file looks like, learned from its first 64 KiB.

The heads are read inside the tasks that list the files, so a folder with very
many files is probed in parallel.
"""

from __future__ import annotations

import codecs
import contextlib
import csv
import io
import re
import sys
from collections.abc import Iterable, Iterator, Sequence
from urllib.parse import unquote

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.schema import DELIMITERS, HEADER_SCAN_ROWS, PROBE_BYTES
from lanewise.sources.headers import plain_name
from lanewise.vocabulary import header_names

# Tasks receive the functions of this module by value; executors need no copy
# of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

HEAD_SCHEMA = (
    "path string, length long, encoding string, delimiter string, skip_records int,"
    " skipped_lines int, headers array<string>, problem string"
)
NO_HEADER = "The file has no header row."


def list_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Path and length of every CSV file; contents are not read."""
    for path in paths:
        if "." in path.rsplit("/", 1)[-1] and not path.lower().endswith((".csv", "*")):
            raise ValueError(f"Only .csv files are supported: {path}")
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[cC][sS][vV]")
        .option("recursiveFileLookup", "true")
        .load(list(paths))
        .select("path", "length")
    )


def listed_paths(files: DataFrame) -> set[str]:
    """All CSV files of the listing, those of length zero included, which scans pass over."""
    return {same_slashes(unquote(p)) for p in files.inputFiles() if p.lower().endswith(".csv")}


def same_slashes(path: str) -> str:
    """``file:///x`` and ``file:/x`` are the same file."""
    return re.sub(r"^(\w+):/+", r"\1:/", path)


def probe(files: DataFrame) -> DataFrame:
    """One row per file: encoding, delimiter, header row and where it is."""
    names = frozenset(n for all_names in header_names().values() for n in all_names)

    def inspect(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame(
                [
                    describe_head(path, length, read_head(path), names)
                    for path, length in zip(batch["path"], batch["length"], strict=True)
                ],
                columns=[c.split()[0] for c in HEAD_SCHEMA.split(", ")],
            )

    return files.mapInPandas(inspect, HEAD_SCHEMA)


def read_head(path: str) -> bytes:
    from pyarrow import fs

    scheme, _, rest = path.partition(":")
    if scheme == "file":
        system, name = fs.LocalFileSystem(), "/" + rest.lstrip("/")
    else:
        system, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    with system.open_input_stream(name) as stream:
        return stream.read(PROBE_BYTES)


def describe_head(path: str, length: int, head: bytes, names: frozenset[str]) -> dict:
    encoding, text = decode_head(head, whole=length <= len(head))
    delimiter = find_delimiter(text)
    skip_records, skipped_lines, headers = find_header(text, delimiter, names)
    return {
        "path": path,
        "length": length,
        "encoding": encoding,
        "delimiter": delimiter,
        "skip_records": skip_records,
        "skipped_lines": skipped_lines,
        "headers": headers,
        "problem": None if any(headers) else NO_HEADER,
    }


def decode_head(head: bytes, whole: bool) -> tuple[str, str]:
    """UTF-8 if it is valid, else Windows-1252, else Latin-1, which always is."""
    for encoding in ("utf-8-sig", "cp1252", "latin-1"):
        try:
            # A character that the probe cuts in half is not an error.
            text = codecs.getincrementaldecoder(encoding)().decode(head, whole)
        except UnicodeDecodeError:
            continue
        return encoding.removesuffix("-sig"), text
    raise AssertionError("latin-1 decodes anything")


def find_delimiter(text: str) -> str:
    """The separator that a sniffer sees, if it is a usual one.

    A text that it cannot make out has the usual separator that its first line
    holds most often, the earlier one on ties, or the first of all if none.
    """
    first_line = text.split("\n", 1)[0]
    sniffed = _sniffed(text)
    unusual = sniffed is not None and sniffed not in DELIMITERS

    def rank(place: int) -> tuple[bool, int, int]:
        candidate = DELIMITERS[place]
        found = 0 if sniffed or unusual else first_line.count(candidate)
        return candidate == sniffed, found, -place

    return DELIMITERS[max(range(len(DELIMITERS)), key=rank)]


def _sniffed(text: str) -> str | None:
    with contextlib.suppress(csv.Error):
        return csv.Sniffer().sniff(text, delimiters=DELIMITERS).delimiter
    return None


def find_header(text: str, delimiter: str, names: frozenset[str]) -> tuple[int, int, list[str]]:
    """Records and lines above the header, and the header's cells.

    The header is the first of 15 records with a known name in it, else the
    first record that is not blank.
    """
    records = []
    for number, record in enumerate(csv.reader(io.StringIO(text, newline=""), delimiter=delimiter)):
        if number >= HEADER_SCAN_ROWS:
            break
        records.append(record)
    found = next(
        (i for i, cells in enumerate(records) if any(plain_name(c) in names for c in cells)), None
    )
    if found is None:
        return 0, 0, next((cells for cells in records if cells), [])
    return sum(1 for cells in records[:found] if cells), found, records[found]
