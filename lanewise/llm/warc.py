"""WARC archives of pages: written by Spark, read back, and indexed by an external merge.

Records are text, as payloads are UTF-8, so Spark's text writer lays them down,
gzipped, with the blank lines that end a record as its separator. Archives are
read back as whole files of bounded size, one record after the other. Each
archive yields a run of captures sorted by URL key and time; ranges of keys are
dealt to tasks, and each task merges its stretch of every run with a loser tree.
"""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator
from itertools import groupby
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import keep
from lanewise.session import scratch_path

LEAST_SHARED = 1000  # bytes from which equal payloads are stored once
RECORDS_PER_FILE = 4000
CAPTURES_PER_RANGE = 8000
FIRST_CAPTURE = 1_600_000_000
CRLF = "\r\n"

CAPTURE = (
    "urlkey string, captured string, page_id long, payload_bytes long, payload_digest string,"
    " record_type string, refers_to long, archive string, position long"
)


def decisions(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """For payloads that occur more than once: (digest, bytes, response).

    Payloads are equal if their SHA-256 and length are. Counts are combined on
    the map side, so a payload that a third of the pages share is one row a task.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    shared = pages.select(
        F.sha2(payload, 256).alias("_digest"), F.octet_length(payload).alias("_bytes"), F.col(page_id).alias("_id")
    ).filter(F.col("_bytes") >= LEAST_SHARED)
    found = shared.groupBy("_digest", "_bytes").agg(F.max("_id").alias("_response"), F.count("*").alias("n"))
    return found.filter("n > 1 and _response is not null").drop("n")


def _lines(*parts: Column | str) -> Column:
    return F.concat_ws(CRLF, *(p if isinstance(p, Column) else F.lit(p) for p in parts))


def _record_id(page: Column) -> Column:
    digest = F.md5(F.concat(F.lit("page:"), page.cast("string")).cast("binary"))
    return F.concat(
        F.lit("<urn:uuid:"),
        F.concat_ws("-", *(F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))),
        F.lit(">"),
    )


def records(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One WARC record per page as text, without the blank lines that end it.

    Pages are joined with the payloads that occur more than once only, which
    adaptive execution broadcasts while they are few.
    """
    payload = F.coalesce(F.col(html), F.lit(""))
    digested = pages.select(
        F.col(page_id).cast("long").alias("_page"),
        F.col(url).cast("string").alias("_url"),
        payload.alias("_payload"),
        F.sha2(payload, 256).alias("_digest"),
        F.octet_length(payload).alias("_bytes"),
    )
    rows = digested.join(decisions(pages, page_id, html), ["_digest", "_bytes"], "left")
    revisit = F.coalesce(~F.col("_page").eqNullSafe(F.col("_response")) & F.col("_response").isNotNull(), F.lit(False))
    second = F.pmod(F.coalesce("_page", F.lit(0)), F.lit(1_000_000_000)) + FIRST_CAPTURE
    date = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(second), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    address = F.replace(F.replace("_url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    named = lambda name, value: F.concat(F.lit(f"{name}: "), value)  # noqa: E731  null if the value is
    http = _lines("HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", named("Content-Length", F.col("_bytes").cast("string")), "", "")
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("_bytes"))
    head = _lines(
        "WARC/1.1",
        named("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        named("WARC-Record-ID", F.coalesce(_record_id(F.col("_page")), F.lit("<urn:uuid:00000000-0000-0000-0000-000000000000>"))),
        named("WARC-Date", date),
        named("WARC-Target-URI", address),
        named("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(F.col("_payload")))),
        F.when(revisit, named("WARC-Refers-To", _record_id(F.col("_response")))),
        F.when(revisit, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        named("X-Page-Id", F.col("_page").cast("string")),
        F.when(revisit, named("X-Refers-To-Page", F.col("_response").cast("string"))),
        "Content-Type: application/http; msgtype=response",
        named("Content-Length", length.cast("string")),
        "",
        "",
    )
    return rows.select(F.concat(head, http, F.when(revisit, "").otherwise(F.col("_payload"))).alias("value"))


def write(pages: DataFrame, path: str, records_per_file: int = RECORDS_PER_FILE, **names: str) -> None:
    """Write gzipped archives below ``path``.

    Null payloads are empty; a page without a URL or id has no such header line.
    Of equal payloads of at least 1,000 bytes the one with the largest id is
    stored and the others refer to it; all rows that carry this id store it.
    Pages without an id store their payload if no page with an id has it.
    """
    (
        records(pages, **names)
        .write.option("compression", "gzip")
        .option("lineSep", CRLF + CRLF)
        .option("maxRecordsPerFile", records_per_file)
        .text(path)
    )


def url_key(url: str | None) -> str:
    """Host parts reversed, then path and query, lower case: the order of capture indexes."""
    try:
        parts = urlsplit((url or "").strip().lower())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return (url or "").strip().lower()
    key = ",".join(reversed(host.removeprefix("www.").split("."))) + (f":{port}" if port else "")
    return f"{key}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


class _Inflated(io.RawIOBase):
    """A gzipped file, of one member or several, as a stream that is never held whole."""

    def __init__(self, content: bytes):
        self.rest, self.press = memoryview(content), zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, target) -> int:
        while True:
            given = self.press.unconsumed_tail or bytes(self.rest[: 1 << 16])
            if not self.press.unconsumed_tail:
                self.rest = self.rest[len(given) :]
            if not given:
                return 0
            out = self.press.decompress(given, len(target))
            if self.press.eof:
                self.rest = memoryview(self.press.unused_data + bytes(self.rest))
                self.press = zlib.decompressobj(31)
            if out:
                target[: len(out)] = out
                return len(out)


def read_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of every record of an archive; a broken archive is an error."""
    stream = io.BufferedReader(_Inflated(content), 1 << 18)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError("A record does not start where the one before it ends.")
        header: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            header[name.lower()] = value
        block = stream.read(int(header["content-length"]))
        if len(block) != int(header["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError("A record is shorter than its header says.")
        yield header, block


def _capture(header: dict[str, str], block: bytes) -> tuple:
    head, _, payload = block.partition(b"\r\n\r\n")
    kind, digest = header["warc-type"], header["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        size = len(payload)
        if hashlib.sha1(payload).hexdigest() != digest:
            raise ValueError("A payload does not have the digest in its header.")
    else:
        fields = dict(line.split(": ", 1) for line in head.decode().split(CRLF)[1:])
        size = int(fields["Content-Length"])
    page, target = header.get("x-page-id"), header.get("x-refers-to-page")
    return (
        url_key(header.get("warc-target-uri")),
        header["warc-date"],
        None if page is None else int(page),
        size,
        digest,
        kind,
        None if target is None else int(target),
    )


COLUMNS = [part.split()[0] for part in CAPTURE.split(",")]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "position": pa.int64()}
    schema = pa.schema([(name, kinds.get(name, pa.string())) for name in COLUMNS])
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            found = sorted((_capture(*r) for r in read_records(content.as_buffer())), key=order)
            rows = [(*capture, path.as_py(), i) for i, capture in enumerate(found)]
            columns = list(zip(*rows)) or [()] * len(COLUMNS)
            yield pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def order(capture: tuple) -> tuple:
    """Captures sort by URL key, time and page, pages without an id first."""
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below ``path``, those of each archive sorted."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_runs, CAPTURE)


class LoserTree:
    """Merges sorted runs: inner nodes hold the losers, so one path is replayed for each row."""

    def __init__(self, runs: list[Iterator[tuple]]):
        self.runs = runs
        self.heads = [next(run, None) for run in runs]
        self.losers = [-1] * len(runs)
        for leaf in range(len(runs)):
            self._replay(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        if self.heads[a] is None or self.heads[b] is None:
            return self.heads[a] is not None
        return self.heads[a] <= self.heads[b]

    def _replay(self, winner: int, building: bool = False) -> None:
        node = (winner + len(self.runs)) // 2
        while node > 0:
            if building and self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                winner, self.losers[node] = self.losers[node], winner
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            self.heads[self.winner] = next(self.runs[self.winner], None)
            self._replay(self.winner)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The captures of one range, merged. Numbers stay in Arrow, as pandas would round those beside nulls."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    rows = pa.Table.from_batches(parts)
    archives = rows.column("archive").to_pylist()
    by_position = sorted(zip(archives, rows.column("position").to_pylist(), range(rows.num_rows)))
    keys = list(zip(*(rows.column(name).to_pylist() for name in ("urlkey", "captured", "page_id"))))
    runs = [
        iter([(*order(keys[i]), i) for _, _, i in run]) for _, run in groupby(by_position, key=lambda row: row[0])
    ]
    yield from rows.take(pa.array([head[-1] for head in LoserTree(runs)], type=pa.int64())).to_batches()


def merge(captures: DataFrame, per_range: int = CAPTURES_PER_RANGE) -> DataFrame:
    """Captures in global order of URL key, time and page.

    Ranges are cut on all three, so a host or URL with very many captures spans
    several; their number follows the count of captures.
    """
    ranges = max(1, -(-captures.count() // per_range))
    dealt = captures.repartitionByRange(ranges, "urlkey", "captured", "page_id")
    return dealt.mapInArrow(_merged, CAPTURE)


def archived(pages: DataFrame, path: str | None = None, **names: str) -> DataFrame:
    """Write pages to archives, read them back, and return the merged capture index."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path, **names)
    return merge(keep(read(spark, path), "captures"))
