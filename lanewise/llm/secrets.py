"""Secrets in texts: fixed patterns, and strings that a primed compressor finds novel.

A candidate is a run of key characters shortly after a word that announces a
secret. It is compressed with zstandard twice, the compressor being primed with
a dictionary of common identifiers and the text around the candidate: once
alone, once as nothing. What it adds in bytes, per character, is its novelty:
identifiers, paths, prose and repeats of the surroundings cost little, random
keys cost nearly a byte for each character of a large alphabet.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import LONG, STRING, released, struct

# The base patterns, in the order that settles ties, with the least lengths.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGNED = 6
MIN_ACCESS = 20
KINDS = ("assign", "access", "hex", "novel")
ASSIGN_HINTS = ("passw", "secret", "token", "api")

# Words that announce a secret, and identifiers that do not make one.
SENSITIVE = re.compile(
    r"(?:key|auth|bearer|credential|passphrase|private|signature|client_id|pwd|salt|nonce|cookie|session|jwt|"
    r"password|passwd|secret|token)",
    re.IGNORECASE | re.ASCII,
)
SENSITIVE_HINTS = (
    "key", "auth", "bearer", "credential", "passphrase", "private", "signature", "client_id",
    "pwd", "salt", "nonce", "cookie", "session", "jwt", "passw", "secret", "token",
)
IDENTIFIERS = (
    "self return import class function public static void string integer boolean const default "
    "private protected package interface extends implements override abstract namespace include "
    "authorization authentication authenticate credentials certificate configuration application "
    "environment production development database connection username password passphrase secret "
    "access_key secret_key api_key client_id client_secret private_key public_key session_id "
    "access_token refresh_token bearer_token token_type expires_in redirect_uri response_type "
    "content-type application/json text/html multipart/form-data charset=utf-8 localhost example.com "
    "http://www. https://www. .github.io/ /usr/local/bin /var/lib/ /home/user/ README.md index.html "
    "BEGIN RSA PRIVATE KEY END CERTIFICATE REQUEST ssh-rsa AAAAB3NzaC1yc2E getElementById "
    "addEventListener toString valueOf hashCode equals length prototype undefined null true false "
    "0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0000000000000000 deadbeef"
)

MIN_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{16,}")
#: A candidate starts within so many characters after a word that announces it.
REACH = 48
#: What may stand between two lines of one secret: line breaks, quotes, plus signs, backslashes, and blanks beside them.
CONTINUES = re.compile(r"""(?=[^\S\r\n]*[\r\n"'+\\])(?:\\[rn]|[\s"'\\]|\+(?=[\s"']))+""")
RUN = re.compile(r"[A-Za-z0-9+/_=.-]+")
#: Characters on either side that prime the compressor.
SURROUNDINGS = 512
#: Least novelty in bytes per character. The compressor also writes the letters of a long string in fewer
#: bits if they are few, so of a random string no more is asked than its letters take, and a table of them.
MIN_NOVELTY = 0.72
TABLE_BYTES, LETTER_BYTES, UNEVEN = 8, 0.25, 8
#: Distinct characters a candidate must have: with digits only, with digits, and without.
MIN_DISTINCT = (5, 7, 10)

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) of every match of the fixed patterns, by start, then kind."""
    found: list[Span] = []
    lowered = text.lower()
    if any(hint in lowered for hint in ASSIGN_HINTS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGNED]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def novelty(candidate: str, before: str, after: str) -> float:
    """Bytes per character that the candidate adds to its surroundings."""
    primed = f"{IDENTIFIERS}\n{after}\n{before}".encode("utf-8", "surrogatepass")
    words = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    press = zstandard.ZstdCompressor(level=19, dict_data=words, write_content_size=False)
    added = len(press.compress(candidate.encode())) - len(press.compress(b""))
    return added / len(candidate)


def least_novelty(candidate: str) -> float:
    """Bytes per character from which a candidate is as novel as a random string of its length and letters.

    Letters that hardly occur, as in a prefix, do not count. If letters are less
    evenly used than in random strings, as in words, there is no allowance.
    """
    counts = Counter(candidate)
    often = [n for n in counts.values() if 4 * n * len(counts) >= len(candidate)]
    total, letters = sum(often), len(often)
    uneven = 2 * sum(n * math.log(n * letters / total) for n in often)  # chi-square of letters - 1 degrees
    if uneven > letters - 1 + UNEVEN * math.sqrt(letters - 1):
        return MIN_NOVELTY
    table = TABLE_BYTES + LETTER_BYTES * letters
    return min(MIN_NOVELTY, (total * math.log2(letters) / 8 + table) / len(candidate))


def varied(candidate: str) -> bool:
    """Whether a candidate has as many different characters as nearly all random ones of its kind have."""
    digits = sum(c.isdigit() for c in candidate)
    kind = 0 if digits == len(candidate) else 1 if digits else 2
    return len(set(candidate)) >= MIN_DISTINCT[kind]


def _value(run: str) -> str:
    """What copies of a candidate share: without a name in front, and signs at its ends."""
    bare = run.strip("+/_=.-")
    value = bare.rpartition("=")[2].strip("+/_=.-")
    return value if len(value) >= MIN_CANDIDATE else bare


def _outside(text: str, start: int, end: int, spans: list[Span], ends: list[int]) -> str:
    """The text from ``start`` to ``end`` without the spans, which are sorted, as are their ``ends``."""
    parts = []
    for i in range(bisect.bisect_right(ends, start), len(spans)):
        if spans[i][0] >= end:
            break
        parts.append(text[start : max(start, spans[i][0])])
        start = max(start, spans[i][2])
    return "".join([*parts, text[start:end]])


def _touches(start: int, end: int, spans: list[Span], ends: list[int]) -> bool:
    i = bisect.bisect_right(ends, start)
    return i < len(spans) and spans[i][0] < end


def _joined(spans: list[Span]) -> list[Span]:
    """Spans by start, overlapping ones as one."""
    found: list[Span] = []
    for start, kind, end in sorted(spans):
        if found and start < found[-1][2]:
            found[-1] = (found[-1][0], found[-1][1], max(end, found[-1][2]))
        else:
            found.append((start, kind, end))
    return found


def _lines(text: str, end: int) -> Iterator[tuple[int, int]]:
    """Runs of key characters that follow one another from ``end``, as the lines of one string do."""
    while (gap := CONTINUES.match(text, end)) and (m := RUN.match(text, gap.end())):
        yield m.span()
        end = m.end()


def _is_rest(text: str, start: int, end: int, width: int, wrapped: bool) -> bool:
    """Whether a run that is shorter than the line above it, and all of its own, ends a string of such lines."""
    run = text[start:end]
    if len(run) >= width or run[0] == "-" or (end < len(text) and text[end] not in "\r\n\"'\\"):
        return False
    mixed = any(c.isdigit() for c in run) and any(c.isalpha() for c in run)
    return mixed or run.endswith("=") or (wrapped and len(run) % 4 == 0)


def _announced(text: str) -> list[Span]:
    """All candidates that stand within reach of a sensitive word, by start."""
    found: list[Span] = []
    free = 0
    for word in SENSITIVE.finditer(text):
        at = max(free, word.end())
        reach = word.end() + REACH
        while (m := CANDIDATE.search(text, at, reach + MIN_CANDIDATE)) and m.start() <= reach:
            start, end = CANDIDATE.match(text, m.start()).span()
            at = free = end
            found.append((start, 3, end))
    return found


def novel_spans(text: str, taken: list[Span]) -> list[Span]:
    """Incompressible strings in a sensitive context that no base span touches, and their copies.

    Other secrets do not prime the compressor: the text before a candidate is
    taken without those found, the text after it without all candidates and
    copies. So a secret that is repeated is as novel as one that stands alone.
    Where a secret, of a base span or novel, goes on in further lines, these
    are candidates too, and those as wide as the line above and a short last
    one belong to it.
    """
    lowered = text.lower()
    if not any(hint in lowered for hint in SENSITIVE_HINTS):
        return []
    taken = _joined(taken)
    taken_ends = [end for _, _, end in taken]
    candidates = _announced(text)
    later = _joined(taken + candidates)
    later_ends = [end for _, _, end in later]
    found: list[Span] = []
    found_ends: list[int] = []
    known: list[Span] = []  # secrets before the candidate
    known_ends: list[int] = []
    values: set[str] = set()
    passed = 0

    def report(start: int, end: int) -> None:
        if end - start >= MIN_CANDIDATE:
            values.add(_value(text[start:end]))
        for spans, ends in ((found, found_ends), (known, known_ends)):
            spans.append((start, 3, end))
            ends.append(end)

    def is_secret(start: int, end: int) -> bool:
        """Whether a candidate is a secret; if no base span touches it, it is reported."""
        nonlocal passed
        while passed < len(taken) and taken[passed][0] < start:
            known.append(taken[passed])
            known_ends.append(taken[passed][2])
            passed += 1
        run = text[start:end]
        if _touches(start, end, taken, taken_ends):
            return True
        if len(run) < MIN_CANDIDATE or not varied(run.strip("=")):
            return False
        value = _value(run)
        before = _outside(text, max(0, start - SURROUNDINGS), start, known, known_ends)
        after = _outside(text, end, min(len(text), end + SURROUNDINGS), later, later_ends)
        if value not in values and novelty(run, before, after.replace(value, "")) < least_novelty(run):
            return False
        report(start, end)
        return True

    free = 0
    for start, _, end in candidates:
        if start < free:
            continue
        free = end
        if not is_secret(start, end):
            continue
        width, wrapped = len(text[start:end].lstrip("=")), False
        for start, end in _lines(text, end):
            even = end - start == width >= MIN_CANDIDATE
            if not is_secret(start, end):
                if not even and not _is_rest(text, start, end, width, wrapped):
                    break
                report(start, end)
            free, width, wrapped = end, end - start, wrapped or even
    copies = []
    for m in CANDIDATE.finditer(text) if found else ():
        start, end = m.span()
        if _value(m[0]) in values and not _touches(start, end, found, found_ends) and not _touches(start, end, taken, taken_ends):
            copies.append((start, 3, end))
    return sorted(found + copies)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


@F.pandas_udf(
    struct(n_assign=LONG, n_access=LONG, n_hex=LONG, n_novel=LONG, base_sha256=STRING, spans=STRING)
)
def _scan(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        rows = []
        for text in batch:
            text = text or ""
            base = base_spans(text)
            novel = novel_spans(text, base)
            counts = [sum(s[1] == kind for s in base) for kind in range(3)]
            digest = hashlib.sha256(written(base).encode()).hexdigest()
            rows.append((*counts, len(novel), digest, written(sorted(base + novel))))
        yield pd.DataFrame(
            rows, columns=["n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"]
        )


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document with its secrets: counts by kind, digest of the base spans, all spans.

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then
    kind. Null and empty texts have none, and the digest of an empty string.
    Repeated rows are scanned each for itself; other columns are not read. Work
    is proportional to the text: compression sees candidates and a fixed
    stretch around them.
    """
    return docs.select(F.col(doc_id), _scan(F.col(text)).alias("_found")).select(doc_id, "_found.*")


MASK = "[SECRET]"


def masked(text: str | None) -> str | None:
    """The text with every secret replaced; overlapping spans are replaced as one."""
    if not text:
        return text
    base = base_spans(text)
    spans = sorted(base + novel_spans(text, base))
    if not spans:
        return text
    parts, at = [], 0
    for start, kind, end in spans:
        if kind == 0:  # the name in front of an assigned secret stays
            start += ASSIGN.match(text, start).start(2) - start
        if end <= at:
            continue
        if start >= at:
            parts += [text[at:start], MASK]
        at = end
    return "".join([*parts, text[at:]])


@F.arrow_udf(STRING)
def _changed(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Masked texts, null where nothing was masked; one text at a time is a Python string."""
    for batch in texts:
        found = []
        for cell in batch:
            text = cell.as_py()
            changed = masked(text)
            found.append(None if changed == text else changed)
        yield pa.array(found, type=pa.string())
        del found
        released()


def mask(text: Column) -> Column:
    """Column of whole texts without their secrets; null stays null."""
    return F.coalesce(_changed(text), text)


def masked_documents(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """All documents and columns, secrets masked in the text and the length of changed texts renewed."""
    masks = docs.withColumn("_masked", mask(F.col(text)))
    length = F.when(F.col("_masked") == F.col(text), F.col(n_chars)).otherwise(F.length("_masked"))
    return masks.withColumn(n_chars, length.cast(docs.schema[n_chars].dataType)).withColumn(
        text, F.col("_masked")
    ).drop("_masked")
