"""Header names -> canonical fields, for any number of files in one job."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from difflib import SequenceMatcher

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.schema import FUZZY_CUTOFF
from lanewise.vocabulary import header_names

# Tasks receive the functions of this module by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MIN_FUZZY_LENGTH = 3
REMEMBERED = 10_000
MAPPED_DDL = "file string, position int, header string, column int, field string, score double"


def plain_name(header: str) -> str:
    return "".join(c for c in header.lower() if c.isalnum())


@dataclass(frozen=True)
class Mapped:
    """What one header of a file holds. ``score`` is the similarity of a guess."""

    header: str
    position: int
    column: int
    field: str | None = None
    score: float | None = None


def mapper(
    extra: Mapping[str, list[str]] | None = None, fuzzy: bool = True
) -> Callable[[Sequence[str]], list[Mapped]]:
    """A function from the header cells of a file to what each of them holds.

    Every header comes out once, empty ones not at all; ``column`` is the
    position to read, the last one where a file repeats a header. A known name
    wins first, the earliest header taking the field. Then each remaining header,
    from left to right, takes the most similar field that is still free, if
    similar enough. Similarity depends on the name alone and is remembered.
    """
    vocabulary = header_names(extra)
    field_of = {name: field for field, names in vocabulary.items() for name in names}
    remembered: dict[str, list[tuple[float, str]]] = {}

    def similar(name: str) -> list[tuple[float, str]]:
        if name not in remembered:
            remembered[name] = similar_fields(name, vocabulary)
        return remembered[name]

    def assign(headers: Sequence[str]) -> list[Mapped]:
        last = {h: i for i, h in enumerate(headers) if h}
        first = {h: i for i, h in reversed(list(enumerate(headers))) if h}
        order = sorted(first, key=first.__getitem__)
        holder: dict[str, str] = {}
        for header in order:
            field = field_of.get(plain_name(header))
            if field:
                holder.setdefault(field, header)
        found = {header: (field, None) for field, header in holder.items()}
        for header in order if fuzzy else ():
            name = plain_name(header)
            if header in found or len(name) < MIN_FUZZY_LENGTH:
                continue
            free = next(((f, s) for s, f in similar(name) if f not in holder), None)
            if free:
                holder[free[0]] = header
                found[header] = (free[0], round(free[1], 3))
        return [Mapped(h, first[h], last[h], *found.get(h, (None, None))) for h in order]

    return assign


def similar_fields(name: str, vocabulary: Mapping[str, Sequence[str]]) -> list[tuple[float, str]]:
    """Fields similar to a name with their similarity, the most similar first, earlier fields first on ties."""
    matcher = SequenceMatcher(None)
    found = []
    for field, known_names in vocabulary.items():
        best = 0.0
        for known in known_names:
            matcher.set_seqs(name, known)
            # The cheap upper bounds rule out nearly everything.
            if matcher.real_quick_ratio() > FUZZY_CUTOFF and matcher.quick_ratio() > FUZZY_CUTOFF:
                best = max(best, matcher.ratio())
        if best > FUZZY_CUTOFF:
            found.append((best, field))
    return sorted(found, key=lambda f: -f[0])


def map_headers(
    headers: DataFrame, extra: Mapping[str, list[str]] | None = None, fuzzy: bool = True
) -> DataFrame:
    """Which column of each file holds which field, as ``mapper`` says.

    ``headers`` has one row per ``file``, ``position`` and ``header``. A file's
    headers fit in one row, as they came from one line of text, so one shuffle
    brings them together.
    """

    def assign(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mapped = mapper(extra, fuzzy)
        names = [c.split()[0] for c in MAPPED_DDL.split(", ")][1:]
        # Files of one origin share their headers, so what these hold is remembered.
        remembered: dict[tuple, list[tuple]] = {}
        for batch in batches:
            if len(remembered) > REMEMBERED:
                remembered.clear()
            found = []
            for positions, cells in zip(batch["positions"], batch["cells"], strict=True):
                key = (*positions, *cells)
                if key not in remembered:
                    in_order = sorted(zip(positions, cells, strict=True))
                    places = [p for p, _ in in_order]
                    remembered[key] = [
                        (places[m.position], m.header, places[m.column], m.field, m.score)
                        for m in mapped([h for _, h in in_order])
                    ]
                found.append(remembered[key])
            files = batch["file"].repeat([len(rows) for rows in found]).reset_index(drop=True)
            rows = pd.DataFrame([r for rows in found for r in rows], columns=names).astype({"score": "float64"})
            rows.insert(0, "file", files)
            yield rows

    cells = F.collect_list(F.struct("position", "header")).alias("cells")
    files = headers.where("header <> ''").groupBy("file").agg(cells)
    flat = files.select("file", F.col("cells.position").alias("positions"), F.col("cells.header").alias("cells"))
    return flat.mapInPandas(assign, MAPPED_DDL)
