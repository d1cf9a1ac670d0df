"""Near duplicates by SimHash, found by anchor-point covering.

Two disjoint blocks of 31 bits are taken from each 64-bit fingerprint. Of two
fingerprints that differ in at most three bits, one block differs in at most
one bit. On a block, the words of the Hamming code of length 31 serve as
anchors: every block value lies within one bit of exactly one anchor, its home.
A fingerprint is copied to every anchor within covering radius plus threshold,
that is two bits: one anchor if it is an anchor itself, else sixteen. Whatever
differs from it in one bit of the block then meets it at its home anchor, where
whole fingerprints are compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lanewise.llm.common import LONG, bridges, hash_map, keep, mapped, released, sent, struct
from lanewise.llm.components import components

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
#: Fingerprints of one anchor that are compared in one step; larger sets are compared block by block.
BLOCK = 1024
#: Shingles that are hashed before their bits are counted.
STEP = 1 << 17

_BITS_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_BYTE_SLOT = np.arange(8, dtype=np.int64) * 256


def fingerprint_of(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer; 0 for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total = max(1, len(words) - SHINGLE_WORDS + 1)
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, total, STEP):
        part = words[start : start + STEP + SHINGLE_WORDS - 1]
        shingles = zip(part, part[1:], part[2:]) if len(words) >= SHINGLE_WORDS else [words]
        hashes = np.fromiter(
            map(xxhash.xxh64_intdigest, map(b" ".join, shingles), repeat(SEED)), dtype="<u8"
        )
        slots = hashes.view(np.uint8).reshape(-1, 8) + _BYTE_SLOT
        ones += (np.bincount(slots.ravel(), minlength=2048).reshape(8, 256) @ _BITS_OF_BYTE).ravel()
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


@F.arrow_udf(LONG)
def _fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([fingerprint_of(cell.as_py()) for cell in batch], type=pa.int64())
        released()


def fingerprints(docs: DataFrame, text: str = "text"):
    """Column of signed 64-bit fingerprints of whole texts."""
    return _fingerprints(docs[text])


def _anchored(prints: DataFrame) -> DataFrame:
    """Each fingerprint with every anchor that it is copied to: (half, anchor, fp, home).

    ``syndrome`` names the bit to flip to reach the home anchor, 0 if none. The
    anchors two flips away come from pairs of positions whose XOR is the syndrome.
    """
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
    syndrome = " + ".join(f"shiftleft(bit_count(x & {m}L) % 2, {j})" for j, m in enumerate(masks))
    flipped = "transform(filter(sequence(0, 31), i -> i < (i ^ s)), i -> x ^ if(i = 0, 0L, shiftleft(1L, i - 1)) ^ shiftleft(1L, (i ^ s) - 1))"
    return (
        prints.select("fp", F.explode(F.array(F.lit(0), F.lit(1))).alias("half"))
        .select("fp", "half", F.expr(f"shiftrightunsigned(fp, 32 * half) & {(1 << 31) - 1}L").alias("x"))
        .select("fp", "half", "x", F.expr(syndrome).cast("int").alias("s"))
        .select(
            "fp",
            "half",
            F.expr("if(s = 0, x, x ^ shiftleft(1L, s - 1))").alias("own"),
            F.explode(F.expr(f"if(s = 0, array(x), {flipped})")).alias("anchor"),
        )
        .select("half", "anchor", "fp", (F.col("own") == F.col("anchor")).alias("home"))
    )


def _links_between(homes: np.ndarray, others: np.ndarray) -> list[dict[str, int]]:
    """Of the links between two sets of fingerprints, enough to connect what they connect."""
    near = np.bitwise_count((homes[:, None] ^ others[None, :]).view(np.uint64)) <= MAX_DISTANCE
    near &= homes[:, None] != others[None, :]
    of_home, of_other = bridges(near)
    moved = np.flatnonzero(of_other != np.arange(len(others)))
    pairs = [(homes[i], others[of_home[i]]) for i in np.flatnonzero(of_home >= 0)]
    pairs += [(others[j], others[of_other[j]]) for j in moved]
    return [{"a": int(a), "b": int(b)} for a, b in pairs]


@F.pandas_udf(T.ArrayType(struct(a=LONG, b=LONG)))
def _links_of(homes: pd.Series, others: pd.Series) -> pd.Series:
    found = [
        _links_between(np.asarray(h, dtype=np.int64), np.asarray(o, dtype=np.int64))
        for h, o in zip(homes, others)
    ]
    return pd.Series(found, dtype=object)


def links(prints: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that connect exactly what fingerprints within three bits connect.

    ``prints`` has distinct fingerprints ``fp``. Anchors with a single
    fingerprint are dropped by a count; the others are compared as arrays. An
    anchor with more than ``block`` fingerprints is dealt over pairs of blocks,
    each a row of its own, so that no row or task grows with the anchor.
    Each block reports a spanning forest of its links, never all pairs. The
    copies, up to 32 a fingerprint, are never sent whole to the driver or a task:
    Spark sizes them as if they were not exploded.
    """
    copies = _anchored(prints)
    busy = keep(
        copies.groupBy("half", "anchor")
        .agg(F.count("*").alias("n"), F.max("home").alias("met"))
        .filter("n > 1 and met")
        .select("half", "anchor", F.ceil(F.col("n") / block).cast("int").alias("parts")),
        "busy-anchors",
    )
    spread = copies.join(sent(busy), ["half", "anchor"]).withColumn(
        "part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    key = ["half", "anchor", "hp", "op"]
    as_home = spread.filter("home").select("half", "anchor", F.col("part").alias("hp"), every.alias("op"), "fp", F.lit(True).alias("home"))
    as_other = spread.select("half", "anchor", every.alias("hp"), F.col("part").alias("op"), "fp", F.lit(False).alias("home"))
    sets = (
        as_home.union(as_other)
        .groupBy(*key)
        .agg(
            F.collect_list(F.when(F.col("home"), F.col("fp"))).alias("homes"),
            F.collect_list(F.when(~F.col("home"), F.col("fp"))).alias("others"),
        )
        .filter((F.size("homes") > 0) & (F.size("others") > 0))
    )
    return sets.select(F.explode(_links_of("homes", "others")).alias("l")).select("l.a", "l.b")


def groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint, component_id, and ``root``.

    Texts are compared by fingerprint alone: null and blank texts have
    fingerprint 0 and belong together. ``component_id`` is the smallest
    non-null id that can be reached, null where no member has an id; ``root``
    names the group in any case. Repeated rows stay as they are. Only distinct
    fingerprints are compared, so exact copies cost one row. Other columns of
    ``docs`` are not read.
    """
    prints = keep(
        docs.select(F.col(doc_id).alias("doc_id"), fingerprints(docs, text).alias("fp")), "fingerprints"
    )
    distinct = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    linked = components(links(distinct.select("fp")))
    rooted = distinct.join(linked, distinct["fp"] == linked["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    rooted = keep(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = keep(rooted.join(firsts, "root").select("fp", "root", "component_id"), "named")
    return prints.join(named, "fp").select(
        "doc_id",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
        "root",
    )


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one left of each group, the one with the smallest id.

    Of rows that share this id, one stays. Ids that go or occur more than once are
    settled on narrow rows; texts whose ids a map of these does not have pass as they
    lie, only the others are joined with the ids. In a group without any id, one row
    per group stays. All columns are passed through.
    """
    found = keep(groups(docs, doc_id, text), "groups")
    ids = keep(
        found.filter("doc_id is not null")
        .groupBy(F.col("doc_id").alias("_id"))
        .agg(F.count("*").alias("_rows"), F.max(F.col("doc_id") == F.col("component_id")).alias("_stays")),
        "ids",
    )
    gone_or_many = ids.filter("_rows > 1 or not _stays").select("_id")
    seen = hash_map(gone_or_many, "_id")
    with_id = docs.filter(docs[doc_id].isNotNull())
    unsure = mapped(with_id, doc_id, seen, there=True)
    single = unsure.join(gone_or_many, unsure[doc_id] == gone_or_many["_id"], "left_anti")
    many = ids.filter("_rows > 1 and _stays").select("_id")
    named = (
        mapped(with_id, doc_id, seen, there=False)
        .unionByName(single)
        .unionByName(unsure.join(many, unsure[doc_id] == many["_id"], "left_semi").dropDuplicates([doc_id]))
    )
    nameless = docs.filter(docs[doc_id].isNull()).withColumn("_fp", fingerprints(docs, text))
    alone = found.filter("component_id is null").select(F.col("fingerprint").alias("_hex"), F.col("root").alias("_root")).distinct()
    nameless = (
        nameless.join(alone, F.lower(F.lpad(F.hex("_fp"), 16, "0")) == alone["_hex"])
        .dropDuplicates(["_root"])
        .drop("_fp", "_hex", "_root")
    )
    return named.unionByName(nameless)
