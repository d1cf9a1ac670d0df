"""Mixing sources to target weights by entropy balancing.

Among all document rates that give every source its target number of words,
entropy balancing takes those closest to uniform. The solution tilts documents
exponentially by the constraint they enter: rate = min(cap, exp(lambda * size /
scale)), with one multiplier per source. Multipliers solve the convex dual by
Newton steps, guarded by a bracket. Documents of one source and size share a
rate, so (source, size, count) cells are all that the steps need to read; cells
and multipliers stay in tables, and each step is one join and one grouping.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import WORD, keep, sent

WEIGHTS = (1, 2, 3)
CAP = 3
#: Share of the target that may be missed before rounding, and Newton steps at most.
TOLERANCE = 1e-9
STEPS = 100
#: Documents of one cell that are ranked in one task.
RANKED = 512


def words(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``sources (source, source_size)`` with ``k``, the place in code point order, and ``target``.

    Nulls come last. Places come from a distributed sort: a row's place within
    its part plus the rows of earlier parts. The level up to which weights fill
    rises until no further source is above its cap; each round is one sum.
    """
    placed = keep(
        sources.orderBy(F.col("source").asc_nulls_last()).withColumn(
            "at", F.monotonically_increasing_id()
        ),
        "sources",
    )
    part = F.shiftright("at", 33).alias("part")
    before = placed.groupBy(part).agg(F.count("*").alias("rows"))
    before = before.select(
        "part", (F.sum("rows").over(Window.orderBy("part")) - F.col("rows")).alias("before")
    )
    ranked = placed.withColumn("part", part).join(before, "part")
    k = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (k % len(weights) + 1).cast("int"))
    ranked = keep(ranked.select("source", "source_size", k.alias("k"), weight.alias("weight")), "ranked")
    limit = cap * F.col("source_size")
    level, capped = 0.0, -1
    while True:
        above = limit < level * F.col("weight")
        row = ranked.agg(
            F.count_if(above).alias("capped"),
            F.sum("source_size").alias("all"),
            F.sum(F.when(above, limit)).alias("fixed"),
            F.sum(F.when(~above, F.col("weight"))).alias("free"),
        ).first()
        if row["capped"] == capped or not row["free"]:
            break
        capped, level = row["capped"], (row["all"] - (row["fixed"] or 0)) / row["free"]
    target = F.least(limit.cast("double"), level * F.col("weight"))
    return ranked.withColumn("target", target).drop("weight")


def multipliers(cells: DataFrame, goals: DataFrame, cap: int = CAP) -> DataFrame:
    """Newton's steps on the dual: ``(k, scale, multiplier)`` for every source with words.

    ``cells (k, size, n)`` have positive sizes, ``goals (k, source_size, target)``.
    """
    shape = cells.groupBy("k").agg(F.min("size").alias("least"), F.sum("n").alias("docs"))
    scale = F.col("source_size") / F.col("docs")
    wanted = F.log(F.col("target") / F.col("source_size"))
    edge = scale / F.col("least")
    state = goals.filter("source_size > 0").join(shape, "k").select(
        "k",
        "target",
        scale.alias("scale"),
        F.when(wanted <= 0, wanted * edge).otherwise(0.0).alias("lo"),
        F.when(wanted <= 0, 0.0).otherwise(edge * float(np.log(cap))).alias("hi"),
        F.when(F.col("target") >= cap * F.col("source_size"), edge * float(np.log(cap)))
        .otherwise(0.0)
        .alias("multiplier"),
        F.lit(False).alias("solved"),
    )
    state = keep(state, "multipliers")
    for _ in range(STEPS):
        tilt = F.exp(F.col("multiplier") * F.col("size") / F.col("scale"))
        size, n = F.col("size").cast("double"), F.col("n").cast("double")
        moments = (
            cells.join(state.filter("not solved").select("k", "scale", "multiplier"), "k")
            .groupBy("k")
            .agg(
                F.sum(n * size * F.least(F.lit(float(cap)), tilt)).alias("got"),
                F.sum(F.when(tilt < cap, n * size * size / F.col("scale") * tilt)).alias("slope"),
            )
        )
        miss = F.col("got") - F.col("target")
        newton = F.col("multiplier") - miss / F.col("slope")
        lo = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("lo"))
        hi = F.when(miss < 0, F.col("hi")).otherwise(F.col("multiplier"))
        solved = F.col("solved") | (F.abs(miss) <= TOLERANCE * F.col("target"))
        stepped = state.join(moments, "k", "left").select(
            "k",
            "target",
            "scale",
            F.when(F.col("solved"), F.col("lo")).otherwise(lo).alias("lo"),
            F.when(F.col("solved"), F.col("hi")).otherwise(hi).alias("hi"),
            F.when(solved, F.col("multiplier"))
            .when((newton > lo) & (newton < hi), newton)
            .otherwise((lo + hi) / 2)
            .alias("multiplier"),
            solved.alias("solved"),
        )
        state = keep(stepped, "multipliers")
        if not state.filter("not solved").take(1):
            break
    return state.select("k", "scale", "multiplier")


def _rounded(cap: int):
    """Whole copies for the cells of one source, largest sizes first.

    Each cell's copies are rounded so that the words owed so far come out
    nearest to none; what is left at the end is spread over cells again, beyond
    their rates if need be, within the cap.
    """

    def rounded(cells: pd.DataFrame) -> pd.DataFrame:
        cells = cells.sort_values("size", ascending=False, ignore_index=True)
        size, n, exact = (cells[c].to_numpy() for c in ("size", "n", "exact"))
        copies, owed = np.zeros(len(cells), dtype=np.int64), 0.0
        for i, (s, m, e) in enumerate(zip(size.tolist(), n.tolist(), exact.tolist())):
            e = min(max(e, 0.0), cap * m)
            c = min(max(round(e + owed / s), int(np.floor(e))), int(np.ceil(e)))
            copies[i], owed = c, owed + (e - c) * s
        for i, (s, m) in enumerate(zip(size.tolist(), n.tolist())):
            more = min(max(round(owed / s), -int(copies[i])), cap * m - int(copies[i]))
            copies[i], owed = copies[i] + more, owed - more * s
        return cells[["k", "size", "rate"]].assign(copies=copies)

    return rounded


def sizes(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return keep(
        docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("_source"), words(text).alias("_size")),
        "sizes",
    )


def cell_copies(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """One row per source and size: figures of the source, rate, and copies of all its documents."""
    cells = keep(sized.groupBy("_source", "_size").agg(F.count("*").alias("n")), "cells")
    sources = cells.groupBy(F.col("_source").alias("source")).agg(
        F.sum(F.col("_size") * F.col("n")).alias("source_size")
    )
    goals = keep(targets(sources, weights, cap), "targets")
    numbered = cells.join(goals, cells["_source"].eqNullSafe(goals["source"])).withColumnRenamed("_size", "size")
    numbered = keep(numbered, "numbered")
    filled = numbered.select("k", "size", "n").filter("size > 0")
    solved = multipliers(filled, goals, cap)
    tilt = F.exp(F.col("multiplier") * F.col("size") / F.col("scale"))
    rates = filled.join(solved, "k").withColumn("rate", F.round(F.least(F.lit(float(cap)), tilt), 9))
    whole = (
        rates.select("k", "size", "n", "rate", (F.col("rate") * F.col("n")).alias("exact"))
        .groupBy("k")
        .applyInPandas(_rounded(cap), "k long, size long, rate double, copies long")
    )
    return keep(
        numbered.join(whole, ["k", "size"], "left").select(
            F.col("k").alias("_k"),
            F.col("source").alias("_from"),
            F.col("size").alias("_words"),
            F.col("n").alias("_n"),
            F.coalesce("copies", "n").alias("_copies"),
            F.struct(
                "size", "source_size", "target", F.coalesce("rate", F.lit(1.0)).alias("rate")
            ).alias("_figures"),
        ),
        "cell-copies",
    )


_CELL = ["_k", "_words", "_part"]


def _placed(frame: DataFrame, cells: DataFrame, key: str, origin: str) -> DataFrame:
    """The rows, whose number of words is in ``_size``, with their cell and the part of it that they are ranked in."""
    same = frame[origin].eqNullSafe(cells["_from"]) & (frame["_size"] == cells["_words"])
    part = F.pmod(F.xxhash64(F.col(key)), F.ceil(F.col("_n") / RANKED)).cast("int")
    return frame.join(cells, same).withColumn("_part", part)


def _spot(key: str) -> Column:
    return F.xxhash64(F.lit(1), F.col(key))


def _ranked(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """All rows ``sized`` with their cell, and ``_bonus``: whether they get one copy more than others of it."""
    placed = _placed(sized, cells, "_id", "_source")
    counts = placed.groupBy(*_CELL).agg(
        F.count("*").alias("rows"),
        F.first(F.col("_copies") % F.col("_n")).alias("extra"),
        F.first("_n").alias("n"),
    )
    upto = F.sum("rows").over(Window.partitionBy("_k", "_words").orderBy("_part"))
    quota = F.expr("(extra * upto) div n - (extra * (upto - rows)) div n").alias("_quota")
    shares = keep(counts.withColumn("upto", upto).select(*_CELL, quota), "shares")
    order = Window.partitionBy(*_CELL).orderBy(_spot("_id"), F.col("_id"))
    bonus = (F.row_number().over(order) <= F.col("_quota")).cast("long")
    return placed.join(shares, _CELL).withColumn("_bonus", bonus)


def rated(sized: DataFrame, cells: DataFrame) -> DataFrame:
    """All rows ``sized`` with ``_mix``: figures and copies.

    Of documents with equal source and size, a hash of the id decides which get
    one copy more, so reruns agree. Cells with very many documents are ranked
    in parts, each with its exact share of the extra copies.
    """
    copies = (F.floor(F.col("_copies") / F.col("_n")) + F.col("_bonus")).alias("copies")
    mix = F.struct("_figures.*", copies)
    return _ranked(sized, cells).select(*sized.columns, mix.alias("_mix"))


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, rate, copies, taken.

    A document's size is its number of words, 0 for null and blank texts: these
    keep rate 1 and add nothing. Null is a source of its own, the last. Copies
    are whole and at most ``cap``; ``taken`` is copies times size. Rows that
    repeat an id are documents of their own. Other columns are not read.
    """
    sized = sizes(docs, doc_id, text, source)
    found = rated(sized, cell_copies(sized, weights, cap))
    taken = (F.col("_mix.copies") * F.col("_mix.size")).alias("taken")
    return found.select(F.col("_id").alias(doc_id), "_mix.*", taken)


def mixed(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    cap: int = CAP,
) -> DataFrame:
    """The mixture itself: every row of ``docs``, all columns, as often as it has copies.

    Copies are decided on narrow rows (id, source, size). Of these remains, per
    cell and part, the last id by hash that gets one copy more: texts are held
    against it where they lie, so none is dealt out. Rows equal in id, source and
    size are numbered only where some of them get a copy more and others do not.
    """
    sized = sizes(docs, doc_id, text, source)
    cells = cell_copies(sized, weights, cap).drop("_figures")
    alike = _ranked(sized, cells).groupBy(*_CELL, _spot("_id").alias("spot"), F.col("_id").alias("id")).agg(
        F.sum("_bonus").alias("more"), F.count("*").alias("rows")
    )
    last = alike.filter("more > 0").groupBy(*_CELL).agg(F.max(F.struct("spot", "id", "more", "rows")).alias("_last"))
    last = keep(last, "last")
    named = docs.withColumns({"_id": F.col(doc_id), "_source": F.col(source), "_size": words(text)})
    placed = _placed(named, sent(cells), "_id", "_source").join(sent(last), _CELL, "left")
    own = F.struct(_spot("_id").alias("spot"), F.col("_id").alias("id"))
    end = F.struct("_last.spot", "_last.id")
    has, torn = F.col("_last").isNotNull(), F.col("_last.more") < F.col("_last.rows")
    split = has & (own == end) & torn
    base = F.floor(F.col("_copies") / F.col("_n")).cast("int")
    found = placed.filter(~split).withColumn("_times", base + F.when(has & (own <= end), 1).otherwise(0))
    if last.filter(torn).take(1):
        nth = F.row_number().over(Window.partitionBy(*_CELL, "_id").orderBy(F.xxhash64(text)))
        some = placed.filter(split).withColumn("_nth", nth)
        more = F.when(F.col("_nth") <= F.col("_last.more"), 1).otherwise(0)
        found = found.unionByName(some.withColumn("_times", base + more).drop("_nth"))
    copy = F.explode(F.array_repeat(F.lit(0), F.col("_times"))).alias("_copy")
    return found.select(*docs.columns, copy).drop("_copy")
