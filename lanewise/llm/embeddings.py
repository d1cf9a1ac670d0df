"""Near duplicates among embeddings, by an exact metric range join.

Vectors of one label are scaled to length one, where a cosine of at least c
means a distance of at most r = sqrt(2 - 2c). Pivots, picked by hash, divide a
label into cells; a vector's home is its nearest pivot q. By the triangle
inequality a vector within r of some vector at home with pivot p is at most 2r
farther from p than from q; dividing by how far the two pivots lie apart makes
this sharper: d(x,p)^2 - d(x,q)^2 <= 2 r d(p,q). Every vector is copied to each
cell where this holds, so each cell finds all partners of its own vectors alone.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import bridges, hash_sample, keep
from lanewise.llm.components import components

MIN_COSINE = 0.98
#: A label of n vectors has sqrt(n / CELL) pivots, so that neither cells nor copies at cell
#: borders grow as fast as the label; vectors in one block of a comparison.
CELL = 64
MAX_PIVOTS = 256
BLOCK = 2048
#: Slack for rounding when vectors are copied to cells; partners are decided by the cosine itself.
SLACK = 1e-6


def _matrix(vectors: pa.ChunkedArray) -> np.ndarray:
    flat = vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(vectors), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _deal(radius: float):
    """Of vectors and pivots of a label, each vector's cells and which one is its home."""

    def deal(vectors: pa.Table, pivots: pa.Table) -> pa.Table:
        points, centres = _matrix(vectors["vec"]), _matrix(pivots["vec"])
        far = np.maximum(0.0, 2 - 2 * points @ centres.T)
        home = far.argmin(axis=1)
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * centres @ centres.T))
        near = far - far.min(axis=1, keepdims=True) <= 2 * radius * apart[home] + SLACK
        near[np.arange(len(home)), home] = True
        row, cell = np.nonzero(near)
        return pa.table(
            {
                "grp": vectors["grp"].take(row),
                "cell": pa.array(cell.astype(np.int32)),
                "cid": vectors["cid"].take(row),
                "copies": vectors["copies"].take(row),
                "vec": vectors["vec"].take(row),
                "home": pa.array(cell == home[row]),
            }
        )

    return deal


def _compare(min_cosine: float):
    """Partners of a block of a cell's own vectors in a block of all its vectors."""

    def compare(block: pa.Table) -> pa.Table:
        home = block["home"].to_numpy().astype(bool)
        points, ids = _matrix(block["vec"]), block["cid"].to_numpy()
        copies = block["copies"].to_numpy()[~home]
        own, other = ids[home], ids[~home]
        near = points[home] @ points[~home].T >= min_cosine
        near &= own[:, None] != other[None, :]
        of_own, of_other = bridges(near)
        linked = np.flatnonzero(of_own >= 0)
        moved = np.flatnonzero(of_other != np.arange(len(other)))
        return pa.table(
            {
                "cid": np.concatenate([own[linked], other[moved]]),
                "partners": np.concatenate([near[linked] @ copies, np.zeros(len(moved), np.int64)]),
                "to": np.concatenate([other[of_own[linked]], other[of_other[moved]]]),
            }
        )

    return compare


def groups(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    min_cosine: float = MIN_COSINE,
    cell: int = CELL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label and equal length are compared. A
    vector that is null, empty, zero, or holds a null or non-finite component
    links with nothing: it has no links and is its own component. Equal vectors
    are compared once and counted as often as they occur; repeated rows count
    as vectors of their own. Rows without an id are counted as partners, take
    the smallest id of their component (null if it has none) and are never
    kept. Other columns are not read.
    """
    rows = keep(
        vectors.select(
            F.col(vec_id).cast("long").alias("vec_id"),
            F.col(label).alias("label"),
            F.col(embedding).cast("array<float>").alias("vec"),
            F.expr(
                f"coalesce({label} is not null and size({embedding}) > 0"
                f" and forall({embedding}, x -> x is not null and not isnan(x) and abs(x) < double('Infinity'))"
                f" and exists({embedding}, x -> x <> 0), false)"
            ).alias("usable"),
        ),
        "vectors",
    )
    grouped = rows.filter("usable").groupBy("label", "vec").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first_id")
    )
    classes = keep(
        grouped.select(
            F.monotonically_increasing_id().alias("cid"),
            F.struct("label", F.size("vec").alias("length")).alias("grp"),
            "vec",
            "copies",
            "first_id",
        ),
        "vector-classes",
    )
    found = keep(_partners(classes, min_cosine, cell, block), "partners")
    roots = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("partners").alias("partners"))
    rooted = (
        classes.join(roots, classes["cid"] == roots["node"], "left")
        .join(counts, "cid", "left")
        .select(
            F.col("grp.label").alias("label"),
            "vec",
            "first_id",
            F.coalesce("root", "cid").alias("root"),
            (F.col("copies") - 1 + F.coalesce("partners", F.lit(0))).alias("n_links"),
        )
    )
    rooted = keep(rooted, "rooted")
    firsts = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = keep(rooted.join(firsts, "root").drop("root", "first_id"), "named")
    linked = rows.filter("usable").join(named, ["label", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked.union(alone).select(
        "*", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    )


def _partners(classes: DataFrame, min_cosine: float, cell: int, block: int) -> DataFrame:
    """Rows (cid, partners, to): copies of linked classes met in one block, and links that connect them."""
    salt_rows = block
    sizes = classes.groupBy("grp").agg(F.count("*").alias("n"))
    sizes = sizes.select(
        "grp",
        F.ceil(F.sqrt(F.col("n") / cell)).alias("pivots"),
        F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"),
    )
    plain = classes.select("grp", "cid", "copies", "vec")
    chosen = hash_sample(classes.select("grp", "cid"), "grp", "cid", MAX_PIVOTS)
    chosen = chosen.join(sizes, "grp").filter(F.col("nth") <= F.col("pivots")).select("cid", "salts")
    pivots = classes.select("grp", "cid", "vec").join(chosen, "cid")
    pivots = keep(
        pivots.select("grp", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "vec"),
        "pivots",
    )
    salted = plain.join(sizes.select("grp", "salts"), "grp").select(
        "*", F.pmod(F.xxhash64("cid"), F.col("salts")).cast("int").alias("salt")
    )
    radius = float(np.sqrt(max(0.0, 2 - 2 * min_cosine)))
    grp = classes.schema["grp"].dataType.simpleString()
    dealt = keep(
        salted.drop("salts")
        .groupBy("grp", "salt")
        .cogroup(pivots.groupBy("grp", "salt"))
        .applyInArrow(
            _deal(radius), f"grp {grp}, cell int, cid long, copies long, vec array<float>, home boolean"
        ),
        "cells",
    )
    parts = dealt.groupBy("grp", "cell").agg(F.ceil(F.count("*") / block).cast("int").alias("parts"))
    spread = dealt.join(parts, ["grp", "cell"]).withColumn(
        "part", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    )
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    value = ["cid", "copies", "vec"]
    own = spread.filter("home").select("grp", "cell", F.col("part").alias("op"), every.alias("ap"), *value, F.lit(True).alias("home"))
    other = spread.select("grp", "cell", every.alias("op"), F.col("part").alias("ap"), *value, F.lit(False).alias("home"))
    return (
        own.union(other)
        .groupBy("grp", "cell", "op", "ap")
        .applyInArrow(_compare(min_cosine), "cid long, partners long, to long")
    )

