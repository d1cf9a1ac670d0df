"""Connected components of a link table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.common import keep


def components(links: DataFrame) -> DataFrame:
    """Rows ``(node, root)`` for every node that occurs in ``links (a, b)``.

    ``root`` is the smallest node that can be reached. Each round points every
    node's larger neighbours at its smallest one, then every node and its
    smaller neighbours at the smallest of these; rounds end when no edge
    changes, after about the logarithm of the longest chain. Edges live in
    written tables; the driver sees one checksum a round. Smallest neighbours
    are combined on the map side and joined back from a written table, so that
    a node with very many neighbours is split over tasks. Links between a node
    and itself and rows with nulls are ignored; repeated links do no harm.
    """
    edges = keep(
        links.filter("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        "links",
    )
    seen = _checksum(edges)
    while seen[0]:
        edges = keep(_small_star(keep(_large_star(edges), "large-star")), "small-star")
        now = _checksum(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select("v", "v").distinct()
    )


def _checksum(edges: DataFrame) -> tuple[int, int | None]:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    smallest = keep(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "smallest")
    larger = edges.select(F.col("v").alias("u"), F.col("u").alias("w"))
    return (
        larger.join(smallest, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    smallest = keep(edges.groupBy("u").agg(F.min("v").alias("m")), "smallest")
    moved = edges.join(smallest, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(smallest).distinct()
