"""Trie of conversation prefixes by composable fingerprints.

A sequence of turns has the fingerprint (length, sum of turn hash times base to
the power of its place), in four lanes modulo a prime. Fingerprints form a
monoid: that of a concatenation is (m + n, left + base^m * right). So a
conversation that is rebuilt from the head of another one and its own suffix
gets the fingerprints of all its prefixes from prefix sums of the stored
conversations, shifted and added; no rebuilt text exists anywhere.

Prefixes meet by depth and fingerprint. The members of a group name their last
turn by its content reference and the fingerprint of the prefix before; both
must be the same in all members, and turns with one reference are compared text
by text where they are stored. By induction over the depth equal groups are
equal sequences. Should a comparison fail, all is done again with another seed.

Sums over subtrees take one step per doubling of the depth: nodes add what
their descendants at exactly 1, 2, 4, ... levels below have gathered. An
ancestor is looked up by (smallest member, depth), which is unique, so no step
has a hot key.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.llm.common import LONG, WORD, keep, struct

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_013, 69_069_641, 1_812_433_253 % PRIME)
LANES = range(4)
SPAN = 20
HEADS = 4
#: Ids of one row of ids that are digested; a power of two.
IDS = 4096
EMPTY = hashlib.sha256().hexdigest()
NODE = ["depth", "x", "y"]


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    found, left = np.ones(len(exponent), dtype=np.int64), exponent.astype(np.int64)
    while left.any():
        found = np.where(left & 1, found * base % PRIME, found)
        base, left = base * base % PRIME, left >> 1
    return found


@F.arrow_udf(struct(t0=LONG, t1=LONG, t2=LONG, t3=LONG))
def _terms(a: pa.Array, b: pa.Array, place: pa.Array) -> pa.Array:
    """The turn hash times the base to the power of its place, for each lane."""
    a, b, place = (np.asarray(x) for x in (a, b, place))
    lanes = (a & PRIME, a >> 31 & PRIME, b & PRIME, b >> 31 & PRIME)
    terms = [v % PRIME * _power(base, place) % PRIME for v, base in zip(lanes, BASES)]
    return pa.StructArray.from_arrays([pa.array(t) for t in terms], names=["t0", "t1", "t2", "t3"])


def stored(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, seed: int) -> DataFrame:
    """Turns with their place, content reference (a, b), terms t and prefix sums s, as a written table."""
    rows = turns.select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).where("conv IS NOT NULL")
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    named = rows.select(
        "conv",
        F.row_number().over(order).cast("long").alias("place"),
        "role",
        "text",
        F.xxhash64(F.lit(seed), "role", "text").alias("a"),
        F.xxhash64(F.lit(seed + 1), "role", "text").alias("b"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )
    placed = named.select("*", _terms("a", "b", "place").alias("t")).select("*", "t.*").drop("t")
    so_far = Window.partitionBy("conv").orderBy("place")
    return keep(placed.withColumns({f"s{i}": F.sum(f"t{i}").over(so_far) % PRIME for i in LANES}), "trie-turns")


def rebuilding(turns: DataFrame, span: int, heads: int) -> DataFrame:
    """How each conversation is rebuilt: head turns, sums at the cut, and the factor that shifts its suffix."""
    skipped = (F.crc32(F.col("conv").cast("string").cast("binary")) % heads).cast("long")
    lanes = [f"s{i}" for i in LANES]
    own = turns.groupBy("conv").agg(
        F.count("*").alias("length"),
        F.max(F.when(F.col("place") == skipped, F.struct(*lanes))).alias("cut"),
    )
    turn = F.struct("place", *lanes, *(f"t{i}" for i in LANES), "a", "b", "words")
    head = (
        turns.where((F.col("place") < heads) & (F.col("conv") % span == 0))
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(turn)).alias("head"))
    )
    planned = (
        own.withColumn("skipped", skipped)
        .withColumn("base", F.col("conv") - F.col("conv") % span)
        .join(head, "base", "left")
        .withColumn("head", F.coalesce(F.filter("head", lambda t: t["place"] <= F.col("skipped")), F.array()))
        .withColumn("led", F.size("head").cast("long"))
    )
    powers = {i: [pow(BASES[i], back, PRIME) for back in range(-heads + 1, 1)] for i in LANES}
    shift = (F.col("led") - F.col("skipped") + heads).cast("int")
    last = F.try_element_at("head", F.lit(-1))
    return keep(
        planned.select(
            "conv",
            "length",
            "skipped",
            "led",
            "head",
            (F.col("led") + F.greatest(F.col("length") - F.col("skipped"), F.lit(0))).alias("total"),
            *(F.coalesce(F.col("cut")[f"s{i}"], F.lit(0)).alias(f"cut{i}") for i in LANES),
            *(F.coalesce(last[f"s{i}"], F.lit(0)).alias(f"led{i}") for i in LANES),
            *(F.element_at(F.array(*map(F.lit, powers[i])), shift).cast("long").alias(f"factor{i}") for i in LANES),
        ),
        "trie-plans",
    )


def _joined(left: Column, right: Column) -> Column:
    return F.shiftleft(left, 31).bitwiseOR(right)


def prefixes(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Every prefix of every rebuilt conversation: member, depth, fingerprint (x, y), that of the prefix before, and last turn."""

    def row(depth: Column, ends: Column, sums: list[Column], terms: list[Column], turn: list[Column]) -> list[Column]:
        before = [F.pmod(s - t, F.lit(PRIME)) for s, t in zip(sums, terms)]
        return [
            F.col("conv").alias("member"),
            depth.alias("depth"),
            _joined(sums[0], sums[1]).alias("x"),
            _joined(sums[2], sums[3]).alias("y"),
            _joined(before[0], before[1]).alias("px"),
            _joined(before[2], before[3]).alias("py"),
            *turn,
            ends.alias("ends"),
        ]

    c = F.col
    lane = lambda i: c(f"factor{i}") * F.pmod(c(f"s{i}") - c(f"cut{i}"), F.lit(PRIME))
    suffix = turns.join(plans.drop("head"), "conv").where("place > skipped")
    own = suffix.select(
        *row(
            c("place") - c("skipped") + c("led"),
            c("place") == c("length"),
            [(c(f"led{i}") + lane(i)) % PRIME for i in LANES],
            [c(f"factor{i}") * c(f"t{i}") % PRIME for i in LANES],
            [c("a"), c("b"), c("words")],
        )
    )
    led = plans.select("conv", "led", "length", "skipped", F.explode("head").alias("h")).select(
        *row(
            c("h.place"),
            (c("h.place") == c("led")) & (c("length") <= c("skipped")),
            [c(f"h.s{i}") for i in LANES],
            [c(f"h.t{i}") for i in LANES],
            [c("h.a"), c("h.b"), c("h.words")],
        )
    )
    return keep(own.unionByName(led), "trie-prefixes")


def grouped(found: DataFrame) -> DataFrame:
    """Nodes below the root, with ``sound``: whether all members agree on their last turn and the node before."""
    same = [F.min(c) == F.max(c) for c in ("px", "py", "a", "b")]
    return keep(
        found.groupBy(*NODE).agg(
            F.min("member").alias("conv_id"),
            F.count("*").alias("n_convs"),
            *(F.min(c).alias(c) for c in ("px", "py", "words")),
            reduce(Column.__and__, same).alias("sound"),
        ),
        "trie-nodes",
    )


def _one_text_each(turns: DataFrame) -> bool:
    """Whether all stored turns of one content reference have the same role and text."""
    texts = turns.groupBy("a", "b").agg(
        ((F.min("role") != F.max("role")) | (F.min("text") != F.max("text"))).alias("mixed")
    )
    return not texts.where("mixed").take(1)


def end_digests(found: DataFrame, plans: DataFrame) -> DataFrame:
    """SHA-256 over the ids of the conversations that end at each node, ascending and comma-joined.

    Ids are put together in rows of a few thousand neighbouring ids first; a
    node's rows then pass through a running digest in order.
    """
    at = found.where("ends").select(*NODE, "member")
    turnless = plans.where("total = 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.col("conv").alias("member")
    )
    block = F.shiftright("member", IDS.bit_length() - 1).alias("block")
    ids = F.transform(F.sort_array(F.collect_list("member")), lambda i: i.cast("string"))
    rows = at.unionByName(turnless).groupBy(*NODE, block).agg(F.array_join(ids, ",").alias("ids"))

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, running = None, None

        def made(done: list) -> pa.RecordBatch:
            columns = list(zip(*done)) or [(), (), (), ()]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds)], names=[*NODE, "ends_sha256"])

        for batch in batches:
            done = []
            for *key, text in zip(*(batch.column(c).to_pylist() for c in (*NODE, "ids"))):
                if key == node:
                    running.update(b"," + text.encode())
                    continue
                if node:
                    done.append((*node, running.hexdigest()))
                node, running = key, hashlib.sha256(text.encode())
            yield made(done)
        if node:
            yield made([(*node, running.hexdigest())])

    ordered = rows.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return ordered.mapInArrow(digested, struct(depth=LONG, x=LONG, y=LONG).add("ends_sha256", "string"))


def subtree_sums(nodes: DataFrame, found: DataFrame, deepest: int) -> DataFrame:
    """``n_leaves`` and ``saved_tokens`` of every node's subtree, from each node's own ``leaf`` and ``saved``."""
    sums = nodes.select(*NODE, "conv_id", "px", "py", F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"))
    figures, reach = ("n_leaves", "saved_tokens"), 1
    while reach < deepest:
        below = sums.where(F.col("depth") > reach)
        up = (F.col("depth") - reach).alias("depth")
        if reach == 1:
            above = below.select(up, F.col("px").alias("x"), F.col("py").alias("y"), *figures)
        else:
            asked = below.select(F.col("conv_id").alias("member"), up, *figures)
            above = asked.join(found.select("member", *NODE), ["member", "depth"])
        more = above.groupBy(*NODE).agg(*(F.sum(f).alias(f"more_{f}") for f in figures))
        added = {f: F.col(f) + F.coalesce(F.col(f"more_{f}"), F.lit(0)) for f in figures}
        sums = keep(sums.join(more, NODE, "left").withColumns(added).select(*sums.columns), "trie-sums")
        reach *= 2
    return sums.select(*NODE, *figures)


def prefix_trie(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    span: int = SPAN,
    heads: int = HEADS,
    seed: int = 1,
) -> DataFrame:
    """One row per node of the trie of rebuilt conversations, with the columns named below.

    Conversation c is rebuilt from the first h turns of conversation c - c %
    span, none if it is absent, and its own turns after its first h; h is the
    CRC-32 of the decimal c modulo ``heads``. Columns: conv_id (smallest member),
    depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Turns are in the order of ``turn``, null first, then of role and
    text, so repeated rows are turns of their own. Null roles and texts count as
    empty. Rows without a conversation id belong to no conversation. A table
    without conversations has no node. Other columns are not read.
    """
    while True:
        stored_turns = stored(turns, conv_id, turn, role, text, seed)
        plans = rebuilding(stored_turns, span, heads)
        found = prefixes(stored_turns, plans)
        nodes = grouped(found)
        if _one_text_each(stored_turns) and not nodes.where("NOT sound").take(1):
            break
        seed += 2
    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("px").alias("x"), F.col("py").alias("y")).agg(
        F.count("*").alias("n_children")
    )
    nodes = keep(
        nodes.drop("sound").join(children, NODE, "left").select(
            *NODE, "conv_id", "n_convs", "px", "py",
            F.coalesce("n_children", F.lit(0)).alias("n_children"),
            F.col("n_children").isNull().cast("long").alias("leaf"),
            ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
        ),
        "trie-children",
    )
    whole = nodes.agg(
        F.coalesce(F.max("depth"), F.lit(0)).alias("deepest"),
        F.sum("leaf").alias("leaves"),
        F.coalesce(F.sum("saved"), F.lit(0)).alias("saved"),
        F.count_if(F.col("depth") == 1).alias("tops"),
    ).first()
    root = plans.agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs")).first()
    ends = keep(end_digests(found, plans), "trie-ends")
    sums = subtree_sums(nodes, found, whole["deepest"])
    parents = nodes.select(
        (F.col("depth") + 1).alias("depth"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id")
    )
    parented = keep(nodes.join(parents, ["depth", "px", "py"], "left").drop("px", "py", "leaf", "saved"), "trie-parents")
    first = F.lit(root["conv_id"]).cast("long")
    below = parented.join(sums, NODE).withColumn("parent_conv_id", F.coalesce("parent_conv_id", first))
    top = (
        turns.sparkSession.range(1 if root["n_convs"] else 0)
        .select(
            *(F.lit(0).cast("long").alias(c) for c in NODE),
            first.alias("conv_id"),
            F.lit(root["n_convs"]).alias("n_convs"),
            F.lit(whole["tops"]).alias("n_children"),
            F.lit(None).cast("long").alias("parent_conv_id"),
            F.lit(whole["leaves"] or 1).cast("long").alias("n_leaves"),
            F.lit(whole["saved"]).cast("long").alias("saved_tokens"),
        )
    )
    return below.unionByName(top).join(ends, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
