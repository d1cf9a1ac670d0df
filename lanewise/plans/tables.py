"""Uploads and snapshots of a set of shipments, as an account would hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators.kpis import count_shipments
from lanewise.operators.risk import headline_and_concentration, score_risk
from lanewise.plans.report import KPI_COLUMNS


def yearly_uploads(shipments: DataFrame) -> DataFrame:
    """One upload per order year, shared between two owners.

    Some uploads have no label, and one in seven years has failed.
    """
    year = F.col("upload_id").cast("int")
    return count_shipments(shipments).select(
        "upload_id",
        F.concat(F.lit("owner-"), (year % 2).cast("string")).alias("user_id"),
        F.concat(F.lit("orders-"), "upload_id", F.lit(".csv")).alias("filename"),
        F.when(year % 3 != 0, F.concat(F.lit("Orders "), "upload_id")).alias("label"),
        F.col("shipment_count").alias("row_count"),
        F.when(year % 7 == 0, "failed").otherwise("completed").alias("status"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("created_at"),
    )


def figures(facts: DataFrame) -> DataFrame:
    """Headline figures and risk of every dataset."""
    scored = score_risk(headline_and_concentration(facts))
    return scored.select("upload_id", F.col("score").alias("risk_score"), "level", *KPI_COLUMNS)


def yearly_snapshots(facts: DataFrame) -> DataFrame:
    """Two snapshots per upload, one of them from a run that stored no figures.

    In every fifth year the run without figures is the later one.
    """
    year = F.col("upload_id").cast("int")
    stored = ("risk_score", "level", *KPI_COLUMNS)
    runs = F.explode(F.array(F.lit("a"), F.lit("b"))).alias("run")
    both = figures(facts).select("*", runs)
    late_run = F.when(year % 5 == 0, "a").otherwise("b")
    has_figures = F.col("run") == "b"
    return both.select(
        F.concat("upload_id", F.lit("-"), "run").alias("id"),
        "upload_id",
        F.when(has_figures, "completed").otherwise("failed").alias("status"),
        F.make_date(year, F.when(F.col("run") == late_run, 3).otherwise(2), F.lit(1)).alias(
            "created_at"
        ),
        *(F.when(has_figures, F.col(c)).alias(c) for c in stored),
    )


def consecutive_pairs(uploads: DataFrame) -> DataFrame:
    """Each year's dataset next to the following year's."""
    following = (F.col("upload_id").cast("int") + 1).cast("string")
    return uploads.select(F.col("upload_id").alias("before_id"), following.alias("after_id"))


def lookup_requests(uploads: DataFrame) -> DataFrame:
    """Requests for datasets by exact name, part of a name, no name, pin, and a wrong name."""
    name = F.coalesce("label", "filename")
    kinds = {
        "exact": F.concat(F.lit("  "), F.upper(name), F.lit(" ")),
        "part": F.right("upload_id", F.lit(2)),
        "newest": F.lit(None),
        "pinned": F.lit("ignored"),
        "wrong": F.concat(F.lit("no such "), name),
    }
    rows = F.explode(
        F.array(
            *(
                F.struct(F.lit(kind).alias("kind"), text.cast("string").alias("name"))
                for kind, text in kinds.items()
            )
        )
    )
    return uploads.select("upload_id", "user_id", rows.alias("r")).select(
        F.concat("r.kind", F.lit("-"), "upload_id").alias("request_id"),
        "user_id",
        "r.name",
        F.when(F.col("r.kind") == "pinned", F.col("upload_id")).alias("pinned_id"),
    )
