"""Stored snapshots: latest per dataset, history over uploads, comparison of two."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions.numeric import rounded, sentence, signed_text1, text1
from lanewise.operators.trends import half_means

OWNER = ("user_id",)
SIGNIFICANT_DELTA = 1.0
FLAT_DELTA = 0.05

# The compared figures, and whether a rise is bad news.
COMPARED = {
    "risk_score": True,
    "late_shipment_pct": True,
    "avg_delay_days": True,
    "p90_delay_days": True,
    "delivery_success_rate": False,
    "value_at_risk": True,
    "distinct_vendors": False,
}


def latest_snapshot(snapshots: DataFrame, by: Sequence[str] = ("upload_id",)) -> DataFrame:
    """The newest snapshot of each dataset.

    An aggregate rather than a ranking: each map task keeps one row per
    dataset, however many snapshots one dataset has.
    """
    rest = [c for c in snapshots.columns if c not in by]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id"))
    return snapshots.groupBy(*by).agg(newest.alias("s")).select(*by, "s.*")


def dataset_label() -> Column:
    return F.coalesce(F.nullif("label", F.lit("")), F.col("filename"))


def history_points(
    uploads: DataFrame, snapshots: DataFrame, limit: int | None = None
) -> DataFrame:
    """Each owner's completed uploads with stored figures, the newest ``limit`` if one is given.

    Uploads without a stored risk score are skipped; a figure the snapshot
    lacks reads as 0.
    """
    completed = uploads.where("status = 'completed'")
    if limit is not None:
        newest = Window.partitionBy(*OWNER).orderBy(F.desc("created_at"), F.desc("upload_id"))
        ranked = completed.withColumn("_rank", F.row_number().over(newest))
        completed = ranked.where(F.col("_rank") <= limit)
    chosen = completed.select(
        *OWNER,
        "upload_id",
        dataset_label().alias("label"),
        F.col("created_at").alias("uploaded_at"),
        "row_count",
    )
    stored = latest_snapshot(snapshots).where("risk_score is not null")
    figures = ("late_shipment_pct", "avg_delay_days", "delivery_success_rate")
    return chosen.join(
        stored.select(
            "upload_id", *(F.coalesce(f, F.lit(0.0)).alias(f) for f in figures), "risk_score"
        ),
        "upload_id",
    ).select(*OWNER, "upload_id", "label", "uploaded_at", "row_count", *figures, "risk_score")


def history_direction(points: DataFrame) -> DataFrame:
    """Whether each owner's risk is rising, with a sentence."""
    first = F.struct("uploaded_at", "upload_id")
    ends = {}
    for figure in ("risk_score", "late_shipment_pct", "avg_delay_days"):
        ends[f"first_{figure}"] = F.min_by(figure, first)
        ends[f"last_{figure}"] = F.max_by(figure, first)
    halves = half_means(
        points,
        OWNER,
        first,
        "risk_score",
        *(column.alias(name) for name, column in ends.items()),
    )
    enough = F.col("period_count") >= 2
    delta = F.when(enough, rounded(F.col("second_half") - F.col("first_half")))
    direction = (
        F.when(~enough, "insufficient_data")
        .when(F.col("risk_delta") > SIGNIFICANT_DELTA, "worsening")
        .when(F.col("risk_delta") < -SIGNIFICANT_DELTA, "improving")
        .otherwise("stable")
    )
    figures = (
        F.col("period_count"),
        text1(F.col("first_risk_score")),
        text1(F.col("last_risk_score")),
        signed_text1(F.col("risk_delta")),
        F.col("direction"),
        text1(F.col("first_late_shipment_pct")),
        text1(F.col("last_late_shipment_pct")),
        text1(F.col("first_avg_delay_days")),
        text1(F.col("last_avg_delay_days")),
    )
    summary = F.when(~enough, schema.FEW_UPLOADS_TEXT).otherwise(
        sentence(schema.HISTORY_TEXT, *figures)
    )
    return (
        halves.withColumn("risk_delta", delta)
        .withColumn("direction", direction)
        .withColumn("summary", summary)
        .withColumnRenamed("period_count", "point_count")
        .select(*OWNER, "point_count", "direction", "risk_delta", "summary")
    )


def compare_metrics(
    figures: DataFrame, pairs: DataFrame, key: str = "upload_id"
) -> DataFrame:
    """Before-and-after of the compared figures for each (before, after) pair.

    ``figures`` has one row per dataset with the compared columns, ``pairs``
    the columns ``before_id`` and ``after_id``. Any number of pairs is one job;
    both joins move one row per pair, which becomes one per figure afterwards.
    """
    values = F.struct(*(F.col(m).cast("double").alias(m) for m in COMPARED))
    before = figures.select(F.col(key).alias("before_id"), values.alias("b"))
    after = figures.select(F.col(key).alias("after_id"), values.alias("a"))
    listed = F.array(
        *(
            F.struct(
                F.lit(m).alias("metric"),
                F.col(f"b.{m}").alias("before"),
                F.col(f"a.{m}").alias("after"),
            )
            for m in COMPARED
        )
    )
    joined = (
        pairs.join(before, "before_id")
        .join(after, "after_id")
        .select("before_id", "after_id", F.inline(listed))
    )
    change = F.col("after") - F.col("before")
    rise_is_bad = F.col("metric").isin(*(m for m, bad in COMPARED.items() if bad))
    worse = F.when(rise_is_bad, change > 0).otherwise(change < 0)
    return joined.select(
        "before_id",
        "after_id",
        "metric",
        "before",
        "after",
        rounded(change, 4).alias("change"),
        F.when(F.abs(change) < FLAT_DELTA, "neutral")
        .when(worse, "worse")
        .otherwise("better")
        .alias("assessment"),
    )
