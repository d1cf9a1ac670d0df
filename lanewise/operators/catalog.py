"""Owner scoping, joins, pages and dataset lookup over the stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.operators.entities import (
    COUNTRY_ORDER,
    VENDOR_ORDER,
    order_columns,
)
from lanewise.operators.history import dataset_label
from lanewise.operators.measures import DATASET

# How many rows the views that are named after it show, unless told otherwise.
VIEW_ROWS = 25
SUMMARY_ROWS = 5
LISTED_DATASETS = 12


def scan_upload(shipments: DataFrame, upload_id: str) -> DataFrame:
    """All shipments of one dataset; prunes partitions of a stored table."""
    return shipments.where(F.col("upload_id") == upload_id)


def page(rows: DataFrame, order: Sequence[Column | str], limit: int, offset: int = 0) -> DataFrame:
    """One page in a stated order; each task keeps only the rows up to the page.

    The rows in front of the page are gathered too, so for deep pages use ``page_after``.
    """
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_after(
    rows: DataFrame, order: Sequence[str], limit: int, last: Sequence[object] | None = None
) -> DataFrame:
    """The page that follows the row whose ``order`` columns equal ``last``.

    The filter reaches the scan and no task keeps more than ``limit`` rows,
    however deep the page. ``order`` must tell all rows apart and hold no NULL.
    """
    if last is not None:
        after = F.lit(False)
        same = F.lit(True)
        for column, value in zip(order, last, strict=True):
            after = after | (same & (F.col(column) > F.lit(value)))
            same = same & (F.col(column) == F.lit(value))
        rows = rows.where((F.col(order[0]) >= F.lit(last[0])) & after)
    return rows.orderBy(*order).limit(limit)


def newest_uploads(uploads: DataFrame, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Each owner's uploads ranked from the newest; one page of them if ``limit`` is given."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("upload_id"))
    ranked = uploads.withColumn("rank", F.row_number().over(newest))
    ranked = ranked.where(F.col("rank") > offset) if offset else ranked
    return ranked if limit is None else ranked.where(F.col("rank") <= offset + limit)


def scope_to_owner(rows: DataFrame, uploads: DataFrame, user_id: str) -> DataFrame:
    """Rows of datasets that belong to one owner, and no others."""
    owned = uploads.where(F.col("user_id") == user_id).select("upload_id")
    return rows.join(owned, "upload_id", "left_semi")


def analyses_for_user(snapshots: DataFrame, uploads: DataFrame, user_id: str) -> DataFrame:
    """One owner's snapshots with the owning upload, newest first."""
    owned = uploads.where(F.col("user_id") == user_id).select(
        "upload_id", "user_id", dataset_label().alias("label")
    )
    return snapshots.join(owned, "upload_id").orderBy(F.desc("created_at"), F.desc("id"))


def without_uploads(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows that remain once the datasets in ``deleted`` are gone."""
    return rows.join(deleted.select("upload_id").distinct(), "upload_id", "left_anti")


def top_per_dataset(
    rows: DataFrame, order: Sequence[str], limit: int, by: Sequence[str] = DATASET
) -> DataFrame:
    """The first ``limit`` rows of every dataset; tasks keep no more than that each."""
    ranking = Window.partitionBy(*by).orderBy(*order_columns(order))
    return rows.withColumn("rank", F.row_number().over(ranking)).where(F.col("rank") <= limit)


def top_vendors(
    scored: DataFrame, limit: int = VIEW_ROWS, by: Sequence[str] = DATASET
) -> DataFrame:
    return top_per_dataset(scored, VENDOR_ORDER, limit, by)


def top_countries(
    scored: DataFrame, limit: int = VIEW_ROWS, by: Sequence[str] = DATASET
) -> DataFrame:
    return top_per_dataset(scored, COUNTRY_ORDER, limit, by)


def resolve_dataset(
    uploads: DataFrame, requests: DataFrame, newest: int | None = None
) -> DataFrame:
    """Which dataset each request means.

    ``requests`` has ``request_id``, ``user_id``, ``name`` and ``pinned_id``. A
    pinned id decides alone; a blank name means the newest; otherwise the exact
    name wins over a name that contains the request, newer before older.
    Requests that match nothing come back with a NULL ``upload_id``. All of an
    owner's uploads are looked at, or their ``newest`` if that is given.
    """
    recent = newest_uploads(uploads, newest).select(
        "user_id", "upload_id", "rank", dataset_label().alias("label")
    )
    wanted = F.lower(F.trim(F.coalesce("name", F.lit(""))))
    name = F.lower(F.trim("label"))
    quality = (
        F.when(F.col("pinned_id").isNotNull(), F.when(F.col("upload_id") == F.col("pinned_id"), 0))
        .when(wanted == "", 0)
        .when(name == wanted, 0)
        .when(name.contains(wanted), 1)
    )
    candidates = (
        requests.join(recent, "user_id", "left")
        .withColumn("_quality", quality)
        .withColumn("_preference", F.when(quality.isNotNull(), F.struct("_quality", "rank")))
    )
    best = F.min_by(F.struct("upload_id", "label"), "_preference")
    return (
        candidates.groupBy("request_id", "user_id")
        .agg(best.alias("b"))
        .select("request_id", "user_id", "b.upload_id", "b.label")
    )
