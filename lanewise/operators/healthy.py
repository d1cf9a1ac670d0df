"""What is demonstrably working, as flags and as sentences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions.numeric import sentence, text1
from lanewise.operators.entities import VENDOR_ORDER, order_columns, score_vendors
from lanewise.operators.measures import DATASET, join_datasets
from lanewise.operators.risk import headline_of, headline_rollup
from lanewise.operators.trends import direction_from, trend_points

# Fixed values.
GOOD_SUCCESS_PCT = 85.0
GOOD_LATE_PCT = 15.0
GOOD_AVG_DELAY = 3.0
MIN_VENDORS = 3
MIN_COUNTRIES = 3
STRONG_HEALTH = 85.0
NAMED_VENDORS = 3

FLAGS = (
    "good_success good_late_rate good_delay vendor_diversity country_diversity"
    " strong_vendors improving"
).split()


def strongest_named(scored: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    """Up to three reliable vendors per dataset, the least healthy of them first."""
    ranking = Window.partitionBy(*by).orderBy(*order_columns(VENDOR_ORDER))
    strong = scored.where(F.col("health_score") >= STRONG_HEALTH)
    ranked = strong.withColumn("rank", F.row_number().over(ranking))
    return ranked.where(F.col("rank") <= NAMED_VENDORS).select(*by, "rank", "vendor")


def joined_names(rank: str = "rank", vendor: str = "vendor") -> Column:
    """Aggregate: the named vendors as one text, NULL when there are none."""
    named = F.when(F.col(rank).isNotNull(), F.struct(F.col(rank), F.col(vendor).alias("name")))
    listed = F.transform(F.array_sort(F.collect_list(named)), lambda v: v["name"])
    return F.nullif(F.array_join(listed, ", "), F.lit(""))


def with_signals(keyed: DataFrame) -> DataFrame:
    """Add flags and sentences to rows of headline figures, vendor names and trend."""
    filled = F.col("total_shipments") > 0
    tests = {
        "good_success": F.col("delivery_success_rate") >= GOOD_SUCCESS_PCT,
        "good_late_rate": F.col("late_shipment_pct") <= GOOD_LATE_PCT,
        "good_delay": F.col("avg_delay_days") <= GOOD_AVG_DELAY,
        "vendor_diversity": F.col("distinct_vendors") >= MIN_VENDORS,
        "country_diversity": F.col("distinct_countries") >= MIN_COUNTRIES,
        "strong_vendors": F.col("strong_vendor_names").isNotNull(),
        "improving": F.coalesce(F.col("direction") == "improving", F.lit(False)),
    }
    late, success = text1(F.col("late_shipment_pct")), text1(F.col("delivery_success_rate"))
    sentences = {
        "good_success": sentence(schema.GOOD_SUCCESS_TEXT, success),
        "good_late_rate": sentence(schema.GOOD_LATE_TEXT, late),
        "good_delay": sentence(schema.GOOD_DELAY_TEXT, text1(F.col("avg_delay_days"))),
        "vendor_diversity": sentence(schema.VENDOR_DIVERSITY_TEXT, F.col("distinct_vendors")),
        "country_diversity": sentence(schema.COUNTRY_DIVERSITY_TEXT, F.col("distinct_countries")),
        "strong_vendors": sentence(schema.STRONG_VENDORS_TEXT, F.col("strong_vendor_names")),
        "improving": F.col("commentary"),
    }
    flagged = keyed.withColumns({flag: filled & test for flag, test in tests.items()})
    return flagged.withColumn(
        "healthy_signals",
        F.array_compact(F.array(*(F.when(F.col(f), sentences[f]) for f in FLAGS))),
    )


def healthy_signals(facts: DataFrame, by: Sequence[str] = DATASET) -> DataFrame:
    rolled = headline_rollup(facts, by, "months")

    def section(name: str, label: str) -> DataFrame:
        return rolled.where(F.col("section") == name).withColumnRenamed("label", label)

    vendors = score_vendors(section("vendors", "vendor"), by, min_shipments=2)
    names = (
        strongest_named(vendors, by).groupBy(*by).agg(joined_names().alias("strong_vendor_names"))
    )
    keyed = join_datasets(headline_of(rolled, by), names, by, "left")
    direction = direction_from(trend_points(section("months", "period"), by), by)
    keyed = join_datasets(keyed, direction, by, "left")
    return with_signals(keyed).select(*by, *FLAGS, "healthy_signals")
