"""Measurements derived from other columns of the same shipment.

Each function takes columns and returns a column. NULL in means "not known",
and a value nobody can work out stays NULL.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions.numeric import rounded


def raw_delay(cell: Column, scheduled: Column, actual: Column) -> Column:
    """Days late; negative when early, NULL when neither stated nor derivable."""
    return F.coalesce(cell, F.datediff(actual, scheduled))


def delay_is_derived(cell: Column, scheduled: Column, actual: Column) -> Column:
    return cell.isNull() & scheduled.isNotNull() & actual.isNotNull()


def delay_days(cell: Column, scheduled: Column, actual: Column) -> Column:
    """Days late as stored: arriving early is not a negative delay."""
    return F.greatest(F.coalesce(raw_delay(cell, scheduled, actual), F.lit(0)), F.lit(0))


def days_under_way(cell: Column, shipped: Column, actual: Column) -> Column:
    """Lead time or transit time: stated, else from shipping to arrival."""
    elapsed = F.datediff(actual, shipped)
    return F.coalesce(cell, F.when(elapsed.isNotNull(), F.greatest(elapsed, F.lit(0))))


def status_from(parsed: Column, delay: Column) -> Column:
    """Fill an unknown status from the raw delay where there is one."""
    inferred = F.when(delay > 0, "delayed").otherwise("on_time")
    return F.when((parsed == "unknown") & delay.isNotNull(), inferred).otherwise(parsed)


def event_date(shipped: Column, actual: Column, scheduled: Column) -> Column:
    return F.coalesce(shipped, actual, scheduled)


def goods_value(quantity: Column, unit_cost: Column) -> Column:
    return quantity * unit_cost


def landed_cost(stated: Column, *parts: Column) -> Column:
    """The stated total, else the sum of the parts that are known."""
    nothing_known = reduce(lambda a, b: a & b, (p.isNull() for p in parts))
    total = reduce(lambda a, b: a + b, (F.coalesce(p, F.lit(0).cast("int")) for p in parts))
    return F.coalesce(stated, F.when(~nothing_known, total))


def estimated_co2(mode: Column, distance_km: Column, weight_kg: Column) -> Column:
    """Kilograms of CO2e, NULL unless mode, distance and weight are all known."""
    grams = F.try_element_at(
        F.create_map(*(F.lit(x) for x in chain.from_iterable(schema.CO2_GRAMS_PER_TKM.items()))),
        mode,
    )
    km, tonnes = distance_km.cast("double"), weight_kg.cast("double") / 1000.0
    measurable = (distance_km != 0) & (weight_kg != 0)
    return F.when(measurable, rounded(tonnes * km * grams / 1000.0, 3))
