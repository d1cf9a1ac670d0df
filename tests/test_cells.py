from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import cells, derive, labels


def evaluate(spark, values, parse):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, raw string")
    rows = frame.select("i", parse(F.col("raw")).alias("out")).orderBy("i").collect()
    return [r.out for r in rows]


NUMBERS = {
    "$1,450.75": 1450.75,
    "(250.00)": -250.0,
    "1,200": 1200.0,
    "€ 12": 12.0,
    "1_000": 1000.0,
    " .5 ": 0.5,
    "5.": 5.0,
    "1e3": 1000.0,
    "-7": -7.0,
    "12d": None,
    "inf": None,
    "abc": None,
    "--": None,
    "": None,
    "Unknown": None,
}


def test_floats(spark):
    assert evaluate(spark, list(NUMBERS), cells.parse_float) == list(NUMBERS.values())


def test_ints(spark):
    cases = {
        "1,200": 1200,
        "1200.9": 1200,
        "-3.9": -3,
        "1_000": 1000,
        "$5": None,
        "99999999999": None,
        "n/a": None,
        None: None,
    }
    assert evaluate(spark, list(cases), cells.parse_int) == list(cases.values())


def test_dates(spark):
    day = date(2024, 3, 15)
    cases = {
        "2024-03-15": day,
        "15/03/2024": day,
        "03/15/2024": day,
        "15-Mar-2024": day,
        "15-MAR-24": day,
        "Mar 15, 2024": day,
        "15 Mar 2024": day,
        "March 15, 2024": day,
        "15.03.2024": day,
        "20240315": day,
        "2024/3/15": day,
        "2024-03-15T09:30:00": day,
        "2024-03-15 09:30": day,
        " 2024-03-15 ": day,
        "04/05/2024": date(2024, 5, 4),
        "04/05/2024 10:00": date(2024, 4, 5),
        "1/13/2024 12:27": date(2024, 1, 13),
        "13/1/2024 12:27": date(2024, 1, 13),
        "15-Mar-69": date(1969, 3, 15),
        "15-Mar-68": date(2068, 3, 15),
        "2024-02-30": None,
        "2024-03-15Z": None,
        "2024-03": None,
        "2024": None,
        "never": None,
        "-": None,
    }
    assert evaluate(spark, list(cases), cells.parse_date) == list(cases.values())


def expected_date(text):
    for fmt in schema.DATE_FORMATS:
        try:
            return datetime.strptime(text.strip(), fmt).date()
        except ValueError:
            continue
    return None


def test_dates_agree_with_trying_each_format_in_turn(spark):
    """Random dates in every format, and the same with the characters rotated."""
    rng = random.Random(7)
    samples = []
    for _ in range(4000):
        when = datetime(1970, 1, 1) + timedelta(minutes=rng.randrange(90 * 365 * 1440))
        text = when.strftime(rng.choice(schema.DATE_FORMATS))
        samples.append(text)
        turn = rng.randrange(len(text))
        samples.append(text[turn:] + text[:turn])
    got = evaluate(spark, samples, cells.parse_date)
    wrong = [
        (s, g, expected_date(s)) for s, g in zip(samples, got, strict=True) if g != expected_date(s)
    ]
    assert wrong == []


def test_bools_have_three_values(spark):
    cases = {"YES": True, "t": True, "Returned": True, "no": False, "OK": False, "0": False}
    cases |= {"none": None, "": None, "perhaps": None, None: None}
    assert evaluate(spark, list(cases), cells.parse_bool) == list(cases.values())


def test_text_is_trimmed_and_cut(spark):
    cases = {"  Acme Ltd ": "Acme", "\tA\t": "A", "nil": None, "NaN": None, "": None}
    assert evaluate(spark, list(cases), lambda c: cells.clean_text(c, 4)) == list(cases.values())


def test_status_and_mode_words(spark):
    statuses = {"On-Time": "on_time", "Late delivery": "delayed", "EXCEPTION": "critical"}
    statuses |= {"Shipping canceled": "cancelled", "closed": "delivered", "??": "unknown"}
    statuses |= {None: "unknown"}
    assert evaluate(spark, list(statuses), labels.parse_status) == list(statuses.values())
    modes = {"Sea Freight": "ocean", "LTL": "road", "courier": "parcel", "intermodal": "multimodal"}
    modes |= {"donkey": None, None: None}
    assert evaluate(spark, list(modes), labels.stored_mode) == list(modes.values())


def test_headers_are_normalised(spark):
    cases = {"Unit Cost": "unitcost", "UNIT-COST": "unitcost", "order date (DateOrders)": "orderdatedateorders"}
    cases |= {"CO2 (kg)": "co2kg", "Größe": "größe"}
    assert evaluate(spark, list(cases), cells.normalize_header) == list(cases.values())


@pytest.mark.parametrize(
    ("expression", "expected"),
    [
        ("place('Rotterdam', 'NL')", "Rotterdam, NL"),
        ("place(NULL, 'NL')", "NL"),
        ("place('', NULL)", None),
    ],
)
def test_places(spark, expression, expected):
    city, country = expression[6:-1].split(", ")
    got = spark.range(1).select(
        cells.join_place(F.expr(city).cast("string"), F.expr(country).cast("string")).alias("p")
    )
    assert got.first().p == expected


def test_derivations(spark):
    frame = spark.sql(
        """SELECT * FROM VALUES
        (1, CAST(NULL AS int), DATE'2024-01-15', DATE'2024-01-29', DATE'2024-01-01'),
        (2, CAST(NULL AS int), DATE'2024-01-15', DATE'2024-01-10', DATE'2024-01-12'),
        (3, 4, DATE'2024-01-15', DATE'2024-01-10', NULL),
        (4, -3, NULL, NULL, NULL),
        (5, CAST(NULL AS int), NULL, NULL, DATE'2024-01-01')
        AS t(i, delay, scheduled, actual, shipped)"""
    )
    args = (F.col("delay"), F.col("scheduled"), F.col("actual"))
    rows = frame.select(
        "i",
        derive.delay_days(*args).alias("delay_days"),
        derive.delay_is_derived(*args).alias("derived"),
        derive.days_under_way(F.lit(None).cast("int"), F.col("shipped"), F.col("actual")).alias("lead"),
        derive.status_from(F.lit("unknown"), derive.raw_delay(*args)).alias("status"),
        derive.event_date(F.col("shipped"), F.col("actual"), F.col("scheduled")).alias("day"),
    ).orderBy("i").collect()
    assert [r.delay_days for r in rows] == [14, 0, 4, 0, 0]
    assert [r.derived for r in rows] == [True, True, False, False, False]
    assert [r.lead for r in rows] == [28, 0, None, None, None]
    assert [r.status for r in rows] == ["delayed", "on_time", "delayed", "on_time", "unknown"]
    assert [str(r.day) for r in rows] == ["2024-01-01", "2024-01-12", "2024-01-10", "None", "2024-01-01"]


def test_landed_cost_and_co2(spark):
    frame = spark.sql(
        """SELECT * FROM VALUES
        (1, CAST(NULL AS double), 10, 2.5D, 5.0D, 'air', 1000.0D, 500.0D),
        (2, 99.0D, 10, 2.5D, 5.0D, 'road', 100.0D, CAST(NULL AS double)),
        (3, NULL, NULL, 2.5D, NULL, 'ship', 0.0D, 10.0D),
        (4, NULL, NULL, 2.5D, 7.0D, 'rail', 0.0D, 10.0D)
        AS t(i, stated, qty, cost, freight, mode, km, kg)"""
    )
    total = derive.landed_cost(F.col("stated"), F.col("qty") * F.col("cost"), F.col("freight"))
    co2 = derive.estimated_co2(F.col("mode"), F.col("km"), F.col("kg"))
    rows = frame.select("i", total.alias("total"), co2.alias("co2")).orderBy("i").collect()
    assert [r.total for r in rows] == [30.0, 99.0, None, 7.0]
    assert [r.co2 for r in rows] == [250.0, None, None, None]
