"""Registered queries of the ingest side: cells, derivations, files, tables, streams.

Text cells are spelled from the given tables by rules that the SQL side repeats,
so every parsed value can be checked against the number or date it came from.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import cells, derive, labels
from lanewise.functions.numeric import rounded
from lanewise.operators import catalog
from lanewise.operators.facts import facts as facts_of
from lanewise.plans import tables
from lanewise.session import scratch_path
from lanewise.sources import exports, headers, store, tpch, yearly_exports
from lanewise.streaming import uploads as streaming

Query = Callable[[SparkSession, str], DataFrame]

KEY = ("l_orderkey", "l_linenumber", "l_partkey")


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return tpch.read_table(spark, folder, "lineitem")


def _pick(number: Column, *choices: Column | str | None) -> Column:
    """The choice at ``number`` modulo the number of choices, as text."""
    texts = [c if isinstance(c, Column) else F.lit(c) for c in choices]
    return F.element_at(
        F.array(*(t.cast("string") for t in texts)), (number % len(texts) + 1).cast("int")
    )


# --- Cells ------------------------------------------------------------------


def coerce_numbers(spark: SparkSession, folder: str) -> DataFrame:
    price = F.col("l_extendedprice").cast("decimal(12,2)")
    spelled = _pick(
        F.col("l_orderkey") + F.col("l_linenumber"),
        F.concat(F.lit("$"), F.format_number(price, 2)),
        F.concat(F.lit("("), price.cast("string"), F.lit(")")),
        F.concat(F.lit("  € "), price.cast("string"), F.lit(" ")),
        "n/a",
        F.concat(price.cast("string"), F.lit("x")),
        F.concat(F.lit("+"), price.cast("string"), F.lit("e0")),
    )
    whole = _pick(
        F.col("l_partkey"),
        F.format_number(F.col("l_quantity") * 1000, 0),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".75")),
        F.concat(F.lit("-"), F.col("l_quantity").cast("int").cast("string")),
        "--",
        "12d",
    )
    return _lines(spark, folder).select(
        *KEY,
        rounded(cells.parse_float(spelled)).alias("amount"),
        cells.parse_int(whole).cast("double").alias("units"),
    )


_DATE_STYLES = (
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy-MM-dd HH:mm",
    "M/d/yyyy H:mm",
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
    "dd.MM.yyyy",
    "dd-MMM-yyyy",
    "dd-MMM-yy",
    "MMM dd, yyyy",
    "MMMM d, yyyy",
    "yyyyMMdd",
)


def coerce_dates(spark: SparkSession, folder: str) -> DataFrame:
    spelled = _pick(
        F.col("l_orderkey") + F.col("l_linenumber"),
        *(F.date_format("l_shipdate", style) for style in _DATE_STYLES),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("Z")),
        "null",
    )
    return _lines(spark, folder).select(*KEY, cells.parse_date(spelled).alias("day"))


def coerce_bools(spark: SparkSession, folder: str) -> DataFrame:
    spelled = _pick(
        F.col("l_orderkey"),
        *(F.lit(f" {t.upper()}") for t in (*schema.TRUE_TOKENS, *schema.FALSE_TOKENS)),
        "maybe",
        "N/A",
        None,
    )
    return _lines(spark, folder).select(*KEY, cells.parse_bool(spelled).cast("string").alias("flag"))


def status_words() -> list[str]:
    return list(schema.STATUS_WORDS)


def mode_words() -> list[str]:
    return list(schema.MODE_WORDS)


def _respelled(word: Column) -> Column:
    """In capitals with blanks around, or with hyphens, by turns."""
    styles = F.array(
        F.concat(F.lit(" "), F.upper(F.replace(word, F.lit("_"), F.lit(" "))), F.lit(" ")),
        F.initcap(F.replace(word, F.lit("_"), F.lit("-"))),
    )
    return F.element_at(styles, (F.col("l_linenumber") % 2 + 1).cast("int"))


def parse_status(spark: SparkSession, folder: str) -> DataFrame:
    word = _pick(F.col("l_orderkey"), *status_words(), "lost at sea")
    return _lines(spark, folder).select(
        *KEY, labels.parse_status(_respelled(word)).alias("status")
    )


def parse_mode(spark: SparkSession, folder: str) -> DataFrame:
    word = _pick(F.col("l_orderkey"), *mode_words(), "on foot")
    return _lines(spark, folder).select(
        *KEY, labels.stored_mode(_respelled(word)).alias("transport_mode")
    )


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    """Trimmed, cut to a field's length, and NULL where a cell says nothing."""
    raw = _pick(
        F.col("p_partkey"),
        F.concat(F.lit("\t "), "p_name", F.lit(" "), "p_type", F.lit("  ")),
        "#N/A",
        F.concat("p_name", F.lit(" "), F.repeat(F.col("p_type"), F.lit(3))),
        " - ",
    )
    return tpch.read_table(spark, folder, "part").select(
        "p_partkey", cells.clean_text(raw, 16).alias("text")
    )


def normalize_header(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")_"), F.col("p_brand"))
    return tpch.read_table(spark, folder, "part").select(
        "p_partkey", cells.normalize_header(raw).alias("name")
    )


def risk_level(spark: SparkSession, folder: str) -> DataFrame:
    score = F.col("l_quantity") * 2
    return _lines(spark, folder).select(*KEY, labels.risk_level(score).alias("level"))


# --- Derivations ------------------------------------------------------------
# Stated values are taken away by key, so that they have to be derived.


def _gappy(spark: SparkSession, folder: str) -> DataFrame:
    base = tpch.base_shipments(spark, folder)

    def missing(column: str, every: int) -> Column:
        return F.when(F.col("l_orderkey") % every != 0, F.col(column))

    return base.select(
        "l_orderkey",
        "l_linenumber",
        "vendor",
        missing("shipped_on", 4).alias("shipped"),
        missing("scheduled_delivery", 3).alias("scheduled"),
        missing("actual_delivery", 5).alias("actual"),
        F.when(F.col("l_orderkey") % 11 == 0, F.col("delay_days")).alias("stated_delay"),
        F.when(F.col("l_orderkey") % 13 == 0, F.col("lead_time_days")).alias("stated_lead"),
        F.when(F.col("l_orderkey") % 2 == 0, F.col("status"))
        .otherwise("unknown")
        .alias("parsed_status"),
        F.nullif("origin_country", F.when(F.col("l_orderkey") % 7 == 0, F.col("origin_country"))).alias("city"),
        F.nullif("destination", F.when(F.col("l_orderkey") % 9 == 0, F.col("destination"))).alias("country"),
        missing("quantity", 4).alias("quantity"),
        "unit_cost",
        "freight_cost",
        F.when(F.col("l_orderkey") % 10 == 0, F.col("unit_cost")).alias("insurance_cost"),
        F.when(F.col("l_orderkey") % 17 == 0, F.col("unit_cost") * 100).alias("stated_total"),
    )


_ROW = ("l_orderkey", "l_linenumber", "vendor")


def derive_delay(spark: SparkSession, folder: str) -> DataFrame:
    args = [F.col(c) for c in ("stated_delay", "scheduled", "actual")]
    return _gappy(spark, folder).select(
        *_ROW,
        derive.delay_days(*args).alias("delay_days"),
        derive.delay_is_derived(*args).alias("derived"),
    )


def derive_lead_time(spark: SparkSession, folder: str) -> DataFrame:
    lead = derive.days_under_way(F.col("stated_lead"), F.col("shipped"), F.col("actual"))
    return _gappy(spark, folder).select(*_ROW, lead.cast("double").alias("lead_time_days"))


def derive_status(spark: SparkSession, folder: str) -> DataFrame:
    delay = derive.raw_delay(F.col("stated_delay"), F.col("scheduled"), F.col("actual"))
    return _gappy(spark, folder).select(
        *_ROW, derive.status_from(F.col("parsed_status"), delay).alias("status")
    )


def derive_dates(spark: SparkSession, folder: str) -> DataFrame:
    when = derive.event_date(F.col("shipped"), F.col("actual"), F.col("scheduled"))
    return _gappy(spark, folder).select(*_ROW, when.alias("shipped_on"))


def derive_destination(spark: SparkSession, folder: str) -> DataFrame:
    place = cells.join_place(F.col("city"), F.col("country"))
    return _gappy(spark, folder).select(*_ROW, place.alias("destination"))


def derive_total_cost(spark: SparkSession, folder: str) -> DataFrame:
    total = derive.landed_cost(
        F.col("stated_total"),
        derive.goods_value(F.col("quantity"), F.col("unit_cost")),
        F.col("freight_cost"),
        F.col("insurance_cost"),
    )
    return _gappy(spark, folder).select(*_ROW, rounded(total, 4).alias("total_cost"))


def co2_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return tpch.shipments(spark, folder).select(
        "l_orderkey", "l_linenumber", "vendor", "transport_mode",
        F.col("co2_kg").cast("double").alias("co2_kg"),
    )


# --- Headers ----------------------------------------------------------------

_SPELLINGS = (
    "Vendor", "Suppler Name", "Qty", "Quantiy", "Unit Price", "Ship Date", "ETA",
    "Actual Delivery Date", "Freigt Cost", "Carrier", "Carrier Nmae", "Internal Notes",
    "Country", "SKU", "shipment_id", "Shipment Mode", "Weight (kg)", "Approver", "id",
)


def _header_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A header line of eight cells for every order, picked by its key."""
    orders = tpch.read_table(spark, folder, "orders")
    files = orders.select(F.col("o_orderkey").cast("string").alias("file")).distinct()
    key = F.col("file").cast("long")
    cells_of = F.transform(
        F.sequence(F.lit(0), F.lit(7)),
        lambda i: F.element_at(
            F.array(*(F.lit(s) for s in _SPELLINGS)),
            ((key * (i + 1) + i * i) % len(_SPELLINGS) + 1).cast("int"),
        ),
    )
    return files.select("file", F.posexplode(cells_of).alias("position", "header"))


def map_headers(spark: SparkSession, folder: str) -> DataFrame:
    return headers.map_headers(_header_rows(spark, folder))


def map_headers_exact(spark: SparkSession, folder: str) -> DataFrame:
    mapped = headers.map_headers(_header_rows(spark, folder), fuzzy=False)
    return mapped.where("field is not null").select("file", "field", "header")


# --- Files, tables and streams ----------------------------------------------


def _exports(spark: SparkSession, folder: str) -> str:
    target = scratch_path(spark, "exports")
    return yearly_exports.write_exports(tpch.base_shipments(spark, folder), target)


def _plan(spark: SparkSession, folder: str, **options: object) -> exports.Ingest:
    return exports.plan_ingest(
        spark, _exports(spark, folder), exports.hive_folder, **options
    )


SHOWN = (
    "upload_id shipment_ref vendor carrier product category service_level origin_country"
    " destination quantity quantity_delivered unit_cost freight_cost total_cost weight_kg"
    " distance_km co2_kg transport_mode lead_time_days transit_days delay_days status"
    " shipped_on scheduled_delivery actual_delivery last_updated damaged returned"
).split()
_AS_DOUBLE = (
    "unit_cost freight_cost total_cost weight_kg distance_km co2_kg quantity_delivered"
    " lead_time_days transit_days"
).split()


def _shown(shipments: DataFrame) -> DataFrame:
    return shipments.select(*SHOWN).withColumns(
        {c: F.col(c).cast("double") for c in _AS_DOUBLE}
        | {c: F.col(c).cast("string") for c in ("damaged", "returned")}
    )


def ingest_csv(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(_plan(spark, folder).shipments)


def ingest_report(spark: SparkSession, folder: str) -> DataFrame:
    report = _plan(spark, folder).report()
    return report.select(
        "upload_id",
        "accepted_rows",
        "rejected_rows",
        "derived_delays",
        F.size("detected_columns").alias("detected"),
        F.array_join("unmapped_columns", ",").alias("unmapped"),
        F.array_join(F.map_keys("fuzzy_columns"), ",").alias("guessed"),
        F.size("warnings").alias("warning_count"),
    )


def ingest_odd_exports(spark: SparkSession, folder: str) -> DataFrame:
    """Title lines, pipes, Windows-1252, quoted line breaks, and a dataset without a row."""
    customers = tpch.read_table(spark, folder, "customer")
    target = yearly_exports.write_odd_exports(customers, scratch_path(spark, "odd-exports"))
    planned = exports.plan_ingest(spark, target, exports.hive_folder, strict=False)
    totals = planned.shipments.groupBy("upload_id").agg(
        F.sum("delay_days").alias("delay_sum"),
        F.countDistinct("vendor").alias("vendors"),
        F.max("vendor").alias("last_vendor"),
        F.max("product").alias("product"),
        F.countDistinct("destination").alias("places"),
    )
    return planned.report().join(totals, "upload_id", "left").select(
        "upload_id",
        "accepted_rows",
        "rejected_rows",
        "damaged_rows",
        F.size("detected_columns").alias("detected"),
        F.size("warnings").alias("warning_count"),
        F.exists("warnings", lambda w: w.contains("above the header")).alias("titles_noted"),
        *(c for c in totals.columns if c != "upload_id"),
    )


def accept_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _plan(spark, folder).staging.groupBy("upload_id", "_accepted").agg(
        F.count(F.lit(1)).alias("row_count")
    ).withColumnRenamed("_accepted", "accepted")


ROW_CAP = 500


def row_cap(spark: SparkSession, folder: str) -> DataFrame:
    capped = _plan(spark, folder, max_rows=ROW_CAP)
    return capped.shipments.groupBy("upload_id").agg(F.count(F.lit(1)).alias("row_count"))


def _totals(shipments: DataFrame) -> DataFrame:
    return shipments.groupBy("upload_id").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.sum("delay_days").alias("delay_sum"),
        F.sum("quantity").alias("quantity_sum"),
        F.sum("freight_cost").cast("double").alias("freight_sum"),
        F.count("co2_kg").alias("co2_count"),
    )


def write_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Append to the stored table and read it back."""
    table = scratch_path(spark, "shipments")
    _plan(spark, folder).append_to(table)
    return _totals(store.read(spark, table))


FILES_PER_BATCH = 3


def ingest_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The exports ingested as a stream whose batches cut through datasets."""
    source = _exports(spark, folder)
    table = scratch_path(spark, "streamed")
    query = streaming.stream_uploads(
        spark,
        source,
        table,
        scratch_path(spark, "rejects"),
        scratch_path(spark, "stream-state"),
        exports.hive_folder,
        files_per_batch=FILES_PER_BATCH,
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return _totals(store.read(spark, table))


def stream_monthly_trend(spark: SparkSession, folder: str) -> DataFrame:
    """The monthly series kept up to date by a stream over stored shipments."""
    table = scratch_path(spark, "stream-source")
    shipments = tpch.base_shipments(spark, folder).select(*_STREAMED)
    store.append(shipments, table)
    stream = spark.readStream.schema(shipments.schema).parquet(table)
    out = scratch_path(spark, "stream-months")

    def keep(batch: DataFrame, _batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = (
        streaming.running_monthly_trend(stream)
        .writeStream.outputMode("complete")
        .foreachBatch(keep)
        .option("checkpointLocation", scratch_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.parquet(out)


_STREAMED = (
    "upload_id vendor origin_country destination product quantity unit_cost delay_days status"
    " shipped_on lead_time_days"
).split()


def replace_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Store snapshots, then store new ones for the datasets of one owner over them."""
    shipments = tpch.shipments(spark, folder)
    snapshots = store.kept(tables.yearly_snapshots(facts_of(shipments)), "fresh-snapshots")
    path = scratch_path(spark, "snapshots")
    store.replace(snapshots, path)
    fresh = catalog.scope_to_owner(
        snapshots, tables.yearly_uploads(shipments), "owner-0"
    ).withColumn("id", F.concat("id", F.lit("-again")))
    store.replace(fresh, path)
    return spark.read.parquet(path).select(
        F.col("upload_id").cast("string").alias("upload_id"), "id", "status", "risk_score"
    )


INGEST: dict[str, Query] = {
    "coerce_numbers": coerce_numbers,
    "coerce_dates": coerce_dates,
    "coerce_bools": coerce_bools,
    "parse_status": parse_status,
    "parse_mode": parse_mode,
    "clean_text": clean_text,
    "normalize_header": normalize_header,
    "risk_level": risk_level,
    "derive_delay": derive_delay,
    "derive_lead_time": derive_lead_time,
    "derive_status": derive_status,
    "derive_dates": derive_dates,
    "derive_destination": derive_destination,
    "derive_total_cost": derive_total_cost,
    "co2_estimate": co2_estimate,
    "map_headers": map_headers,
    "map_headers_exact": map_headers_exact,
    "ingest_csv": ingest_csv,
    "ingest_report": ingest_report,
    "ingest_odd_exports": ingest_odd_exports,
    "accept_rows": accept_rows,
    "row_cap": row_cap,
    "write_shipments": write_shipments,
    "ingest_stream": ingest_stream,
    "stream_monthly_trend": stream_monthly_trend,
    "replace_snapshot": replace_snapshot,
}
