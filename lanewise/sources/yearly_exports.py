"""Write the order-line shipments as CSV exports in three house styles.

Gives the ingest something to read that grows with the tables: a dataset per
order year, with foreign headers, separators, number and date formats, missing
values in several spellings, and blank rows.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise.sources import store
from lanewise.sources.store import PARTITION

BLANK = "_blank"
STYLES = ("comma", "semicolon", "tab")
SEPARATORS = {"comma": ",", "semicolon": ";", "tab": "\t"}
#: Bytes of stored rows that become a file, and years that are written at a time.
FILE_BYTES = 32 << 20
YEARS = 4


def _priced(amount: str) -> Column:
    """1234.5 -> $1,234.50"""
    return F.concat(F.lit("$"), F.format_number(amount, 4))


def _comma(rows: DataFrame) -> DataFrame:
    """Dates day first, prices with currency, a status column, one misspelt header."""
    day_first = "dd/MM/yyyy"
    status = F.element_at(
        F.create_map(
            *(
                F.lit(x)
                for pair in (
                    ("on_time", "Shipping On Time"),
                    ("delayed", "Late delivery"),
                    ("critical", "EXCEPTION"),
                    ("cancelled", "Shipping canceled"),
                )
                for x in pair
            )
        ),
        F.col("status"),
    )
    return rows.select(
        PARTITION,
        BLANK,
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("Order Id"),
        F.col("vendor").alias("Suppler Name"),
        F.col("origin_country").alias("Country"),
        F.col("destination").alias("Ship To"),
        F.col("product").alias("Item Description"),
        F.format_number("quantity", 0).alias("Qty"),
        _priced("unit_cost").alias("Unit Price"),
        F.date_format("shipped_on", day_first).alias("Ship Date"),
        F.date_format("scheduled_delivery", day_first).alias("Promised Delivery Date"),
        F.date_format("actual_delivery", day_first).alias("Actual Delivery Date"),
        status.alias("Delivery Status"),
        F.coalesce("carrier", F.lit("N/A")).alias("Carrier"),
        F.initcap("transport_mode").alias("Shipment Mode"),
        _priced("freight_cost").alias("Freight Cost"),
        F.col("weight_kg").cast("string").alias("Weight (kg)"),
        F.col("distance_km").cast("string").alias("Distance (km)"),
        F.when(F.col("damaged"), "Yes").when(~F.col("damaged"), "No").alias("Is Damaged"),
        F.when(F.col("returned"), "returned").when(~F.col("returned"), "ok").alias("Returned"),
        F.col("quantity_delivered").cast("string").alias("Quantity Delivered"),
        F.col("service_level").alias("Service Level"),
        F.col("category").alias("Product Category"),
        F.lit("checked").alias("Internal Notes"),
    )


def _semicolon(rows: DataFrame) -> DataFrame:
    """ISO dates, plain numbers, a delay column that is blank when not late."""
    return rows.select(
        PARTITION,
        BLANK,
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("shipment_id"),
        F.col("vendor").alias("VENDOR"),
        F.col("origin_country").alias("ORIGIN-COUNTRY"),
        F.col("destination").alias("destination"),
        F.col("product").alias("product"),
        F.col("quantity").cast("string").alias("quantity"),
        F.col("unit_cost").cast("string").alias("unit cost"),
        F.col("shipped_on").cast("string").alias("shipped_on"),
        F.when(F.col("delay_days") > 0, F.col("delay_days").cast("string"))
        .otherwise("none")
        .alias("delay_days"),
        F.col("lead_time_days").cast("string").alias("lead time (days)"),
        F.col("carrier").alias("carrier name"),
        F.upper("transport_mode").alias("mode"),
        F.col("freight_cost").cast("string").alias("freight"),
        F.col("weight_kg").cast("string").alias("weight"),
        F.col("distance_km").cast("string").alias("distance"),
        F.col("damaged").cast("string").alias("damaged"),
        F.col("returned").cast("string").alias("returned"),
        F.col("quantity_delivered").cast("string").alias("qty delivered"),
        F.col("service_level").alias("service"),
        F.col("category").alias("category"),
    )


def _tab(rows: DataFrame) -> DataFrame:
    """Time stamps, month names, accounting brackets, and nothing about quality."""
    return rows.select(
        PARTITION,
        BLANK,
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("Record ID"),
        F.col("vendor").alias("Manufacturer"),
        F.col("origin_country").alias("Source Country"),
        F.col("destination").alias("Delivery Country"),
        F.col("product").alias("Material"),
        F.concat(F.col("quantity").cast("string"), F.lit(".0")).alias("Units"),
        F.concat(F.lit("("), F.col("unit_cost").cast("string"), F.lit(")")).alias("Price"),
        F.date_format("shipped_on", "yyyy-MM-dd'T'HH:mm:ss").alias("Dispatch Date"),
        F.date_format("scheduled_delivery", "dd-MMM-yyyy").alias("ETA"),
        F.date_format("actual_delivery", "MMM dd, yyyy").alias("Received Date"),
        F.col("carrier").alias("Courier"),
        F.col("service_level").alias("Ship Method"),
    )


_WRITERS = {"comma": _comma, "semicolon": _semicolon, "tab": _tab}


# --- Exports in unusual shapes --------------------------------------------------

ODD = ("titled", "windows", "broken", "headeronly")
TITLES = (
    ("Weekly delays by supplier", None, None),
    ("Printed for the file", None, None),
    (None, None, None),
    ("Supplier", "Days Late", "Ship To"),
)


def _with_titles(batches):
    """Put the titles and the header on top of every file."""
    import pyarrow as pa

    for i, batch in enumerate(batches):
        if i == 0:
            columns = [pa.array(c, type=pa.string()) for c in zip(*TITLES, strict=True)]
            yield pa.record_batch(columns, schema=batch.schema)
        yield batch


def write_odd_exports(customers: DataFrame, folder: str) -> str:
    """The customers as suppliers in four shapes that ordinary exports do not have.

    ``titled`` has lines above the header and pipes between cells, ``windows``
    is in a one-byte encoding, ``broken`` has line breaks and inch marks in cells,
    ``headeronly`` has a header and no row. Returns ``folder``.
    """
    key = F.col("c_custkey")
    late = (key % 5).cast("string")
    place = F.concat(F.lit("Place "), F.col("c_nationkey").cast("string"))
    titled = customers.select(F.col("c_name").alias("a"), late.alias("b"), place.alias("c"))
    titled.mapInArrow(_with_titles, titled.schema).write.option("sep", "|").csv(
        f"{folder}/upload_id=titled"
    )
    windows = customers.select(
        F.concat(F.lit("Café "), F.col("c_name")).alias("Vendor"),
        late.alias("Delay Days"),
        place.alias("Destination"),
    )
    windows.write.option("header", True).option("encoding", "ISO-8859-1").csv(
        f"{folder}/upload_id=windows"
    )
    broken = customers.select(
        F.lit('5" pipe').alias("Product"),
        late.alias("Delay Days"),
        F.concat(F.lit("Two\nlines "), F.col("c_name")).alias("Vendor"),
    )
    broken.write.option("header", True).option("escape", '"').csv(f"{folder}/upload_id=broken")
    header = [("Vendor", "Delay Days", "Quantity")]
    customers.sparkSession.createDataFrame(header, "a string, b string, c string").coalesce(
        1
    ).write.csv(
        f"{folder}/upload_id=headeronly"
    )
    return folder


def style_of(year: str) -> str:
    """Years take turns in the three styles."""
    return STYLES[int(year) % len(STYLES)]


def write_exports(base: DataFrame, folder: str) -> str:
    """Write every year's export below ``folder``; returns ``folder``.

    In every year the order lines of one in fifty orders are followed by a blank row.
    The rows are made once and kept by year until this is written. A year's files
    are as many as its bytes ask for, so that files grow with the data before
    their number does; no row is shuffled for that.
    """
    spark = base.sparkSession
    rows = base.where(F.col(PARTITION).isNotNull())
    path = store.parted(rows, "export-rows")
    copies = F.when(F.col("l_orderkey") % 50 == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))

    def write(year: str, size: int) -> None:
        style, kept = style_of(year), f"{path}/{PARTITION}={year}"
        found = spark.read.schema(rows.schema).option("basePath", path).parquet(kept)
        own = _WRITERS[style](found.withColumn(BLANK, F.explode(copies)))
        cells = [c for c in own.columns if c not in (PARTITION, BLANK)]
        shown = own.select(*(F.when(~F.col(BLANK), F.col(c)).alias(c) for c in cells))
        shown.coalesce(1 + size // FILE_BYTES).write.option("header", True).option("sep", SEPARATORS[style]).option(
            "escape", '"'
        ).csv(f"{folder}/{style}/{PARTITION}={year}")
        store.discard(spark, kept)

    store.made(spark, folder)
    years = store.datasets(spark, path)
    with ThreadPoolExecutor(YEARS) as some:
        list(some.map(write, years, years.values()))
    store.discard(spark, path)
    return folder
