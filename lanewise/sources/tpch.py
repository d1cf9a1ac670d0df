"""Shipments derived from order-line tables, for tests, checks and benchmarks.

Ship and order dates of these tables are unrelated, so planned and actual dates
are built from the ship date and the keys, and missing values are placed by
key. ``SHIPMENTS_SQL`` runs unchanged in Spark and in a SQL database.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import schema
from lanewise.functions import derive

TABLES = ("lineitem", "orders", "supplier", "nation", "customer", "part")

SHIPMENTS_SQL = """
WITH b AS (
  SELECT l.*, o.o_orderdate, o.o_custkey, o.o_orderpriority, o.o_orderstatus, s.s_name,
         sn.n_name AS s_nation, sn.n_nationkey AS s_nk, cn.n_name AS c_nation, cn.n_nationkey AS c_nk,
         c.c_name, c.c_mktsegment, p.p_retailprice, p.p_name, p.p_brand, p.p_type, p.p_size,
         CAST(l.l_shipdate AS DATE) AS ship,
         CAST(5 + l.l_partkey % 30 AS INT) AS plan_days,
         CAST(((l.l_orderkey*7 + l.l_linenumber*13 + l.l_partkey*3) % 31 - 15) * (1 + l.l_suppkey % 3) AS INT) AS slip
  FROM lineitem l
  JOIN orders o   ON l.l_orderkey = o.o_orderkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation sn  ON s.s_nationkey = sn.n_nationkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation cn  ON c.c_nationkey = cn.n_nationkey
  JOIN part p     ON l.l_partkey = p.p_partkey)
SELECT CAST(year(o_orderdate) AS VARCHAR(4)) AS upload_id, l_orderkey, l_linenumber,
  s_name AS vendor, s_nation AS origin_country, c_nation AS destination, p_name AS product,
  p_type AS category, o_orderpriority AS service_level,
  CAST(l_quantity AS INT) AS quantity,
  CAST(p_retailprice AS DECIMAL(14,4)) AS unit_cost,
  ship AS shipped_on, ship + plan_days AS scheduled_delivery, ship + plan_days + slip AS actual_delivery,
  greatest(slip, 0) AS delay_days, greatest(plan_days + slip, 0) AS lead_time_days,
  CASE WHEN o_orderstatus = 'P' AND l_linenumber = 1 THEN 'cancelled'
       WHEN slip > 20 AND l_returnflag = 'R' THEN 'critical'
       WHEN slip > 0 THEN 'delayed' ELSE 'on_time' END AS status,
  CASE WHEN l_partkey % 10 = 0 THEN NULL
       ELSE concat('CARRIER_', CAST(l_partkey % 6 AS VARCHAR(10))) END AS carrier,
  CASE l_linenumber % 6 WHEN 0 THEN 'air' WHEN 1 THEN 'ocean' WHEN 2 THEN 'road'
       WHEN 3 THEN 'rail' WHEN 4 THEN 'parcel' ELSE NULL END AS transport_mode,
  CASE WHEN l_orderkey % 5 = 0 THEN NULL
       ELSE CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * CAST(l_tax AS DECIMAL(4,2)) AS DECIMAL(14,4)) END AS freight_cost,
  CAST(p_size * l_quantity AS DECIMAL(14,3)) AS weight_kg,
  CAST(abs(s_nk - c_nk) * 450 AS DECIMAL(12,2)) AS distance_km,
  CASE WHEN l_linestatus = 'F' THEN (l_orderkey + l_linenumber) % 20 = 0 END AS damaged,
  CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS returned,
  CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(l_quantity - (l_orderkey % 3) AS INT) END AS quantity_delivered
FROM b
"""

_JOINS = """FROM {lineitem} l
  JOIN ({orders} o JOIN {customer} c ON o.o_custkey = c.c_custkey) ON l.l_orderkey = o.o_orderkey
  JOIN {supplier} s ON l.l_suppkey = s.s_suppkey
  JOIN {part} p ON l.l_partkey = p.p_partkey
  JOIN {nation} cn ON c.c_nationkey = cn.n_nationkey
  JOIN {nation} sn ON s.s_nationkey = sn.n_nationkey"""


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def base_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """One dataset per order year, before landed cost and CO2e are derived.

    The joins of ``SHIPMENTS_SQL`` in another order: customers meet the orders,
    which are fewer than the order lines, and names of nations come last, so that
    none is shuffled with an order line.
    """
    before, _, after = re.split(r"(FROM lineitem l.*?)(?=\)\nSELECT)", SHIPMENTS_SQL, flags=re.S)
    return spark.sql(
        before + _JOINS + after,
        **{name: read_table(spark, folder, name) for name in TABLES},
    )


def with_derived(shipments: DataFrame) -> DataFrame:
    """Add landed cost and estimated CO2e."""
    goods = derive.goods_value(F.col("quantity"), F.col("unit_cost"))
    total = derive.landed_cost(F.lit(None).cast("decimal(14,4)"), goods, F.col("freight_cost"))
    co2 = derive.estimated_co2(F.col("transport_mode"), F.col("distance_km"), F.col("weight_kg"))
    return shipments.withColumns(
        {
            "total_cost": total.cast(schema.FIELD_TYPES["total_cost"]),
            "co2_kg": co2.cast(schema.FIELD_TYPES["co2_kg"]),
        }
    )


def shipments(spark: SparkSession, folder: str) -> DataFrame:
    return with_derived(base_shipments(spark, folder))
