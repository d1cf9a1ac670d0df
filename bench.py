"""Time the headline queries and print one JSON line.

Shipments are written once as a stored table, the way they are kept after an
ingest, and the analytics read that table. The ingest is timed on CSV exports
written from the same rows. Environment: BENCH_SF_DIR, BENCH_CPUS.
"""

from __future__ import annotations

import json
import os
import sys
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from lanewise.operators import dimensions, entities, kpis, operations, risk, trends
from lanewise.operators.facts import facts as facts_of
from lanewise.plans.report import report
from lanewise.session import local_session, scratch_path
from lanewise.sources import exports, store, tpch, yearly_exports

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TABLE_DDL = (
    "upload_id string, vendor string, origin_country string, destination string, product string,"
    " category string, service_level string, quantity int, unit_cost decimal(14,4),"
    " shipped_on date, delay_days int, lead_time_days int, status string, carrier string,"
    " transport_mode string, freight_cost decimal(14,4), weight_kg decimal(14,3),"
    " damaged boolean, returned boolean, quantity_delivered int, total_cost decimal(14,4),"
    " co2_kg decimal(14,3)"
)


def drain(frame: DataFrame) -> None:
    frame.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(
        "bench",
        CPUS,
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.showConsoleProgress": "false",
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    times: dict[str, float] = {}

    def timed(name: str, run: Callable[[], object]) -> object:
        started = time.perf_counter()
        result = run()
        times[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {times[name]} s", file=sys.stderr, flush=True)
        return result

    table = scratch_path(spark, "bench-shipments")
    columns = [c.strip().split()[0] for c in TABLE_DDL.split(", ")]
    rows = tpch.shipments(spark, FOLDER).select(*columns)
    timed("build_shipments", lambda: store.append(rows, table))
    facts = facts_of(store.read(spark, table, TABLE_DDL))
    row_count = facts.count()

    queries: dict[str, Callable[[DataFrame], DataFrame]] = {
        "kpis": kpis.kpis,
        "vendor_health": lambda f: entities.vendor_health(f, min_shipments=2),
        "country_risk": entities.country_risk,
        "composite_risk": risk.composite_risk,
        "dimension_score": lambda f: dimensions.dimension_score(f, "destination"),
        "all_dimensions": dimensions.all_dimensions,
        "dim_lanes": dimensions.lanes,
        "freight_cost": operations.freight_cost,
        "order_quality": operations.order_quality,
        "emissions_by_mode": operations.emissions_by_mode,
        "monthly_trend": trends.monthly_trend,
        "trend_direction": trends.trend_direction,
    }
    for name, query in queries.items():
        timed(name, lambda query=query: drain(query(facts)))

    def whole_report() -> None:
        drain(report(facts).document())

    timed("report", whole_report)

    folder = scratch_path(spark, "bench-exports")
    yearly_exports.write_exports(tpch.base_shipments(spark, FOLDER), folder)
    planned = timed(
        "plan_ingest", lambda: exports.plan_ingest(spark, folder, exports.hive_folder)
    )
    target = scratch_path(spark, "bench-ingested")
    timed("ingest", lambda: planned.append_to(target))

    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER.rstrip("/")).removeprefix("sf"),
                "rows": row_count,
                "ingest_rows_per_sec": round(
                    row_count / (times["plan_ingest"] + times["ingest"])
                ),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
