"""SQL equivalents of the registered queries, for checking against a SQL database."""

from __future__ import annotations

from lanewise import schema
from lanewise.sources.tpch import SHIPMENTS_SQL


def r(value: str, digits: int = 2) -> str:
    return f"CAST(round(CAST({value} AS DECIMAL(28,8)), {digits}) AS DOUBLE)"


def cents(total: str) -> str:
    return f"CAST(round({total}, 2) AS DOUBLE)"


def ratio(top: str, bottom: str) -> str:
    return f"coalesce(CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0), 0)"


def pct(part: str, whole: str) -> str:
    return r(f"{ratio(part, whole)} * 100")


def mean(total: str, count: str) -> str:
    return r(ratio(total, count))


def clamp(value: str) -> str:
    return f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {value}))"


def t1(value: str) -> str:
    return f"CAST(CAST(round(CAST({value} AS DECIMAL(28,8)), 1) AS DECIMAL(28,1)) AS VARCHAR)"


def st1(value: str) -> str:
    return f"CASE WHEN {value} < 0 THEN '' ELSE '+' END || {t1(value)}"


def level(score: str) -> str:
    return f"CASE WHEN {score} >= 66 THEN 'HIGH' WHEN {score} >= 33 THEN 'MEDIUM' ELSE 'LOW' END"


def dbl(column: str, name: str | None = None) -> str:
    return f"CAST({column} AS DOUBLE) AS {name or column}"


_CO2 = " ".join(f"WHEN '{m}' THEN CAST({g} AS DOUBLE)" for m, g in schema.CO2_GRAMS_PER_TKM.items())
CO2_SQL = (
    "CASE WHEN distance_km <> 0 AND weight_kg <> 0 THEN "
    + r(
        "CAST(weight_kg AS DOUBLE) / CAST(1000 AS DOUBLE) * CAST(distance_km AS DOUBLE)"
        f" * CASE transport_mode {_CO2} END / CAST(1000 AS DOUBLE)",
        3,
    )
    + " END"
)

_BASE = SHIPMENTS_SQL.strip().removeprefix("WITH ").split("\nSELECT CAST(year", 1)
SHIPMENTS = f"""WITH {_BASE[0]},
base AS (SELECT CAST(year{_BASE[1]}),
shipments AS (
  SELECT *, CAST(quantity * unit_cost + coalesce(freight_cost, 0) AS DECIMAL(14,4)) AS total_cost,
    CAST({CO2_SQL} AS DECIMAL(14,3)) AS co2_kg
  FROM base)"""

FACTS = f"""{SHIPMENTS},
facts0 AS (
  SELECT upload_id, coalesce(nullif(vendor, ''), 'Unknown vendor') AS vendor,
    coalesce(nullif(origin_country, ''), 'Unknown') AS origin_country,
    coalesce(nullif(destination, ''), 'Unknown') AS destination,
    coalesce(nullif(product, ''), 'Unknown') AS product,
    coalesce(quantity, 0) AS quantity, coalesce(unit_cost, 0) AS unit_cost,
    coalesce(delay_days, 0) AS delay_days, status, shipped_on AS occurred_on,
    carrier, transport_mode, service_level, category, freight_cost, total_cost, weight_kg, co2_kg,
    damaged, returned, quantity_delivered, lead_time_days
  FROM shipments),
facts AS (
  SELECT *, CAST(quantity AS DECIMAL(10,0)) * unit_cost AS value,
    delay_days > 0 AS is_late,
    delay_days > 0 OR coalesce(status IN ('delayed', 'critical', 'cancelled'), false) AS is_at_risk,
    NOT (delay_days > 0 OR coalesce(status IN ('delayed', 'critical', 'cancelled'), false)) AS is_successful,
    CASE WHEN quantity <> 0 AND quantity_delivered IS NOT NULL
      THEN least(CAST(quantity_delivered AS DOUBLE) / CAST(quantity AS DOUBLE), CAST(1 AS DOUBLE)) * 100 END AS fill_rate,
    origin_country || ' → ' || destination AS lane,
    CASE WHEN origin_country <> 'Unknown' AND destination <> 'Unknown'
      THEN origin_country || ' → ' || destination END AS route,
    strftime(occurred_on, '%Y-%m') AS period
  FROM facts0)"""

KPI_SELECT = f"""
  count(*) AS total_shipments,
  count(*) FILTER (is_late) AS late_shipments,
  {pct('count(*) FILTER (is_late)', 'count(*)')} AS late_shipment_pct,
  {mean('sum(delay_days)', 'count(*)')} AS avg_delay_days,
  {mean('sum(delay_days) FILTER (is_late)', 'count(*) FILTER (is_late)')} AS avg_delay_days_when_late,
  {r('quantile_cont(delay_days, 0.5)')} AS median_delay_days,
  {r('quantile_cont(delay_days, 0.9)')} AS p90_delay_days,
  {mean('sum(lead_time_days)', 'count(lead_time_days)')} AS avg_lead_time_days,
  {pct('count(*) FILTER (is_successful)', 'count(*)')} AS delivery_success_rate,
  {cents('sum(value)')} AS total_value,
  {cents('coalesce(sum(value) FILTER (is_at_risk), 0)')} AS value_at_risk,
  count(DISTINCT vendor) AS distinct_vendors,
  count(DISTINCT origin_country) AS distinct_countries"""

KPIS = f"{FACTS},\nkpis AS (SELECT upload_id, {KPI_SELECT} FROM facts GROUP BY upload_id)"

VENDORS = f"""{FACTS},
v0 AS (
  SELECT upload_id, vendor, count(*) AS shipment_count, count(*) FILTER (is_late) AS late_count,
    {pct('count(*) FILTER (is_late)', 'count(*)')} AS late_pct,
    {mean('sum(delay_days)', 'count(*)')} AS avg_delay_days,
    {mean('sum(lead_time_days)', 'count(lead_time_days)')} AS avg_lead_time_days,
    {cents('sum(value)')} AS total_value,
    {cents('coalesce(sum(value) FILTER (is_at_risk), 0)')} AS value_at_risk
  FROM facts GROUP BY upload_id, vendor HAVING count(*) >= 2),
v1 AS (SELECT *, {r('('
    + clamp('1 - late_pct / 100') + ' * CAST(0.5 AS DOUBLE) + '
    + clamp('1 - avg_delay_days / 21') + ' * CAST(0.3 AS DOUBLE) + '
    + clamp('1 - avg_lead_time_days / 45') + ' * CAST(0.2 AS DOUBLE)) * 100')} AS health_score FROM v0),
vendors AS (SELECT *, {level('100 - health_score')} AS risk_level FROM v1)"""

COUNTRIES = f"""{FACTS},
c0 AS (
  SELECT upload_id, origin_country AS country, count(*) AS shipment_count,
    count(*) FILTER (is_late) AS late_count,
    {pct('count(*) FILTER (is_late)', 'count(*)')} AS late_pct,
    {mean('sum(delay_days)', 'count(*)')} AS avg_delay_days,
    {cents('sum(value)')} AS total_value
  FROM facts GROUP BY upload_id, origin_country),
c1 AS (SELECT *, {r('(late_pct / 100 * CAST(0.6 AS DOUBLE) + '
    + clamp('avg_delay_days / 21') + ' * CAST(0.4 AS DOUBLE)) * 100')} AS risk_score FROM c0),
countries AS (SELECT *, {level('risk_score')} AS risk_level FROM c1)"""

_HHI = """
hv AS (SELECT upload_id, CASE WHEN sum(v) > 0 THEN sum(v * v) / (sum(v) * sum(v)) ELSE sum(n * n) / (sum(n) * sum(n)) END AS vendor_hhi
  FROM (SELECT upload_id, vendor, CAST(sum(value) AS DOUBLE) AS v, CAST(count(*) AS DOUBLE) AS n FROM facts GROUP BY upload_id, vendor) GROUP BY upload_id),
hc AS (SELECT upload_id, sum(n * n) / (sum(n) * sum(n)) AS country_hhi
  FROM (SELECT upload_id, origin_country, CAST(count(*) AS DOUBLE) AS n FROM facts GROUP BY upload_id, origin_country) GROUP BY upload_id)"""

_COMPONENTS = {
    "late_rate": clamp("late_shipment_pct / 100"),
    "delay_severity": clamp("avg_delay_days / 21"),
    "value_at_risk": clamp(ratio("value_at_risk", "total_value")),
    "vendor_concentration": clamp("vendor_hhi"),
    "country_concentration": clamp("country_hhi"),
}


def _weight(name: str) -> str:
    weight = schema.RISK_WEIGHTS[name]
    if name == "value_at_risk":
        return f"CASE WHEN total_value > 0 THEN CAST({weight} AS DOUBLE) END"
    return (
        f"CASE WHEN total_value > 0 THEN CAST({weight} AS DOUBLE)"
        f" ELSE CAST({weight} AS DOUBLE) / CAST(0.8 AS DOUBLE) END"
    )


_SCORE = " + ".join(f"{c} * coalesce({_weight(n)}, 0)" for n, c in _COMPONENTS.items())
RISK = f"""{KPIS},{_HHI},
risk0 AS (SELECT kpis.*, {r(f'({_SCORE}) * 100')} AS score,
    {', '.join(f"{r(c, 4)} AS component_{n}" if n != 'value_at_risk'
               else f"CASE WHEN total_value > 0 THEN {r(c, 4)} END AS component_{n}"
               for n, c in _COMPONENTS.items())},
    {', '.join(f"{r(_weight(n), 4)} AS weight_{n}" for n in _COMPONENTS)}
  FROM kpis JOIN hv USING (upload_id) JOIN hc USING (upload_id)),
risk AS (SELECT *, {level('score')} AS level FROM risk0)"""

RISK_COLUMNS = ", ".join(
    ["score", "level"]
    + [f"component_{n}" for n in _COMPONENTS]
    + [f"weight_{n}" for n in _COMPONENTS]
)


def dimension(key: str, top: int | None = None) -> str:
    cut = (
        f"WHERE rn <= {top}" if top else ""
    )
    return f"""{FACTS},
g AS (SELECT upload_id, {key} AS label, count(*) AS shipment_count, count(*) FILTER (is_late) AS late_count,
    {pct('count(*) FILTER (is_late)', 'count(*)')} AS late_pct,
    {mean('sum(delay_days)', 'count(*)')} AS avg_delay_days,
    CASE WHEN count(lead_time_days) > 0 THEN {mean('sum(lead_time_days)', 'count(lead_time_days)')} END AS avg_transit_days,
    {cents('sum(value)')} AS total_value,
    CASE WHEN count(freight_cost) > 0 THEN {mean('sum(freight_cost)', 'count(freight_cost)')} END AS avg_freight_cost
  FROM facts WHERE {key} <> '' GROUP BY upload_id, {key} HAVING count(*) >= 2),
t AS (SELECT upload_id, count(*) AS labels, sum(shipment_count) AS shipments FROM g GROUP BY upload_id),
d AS (SELECT g.*, {pct('shipment_count', 'shipments')} AS share_pct,
    row_number() OVER (PARTITION BY g.upload_id ORDER BY late_pct DESC, avg_delay_days DESC, label) AS rn
  FROM g JOIN t USING (upload_id) WHERE labels >= 2),
dims AS (SELECT * FROM d {cut})"""


DIMENSION_COLUMNS = (
    "upload_id, label, shipment_count, share_pct, late_count, late_pct, avg_delay_days,"
    " avg_transit_days, total_value, avg_freight_cost"
)


DIMENSION_KEYS = {
    "carriers": "carrier",
    "transport_modes": "transport_mode",
    "service_levels": "service_level",
    "categories": "category",
    "lanes": "route",
}


def gate(count: str, total: str) -> str:
    return f"({count} >= 3 AND {ratio(count, total)} * 100 >= 20)"


TOTALS = f"""{FACTS},
tot AS (SELECT upload_id, count(*) AS n, count(freight_cost) AS fn, sum(freight_cost) AS fs,
    sum(value) FILTER (freight_cost IS NOT NULL) AS goods,
    sum(quantity) FILTER (freight_cost IS NOT NULL) AS units,
    sum(weight_kg) FILTER (freight_cost IS NOT NULL AND weight_kg <> 0) AS kg,
    count(*) FILTER (freight_cost IS NOT NULL AND weight_kg <> 0) AS kgn,
    sum(freight_cost) FILTER (is_late) AS late_freight,
    sum(total_cost) AS landed, count(total_cost) AS landed_n,
    count(damaged) AS dn, count(*) FILTER (damaged) AS ds,
    count(returned) AS rn, count(*) FILTER (returned) AS rs,
    count(fill_rate) AS filln, sum(fill_rate) AS fills,
    count(*) FILTER (NOT is_late AND NOT coalesce(damaged, false) AND NOT coalesce(returned, false)
      AND NOT coalesce(fill_rate < 100, false)) AS perfect,
    count(*) FILTER (damaged IS NOT NULL OR returned IS NOT NULL) AS checked,
    sum(co2_kg) AS co2s, count(co2_kg) AS co2n,
    count(carrier) AS has_carrier, count(transport_mode) AS has_transport_mode,
    count(service_level) AS has_service_level, count(category) AS has_category,
    count(weight_kg) AS has_weight, count(quantity_delivered) AS has_fill_rate
  FROM facts GROUP BY upload_id)"""

MONTHS = f"""{FACTS},
months AS (SELECT upload_id, period, count(*) AS shipment_count, count(*) FILTER (is_late) AS late_count,
    {pct('count(*) FILTER (is_late)', 'count(*)')} AS late_pct,
    {mean('sum(delay_days)', 'count(*)')} AS avg_delay_days, {cents('sum(value)')} AS total_value
  FROM facts WHERE period IS NOT NULL GROUP BY upload_id, period)"""

_CHANGE = (
    "CASE WHEN period_count < 3 THEN NULL WHEN f = 0 THEN CASE WHEN s = 0 THEN 0.0 ELSE 100.0 END"
    f" ELSE {r('(s - f) / f * 100')} END"
)
TREND = f"""{MONTHS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY period) AS i,
    count(*) OVER (PARTITION BY upload_id) AS c FROM months),
halves AS (SELECT upload_id, max(c) AS period_count,
    coalesce(avg(avg_delay_days) FILTER (i <= c // 2), 0) AS f,
    coalesce(avg(avg_delay_days) FILTER (i > c // 2), 0) AS s FROM numbered GROUP BY upload_id),
changes AS (SELECT *, CAST({_CHANGE} AS DOUBLE) AS delay_change_pct FROM halves),
directions AS (SELECT *, CASE WHEN period_count < 3 THEN 'insufficient_data'
    WHEN delay_change_pct > 10 THEN 'worsening' WHEN delay_change_pct < -10 THEN 'improving'
    ELSE 'stable' END AS direction FROM changes),
trend AS (SELECT upload_id, period_count, direction, delay_change_pct, CASE
    WHEN period_count < 3 THEN 'Only ' || period_count || ' dated period(s) available; at least 3 are needed to call a direction.'
    WHEN direction IN ('worsening', 'improving') THEN 'Average delay ' || CASE direction WHEN 'worsening' THEN 'rose ' ELSE 'fell ' END
      || {t1('abs(delay_change_pct)')} || '% between the first and second half of the period (' || {t1('f')} || ' → ' || {t1('s')} || ' days).'
    ELSE 'Average delay held roughly flat at ' || {t1('s')} || ' days (' || {st1('delay_change_pct')} || '% change).' END AS commentary
  FROM directions)"""

UPLOADS = """
uploads AS (SELECT upload_id, 'owner-' || (CAST(upload_id AS INT) % 2) AS user_id,
    'orders-' || upload_id || '.csv' AS filename,
    CASE WHEN CAST(upload_id AS INT) % 3 <> 0 THEN 'Orders ' || upload_id END AS label,
    count(*) AS row_count,
    CASE WHEN CAST(upload_id AS INT) % 7 = 0 THEN 'failed' ELSE 'completed' END AS status,
    make_date(CAST(upload_id AS INT), 1, 1) AS created_at
  FROM shipments GROUP BY upload_id),
named AS (SELECT *, coalesce(nullif(label, ''), filename) AS name FROM uploads)"""

_KPI_NAMES = (
    "total_shipments late_shipments late_shipment_pct avg_delay_days avg_delay_days_when_late"
    " median_delay_days p90_delay_days avg_lead_time_days delivery_success_rate total_value"
    " value_at_risk distinct_vendors distinct_countries"
).split()
_STORED = ", ".join(
    f"CASE WHEN run = 'b' THEN {c} END AS {c}" for c in ["score", "level", *_KPI_NAMES]
)
SNAPSHOTS = f"""{RISK},{UPLOADS},
snap0 AS (SELECT upload_id || '-' || run AS id, upload_id,
    CASE run WHEN 'b' THEN 'completed' ELSE 'failed' END AS status,
    make_date(CAST(upload_id AS INT), CASE WHEN run = CASE WHEN CAST(upload_id AS INT) % 5 = 0 THEN 'a' ELSE 'b' END THEN 3 ELSE 2 END, 1) AS created_at,
    {_STORED}
  FROM risk CROSS JOIN (VALUES ('a'), ('b')) AS runs(run)),
snapshots AS (SELECT * EXCLUDE (score), score AS risk_score FROM snap0),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY created_at DESC, id DESC) AS rn FROM snapshots) WHERE rn = 1),
points AS (SELECT n.user_id, n.upload_id, n.name AS label, n.created_at AS uploaded_at, n.row_count,
    coalesce(l.late_shipment_pct, 0) AS late_shipment_pct, coalesce(l.avg_delay_days, 0) AS avg_delay_days,
    coalesce(l.delivery_success_rate, 0) AS delivery_success_rate, l.risk_score
  FROM named n JOIN latest l USING (upload_id) WHERE n.status = 'completed' AND l.risk_score IS NOT NULL)"""


HISTORY = f"""{SNAPSHOTS},
            hn AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY uploaded_at, upload_id) AS i, count(*) OVER (PARTITION BY user_id) AS c FROM points),
            hh AS (SELECT user_id, max(c) AS point_count, coalesce(avg(risk_score) FILTER (i <= c // 2), 0) AS f, coalesce(avg(risk_score) FILTER (i > c // 2), 0) AS s,
              max(risk_score) FILTER (i = 1) AS r0, max(risk_score) FILTER (i = c) AS r1, max(late_shipment_pct) FILTER (i = 1) AS l0, max(late_shipment_pct) FILTER (i = c) AS l1,
              max(avg_delay_days) FILTER (i = 1) AS d0, max(avg_delay_days) FILTER (i = c) AS d1 FROM hn GROUP BY user_id),
            hd AS (SELECT *, CASE WHEN point_count >= 2 THEN {r('s - f')} END AS risk_delta FROM hh),
            hx AS (SELECT *, CASE WHEN point_count < 2 THEN 'insufficient_data' WHEN risk_delta > 1 THEN 'worsening' WHEN risk_delta < -1 THEN 'improving' ELSE 'stable' END AS direction FROM hd),
directed AS (SELECT user_id, point_count, direction, risk_delta, CASE WHEN point_count < 2 THEN 'Upload at least two datasets to see how performance is trending.'
              ELSE 'Across ' || point_count || ' uploads, the composite risk score moved from ' || {t1('r0')} || ' to ' || {t1('r1')} || ' (' || {st1('risk_delta')} || ' on average, ' || direction
              || '). Late-shipment rate went from ' || {t1('l0')} || '% to ' || {t1('l1')} || '%, and average delay from ' || {t1('d0')} || ' to ' || {t1('d1')} || ' days.' END AS summary FROM hx)"""


def oracle_sql() -> dict[str, str]:
    months_cols = "upload_id, period, shipment_count, late_count, late_pct, avg_delay_days, total_value"
    vendor_cols = (
        "upload_id, vendor, shipment_count, late_count, late_pct, avg_delay_days,"
        " avg_lead_time_days, total_value, value_at_risk, health_score, risk_level"
    )
    country_cols = (
        "upload_id, country, shipment_count, late_count, late_pct, avg_delay_days,"
        " total_value, risk_score, risk_level"
    )
    probes = [
        ("carrier", "has_carrier"),
        ("transport_mode", "has_transport_mode"),
        ("service_level", "has_service_level"),
        ("category", "has_category"),
        ("freight_cost", "fn"),
        ("weight", "has_weight"),
        ("co2", "co2n"),
        ("damage", "dn"),
        ("returns", "rn"),
        ("fill_rate", "has_fill_rate"),
    ]
    coverage = " UNION ALL ".join(
        f"SELECT upload_id, '{name}' AS dimension, {i} AS position FROM tot"
        f" WHERE {column} >= CAST(n AS DOUBLE) * CAST(0.2 AS DOUBLE)"
        for i, (name, column) in enumerate(probes, 1)
    )
    drivers = " UNION ALL ".join(
        f"SELECT upload_id, score, '{n}' AS component, '{schema.RISK_LABELS[n]}' AS label,"
        f" {i} AS tie, component_{n} * weight_{n} AS contribution FROM risk"
        for i, n in enumerate(
            (
                "late_rate",
                "delay_severity",
                "vendor_concentration",
                "country_concentration",
                "value_at_risk",
            )
        )
    )
    compared = [
        ("risk_score", "score", True),
        ("late_shipment_pct", "late_shipment_pct", True),
        ("avg_delay_days", "avg_delay_days", True),
        ("p90_delay_days", "p90_delay_days", True),
        ("delivery_success_rate", "delivery_success_rate", False),
        ("value_at_risk", "value_at_risk", True),
        ("distinct_vendors", "distinct_vendors", False),
    ]
    long = " UNION ALL ".join(
        f"SELECT upload_id, '{m}' AS metric, CAST({c} AS DOUBLE) AS value, {bad} AS rise_is_bad FROM risk"
        for m, c, bad in compared
    )
    newest = (
        "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, upload_id DESC)"
        " AS rank FROM named"
    )
    flags = """SELECT k.upload_id, delivery_success_rate >= 85 AS good_success, late_shipment_pct <= 15 AS good_late_rate,
    avg_delay_days <= 3 AS good_delay, distinct_vendors >= 3 AS vendor_diversity,
    distinct_countries >= 3 AS country_diversity, EXISTS (SELECT 1 FROM vendors v WHERE v.upload_id = k.upload_id AND health_score >= 85) AS strong_vendors,
    direction = 'improving' AS improving,"""
    signals = f"""concat_ws('|',
      CASE WHEN delivery_success_rate >= 85 THEN {t1('delivery_success_rate')} || '% of shipments arrived without a delay flag.' END,
      CASE WHEN late_shipment_pct <= 15 THEN 'Only ' || {t1('late_shipment_pct')} || '% of shipments ran late.' END,
      CASE WHEN avg_delay_days <= 3 THEN 'Average delay is ' || {t1('avg_delay_days')} || ' days across the book.' END,
      CASE WHEN distinct_vendors >= 3 THEN 'Supply is spread across ' || distinct_vendors || ' vendors, limiting single-supplier exposure.' END,
      CASE WHEN distinct_countries >= 3 THEN 'Sourcing spans ' || distinct_countries || ' origin countries.' END,
      (SELECT 'Consistently reliable vendors: ' || string_agg(vendor, ', ' ORDER BY health_score, value_at_risk DESC, vendor) || '.'
        FROM (SELECT * FROM vendors v WHERE v.upload_id = k.upload_id AND health_score >= 85 ORDER BY health_score, value_at_risk DESC, vendor LIMIT 3)),
      CASE WHEN direction = 'improving' THEN commentary END) AS signals"""
    after_facts = lambda block: block.removeprefix(FACTS)

    outline = f"""{RISK}{after_facts(TREND)}{after_facts(VENDORS)}{after_facts(TOTALS)}{after_facts(dimension('route', 12))},
            cov AS ({coverage}), av AS (SELECT upload_id, string_agg(dimension, ',' ORDER BY position) AS available FROM cov GROUP BY upload_id),
            wv AS (SELECT upload_id, vendor AS worst_vendor, health_score AS worst_health, row_number() OVER (PARTITION BY upload_id ORDER BY health_score, value_at_risk DESC, vendor) AS place, count(*) OVER (PARTITION BY upload_id) AS scored FROM vendors),
            ln AS (SELECT upload_id, count(*) AS lanes, max(label) FILTER (rn = 1) AS worst_lane, max(share_pct) FILTER (rn = 1) AS worst_lane_share FROM dims GROUP BY upload_id),
            air AS (SELECT upload_id, {cents('sum(co2_kg)')} AS air_co2_kg FROM facts WHERE transport_mode = 'air' GROUP BY upload_id)
            SELECT k.upload_id, total_shipments, late_shipment_pct, p90_delay_days, score, level, direction, delay_change_pct, period_count AS months, {signals},
              {cents('fs')} AS total_freight_cost, {pct('fs', 'goods')} AS freight_pct_of_goods, {pct('perfect', 'n')} AS perfect_order_rate_pct,
              {cents('co2s')} AS total_co2_kg, air_co2_kg, available, scored AS vendors, distinct_countries AS countries, lanes,
              worst_vendor, worst_health, worst_lane, worst_lane_share
            FROM risk k JOIN trend USING (upload_id) JOIN tot USING (upload_id) JOIN av USING (upload_id) JOIN wv USING (upload_id) JOIN ln USING (upload_id) JOIN air USING (upload_id)
            WHERE place = 1"""

    out = {
        "facts": f"""{FACTS} SELECT upload_id, vendor, origin_country, destination, product, quantity,
            {dbl('unit_cost')}, lead_time_days, delay_days, status, occurred_on, {dbl('value')}, is_late, is_at_risk,
            is_successful, {r('fill_rate', 4)} AS fill_rate, lane, period FROM facts""",
        "kpis": f"{KPIS} SELECT * FROM kpis",
        "kpis_overall": f"{FACTS} SELECT {KPI_SELECT} FROM facts",
        "kpi_bands": f"""{KPIS} SELECT upload_id, late_shipment_pct, delivery_success_rate,
            CASE WHEN late_shipment_pct >= 40 THEN 'high' WHEN late_shipment_pct >= 15 THEN 'medium' ELSE 'low' END AS late_band,
            CASE WHEN delivery_success_rate >= 85 THEN 'low' WHEN delivery_success_rate >= 60 THEN 'medium' ELSE 'high' END AS success_band,
            CASE WHEN total_value > 0 AND value_at_risk > total_value * CAST(0.3 AS DOUBLE) THEN 'high' END AS value_at_risk_band FROM kpis""",
        "delay_percentiles": f"""{FACTS} SELECT upload_id, {r('quantile_cont(delay_days, 0.5)')} AS median_delay_days,
            {r('quantile_cont(delay_days, 0.9)')} AS p90_delay_days FROM facts GROUP BY upload_id""",
        "vendor_health": f"{VENDORS} SELECT {vendor_cols} FROM vendors",
        "country_risk": f"{COUNTRIES} SELECT {country_cols} FROM countries",
        "vendor_shares": f"""{FACTS}, s AS (SELECT upload_id, vendor, sum(value) AS v, count(*) AS n FROM facts GROUP BY upload_id, vendor),
            t AS (SELECT upload_id, sum(v) AS tv, sum(n) AS tn FROM s GROUP BY upload_id)
            SELECT upload_id, vendor, {r(f"CASE WHEN tv > 0 THEN {ratio('v', 'tv')} ELSE {ratio('n', 'tn')} END", 6)} AS share FROM s JOIN t USING (upload_id)""",
        "country_shares": f"""{FACTS}, s AS (SELECT upload_id, origin_country AS country, count(*) AS n FROM facts GROUP BY ALL),
            t AS (SELECT upload_id, sum(n) AS tn FROM s GROUP BY upload_id)
            SELECT upload_id, country, {r(ratio('n', 'tn'), 6)} AS share FROM s JOIN t USING (upload_id)""",
        "concentration": f"""{FACTS},{_HHI} SELECT upload_id, {r('vendor_hhi', 4)} AS vendor_concentration,
            {r('country_hhi', 4)} AS country_concentration FROM hv JOIN hc USING (upload_id)""",
        "composite_risk": f"{RISK} SELECT upload_id, {RISK_COLUMNS} FROM risk",
        "risk_drivers": f"""{RISK}, dr AS ({drivers}),
            rk AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY contribution DESC, tie) AS rank FROM dr WHERE contribution IS NOT NULL)
            SELECT upload_id, rank, component, {r('contribution * 100', 4)} AS contribution_points,
              label || ' (contributes ' || {t1('contribution * 100')} || ' of ' || {t1('score')} || ')' AS driver
            FROM rk WHERE rank <= 3 AND contribution > 0""",
        "risk_unmeasured": f"""{RISK} SELECT upload_id, CASE WHEN total_value > 0 THEN '' ELSE 'value_at_risk' END AS components_not_measurable FROM risk""",
        "dimension_score": f"{dimension('destination')} SELECT {DIMENSION_COLUMNS} FROM dims",
        "dim_carriers": f"{dimension('carrier')} SELECT {DIMENSION_COLUMNS} FROM dims",
        "dim_transport_modes": f"{dimension('transport_mode')} SELECT {DIMENSION_COLUMNS} FROM dims",
        "dim_service_levels": f"{dimension('service_level')} SELECT {DIMENSION_COLUMNS} FROM dims",
        "dim_categories": f"{dimension('category')} SELECT {DIMENSION_COLUMNS} FROM dims",
        "dim_lanes": f"{dimension('route', 12)} SELECT {DIMENSION_COLUMNS} FROM dims",
        "freight_cost": f"""{TOTALS} SELECT upload_id, {pct('fn', 'n')} AS coverage_pct, {cents('fs')} AS total_freight_cost,
            {mean('fs', 'fn')} AS avg_freight_cost,
            CASE WHEN units <> 0 THEN {r(ratio('fs', 'units'))} END AS freight_per_unit,
            CASE WHEN kgn > 0 THEN {r(ratio('fs', 'kg'))} END AS freight_per_kg,
            CASE WHEN goods > 0 THEN {pct('fs', 'goods')} END AS freight_pct_of_goods,
            CASE WHEN landed_n > 0 THEN {cents('landed')} END AS total_landed_cost,
            {cents('coalesce(late_freight, 0)')} AS freight_spent_on_late_shipments FROM tot WHERE {gate('fn', 'n')}""",
        "order_quality": f"""{TOTALS} SELECT upload_id,
            CASE WHEN {gate('dn', 'n')} THEN {pct('ds', 'dn')} END AS damage_rate_pct,
            CASE WHEN {gate('dn', 'n')} THEN ds END AS damaged_count,
            CASE WHEN {gate('rn', 'n')} THEN {pct('rs', 'rn')} END AS return_rate_pct,
            CASE WHEN {gate('rn', 'n')} THEN rs END AS returned_count,
            CASE WHEN {gate('filln', 'n')} THEN {mean('fills', 'filln')} END AS avg_fill_rate_pct,
            {pct('perfect', 'n')} AS perfect_order_rate_pct, {pct('checked', 'n')} AS coverage_pct
            FROM tot WHERE {gate('dn', 'n')} OR {gate('rn', 'n')} OR {gate('filln', 'n')}""",
        "perfect_order": f"{TOTALS} SELECT upload_id, {pct('perfect', 'n')} AS perfect_order_rate_pct FROM tot",
        "emissions": f"""{TOTALS} SELECT upload_id, {pct('co2n', 'n')} AS coverage_pct, {cents('co2s')} AS total_co2_kg,
            {mean('co2s', 'co2n')} AS avg_co2_per_shipment_kg FROM tot WHERE {gate('co2n', 'n')}""",
        "emissions_by_mode": f"""{TOTALS} SELECT upload_id, transport_mode, {cents('sum(co2_kg)')} AS co2_kg FROM facts
            WHERE co2_kg IS NOT NULL AND transport_mode <> '' AND upload_id IN (SELECT upload_id FROM tot WHERE {gate('co2n', 'n')})
            GROUP BY upload_id, transport_mode""",
        "coverage": f"{TOTALS} {coverage}",
        "vendor_rollup": f"""{SHIPMENTS} SELECT upload_id, vendor, count(*) AS shipment_count,
            count(*) FILTER (delay_days > 0) AS late_count, {r('avg(delay_days)', 6)} AS avg_delay_days,
            {r('avg(lead_time_days)', 6)} AS avg_lead_time_days FROM shipments GROUP BY upload_id, vendor""",
        "distinct_vendors": f"{SHIPMENTS} SELECT DISTINCT upload_id, vendor FROM shipments WHERE vendor <> ''",
        "count_shipments": f"{SHIPMENTS} SELECT upload_id, count(*) AS shipment_count FROM shipments GROUP BY upload_id",
        "country_exposure": f"""{COUNTRIES}, t AS (SELECT upload_id, sum(shipment_count) AS n FROM countries GROUP BY upload_id)
            SELECT upload_id, country, risk_score, risk_level, {pct('shipment_count', 'n')} AS share_pct FROM countries JOIN t USING (upload_id)""",
        "monthly_trend": f"{MONTHS} SELECT {months_cols} FROM months",
        "trend_direction": f"{TREND} SELECT * FROM trend",
        "trend_last_12": f"""{MONTHS} SELECT {months_cols} FROM
            (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY period DESC) AS rn FROM months) WHERE rn <= 12""",
        "healthy_signals": f"""{KPIS}{after_facts(VENDORS)}{after_facts(TREND)}
            {flags} {signals} FROM kpis k JOIN trend USING (upload_id)""",
        "latest_snapshot": f"{SNAPSHOTS} SELECT upload_id, id, status, created_at, risk_score, CAST(total_shipments AS DOUBLE) AS total_shipments, late_shipment_pct FROM latest",
        "history_points": f"{SNAPSHOTS} SELECT * FROM points",
        "history_direction": f"{HISTORY} SELECT * FROM directed",
        "compare_metrics": f"""{RISK.replace("risk AS (", "risk AS MATERIALIZED (")}, long AS MATERIALIZED ({long})
            SELECT a.upload_id AS before_id, b.upload_id AS after_id, a.metric, a.value AS before, b.value AS after,
              {r('b.value - a.value', 4)} AS change, CASE WHEN abs(b.value - a.value) < CAST(0.05 AS DOUBLE) THEN 'neutral'
              WHEN CASE WHEN a.rise_is_bad THEN b.value > a.value ELSE b.value < a.value END THEN 'worse' ELSE 'better' END AS assessment
            FROM long a JOIN long b ON a.metric = b.metric AND CAST(b.upload_id AS INT) = CAST(a.upload_id AS INT) + 1""",
        "analyses_for_user": f"""{SNAPSHOTS} SELECT s.upload_id, s.id, s.status, s.created_at, s.risk_score, n.user_id, n.name AS label
            FROM snapshots s JOIN named n USING (upload_id) WHERE n.user_id = 'owner-1'""",
        "scope_to_owner": f"""{SHIPMENTS},{UPLOADS} SELECT upload_id, l_orderkey, l_linenumber, vendor, delay_days
            FROM shipments WHERE upload_id IN (SELECT upload_id FROM uploads WHERE user_id = 'owner-1')""",
        "delete_upload": f"""{SHIPMENTS},{UPLOADS} SELECT upload_id, l_orderkey, l_linenumber, vendor, delay_days
            FROM shipments WHERE upload_id NOT IN (SELECT upload_id FROM uploads WHERE status = 'failed')""",
        "scan_upload": f"{SHIPMENTS} SELECT upload_id, l_orderkey, l_linenumber, vendor, delay_days, status FROM shipments WHERE upload_id = '1996'",
        "resolve_dataset": f"""{SHIPMENTS},{UPLOADS}, ranked AS ({newest}),
            req AS (SELECT k.kind || '-' || upload_id AS request_id, user_id,
                CASE k.kind WHEN 'exact' THEN '  ' || upper(name) || ' ' WHEN 'part' THEN right(upload_id, 2) WHEN 'pinned' THEN 'ignored' WHEN 'wrong' THEN 'no such ' || name END AS wanted,
                CASE k.kind WHEN 'pinned' THEN upload_id END AS pinned_id
              FROM named CROSS JOIN (VALUES ('exact'), ('part'), ('newest'), ('pinned'), ('wrong')) AS k(kind)),
            q AS (SELECT r.request_id, r.user_id, u.upload_id, u.name, u.rank,
                CASE WHEN r.pinned_id IS NOT NULL THEN CASE WHEN u.upload_id = r.pinned_id THEN 0 END
                  WHEN trim(coalesce(r.wanted, '')) = '' THEN 0 WHEN lower(trim(u.name)) = lower(trim(r.wanted)) THEN 0
                  WHEN contains(lower(trim(u.name)), lower(trim(r.wanted))) THEN 1 END AS quality
              FROM req r LEFT JOIN ranked u ON r.user_id = u.user_id),
            best AS (SELECT *, row_number() OVER (PARTITION BY request_id, user_id ORDER BY quality NULLS LAST, rank) AS rn FROM q)
            SELECT request_id, user_id, CASE WHEN quality IS NOT NULL THEN upload_id END AS upload_id, CASE WHEN quality IS NOT NULL THEN name END AS label FROM best WHERE rn = 1""",
        "page_shipments": f"""{SHIPMENTS} SELECT upload_id, vendor, product, origin_country, destination, quantity, {dbl('unit_cost')},
            lead_time_days, delay_days, status, shipped_on FROM shipments
            ORDER BY upload_id, l_orderkey, l_linenumber, vendor, product, destination, shipped_on, quantity LIMIT 500 OFFSET 1000""",
        "top_vendors": f"""{VENDORS} SELECT {vendor_cols}, rank FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY health_score, value_at_risk DESC, vendor) AS rank FROM vendors) WHERE rank <= 25""",
        "top_countries": f"""{COUNTRIES} SELECT {country_cols}, rank FROM (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY risk_score DESC, total_value DESC, country) AS rank FROM countries) WHERE rank <= 25""",
        "list_datasets": f"""{SHIPMENTS},{UPLOADS}, ranked AS ({newest}) SELECT user_id, rank, name, row_count AS rows, created_at AS uploaded, status FROM ranked WHERE rank <= 12""",
        "kpi_view": f"{KPIS} SELECT * EXCLUDE (median_delay_days, avg_lead_time_days) FROM kpis",
        "vendor_view": f"""{VENDORS}, rk AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY health_score, value_at_risk DESC, vendor) AS rank, count(*) OVER (PARTITION BY upload_id) AS vendors_scored FROM vendors)
            SELECT upload_id, vendors_scored, rank, vendor, health_score, risk_level, late_pct, avg_delay_days, shipment_count, value_at_risk FROM rk WHERE rank <= 5""",
        "country_view": f"""{COUNTRIES}, rk AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY risk_score DESC, total_value DESC, country) AS rank FROM countries)
            SELECT upload_id, rank, country, risk_score, risk_level, late_pct, avg_delay_days, shipment_count FROM rk WHERE rank <= 5""",
        "trend_view": f"""{TREND}, lm AS (SELECT *, row_number() OVER (PARTITION BY upload_id ORDER BY period DESC) AS rn FROM months)
            SELECT upload_id, direction, commentary, delay_change_pct, period, shipment_count AS shipments, late_pct, avg_delay_days FROM trend JOIN lm USING (upload_id) WHERE rn <= 12""",
        "dimension_view": " UNION ALL ".join(
            f"""SELECT * FROM ({dimension(key)}, every AS (SELECT DISTINCT upload_id FROM facts)
            SELECT upload_id, '{name}' AS dimension, rn AS rank, label, share_pct, shipment_count, late_pct, avg_delay_days, avg_freight_cost,
              CASE WHEN label IS NULL THEN 'No data: fewer than two labels with enough shipments.' END AS note
            FROM every LEFT JOIN (SELECT * FROM dims WHERE rn <= 5) USING (upload_id))"""
            for name, key in DIMENSION_KEYS.items()
        ),
        "history_view": f"{HISTORY} SELECT p.user_id, label AS dataset, uploaded_at AS uploaded, row_count AS rows, risk_score, late_shipment_pct, avg_delay_days, direction, summary FROM points p JOIN directed USING (user_id)",
        "operations_view": f"""{TOTALS}, cov AS ({coverage}), av AS (SELECT upload_id, string_agg(dimension, ',' ORDER BY position) AS available FROM cov GROUP BY upload_id)
            SELECT upload_id, CASE WHEN {gate('fn', 'n')} THEN {cents('fs')} END AS total_freight_cost,
              CASE WHEN {gate('fn', 'n')} AND kgn > 0 THEN {r(ratio('fs', 'kg'))} END AS freight_per_kg,
              CASE WHEN {gate('dn', 'n')} THEN {pct('ds', 'dn')} END AS damage_rate_pct, {pct('perfect', 'n')} AS perfect_order_rate_pct,
              CASE WHEN {gate('co2n', 'n')} THEN {cents('co2s')} END AS total_co2_kg,
              CASE WHEN {gate('co2n', 'n')} THEN air_co2_kg END AS air_co2_kg, coalesce(available, '') AS available
            FROM tot LEFT JOIN av USING (upload_id) LEFT JOIN (SELECT upload_id, {cents('sum(co2_kg)')} AS air_co2_kg FROM facts
              WHERE transport_mode = 'air' GROUP BY upload_id) USING (upload_id)""",
        "report_outline": outline,
        "snapshot_report": outline,
        "report_shareable": f"SELECT upload_id, total_shipments, score, lanes, worst_vendor, false AS names_lanes FROM ({outline})",
        "report_items": f"""{VENDORS}{after_facts(COUNTRIES)}{after_facts(MONTHS)},
            {" , ".join(f"items_{name} AS (WITH {after_facts(dimension(key, 12 if name == 'lanes' else None)).lstrip(',').strip()} SELECT * FROM dims)" for name, key in DIMENSION_KEYS.items())}
            SELECT upload_id, 'vendors' AS section, row_number() OVER (PARTITION BY upload_id ORDER BY health_score, value_at_risk DESC, vendor) AS position,
              vendor AS label, shipment_count, NULL::DOUBLE AS share_pct, late_count, late_pct, avg_delay_days, avg_lead_time_days, NULL::DOUBLE AS avg_transit_days,
              total_value, value_at_risk, NULL::DOUBLE AS avg_freight_cost, health_score, NULL::DOUBLE AS risk_score, risk_level FROM vendors
            UNION ALL SELECT upload_id, 'countries', row_number() OVER (PARTITION BY upload_id ORDER BY risk_score DESC, total_value DESC, country),
              country, shipment_count, NULL, late_count, late_pct, avg_delay_days, NULL, NULL, total_value, NULL, NULL, NULL, risk_score, risk_level FROM countries
            UNION ALL SELECT upload_id, 'months', row_number() OVER (PARTITION BY upload_id ORDER BY period),
              period, shipment_count, NULL, late_count, late_pct, avg_delay_days, NULL, NULL, total_value, NULL, NULL, NULL, NULL, NULL FROM months
            {" ".join(f"UNION ALL SELECT upload_id, '{name}', rn, label, shipment_count, share_pct, late_count, late_pct, avg_delay_days, NULL, avg_transit_days, total_value, NULL, avg_freight_cost, NULL, NULL, NULL FROM items_{name}" for name in DIMENSION_KEYS)}""",
        "report": f"""{RISK}{after_facts(TREND)}{after_facts(VENDORS)},
            {" , ".join(f"items_{name} AS (WITH {after_facts(dimension(key, 12 if name == 'lanes' else None)).lstrip(',').strip()} SELECT * FROM dims)" for name, key in DIMENSION_KEYS.items())}
            SELECT upload_id, {", ".join(_KPI_NAMES)}, score, level, direction, delay_change_pct, commentary, {signals},
              (SELECT count(*) FROM vendors x WHERE x.upload_id = k.upload_id) AS vendors_count, distinct_countries AS countries_count,
              {", ".join(f"(SELECT count(*) FROM items_{name} x WHERE x.upload_id = k.upload_id) AS {name}_count" for name in DIMENSION_KEYS)}
            FROM risk k JOIN trend USING (upload_id)""",
        "risk_view": f"""{RISK} SELECT upload_id, {RISK_COLUMNS},
            CASE WHEN total_value > 0 THEN 0 ELSE 1 END AS missing FROM risk""",
    }
    return {name: sql.strip() for name, sql in out.items()}
