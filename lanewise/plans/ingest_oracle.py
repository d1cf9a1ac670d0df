"""SQL equivalents of the ingest queries."""

from __future__ import annotations

from lanewise import schema
from lanewise.plans.ingest_queries import _SPELLINGS, ROW_CAP, mode_words, status_words
from lanewise.plans.oracle import MONTHS, SHIPMENTS, SNAPSHOTS, dbl, r
from lanewise.sources.headers import plain_name, similar_fields
from lanewise.vocabulary import header_names

KEY = "l_orderkey, l_linenumber, l_partkey"


def _case(number: str, count: int, branches: dict[int, str]) -> str:
    cases = " ".join(f"WHEN {i} THEN {value}" for i, value in branches.items())
    return f"CASE {number} % {count} {cases} END"


def _words(labels: dict[str, str], words: list[str], other: str) -> str:
    branches = {i: f"'{labels[w]}'" for i, w in enumerate(words)} | {len(words): other}
    return _case("l_orderkey", len(words) + 1, branches)


_DAY_FIRST = (
    "CASE WHEN day(l_shipdate) <= 12 THEN make_date(year(l_shipdate), day(l_shipdate),"
    " month(l_shipdate)) ELSE CAST(l_shipdate AS DATE) END"
)

# The three export styles state different things.
EXPORTED = f"""{SHIPMENTS},
styled AS (SELECT *, CAST(upload_id AS INT) % 3 AS style FROM shipments),
stated AS (SELECT *, CASE style WHEN 2 THEN -unit_cost ELSE unit_cost END AS cost,
    CASE WHEN style <> 2 THEN freight_cost END AS freight,
    CASE WHEN style = 2 THEN NULL ELSE weight_kg END AS kg, CASE WHEN style = 2 THEN NULL ELSE distance_km END AS km,
    CASE WHEN style = 2 THEN NULL ELSE transport_mode END AS mode FROM styled),
ingested AS (SELECT upload_id, l_orderkey || '-' || l_linenumber AS shipment_ref, vendor, carrier, product,
    CASE WHEN style <> 2 THEN category END AS category, service_level, origin_country, destination, quantity,
    CASE WHEN style <> 2 THEN quantity_delivered END::DOUBLE AS quantity_delivered,
    {dbl('cost', 'unit_cost')}, {dbl('freight', 'freight_cost')},
    CAST(CAST(quantity * cost + coalesce(freight, 0) AS DECIMAL(14,4)) AS DOUBLE) AS total_cost,
    {dbl('kg', 'weight_kg')}, {dbl('km', 'distance_km')},
    CASE WHEN style <> 2 THEN CAST(co2_kg AS DOUBLE) END AS co2_kg, mode AS transport_mode, lead_time_days::DOUBLE AS lead_time_days,
    CASE WHEN style <> 1 THEN greatest(CAST(actual_delivery - shipped_on AS INT), 0) END::DOUBLE AS transit_days,
    delay_days, CASE WHEN style = 0 THEN status
      WHEN style = 1 THEN CASE WHEN delay_days > 0 THEN 'delayed' ELSE 'unknown' END
      WHEN delay_days > 0 THEN 'delayed' ELSE 'on_time' END AS status, shipped_on,
    CASE WHEN style <> 1 THEN scheduled_delivery END AS scheduled_delivery,
    CASE WHEN style <> 1 THEN actual_delivery END AS actual_delivery,
    CASE WHEN style <> 1 THEN actual_delivery END AS last_updated,
    CASE WHEN style <> 2 THEN damaged END::VARCHAR AS damaged, CASE WHEN style <> 2 THEN returned END::VARCHAR AS returned
  FROM stated)"""

TOTALS = """SELECT upload_id, count(*) AS row_count, CAST(sum(delay_days) AS BIGINT) AS delay_sum,
    CAST(sum(quantity) AS BIGINT) AS quantity_sum,
    CAST(sum(CAST(freight_cost AS DECIMAL(14,4))) AS DOUBLE) AS freight_sum, count(co2_kg) AS co2_count
  FROM ingested GROUP BY upload_id"""

GAPPY = f"""{SHIPMENTS},
gappy AS (SELECT l_orderkey, l_linenumber, vendor,
    CASE WHEN l_orderkey % 4 <> 0 THEN shipped_on END AS shipped,
    CASE WHEN l_orderkey % 3 <> 0 THEN scheduled_delivery END AS scheduled,
    CASE WHEN l_orderkey % 5 <> 0 THEN actual_delivery END AS actual,
    CASE WHEN l_orderkey % 11 = 0 THEN delay_days END AS stated_delay,
    CASE WHEN l_orderkey % 13 = 0 THEN lead_time_days END AS stated_lead,
    CASE WHEN l_orderkey % 2 = 0 THEN status ELSE 'unknown' END AS parsed_status,
    CASE WHEN l_orderkey % 7 <> 0 THEN origin_country END AS city,
    CASE WHEN l_orderkey % 9 <> 0 THEN destination END AS country,
    CASE WHEN l_orderkey % 4 <> 0 THEN quantity END AS quantity, unit_cost, freight_cost,
    CASE WHEN l_orderkey % 10 = 0 THEN unit_cost END AS insurance_cost,
    CASE WHEN l_orderkey % 17 = 0 THEN unit_cost * 100 END AS stated_total
  FROM shipments)"""
_ROW = "l_orderkey, l_linenumber, vendor"
_RAW_DELAY = "coalesce(stated_delay, CAST(actual - scheduled AS INT))"


def _map_headers(names: str) -> str:
    """Known names first; then header by header the most similar field that is free.

    Similarity depends on the name alone, so the ranked fields of every spelling
    are values here, and the SQL does the choosing.
    """
    vocabulary = header_names()
    ranked = []
    for header in _SPELLINGS:
        found = similar_fields(plain_name(header), vocabulary) if len(plain_name(header)) > 2 else []
        fields = ", ".join(f"{{'field': '{f}', 'score': {round(s, 3)}::DOUBLE}}" for s, f in found)
        empty = "[]::STRUCT(field VARCHAR, score DOUBLE)[]"
        ranked.append(f"('{header}', {f'[{fields}]' if found else empty})")
    spellings = ", ".join(f"'{s}'" for s in _SPELLINGS)
    return f"""WITH RECURSIVE cells AS (SELECT CAST(o_orderkey AS VARCHAR) AS file, i AS position,
          ([{spellings}])[CAST((o_orderkey * (i + 1) + i * i) % {len(_SPELLINGS)} AS INT) + 1] AS header
          FROM (SELECT DISTINCT o_orderkey FROM orders), range(8) AS t(i)),
        h AS (SELECT file, header, CAST(min(position) AS INT) AS position, CAST(max(position) AS INT) AS "column" FROM cells GROUP BY file, header),
        names(field, name) AS (VALUES {names}),
        alike(header, candidates) AS (VALUES {", ".join(ranked)}),
        hits AS (SELECT h.*, n.field, row_number() OVER (PARTITION BY file, n.field ORDER BY position) AS rn
          FROM h JOIN names n ON n.name = regexp_replace(lower(h.header), '[^a-z0-9]', '', 'g')),
        exact AS (SELECT * FROM hits WHERE rn = 1),
        taken AS (SELECT h.file, coalesce(list(e.field) FILTER (e.field IS NOT NULL), []) AS filled
          FROM h LEFT JOIN exact e USING (file, header) GROUP BY h.file),
        open AS (SELECT h.*, s.candidates, row_number() OVER (PARTITION BY h.file ORDER BY h.position) AS k
          FROM h JOIN alike s USING (header) ANTI JOIN exact e USING (file, header)),
        chosen AS (SELECT file, CAST(0 AS BIGINT) AS k, filled, NULL::VARCHAR AS header, NULL::INT AS position, NULL::INT AS "column",
            NULL::VARCHAR AS field, NULL::DOUBLE AS score FROM taken
          UNION ALL
          SELECT file, k, CASE WHEN pick IS NULL THEN filled ELSE list_append(filled, pick.field) END, header, position, "column", pick.field, pick.score
          FROM (SELECT c.file, o.k, c.filled, o.header, o.position, o."column",
              list_filter(o.candidates, lambda x: NOT list_contains(c.filled, x.field))[1] AS pick
            FROM chosen c JOIN open o ON o.file = c.file AND o.k = c.k + 1))
        SELECT file, position, header, "column", field, NULL::DOUBLE AS score FROM exact
        UNION ALL SELECT file, position, header, "column", field, score FROM chosen WHERE k > 0"""


def oracle_sql() -> dict[str, str]:
    tokens = [*schema.TRUE_TOKENS, *schema.FALSE_TOKENS]
    flags = {
        i: ("true" if i < len(schema.TRUE_TOKENS) else "NULL" if t == "none" else "false")
        for i, t in enumerate(tokens)
    }
    dates = dict.fromkeys(range(13), "CAST(l_shipdate AS DATE)") | {6: _DAY_FIRST}
    names = ", ".join(
        f"('{field}', '{name}')" for field, known in header_names().items() for name in known
    )
    spellings = ", ".join(f"'{s}'" for s in _SPELLINGS)
    return {
        "coerce_numbers": f"""SELECT {KEY}, {r(_case('(l_orderkey + l_linenumber)', 6, {
            0: 'l_extendedprice', 1: '-l_extendedprice', 2: 'l_extendedprice', 5: 'l_extendedprice'}))} AS amount,
            CAST({_case('l_partkey', 5, {0: 'l_quantity * 1000', 1: 'l_quantity', 2: '-l_quantity'})} AS INT)::DOUBLE AS units FROM lineitem""",
        "coerce_dates": f"SELECT {KEY}, {_case('(l_orderkey + l_linenumber)', 15, dates)} AS day FROM lineitem",
        "coerce_bools": f"SELECT {KEY}, CAST({_case('l_orderkey', len(tokens) + 3, flags)} AS BOOLEAN)::VARCHAR AS flag FROM lineitem",
        "parse_status": f"SELECT {KEY}, {_words(schema.STATUS_WORDS, status_words(), chr(39) + 'unknown' + chr(39))} AS status FROM lineitem",
        "parse_mode": f"SELECT {KEY}, {_words(schema.MODE_WORDS, mode_words(), 'NULL')} AS transport_mode FROM lineitem",
        "clean_text": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN substr(p_name || ' ' || p_type, 1, 16)
            WHEN 2 THEN substr(p_name || ' ' || p_type || p_type || p_type, 1, 16) END AS text FROM part""",
        "normalize_header": "SELECT p_partkey, regexp_replace(lower(p_name || ' (' || p_type || ')_' || p_brand), '[^a-z0-9]', '', 'g') AS name FROM part",
        "risk_level": f"SELECT {KEY}, CASE WHEN l_quantity * 2 >= 66 THEN 'HIGH' WHEN l_quantity * 2 >= 33 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM lineitem",
        "derive_delay": f"""{GAPPY} SELECT {_ROW}, greatest(coalesce({_RAW_DELAY}, 0), 0) AS delay_days,
            stated_delay IS NULL AND scheduled IS NOT NULL AND actual IS NOT NULL AS derived FROM gappy""",
        "derive_lead_time": f"""{GAPPY} SELECT {_ROW}, CASE WHEN stated_lead IS NOT NULL THEN stated_lead
            WHEN shipped IS NOT NULL AND actual IS NOT NULL THEN greatest(CAST(actual - shipped AS INT), 0) END::DOUBLE AS lead_time_days FROM gappy""",
        "derive_status": f"""{GAPPY} SELECT {_ROW}, CASE WHEN parsed_status = 'unknown' AND {_RAW_DELAY} IS NOT NULL
            THEN CASE WHEN {_RAW_DELAY} > 0 THEN 'delayed' ELSE 'on_time' END ELSE parsed_status END AS status FROM gappy""",
        "derive_dates": f"{GAPPY} SELECT {_ROW}, coalesce(shipped, actual, scheduled) AS shipped_on FROM gappy",
        "derive_destination": f"""{GAPPY} SELECT {_ROW}, CASE WHEN city IS NOT NULL AND country IS NOT NULL THEN city || ', ' || country
            ELSE coalesce(city, country) END AS destination FROM gappy""",
        "derive_total_cost": f"""{GAPPY} SELECT {_ROW}, {r('''coalesce(stated_total, CASE WHEN quantity IS NOT NULL OR freight_cost IS NOT NULL
            OR insurance_cost IS NOT NULL THEN coalesce(quantity * unit_cost, 0) + coalesce(freight_cost, 0) + coalesce(insurance_cost, 0) END)''', 4)} AS total_cost FROM gappy""",
        "co2_estimate": f"{SHIPMENTS} SELECT l_orderkey, l_linenumber, vendor, transport_mode, {dbl('co2_kg')} FROM shipments",
        "map_headers_exact": f"""WITH h AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS file, i AS position,
              ([{spellings}])[CAST((o_orderkey * (i + 1) + i * i) % {len(_SPELLINGS)} AS INT) + 1] AS header
              FROM orders, range(8) AS t(i)),
            names(field, name) AS (VALUES {names}),
            hits AS (SELECT h.*, n.field, row_number() OVER (PARTITION BY file, n.field ORDER BY position) AS rn
              FROM h JOIN names n ON n.name = regexp_replace(lower(h.header), '[^a-z0-9]', '', 'g'))
            SELECT file, field, header FROM hits WHERE rn = 1""",
        "map_headers": _map_headers(names),
        "ingest_odd_exports": """
            WITH c AS (SELECT c_custkey % 5 AS late, c_name, c_nationkey FROM customer),
            n AS (SELECT count(*) AS n, CAST(sum(late) AS BIGINT) AS delay_sum, count(DISTINCT c_name) AS vendors, max(c_name) AS last, count(DISTINCT c_nationkey) AS places FROM c)
            SELECT 'titled' AS upload_id, n AS accepted_rows, 0::BIGINT AS rejected_rows, 0::BIGINT AS damaged_rows, 3 AS detected, 2 AS warning_count, true AS titles_noted,
              delay_sum, vendors, last AS last_vendor, NULL::VARCHAR AS product, places FROM n
            UNION ALL SELECT 'windows', n, 0, 0, 3, 1, false, delay_sum, vendors, 'Café ' || last, NULL, places FROM n
            UNION ALL SELECT 'broken', n, 0, 0, 3, 1, false, delay_sum, vendors, 'Two' || chr(10) || 'lines ' || last, '5" pipe', 0 FROM n
            UNION ALL SELECT 'headeronly', 0, 0, 0, 3, 2, false, NULL, NULL, NULL, NULL, NULL FROM n""",
        "ingest_csv": f"{EXPORTED} SELECT * FROM ingested",
        "ingest_report": f"""{EXPORTED}, blanks AS (SELECT upload_id, count(*) FILTER (l_orderkey % 50 = 0) AS rejected_rows FROM shipments GROUP BY upload_id)
            SELECT upload_id, count(*) AS accepted_rows, any_value(rejected_rows) AS rejected_rows,
              count(*) FILTER (scheduled_delivery IS NOT NULL) AS derived_delays,
              CASE CAST(upload_id AS INT) % 3 WHEN 0 THEN 21 WHEN 1 THEN 20 ELSE 12 END AS detected,
              CASE CAST(upload_id AS INT) % 3 WHEN 0 THEN 'Internal Notes' ELSE '' END AS unmapped,
              CASE CAST(upload_id AS INT) % 3 WHEN 0 THEN 'Suppler Name' ELSE '' END AS guessed, CAST(0 AS INT) AS warning_count
            FROM ingested JOIN blanks USING (upload_id) GROUP BY upload_id""",
        "accept_rows": f"""{SHIPMENTS} SELECT upload_id, true AS accepted, count(*) AS row_count FROM shipments GROUP BY upload_id
            UNION ALL SELECT upload_id, false AS accepted, count(*) AS row_count FROM shipments WHERE l_orderkey % 50 = 0 GROUP BY upload_id""",
        "row_cap": f"{SHIPMENTS} SELECT upload_id, least(count(*), {ROW_CAP}) AS row_count FROM shipments GROUP BY upload_id",
        "write_shipments": f"{EXPORTED} {TOTALS}",
        "ingest_stream": f"{EXPORTED} {TOTALS}",
        "stream_monthly_trend": f"{MONTHS} SELECT upload_id, period, shipment_count, late_count, late_pct, avg_delay_days, total_value FROM months",
        "replace_snapshot": f"""{SNAPSHOTS} SELECT s.upload_id, CASE WHEN n.user_id = 'owner-0' THEN s.id || '-again' ELSE s.id END AS id, s.status, s.risk_score
            FROM snapshots s JOIN named n USING (upload_id)""",
    }
