"""DuckDB SQL giving the same rows as the queries of ``registry``, written independently of the operators."""

from __future__ import annotations

_BASE = """
WITH raw_one AS (
  SELECT event_id,
    CASE WHEN event_id % 37 = 5 THEN '' ELSE concat('TRK-', lpad(CAST(user_id AS VARCHAR), 6, '0')) END AS truck_id,
    CASE WHEN event_id % 23 = 1 THEN NULL WHEN event_id % 29 = 2 THEN CAST(95.5 AS DOUBLE)
      ELSE CAST(41.65 AS DOUBLE) + CAST((event_id * 7919) % 4001 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS latitude,
    CASE WHEN event_id % 31 = 3 THEN CAST(-200.25 AS DOUBLE)
      ELSE CAST(-87.85 AS DOUBLE) + CAST((event_id * 104729) % 4001 AS DOUBLE) / CAST(10000 AS DOUBLE) END AS longitude,
    CASE WHEN event_id % 41 = 4 THEN 'not-a-timestamp' WHEN event_id % 43 = 6 THEN NULL
      ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' END AS event_ts_raw,
    ts
  FROM events),
raw AS (SELECT * FROM raw_one UNION ALL SELECT * FROM raw_one WHERE event_id % 10 = 0),
typed AS (SELECT *, CASE WHEN event_ts_raw IS NOT NULL AND event_ts_raw <> 'not-a-timestamp' THEN CAST(ts AS TIMESTAMP) END AS event_ts FROM raw),
judged AS (
  SELECT *, CASE
    WHEN truck_id IS NULL OR trim(truck_id) = '' THEN 'missing_truck_id'
    WHEN event_ts_raw IS NULL THEN 'missing_event_ts'
    WHEN event_ts IS NULL THEN 'unparseable_event_ts'
    WHEN latitude IS NULL OR longitude IS NULL THEN 'missing_coordinates'
    WHEN NOT latitude BETWEEN -90 AND 90 THEN 'latitude_out_of_range'
    WHEN NOT longitude BETWEEN -180 AND 180 THEN 'longitude_out_of_range' END AS reject_reason
  FROM typed),
silver AS (
  SELECT DISTINCT sha256(concat_ws('||', truck_id, event_ts_raw)) AS ping_id, truck_id, event_ts, CAST(event_ts AS DATE) AS event_date,
    latitude, longitude, event_ts_raw
  FROM judged WHERE reject_reason IS NULL),
rejects AS (SELECT DISTINCT truck_id, event_ts_raw, latitude, longitude, reject_reason FROM judged WHERE reject_reason IS NOT NULL),
dim AS (
  SELECT concat('TRK-', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS truck_id, c_mktsegment AS make,
    concat('M', CAST(c_custkey % 4 AS VARCHAR)) AS model,
    CAST(CASE c_custkey % 4 WHEN 0 THEN 20000 WHEN 1 THEN 26000 WHEN 2 THEN 34000 ELSE 40000 END AS INT) AS capacity_lbs,
    n_name AS home_depot, r_name AS region, c_name AS driver, c_custkey AS k
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_custkey % 10 <> 9),
latest AS (
  SELECT truck_id, event_ts AS last_event_ts, latitude, longitude FROM silver
  QUALIFY row_number() OVER (PARTITION BY truck_id ORDER BY event_ts DESC, latitude DESC, longitude DESC) = 1),
position AS (
  SELECT l.*, make, model, capacity_lbs, home_depot, region, driver,
    latitude BETWEEN 41.80 AND 41.95 AND longitude BETWEEN -87.75 AND -87.55 AS in_geofence,
    'chicago_loop' AS geofence_name,
    round(CAST(capacity_lbs AS DOUBLE) / CAST(2204.62 AS DOUBLE), 2) AS capacity_tons
  FROM latest l LEFT JOIN dim USING (truck_id)),
activity AS (
  SELECT coalesce(region, 'UNKNOWN') AS region, time_bucket(INTERVAL '5 minutes', event_ts) AS window_start,
    time_bucket(INTERVAL '5 minutes', event_ts) + INTERVAL '5 minutes' AS window_end,
    count(*) AS ping_count, count(DISTINCT s.truck_id) AS truck_count
  FROM silver s LEFT JOIN dim USING (truck_id) GROUP BY ALL),
target AS (SELECT truck_id, capacity_lbs, region FROM dim WHERE k % 3 <> 0),
source AS (SELECT truck_id, CAST(capacity_lbs + 1 AS INT) AS capacity_lbs, upper(region) AS region FROM dim WHERE k % 3 <> 1)
"""

_POSITIONS = "truck_id, last_event_ts, latitude, longitude, make, model, capacity_lbs, home_depot, region, driver"
_ACTIVITY = "SELECT region, window_start, window_end, ping_count, truck_count FROM activity"
_COUNTS = """
  SELECT 'bronze_pings_raw' AS tbl, count(*) AS n FROM raw
  UNION ALL SELECT 'silver_pings', count(*) FROM silver
  UNION ALL SELECT 'silver_pings_quarantine', count(*) FROM {rejects}
  UNION ALL SELECT 'gold_truck_current_position', count(*) FROM position
  UNION ALL SELECT 'gold_region_activity_5m', count(*) FROM activity
"""

_SELECTS = {
    "silver_clean": "SELECT * FROM silver",
    "reject_reason_counts": "SELECT coalesce(reject_reason, 'clean') AS reject_reason, count(*) AS n FROM judged GROUP BY 1",
    "quarantine_rows": "SELECT * FROM rejects",
    "current_position": f"SELECT {_POSITIONS} FROM position",
    "current_position_geofenced": "SELECT truck_id, last_event_ts, in_geofence, geofence_name FROM position",
    "geofence_counts": "SELECT geofence_name, in_geofence, count(*) AS trucks FROM position GROUP BY ALL",
    "region_activity_5m": _ACTIVITY,
    "region_activity_recompute": _ACTIVITY,
    "capacity_tons": "SELECT truck_id, capacity_lbs, round(CAST(capacity_lbs AS DOUBLE) / CAST(2204.62 AS DOUBLE), 2) AS capacity_tons FROM dim",
    "merge_insert_only": "SELECT * FROM target UNION ALL SELECT * FROM source WHERE truck_id NOT IN (SELECT truck_id FROM target)",
    "merge_upsert": "SELECT * FROM source UNION ALL SELECT * FROM target WHERE truck_id NOT IN (SELECT truck_id FROM source)",
    "merge_sequence_guard": """
        , t AS (SELECT truck_id, event_ts AS last_event_ts, latitude, longitude FROM silver WHERE second(event_ts) < 40
          QUALIFY row_number() OVER (PARTITION BY truck_id ORDER BY event_ts DESC, latitude DESC, longitude DESC) = 1),
        s AS (SELECT truck_id, event_ts AS last_event_ts, latitude + 1 AS latitude, longitude FROM silver WHERE second(event_ts) >= 20
          QUALIFY row_number() OVER (PARTITION BY truck_id ORDER BY event_ts DESC, silver.latitude DESC, longitude DESC) = 1)
        SELECT truck_id, CASE WHEN newer THEN s.last_event_ts ELSE t.last_event_ts END AS last_event_ts,
          CASE WHEN newer THEN s.latitude ELSE t.latitude END AS latitude, CASE WHEN newer THEN s.longitude ELSE t.longitude END AS longitude
        FROM (SELECT coalesce(t.truck_id, s.truck_id) AS truck_id, t, s, t.truck_id IS NULL OR coalesce(s.last_event_ts >= t.last_event_ts, false) AS newer
          FROM t FULL JOIN s ON t.truck_id = s.truck_id)""",
    "merge_tolerant_columns": """
        SELECT coalesce(s.truck_id, t.truck_id) AS truck_id, coalesce(s.capacity_lbs, t.capacity_lbs) AS capacity_lbs, t.region
        FROM target t FULL JOIN source s ON t.truck_id = s.truck_id""",
    "dedup_ordered": """
        SELECT truck_id, event_date, event_ts, latitude, longitude FROM silver
        QUALIFY row_number() OVER (PARTITION BY truck_id, event_date ORDER BY event_ts DESC, latitude DESC, longitude DESC) = 1""",
    "dedup_any": "SELECT DISTINCT truck_id, event_ts_raw AS event_ts FROM raw WHERE event_ts_raw IS NOT NULL",
    "bronze_report": "SELECT count(*) AS bronze_rows, count(DISTINCT truck_id) AS trucks, min(event_ts_raw) AS first_ts, max(event_ts_raw) AS last_ts FROM raw",
    "medallion_counts": _COUNTS.format(rejects="rejects") + " UNION ALL SELECT 'truck_details', count(*) FROM dim",
    "dedup_proof": "SELECT (SELECT count(*) FROM raw) AS bronze_rows, (SELECT count(*) FROM silver) AS silver_rows, (SELECT count(DISTINCT ping_id) FROM silver) AS silver_distinct_keys, (SELECT count(*) FROM rejects) AS quarantined_rows",
    "latest_positions_top20": "SELECT truck_id, last_event_ts, round(latitude, 4) AS lat, round(longitude, 4) AS lon, make, model, driver, home_depot, region FROM position ORDER BY last_event_ts DESC, truck_id LIMIT 20",
    "activity_top20": f"{_ACTIVITY} ORDER BY window_start DESC, region LIMIT 20",
    "backfill_update": "SELECT truck_id, in_geofence, capacity_tons FROM position",
    "delete_by_key": "SELECT truck_id, last_event_ts FROM position WHERE truck_id NOT IN ('TRK-000001', 'TRK-000002', 'TRK-000005')",
    "drop_column": "SELECT truck_id, last_event_ts, latitude, longitude, capacity_lbs, home_depot AS depot, region FROM position",
    "restore_version": "SELECT truck_id, region FROM position",
    "change_feed": """
        , n AS (SELECT truck_id, region, CAST(substr(truck_id, 5, 6) AS INT) % 7 AS k FROM position)
        SELECT truck_id, CASE k WHEN 0 THEN 'moved' ELSE region END AS region, CASE k WHEN 0 THEN 'update' ELSE 'delete' END AS _change FROM n WHERE k < 2
        UNION ALL SELECT 'TRK-999999', 'new', 'insert'""",
    "stream_bronze_silver_gold": "SELECT tbl, CAST(n AS BIGINT) AS n FROM (" + _COUNTS.format(rejects="rejects") + " UNION ALL SELECT 'window_pings', count(*) FROM silver)",
    "late_data_window": _ACTIVITY,
    "late_data_position": f"SELECT {_POSITIONS}, in_geofence, geofence_name, capacity_tons FROM position",
    "dimension_refresh": "SELECT truck_id, last_event_ts, CASE WHEN last_event_ts >= TIMESTAMP '2024-01-16 00:00:00' THEN region || ' 2' ELSE region END AS region FROM position",
    "rescued_data": """
        SELECT event_id, CASE WHEN event_id % 11 <> 0 THEN 'T' || user_id END AS truck_id,
          CASE WHEN event_id % 11 <> 0 AND event_id % 7 <> 0 THEN CAST(event_id % 90 AS DOUBLE) END AS latitude,
          CASE WHEN event_id % 11 <> 0 THEN CAST(event_id AS VARCHAR) END AS event_ts,
          CASE WHEN event_id % 11 <> 0 AND event_id % 7 = 0 THEN 'abc' END AS rescued_latitude,
          CASE WHEN event_id % 11 <> 0 AND event_id % 5 = 0 THEN CAST(event_id % 50 AS VARCHAR) END AS rescued_speed,
          event_id % 11 = 0 AS corrupt
        FROM events""",
    "migration_ledger": "SELECT * FROM (VALUES ('001', '001_medallion_tables.sql', 6), ('002', '002_geofence.sql', 2), ('003', '003_capacity_tons.sql', 2)) v(version, filename, statements)",
    "catalog_columns": """
        SELECT * FROM (VALUES ('truck_id', 1, 'string', false), ('last_event_ts', 2, 'timestamp', true), ('latitude', 3, 'double', true),
          ('longitude', 4, 'double', true), ('make', 5, 'string', true), ('model', 6, 'string', true), ('capacity_lbs', 7, 'int', true),
          ('home_depot', 8, 'string', true), ('region', 9, 'string', true), ('driver', 10, 'string', true), ('_updated_at', 11, 'timestamp', true),
          ('in_geofence', 12, 'boolean', true), ('geofence_name', 13, 'string', true), ('capacity_tons', 14, 'double', true)
        ) v(column_name, ordinal_position, data_type, is_nullable)""",
    "sql_statements": """
        SELECT n_name AS depot, CAST(CASE WHEN n_nationkey BETWEEN 3 AND 7 THEN n_nationkey * 10 ELSE n_nationkey END AS BIGINT) AS trucks,
          CASE WHEN n_nationkey BETWEEN 3 AND 7 THEN 'it''s; new!' ELSE 'it''s; new' END AS note,
          CASE WHEN n_nationkey BETWEEN 3 AND 7 THEN n_nationkey * 10 ELSE n_nationkey END >= 40 AS big
        FROM nation WHERE n_name <> 'CHINA'""",
    "watermarked_activity": "SELECT time_bucket(INTERVAL '5 minutes', event_ts) AS window_start, count(*) AS ping_count FROM silver GROUP BY 1",
    "observed_schema": "SELECT * FROM (VALUES ('speed', 'BIGINT'), ('heading', 'BIGINT')) v(field, type)",
    "late_behind_watermark": "SELECT time_bucket(INTERVAL '5 minutes', event_ts) AS window_start, count(*) AS ping_count FROM silver WHERE event_ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY 1",
    "approx_trucks": "SELECT coalesce(region, 'UNKNOWN') AS region, count(DISTINCT s.truck_id) AS exact, true AS near FROM silver s LEFT JOIN dim USING (truck_id) GROUP BY 1",
    "file_lineage": "SELECT count(*) AS n, CAST(4 AS BIGINT) AS files, CAST(0 AS BIGINT) AS unequal FROM raw",
    "ingest_timestamp": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS outside, CAST(2 AS BIGINT) AS batches FROM raw",
    "in_memory_rows": "SELECT * FROM (VALUES ('Chicago', 'Midwest'), ('Dallas', 'South'), ('Denver', 'West'), ('Atlanta', 'Southeast')) v(depot, region)",
    "synthetic_pings": "SELECT CAST(i AS INT) AS file, true AS sized, CAST(1 AS BIGINT) AS doubled, CAST(1 AS BIGINT) AS without_latitude FROM range(5) r(i)",
    "seeded_dimension": "SELECT concat('TRK-', lpad(CAST(i AS VARCHAR), 3, '0')) AS truck_id, true AS known FROM range(1, 21) r(i)",
    "empty_batches": "SELECT t AS tbl, CAST(CASE WHEN t = 'truck_details' THEN (SELECT count(*) FROM dim) ELSE 0 END AS BIGINT) AS n FROM (VALUES ('bronze_pings_raw'), ('silver_pings'), ('silver_pings_quarantine'), ('truck_details'), ('gold_truck_current_position'), ('gold_region_activity_5m')) v(t)",
    "replayed_batches": "SELECT tbl, n, 3 AS failures FROM (" + _COUNTS.format(rejects="rejects") + " UNION ALL SELECT 'truck_details', count(*) FROM dim)",
    "migration_rerun": "SELECT v AS version, 'applied' AS first, 'applied' AS second, 'already applied' AS third, 14 AS columns FROM (VALUES ('001'), ('002'), ('003')) t(v)",
    "job_graph": """
        SELECT * FROM (VALUES ('setup', 0, 'migrate', 'done', true), ('setup', 1, 'seed', 'done', true), ('setup', 2, 'generate', 'done', true),
          ('medallion', 0, 'migrate', 'done', true), ('medallion', 1, 'bronze', 'done', true), ('medallion', 2, 'silver', 'done', true),
          ('medallion', 3, 'gold', 'done', true), ('medallion', 4, 'verify', 'done', true), ('medallion', 5, 'maintain', 'done', true),
          ('failing', 0, 'a', 'done', true), ('failing', 1, 'd', 'done', true), ('failing', 2, 'b', 'failed', true), ('failing', 3, 'c', 'skipped', true)
        ) v(job, place, task, state, stored)""",
}

ORACLE: dict[str, str] = {name: _BASE + sql for name, sql in _SELECTS.items()}
