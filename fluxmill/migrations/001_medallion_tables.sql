-- The pipeline's tables. Safe to run again: a table that is there stays as it is.
-- Fixed values: names, columns, types and order are the contract of the tables.

CREATE TABLE IF NOT EXISTS ${catalog}.${schema}.bronze_pings_raw (
  truck_id STRING COMMENT 'as landed',
  latitude DOUBLE, longitude DOUBLE,
  event_ts STRING COMMENT 'text of the instant, not parsed',
  _rescued_data STRING COMMENT 'JSON of what the other columns could not take',
  _source_file STRING, _ingested_at TIMESTAMP
) COMMENT 'Every landed line; nothing cast, nothing dropped.';

CREATE TABLE IF NOT EXISTS ${catalog}.${schema}.silver_pings (
  ping_id STRING NOT NULL COMMENT 'hash of truck and raw instant',
  truck_id STRING, event_ts TIMESTAMP, event_date DATE,
  latitude DOUBLE, longitude DOUBLE,
  event_ts_raw STRING, _source_file STRING, _ingested_at TIMESTAMP, _processed_at TIMESTAMP
) CLUSTER BY (truck_id, event_date) COMMENT 'Valid pings, one row for each key; rows only arrive.';

CREATE TABLE IF NOT EXISTS ${catalog}.${schema}.silver_pings_quarantine (
  reject_id STRING NOT NULL, truck_id STRING, event_ts_raw STRING,
  latitude DOUBLE, longitude DOUBLE,
  reject_reason STRING COMMENT 'the first rule that failed',
  _source_file STRING, _quarantined_at TIMESTAMP
) COMMENT 'Rows that broke a rule, kept to be looked at.';

CREATE TABLE IF NOT EXISTS ${catalog}.${schema}.truck_details (
  truck_id STRING NOT NULL, make STRING, model STRING, capacity_lbs INT,
  home_depot STRING, region STRING, driver STRING, _updated_at TIMESTAMP
) COMMENT 'The truck dimension.';

CREATE TABLE IF NOT EXISTS ${catalog}.${schema}.gold_truck_current_position (
  truck_id STRING NOT NULL, last_event_ts TIMESTAMP, latitude DOUBLE, longitude DOUBLE,
  make STRING, model STRING, capacity_lbs INT, home_depot STRING, region STRING, driver STRING,
  _updated_at TIMESTAMP
) CLUSTER BY (truck_id) COMMENT 'The newest ping of each truck, with its dimension row.';

CREATE TABLE IF NOT EXISTS ${catalog}.${schema}.gold_region_activity_5m (
  region STRING NOT NULL, window_start TIMESTAMP NOT NULL, window_end TIMESTAMP,
  ping_count BIGINT, truck_count BIGINT, _updated_at TIMESTAMP
) CLUSTER BY (region, window_start) COMMENT 'Pings and trucks per region and five minutes, recomputed rather than added to.';
