-- Whether the newest ping lies in the environment's geofence, with a backfill of rows that have no answer yet.

ALTER TABLE ${catalog}.${schema}.gold_truck_current_position ADD COLUMNS (
  in_geofence BOOLEAN COMMENT 'inside the box; false outside',
  geofence_name STRING COMMENT 'the box meant; it differs by environment'
);

UPDATE ${catalog}.${schema}.gold_truck_current_position
SET in_geofence = latitude BETWEEN ${geofence_min_lat} AND ${geofence_max_lat} AND longitude BETWEEN ${geofence_min_lon} AND ${geofence_max_lon},
    geofence_name = '${geofence_name}',
    _updated_at = current_timestamp()
WHERE in_geofence IS NULL;
