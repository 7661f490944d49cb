-- Capacity in metric tons; rows written from here on get it from the writer.

ALTER TABLE ${catalog}.${schema}.gold_truck_current_position ADD COLUMNS (capacity_tons DOUBLE COMMENT 'from capacity_lbs');

UPDATE ${catalog}.${schema}.gold_truck_current_position
SET capacity_tons = round(CAST(capacity_lbs AS DOUBLE) / CAST(2204.62 AS DOUBLE), 2), _updated_at = current_timestamp()
WHERE capacity_tons IS NULL;
