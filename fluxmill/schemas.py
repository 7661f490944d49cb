"""Schemas of the medallion tables with their keys, as the contracts of the writers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {"STRING": T.StringType(), "DOUBLE": T.DoubleType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "DATE": T.DateType(), "TIMESTAMP": T.TimestampType()}


def ddl(text: str) -> T.StructType:
    """``name TYPE [NOT NULL], ...`` without a session."""
    columns = [c.split() for c in text.split(",")]
    return T.StructType([T.StructField(c[0], _TYPES[c[1]], c[2:] != ["NOT", "NULL"]) for c in columns])


@dataclass(frozen=True)
class TableSpec:
    name: str
    schema: T.StructType
    keys: tuple[str, ...] = ()
    sequence: str | None = None
    cluster: tuple[str, ...] = ()


#: The landing fields whose types are pinned; everything else is rescued.
HINTED = ddl("truck_id STRING, latitude DOUBLE, longitude DOUBLE, event_ts STRING")

BRONZE = TableSpec("bronze_pings_raw", ddl("truck_id STRING, latitude DOUBLE, longitude DOUBLE, event_ts STRING, _rescued_data STRING, _source_file STRING, _ingested_at TIMESTAMP"))
SILVER = TableSpec(
    "silver_pings",
    ddl("ping_id STRING NOT NULL, truck_id STRING, event_ts TIMESTAMP, event_date DATE, latitude DOUBLE, longitude DOUBLE, event_ts_raw STRING, _source_file STRING, _ingested_at TIMESTAMP, _processed_at TIMESTAMP"),
    ("ping_id",),
    "_ingested_at",
    ("truck_id", "event_date"),
)
QUARANTINE = TableSpec("silver_pings_quarantine", ddl("reject_id STRING NOT NULL, truck_id STRING, event_ts_raw STRING, latitude DOUBLE, longitude DOUBLE, reject_reason STRING, _source_file STRING, _quarantined_at TIMESTAMP"), ("reject_id",))
TRUCKS = TableSpec("truck_details", ddl("truck_id STRING NOT NULL, make STRING, model STRING, capacity_lbs INT, home_depot STRING, region STRING, driver STRING, _updated_at TIMESTAMP"), ("truck_id",))
POSITION = TableSpec(
    "gold_truck_current_position",
    ddl("truck_id STRING NOT NULL, last_event_ts TIMESTAMP, latitude DOUBLE, longitude DOUBLE, make STRING, model STRING, capacity_lbs INT, home_depot STRING, region STRING, driver STRING, _updated_at TIMESTAMP"),
    ("truck_id",),
    "last_event_ts",
    ("truck_id",),
)
ACTIVITY = TableSpec("gold_region_activity_5m", ddl("region STRING NOT NULL, window_start TIMESTAMP NOT NULL, window_end TIMESTAMP, ping_count BIGINT, truck_count BIGINT, _updated_at TIMESTAMP"), ("region", "window_start"), None, ("region", "window_start"))
LEDGER = TableSpec("schema_migrations", ddl("version STRING NOT NULL, filename STRING, checksum STRING, applied_at TIMESTAMP, applied_by STRING, statements INT"), ("version",))

SPECS = {s.name: s for s in (BRONZE, SILVER, QUARANTINE, TRUCKS, POSITION, ACTIVITY, LEDGER)}
