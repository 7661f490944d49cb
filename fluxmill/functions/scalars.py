"""Column expressions of the pipeline; all run inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fluxmill.config import Geofence

WINDOW = "5 minutes"
POUNDS_PER_TON = 2204.62
UNKNOWN = "UNKNOWN"


def parsed_timestamp(raw: str = "event_ts_raw") -> Column:
    """The instant a raw string names, or null (never an error)."""
    return F.col(raw).try_cast("timestamp")


def ping_id(truck: str = "truck_id", raw: str = "event_ts_raw") -> Column:
    """One hash for a truck at an instant, over the raw text of the instant."""
    return F.sha2(F.concat_ws("||", truck, raw), 256)


def reject_id(*columns: str) -> Column:
    """A fingerprint of a bad row: nulls count as empty text."""
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def blank(column: str) -> Column:
    """Null, or nothing but spaces."""
    return F.col(column).isNull() | (F.trim(column) == F.lit(""))


def outside(column: str, bound: float) -> Column:
    """Not within plus or minus ``bound``, ends included; not-a-number is outside."""
    return ~F.col(column).between(-bound, bound)


def in_geofence(fence: Geofence, latitude: str = "latitude", longitude: str = "longitude") -> Column:
    return F.col(latitude).between(fence.min_lat, fence.max_lat) & F.col(longitude).between(fence.min_lon, fence.max_lon)


def capacity_tons(pounds: str = "capacity_lbs") -> Column:
    """Metric tons to two places, in doubles throughout."""
    return F.round(F.col(pounds).cast("double") / F.lit(POUNDS_PER_TON), 2)


def region_or_unknown(region: str = "region") -> Column:
    return F.coalesce(F.col(region), F.lit(UNKNOWN))


def tumbling(ts: str = "event_ts", width: str = WINDOW) -> Column:
    """Epoch-aligned [start, end) windows."""
    return F.window(ts, width)
